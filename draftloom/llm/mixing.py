"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD

#: Most times that a mix takes a source.
MAX_REPEATS = 3
#: Weights of the sources in code point order, repeating.
CYCLE = (1, 2, 3)
#: Relative weight over training time 0..1, by the source's weight: (time, height) knots joined by lines. Heights may rise
#: or fall; only their integral, made 1, scales the source's demand.
QUERY_SCHEDULES = {1: ((0.0, 1.5), (1.0, 0.5)), 2: ((0.0, 1.0), (1.0, 1.0)), 3: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))}
#: Running sums of a source are taken in this many parts (three hex digits), so that no source is one task's work.
HASH_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, and the hash that fixes the order of a source's documents."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))).cast("binary")).alias("hash"),
        F.xxhash64("text").alias("tie"),
    )


def source_targets(parts: DataFrame, cycle: Sequence[int] = CYCLE, repeats: int = MAX_REPEATS) -> DataFrame:
    """From (source, size) rows: source, source_size, weight, target.

    All sizes are shared by weight. Sources in order of how soon they reach ``repeats`` times their size: one is cut to
    that if its share of what the ones before it leave is above it. This is where resharing the excess ends. The windows
    run over one row per source.
    """
    by_source = parts.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(int(w)) for w in cycle])
    weighed = by_source.withColumn("weight", F.element_at(weights, (place % len(cycle) + 1).cast("int")).cast("long"))
    soon = [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*soon).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*soon).rowsBetween(0, Window.unboundedFollowing)
    cap = F.lit(repeats) * F.col("source_size")
    left = (
        weighed.withColumn("left", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(onward))
        .withColumn("cut", F.col("weight") * F.col("left") > cap * F.col("rest"))
    )
    # the first source that is not cut fixes the share a unit of weight for it and all after it
    first = F.first(F.when(~F.col("cut"), F.struct("left", "rest")), ignorenulls=True).over(Window.orderBy(*soon).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    share = left.withColumn("unit", first)
    target = F.when(F.col("cut"), cap.cast("double")).otherwise((F.col("weight") * F.col("unit.left")).cast("double") / F.col("unit.rest").cast("double"))
    return share.select("source", "source_size", "weight", target.alias("target"))


def training_time(done: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of the schedule, made 1 at its end, reaches ``done``: each line between knots has a
    quadratic integral, which is solved for the time."""
    areas = [(t1 - t0) * (h0 + h1) / 2 for (t0, h0), (t1, h1) in zip(knots, knots[1:], strict=False)]
    whole = sum(areas)
    if whole <= 0 or min(h for _, h in knots) < 0:
        raise ValueError("a schedule needs heights of 0 or more and a positive integral")
    need = done * whole
    out, start = F.lit(float(knots[-1][0])), whole
    for (t0, h0), (t1, h1), area in reversed(list(zip(knots, knots[1:], areas, strict=False))):
        start -= area
        slope, rest = (h1 - h0) / (t1 - t0), F.greatest(need - F.lit(start), F.lit(0.0))
        # t of h0 t + slope t^2 / 2 = rest, in the form that also holds for slope 0
        root = 2 * rest / (F.lit(h0) + F.sqrt(F.greatest(F.lit(h0 * h0) + 2 * F.lit(slope) * rest, F.lit(0.0))))
        here = F.least(F.lit(t0) + F.when(rest > 0, root).otherwise(F.lit(0.0)), F.lit(float(t1)))
        out = F.when(need < F.lit(start + area), here).otherwise(out)
    return out


def mix(docs: DataFrame, cycle: Sequence[int] = CYCLE, repeats: int = MAX_REPEATS, schedules: Mapping[int, Sequence[tuple[float, float]]] = QUERY_SCHEDULES) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies, position.

    A source is taken whole as often as its target holds its size; the rest goes to a prefix of its documents in the
    order of a hash of id and text, whose last document counts in part, so that taken sums to the target, rounded.
    ``copies`` are whole documents: a part of half or more counts, and any part of a source's first document, so that no
    source with a goal goes without. ``position`` is the training time from 0 to 1 of the
    document's first copy: the place of its words in the source's demand, put through the inverse of the integral of
    the source's schedule (``done`` is that place as a share of the demand). Null when nothing is taken. Null and empty
    texts have size 0 and are never taken; a very long text is one document, taken in part where the target ends in it; null
    sources are one source; rows with null or repeated ids are kept apart; reruns give the same rows. Other columns are
    dropped. A source whose documents are all empty has target 0.
    """
    parts = sized(docs).withColumn("part", F.substring("hash", 1, HASH_DIGITS))
    totals = parts.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    targets = source_targets(totals.select("source", F.col("part_size").alias("size")), cycle, repeats)
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "part", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("offset"))
    t = targets.select(F.col("source").alias("t_source"), "source_size", "weight", "target")
    plan = offsets.join(t, F.col("source").eqNullSafe(F.col("t_source"))).select(F.col("source").alias("p_source"), F.col("part").alias("p_part"), "offset", "source_size", "weight", "target")
    inside = Window.partitionBy("source", "part").orderBy("hash", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        parts.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part")))
        .withColumn("start", F.col("offset") + F.col("within"))
    )
    goal = F.floor(F.col("target") + 0.5)
    full = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0))
    rest = goal - F.col("full") * F.col("source_size")
    counted = placed.withColumn("full", full.cast("long")).withColumn("part_taken", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start"))).cast("long"))
    taken = F.col("full") * F.col("size") + F.col("part_taken")
    one_more = (2 * F.col("part_taken") >= F.col("size")) | ((F.col("full") + F.col("start") == 0) & (F.col("part_taken") > 0))
    copies = F.when(F.col("size") > 0, F.col("full") + one_more.cast("long")).otherwise(F.lit(0))
    done = F.try_divide(F.col("start"), F.col("target"))
    position = scheduled_time(done, F.col("weight"), schedules)
    return counted.select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken"), copies.cast("long").alias("copies"),
        F.when(taken > 0, position).alias("position"), "weight", done.alias("done"), "tie",
    )


def scheduled_time(done: Column, weight: Column, schedules: Mapping[int, Sequence[tuple[float, float]]]) -> Column:
    """:func:`training_time` by the schedule of the source's weight; null for a weight without one."""
    out = F.lit(None).cast("double")
    for key, knots in sorted(schedules.items()):
        out = F.when(weight == key, training_time(done, knots)).otherwise(out)
    return out


def by_position(plan: DataFrame) -> DataFrame:
    """The rows of :func:`mix`, range-partitioned and sorted by training position; what is not taken comes last."""
    order = [F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_first(), F.col("tie").asc_nulls_first()]
    return plan.repartitionByRange(*order).sortWithinPartitions(*order)


def materialize(docs: DataFrame, plan: DataFrame, schedules: Mapping[int, Sequence[tuple[float, float]]] = QUERY_SCHEDULES) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``plan`` has copies of it, by training position.

    Copy k of a document stands k source lengths further along the source's demand; the rows are range-partitioned and
    sorted by position. Identical rows share out the copies of all of them. Columns are those of ``docs``.
    """
    mine = {c: f"in_{k}" for k, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in mine.items()], F.xxhash64("text").alias("k_tie"), F.col("doc_id").cast("long").alias("k_id"), F.col("source").cast("string").alias("k_source"))
    asked = plan.groupBy("doc_id", "source", "tie").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"), F.min("done").alias("done"), F.first("weight").alias("weight"), F.first(F.try_divide(F.col("source_size"), F.col("target"))).alias("lap")).where("copies > 0")
    joined = renamed.join(asked, F.col("k_id").eqNullSafe(F.col("doc_id")) & F.col("k_source").eqNullSafe(F.col("source")) & (F.col("k_tie") == F.col("tie")))
    # of identical rows, which are few of all, the first ones have one copy more where the sum is not even
    place = F.row_number().over(Window.partitionBy("k_id", "k_source", "k_tie").orderBy("k_id")).cast("long")
    alone, several = joined.where("rows = 1").withColumn("place", F.lit(1).cast("long")), joined.where("rows > 1").withColumn("place", place)
    share = F.floor((F.col("copies") - F.col("place")) / F.col("rows")).cast("int")
    each_copy = alone.unionByName(several).where("copies >= place").withColumn("copy", F.explode(F.sequence(F.lit(0), share)))
    rows = each_copy.withColumn("position", scheduled_time(F.least(F.col("done") + F.col("copy") * F.col("lap"), F.lit(1.0)), F.col("weight"), schedules))
    ordered = rows.repartitionByRange(F.col("position"), F.col("k_id"), F.col("k_tie")).sortWithinPartitions("position", "k_id", "k_tie")
    return ordered.select(*[F.col(n).alias(c) for c, n in mine.items()])
