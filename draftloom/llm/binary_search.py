"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import as_table, drop_table

BITS, TOP = 64, 10


def sign_code(embedding: Column) -> Column:
    """64 bits as a long: bit i is set where component i is above 0. More than 64 components are an error; missing, null
    and NaN components give 0. Null embeddings give null."""
    one = F.lit(1).cast("long")
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        lambda i: F.when((F.get(embedding, i) > 0) & ~F.isnan(F.get(embedding, i)), F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("long")),
    )
    wide = F.raise_error(F.concat(F.lit(f"codes have {BITS} bits, the embedding has "), F.size(embedding).cast("string"), F.lit(" components"))).cast("long")
    return F.when(F.size(embedding) > BITS, wide).when(embedding.isNotNull(), F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def widths(segments: int) -> list[int]:
    """Bits of each segment: where their number doesn't divide ``BITS``, the first have one more."""
    return [BITS // segments + (s < BITS % segments) for s in range(segments)]


def _segments(code: Column, m: int) -> list[Column]:
    wide = widths(m)
    return [F.call_function("shiftrightunsigned", code, F.lit(sum(wide[:s]))).bitwiseAND(F.lit((1 << w) - 1)) for s, w in enumerate(wide)]


def expected_cost(codes: int, segments: int, k: int = TOP) -> float:
    """Probes of a query, and codes that they meet, in ``segments`` segments, for ``codes`` codes that are spread evenly.

    The k-th code is then about at the distance within which k of them lie, and rounds go on until that is covered: round r
    has C(width, r) probes a segment, the last round in as many segments as are left to cover, and a value of a segment has
    its share of the codes. Codes that lie closer need fewer rounds, whatever the segments.
    """
    near, within = 0, 0
    while near < BITS:
        within += math.comb(BITS, near)
        if codes * within >= k << BITS:
            break
        near += 1
    rounds = [near // segments + (s <= near % segments) for s in range(segments)]
    return sum(sum(math.comb(w, r) for r in range(n)) * (1 + codes / (1 << w)) for w, n in zip(widths(segments), rounds, strict=True))


def segments_for(codes: int, k: int = TOP) -> int:
    """The number of segments with the least expected cost. From 8 to 4 each number counts: halving it makes segments twice as
    wide at once, and probes grow with the power of the width."""
    return min((16, 8, 7, 6, 5, 4, 2), key=lambda m: (expected_cost(codes, m, k), m))


def flip_masks(spark: SparkSession, width: int, flips: int) -> DataFrame:
    """All masks of ``flips`` bits among ``width``, each bit above the one before; their number depends on the width alone."""
    out = spark.range(1).select(F.lit(0).cast("long").alias("mask"), F.lit(0).alias("above"))
    for n in range(flips):
        bit = F.explode(F.sequence(F.col("above"), F.lit(width - flips + n)))
        out = out.withColumn("bit", bit).select(F.col("mask").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("mask"), (F.col("bit") + 1).alias("above"))
    return out.select("mask")


def search(rows: DataFrame, queries: DataFrame, k: int = TOP, segments: int | None = None) -> DataFrame:
    """query_id, rank, id, distance: of each row of ``queries`` (id, code) the k rows of ``rows`` (id, code) at the smallest
    Hamming distance, ties by id. Exact.

    Codes are cut into m segments. Round r looks up, for each query that is still open and each segment, the values that
    differ from the query's in exactly r bits. After it every code at a distance below m * (r + 1) has been met, since it
    differs in r bits or fewer in some segment. A query is closed once it has k rows within that distance. A query whose k-th
    row so far is at distance b needs only the first b - m * r + 1 segments of the round: a code within b differs in r bits or fewer in one
    of them, or in fewer than r in some segment, which was met before. Equal codes
    are one index entry with its k smallest ids, so a code that very many rows share is met once. A code is counted at
    the first segment and round that meet it, and only if it is no further than the k-th row so far. Queries with equal codes are searched once.

    Null codes are neither found nor searched. Rows with equal ids are separate rows; with fewer than k rows all are
    returned. An empty side gives an empty result.
    """
    spark = rows.sparkSession
    known = rows.where("code is not null").select(F.col("id").cast("long").alias("id"), "code")
    per_code = Window.partitionBy("code").orderBy(F.col("id").asc_nulls_last())
    few = known.withColumn("n", F.row_number().over(per_code)).where(F.col("n") <= k)
    index = as_table(few.groupBy("code").agg(F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id"))).alias("ids")), "codes")
    m = segments or segments_for(index.count(), k)
    wide = widths(m)
    width = wide[0]
    # segment and value in one long: joins by one long are the leanest that Spark has
    joint = lambda segment, value: F.call_function("shiftleft", segment.cast("long"), F.lit(width)).bitwiseOR(value) if m > 2 else value * 2 + segment
    keys = index.select("code", "ids", F.posexplode(F.array(*_segments(F.col("code"), m))).alias("segment", "value"))
    keys = keys.select("code", "ids", "segment", joint(F.col("segment"), F.col("value")).alias("key"))
    keys = as_table(keys, "index")
    asked = queries.where("code is not null").select(F.col("id").cast("long").alias("query_id"), F.col("code").alias("q_code"))
    open_codes = as_table(asked.select("q_code").distinct().withColumn("bound", F.lit(BITS)), "open")
    best: DataFrame | None = None
    closed: list[DataFrame] = []
    order = Window.partitionBy("q_code").orderBy("distance", F.col("id").asc_nulls_last())
    for r in range(width + 1):
        masks = flip_masks(spark, width, r)
        near = open_codes.select("q_code", "bound", F.posexplode(F.array(*_segments(F.col("q_code"), m))).alias("q_segment", "q_key")).where(F.col("q_segment") <= F.col("bound") - m * r)
        # the masks are at most C(width, r) rows, whatever the input: they are broadcast where Spark finds them small
        fits = F.lit(True) if wide[-1] == width else (F.col("q_segment") < BITS % m) | (F.col("mask") < (1 << wide[-1]))
        probes = near.join(masks, fits).select("q_code", "bound", joint(F.col("q_segment"), F.col("q_key").bitwiseXOR(F.col("mask"))).alias("probe"))
        # Spark takes the exploded probes for small and would broadcast them; both sides grow with the input, so both are shuffled
        met = probes.hint("merge").join(keys, F.col("probe") == F.col("key"))
        differ = F.col("q_code").bitwiseXOR(F.col("code"))
        parts = [F.bit_count(part) for part in _segments(differ, m)]
        # nothing beyond the k-th distance so far can be among the k; both conditions are part of the join
        first = F.bit_count(differ) <= F.col("bound")
        for s in range(m):
            # no segment within fewer bits, and no earlier one within r: else the code was met there
            first &= F.when(F.lit(s) < F.col("segment"), parts[s] > r).otherwise(parts[s] >= r)
        fresh = met.where(first).select("q_code", F.bit_count(differ).alias("distance"), F.explode("ids").alias("e")).select("q_code", "distance", "e.id")
        every = fresh.unionByName(best) if best is not None else fresh
        now = as_table(every.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n"), "best")
        covered = m * (r + 1) - 1
        done = now.where(F.col("distance") <= covered).groupBy(F.col("q_code").alias("d_code")).agg(F.count("*").alias("c")).where(F.col("c") >= k)
        closed.append(now.join(done, F.col("q_code") == F.col("d_code"), "left_semi"))
        kth = now.groupBy(F.col("q_code").alias("b_code")).agg(F.count("*").alias("c"), F.max("distance").alias("kth")).where(F.col("c") >= k).select("b_code", "kth")
        still = open_codes.select("q_code").join(done, F.col("q_code") == F.col("d_code"), "left_anti")
        left = as_table(still.join(kth, F.col("q_code") == F.col("b_code"), "left").select("q_code", F.coalesce("kth", F.lit(BITS)).alias("bound")), "open")
        best = now.join(left.select(F.col("q_code").alias("l_code")), F.col("q_code") == F.col("l_code"), "left_semi")
        drop_table(open_codes)
        open_codes = left
        if left.isEmpty():
            break
    found = best
    for part in closed:
        found = found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("f_code").orderBy("distance", F.col("id").asc_nulls_last()))
    ranked = found.withColumnRenamed("q_code", "f_code").withColumn("rank", rank)
    return asked.join(ranked, F.col("q_code") == F.col("f_code")).select("query_id", "rank", "id", "distance")
