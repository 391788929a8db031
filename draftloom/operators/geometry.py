"""Clustering, intervals, bands and votes over positioned items, as windows and range joins.

Everything is partitioned by a group (a drawing, a page), so groups are spread over the cluster; a group is the items of
one page, which are few.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import dealt, written
from .graph import chain

#: Gaps between boundaries that one window looks at.
CELL = 256
#: Numbers that a batch of fits holds at once.
FIT_CELLS = 1 << 21


def islands(df: DataFrame, group: Sequence[str], order: Sequence[Column], starts: Column, name: str = "island") -> DataFrame:
    """Number the runs of rows in an order: a row for which ``starts`` holds begins a new one. ``starts`` may use lag()."""
    w = Window.partitionBy(*group).orderBy(*order)
    flagged = df.withColumn(f"{name}_starts", F.coalesce(starts, F.lit(True)).cast("int"))
    return flagged.withColumn(name, F.sum(f"{name}_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop(f"{name}_starts")


def gap_islands(df: DataFrame, group: Sequence[str], value: str, ties: Sequence[str], gap: Column, descending: bool = False, name: str = "island") -> DataFrame:
    """Chain clustering: a value further than ``gap`` from the one before it in order starts a new cluster."""
    order = [F.desc(value) if descending else F.asc(value), *[F.asc(t) for t in ties]]
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(*order))
    return islands(df, group, order, F.abs(F.col(value) - before) > gap, name)


def text_lines(items: DataFrame, group: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Items (y upward, h) in lines from the top: a step of more than 0.55 median heights begins the next."""
    tall = items.withColumn("median_h", F.median("h").over(Window.partitionBy(*group)))
    return gap_islands(tall, group, "y", ties, 0.55 * F.col("median_h"), descending=True, name="line").drop("median_h")


def merge_cells(items: DataFrame, line: Sequence[str]) -> DataFrame:
    """Items (x, x1, h, text) of a line joined to cells: a gap of 1.2 heights from all that came before, or two numbers side
    by side, keep cells apart; a gap of more than 0.6 heights puts a blank between texts."""
    w = Window.partitionBy(*line).orderBy("x", "x1", "text")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("x") - reach
    numeric = lambda c: c.rlike(r"^[\d.,]+$")
    both = numeric(F.col("text")) & numeric(F.lag("text").over(w))
    split = islands(items.withColumn("gap", gap), line, [F.col("x"), F.col("x1"), F.col("text")], (gap >= 1.2 * F.col("h")) | both, "cell")
    piece = F.concat(F.when(F.col("gap") > 0.6 * F.col("h"), " ").otherwise(""), F.col("text"))
    rows = split.groupBy(*line, "cell").agg(F.min("x").alias("x"), F.max("x1").alias("x1"), F.sort_array(F.collect_list(F.struct("x", "x1", piece.alias("t")))).alias("s"))
    return rows.select(*line, "cell", "x", "x1", F.ltrim(F.array_join(F.transform("s", lambda p: p.t), "")).alias("text"))


def merge_intervals(df: DataFrame, group: Sequence[str], start: str, end: str, gap: Column) -> DataFrame:
    """Intervals joined where one starts within ``gap`` of all before it: group, start, end, n."""
    w = Window.partitionBy(*group).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = islands(df, group, [F.col(start), F.col(end)], F.col(start) > reach + gap, "run")
    return runs.groupBy(*group, "run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("run")


def boundaries(df: DataFrame, group: Sequence[str], value: str, gap: float) -> DataFrame:
    """(group, value): of each group's values, in order, those further than ``gap`` from the last one kept, the first one included.

    Each value's next is the least value beyond the gap; what is kept is the chain from the first value. The next one is looked
    for in cells of ``CELL`` gaps, each a window of its own, and else is the first of the next cells, so a large group is many
    tasks' work; its chain is followed by doubling.
    """
    keys = list(group)
    values = written(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v")).distinct(), "values")
    cell = lambda c: F.floor(c / (gap * CELL))
    target = F.col("v") + gap
    asked = values.select(*keys, cell(target).alias("cell"), target.alias("at"), F.lit(0).alias("kind"), "v", F.lit(None).cast("double").alias("w"))
    there = values.select(*keys, cell(F.col("v")).alias("cell"), F.col("v").alias("at"), F.lit(1).alias("kind"), "v", F.col("v").cast("double").alias("w"))
    # from above, a value is seen by what stands strictly below it
    seen = Window.partitionBy(*keys, "cell").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    inside = asked.unionByName(there).withColumn("next", F.last("w", ignorenulls=True).over(seen)).where("kind = 0").select(*keys, "v", F.col("cell").alias("t_cell"), "next")
    cells = values.groupBy(*keys, cell(F.col("v")).alias("cell")).agg(F.min("v").alias("low"))
    along = Window.partitionBy(*keys).orderBy("cell")
    later = cells.select(*keys, "cell", *[F.lead(c, n).over(along).alias(f"{c}_{n}") for c in ("cell", "low") for n in (1, 2)])
    placed = inside.withColumn("cell", cell(F.col("v"))).join(later, [*keys, "cell"])
    beyond = F.when(F.col("cell_1") > F.col("t_cell"), F.col("low_1")).otherwise(F.col("low_2"))
    successors = placed.select(*keys, "v", F.coalesce("next", beyond).alias("next"))
    return chain(successors, values.groupBy(*keys).agg(F.min("v").alias("v")), keys, "v", "next").select(*keys, F.col("v").alias(value))


def tolerance_mode(df: DataFrame, group: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Per group the value with most values within the tolerance of it; ties give the smaller. A range frame counts the
    neighbours, so no pairs are made."""
    near = F.count("*").over(Window.partitionBy(*group).orderBy(value).rangeBetween(-tolerance, tolerance))
    counted = df.withColumn("near", near)
    best = F.max(F.struct("near", (-F.col(value)).alias("v"))).alias("s")
    return counted.groupBy(*group).agg(best).select(*group, (-F.col("s.v")).alias("mode"), F.col("s.near").alias("votes"))


def contained(points: DataFrame, spans: DataFrame, at: Column, prefer: Sequence[Column], point_key: Sequence[str], on: Sequence[str] = ()) -> DataFrame:
    """Points with the span [lo, hi) that holds them; of several the first by ``prefer``. Spans of a group are few, so the
    range is a condition on an equi-join by group, or on a broadcast of them."""
    condition = (at >= F.col("lo")) & (at < F.col("hi"))
    joined = points.join(spans, list(on)).where(condition) if on else points.join(spans, condition)
    place = F.row_number().over(Window.partitionBy(*point_key).orderBy(*prefer))
    return joined.withColumn("place", place).where("place = 1").drop("place")


def nearest(left: DataFrame, right: DataFrame, on: Sequence[str], distance: Column, eligible: Column, key: Sequence[str], value: Column, ties: Sequence[Column]) -> DataFrame:
    """For each row of ``left`` the eligible row of ``right`` at the smallest distance, ties in order: key, value, distance."""
    # both sides may be exploded from a small table, which looks small to Spark: neither is broadcast
    pairs = left.join(right.hint("merge"), list(on)).where(eligible)
    return pairs.groupBy(*key).agg(F.min(F.struct(distance.alias("d"), *[t.alias(f"t{n}") for n, t in enumerate(ties)], value.alias("value"))).alias("s")).select(*key, "s.value", F.col("s.d").alias("distance"))


def label_values(items: DataFrame, group: Sequence[str], is_label: Column, is_word: Column) -> DataFrame:
    """Labels of a title block with the text beside or below them. items: id, text, x, y, h.

    Right of the label: up to 25 heights away and within 0.8 heights up or down; below: 0.3 to 4 heights lower, from 2 left
    to 12 right. The smallest |dx| + 3 |dy| counts. Labels and printed words of the form are no values.
    """
    labels = items.where(is_label).select(*group, F.col("id").alias("l_id"), F.col("text").alias("label"), F.col("x").alias("lx"), F.col("y").alias("ly"), F.greatest("h", F.lit(1e-6)).alias("lh"))
    values = items.where(~is_label & ~is_word).select(*group, "id", "text", "x", "y")
    dx, dy, h = F.col("x") - F.col("lx"), F.col("y") - F.col("ly"), F.col("lh")
    right = (dx > 0) & (dx < 25 * h) & (F.abs(dy) < 0.8 * h)
    below = (dy > -4 * h) & (dy < -0.3 * h) & (dx > -2 * h) & (dx < 12 * h)
    return nearest(labels, values, group, F.abs(dx) + 3 * F.abs(dy), right | below, [*group, "l_id", "label"], F.col("text"), [F.col("id")])


def outside_boxes(points: DataFrame, boxes: DataFrame, on: Sequence[str]) -> DataFrame:
    """Points (px, py) that lie in no box (x0, y0, x1, y1) of their group."""
    inside = (points.px >= boxes.x0) & (points.px <= boxes.x1) & (points.py >= boxes.y0) & (points.py <= boxes.y1)
    for c in on:
        inside &= points[c] == boxes[c]
    return points.join(boxes, inside, "left_anti")


def fit_line(df: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Least squares of y on x per group: slope, intercept, n."""
    return df.groupBy(*group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))


def vote_offset(df: DataFrame, group: Sequence[str], number: Column, position: Column, least: int = 2) -> DataFrame:
    """Per group the offset between printed numbers and positions with most votes, ties nearest 1; 1 with too few votes."""
    votes = df.withColumn("k", (number - position).cast("long")).where("k is not null").groupBy(*group, "k").agg(F.count("*").alias("votes"))
    best = F.max(F.struct("votes", (-F.abs(F.col("k") - 1)).alias("near"), "k")).alias("s")
    return votes.groupBy(*group).agg(best).select(*group, F.when(F.col("s.votes") >= least, F.col("s.k")).otherwise(F.lit(1)).alias("shift"), F.col("s.votes").alias("votes"))


def template_fits(lines: DataFrame, group: Sequence[str], edges: Sequence[float], unit: tuple[int, int], ratio: float = 0.04, tolerance: float = 5.0, least: int = 8) -> DataFrame:
    """Where a printed form lies among vertical lines (x): group, shift, scale, hits of the best fit.

    Two lines as far apart as the two ``unit`` edges of the form, within the ratio, place it; each edge then looks for its
    nearest line. The fit with most edges met wins, ties by the smaller error; below ``least`` there is none. Pairs are of
    the lines of one group, and only those at about the right distance are kept.
    """
    wide = edges[unit[1]] - edges[unit[0]]
    # lines that were exploded from a small table look small to Spark, but grow with it: they are never broadcast
    a, b = lines.select(*group, F.col("x").alias("xa")), lines.select(*group, F.col("x").alias("xb"))
    pairs = a.join(b.hint("merge"), list(group)).where((F.col("xb") - F.col("xa")).between(wide * (1 - ratio), wide * (1 + ratio)))
    placed = pairs.withColumn("scale", (F.col("xb") - F.col("xa")) / wide).withColumn("shift", F.col("xa") - F.col("scale") * edges[unit[0]])
    want = placed.withColumn("edge", F.explode(F.array(*map(F.lit, edges)))).withColumn("target", F.col("shift") + F.col("scale") * F.col("edge"))
    error = want.join(lines.hint("merge"), list(group)).groupBy(*group, "xa", "xb", "scale", "shift", "edge").agg(F.min(F.abs(F.col("x") - F.col("target"))).alias("error"))
    fits = error.groupBy(*group, "xa", "xb", "scale", "shift").agg(F.count_if(F.col("error") <= tolerance).alias("hits"), F.sum(F.least("error", F.lit(tolerance))).alias("total"))
    best = F.max(F.struct("hits", (-F.round("total", 6)).alias("e"), (-F.col("xa")).alias("a"), "shift", "scale")).alias("s")
    return fits.groupBy(*group).agg(best).select(*group, F.round("s.shift", 4).alias("shift"), F.round("s.scale", 6).alias("scale"), F.col("s.hits").alias("hits")).where(F.col("hits") >= least)


def list_fits(tables: DataFrame, lines: str, edges: Sequence[float], unit: tuple[int, int], ratio: float = 0.04, tolerance: float = 5.0) -> DataFrame:
    """The best fits of :func:`template_fits`, as shift, scale and hits beside the other columns, where the lines of a group are a sorted
    list in one row: no pair is a row. Groups without two lines that place the form have no row."""
    rest = [c for c in tables.columns if c != lines]
    kinds = dict(tables.dtypes)
    wide, form = edges[unit[1]] - edges[unit[0]], np.array(edges)

    def best(x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
        # x: a group a row, filled up by infinity; of: its lines
        with np.errstate(invalid="ignore"):
            apart = x[:, None, :] - x[:, :, None]
        g, a, b = np.nonzero((apart >= wide * (1 - ratio)) & (apart <= wide * (1 + ratio)))
        scale = (x[g, b] - x[g, a]) / wide
        shift = x[g, a] - scale * edges[unit[0]]
        hits, total = np.zeros(len(g), np.int64), np.zeros(len(g))
        step = max(1, FIT_CELLS // (len(form) * x.shape[1]))
        for n in range(0, len(g), step):
            some = slice(n, n + step)
            targets = shift[some, None] + scale[some, None] * form
            error = np.abs(x[g[some], None, :] - targets[:, :, None]).min(axis=2)
            hits[some], total[some] = (error <= tolerance).sum(axis=1), np.minimum(error, tolerance).sum(axis=1)
        order = np.lexsort((scale, shift, -x[g, a], -np.round(total, 6), hits, g))
        last = order[np.flatnonzero(np.append(np.diff(g[order]) > 0, True))] if len(order) else order
        return of[g[last]], shift[last], scale[last], hits[last]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(lines))
            sizes, values = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            found = []
            # groups of about one number of lines together, as many as fit
            order = np.argsort(sizes, kind="stable")
            order = order[sizes[order] > 1]
            while len(order):
                most = sizes[order[-1]]
                some = order[-max(1, FIT_CELLS // int(most) ** 2) :]
                order = order[: len(order) - len(some)]
                at = np.arange(most)
                inside = at < sizes[some, None]
                x = np.where(inside, values[np.where(inside, starts[some, None] + at, 0)], np.inf)
                found.append(best(x, some))
            of, shift, scale, hits = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64))
            taken = [batch.column(c).take(pa.array(of, pa.int64())) for c in rest]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(shift), pa.array(scale), pa.array(hits)], [*rest, "shift", "scale", "hits"])

    return tables.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], "shift double, scale double, hits long"]))


def dark_runs(pixels: DataFrame, column: Sequence[str], at: str, dark: Column, least: int) -> DataFrame:
    """Vertical strokes of a bitmap: runs of at least ``least`` dark pixels per column, first to last."""
    marked = pixels.where(dark)
    gone = F.col(at) - F.row_number().over(Window.partitionBy(*column).orderBy(at))
    runs = marked.withColumn("run", gone).groupBy(*column, "run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).drop("run")


# Landscape paper sizes in millimetres, and how much smaller or larger a frame may be.
PAPERS = [("A4", 297.0, 210.0), ("A3", 420.0, 297.0), ("A2", 594.0, 420.0), ("A1", 841.0, 594.0), ("A0", 1189.0, 841.0)]
SMALLER, LARGER = 0.13, 0.01


def paper_fit(rects: DataFrame, key: str, scale: Column) -> DataFrame:
    """(key, paper, portrait, factor): the sheet that a drawing's frames belong to. rects: key, w, h.

    A frame at factor 1 or the drawing's scale fits a paper if it is at most 13 % smaller and 1 % larger in both
    directions. The largest frame wins, factor 1 first. Papers and factors are a dozen combinations, so this expands rows
    by a constant.
    """
    options = F.array(*[F.struct(F.lit(n).alias("paper"), F.lit(a).alias("pw"), F.lit(b).alias("ph"), F.lit(p).alias("portrait")) for n, w, h in PAPERS for a, b, p in ((w, h, False), (h, w, True))])
    tried = rects.withColumn("factor", F.explode(F.array_distinct(F.array(F.lit(1.0), F.coalesce(scale, F.lit(1.0))))))
    sized = tried.withColumn("o", F.explode(options)).select(key, "factor", "o.*", (F.col("w") / F.col("factor")).alias("fw"), (F.col("h") / F.col("factor")).alias("fh"))
    fits = sized.where(F.col("fw").between(F.col("pw") * (1 - SMALLER), F.col("pw") * (1 + LARGER)) & F.col("fh").between(F.col("ph") * (1 - SMALLER), F.col("ph") * (1 + LARGER)))
    best = F.max(F.struct((F.col("factor") == 1).alias("one"), (F.col("fw") * F.col("fh")).alias("area"), "paper", "portrait", "factor")).alias("s")
    return fits.groupBy(key).agg(best).select(key, "s.paper", "s.portrait", "s.factor")


def title_block_region(items: DataFrame, width: Column, height: Column) -> DataFrame:
    """Items of the lower right corner, where title blocks stand."""
    return items.where((F.col("x") >= 0.55 * width) & (F.col("y") <= 0.22 * height))


def is_page_set(pages: DataFrame, key: str, has_code: Column) -> DataFrame:
    """Files of which at least two pages and half of all have a code: each page is a drawing of its own."""
    counts = pages.groupBy(key).agg(F.count("*").alias("n_pages"), F.count_if(has_code).alias("n_coded"))
    return counts.withColumn("page_set", (F.col("n_coded") >= 2) & (2 * F.col("n_coded") >= F.col("n_pages")))


def sheet_of(drawings: DataFrame, key: str, rects: DataFrame, scale: Column) -> DataFrame:
    """(key, paper, portrait, factor, exact): the fitting frame's paper; without one the smallest paper that holds the whole
    drawing (w, h), first at factor 1, then at its scale; else A3 with the factor that shrinks it to fit.

    drawings: key, w, h; rects: key, w, h. Papers are a constant few, so no join grows with the input.
    """
    whole = drawings.withColumn("f_scale", F.coalesce(scale, F.lit(1.0)))
    framed = paper_fit(rects.unionByName(drawings.select(*rects.columns)), key, scale).select(F.col(key).alias("p_key"), F.struct("paper", "portrait", "factor").alias("frame"))
    tall = F.col("w") < F.col("h")
    long, short = F.greatest("w", "h"), F.least("w", "h")

    def holds(f: Column) -> Column:
        return F.coalesce(*[F.when((long / f <= w) & (short / f <= h), F.lit(n)) for n, w, h in PAPERS])

    at_one, at_scale = holds(F.lit(1.0)), holds(F.col("f_scale"))
    named = lambda p, f: F.struct(p.alias("paper"), tall.alias("portrait"), f.alias("factor"))
    shrunk = F.greatest(long / 420.0, short / 297.0)
    found = F.coalesce("frame", F.when(at_one.isNotNull(), named(at_one, F.lit(1.0))), F.when(at_scale.isNotNull(), named(at_scale, F.col("f_scale"))))
    out = whole.join(framed, F.col(key) == F.col("p_key"), "left").withColumn("sheet", F.coalesce(found, named(F.lit(""), shrunk)))
    return out.select(key, "sheet.paper", "sheet.portrait", "sheet.factor", (F.col("sheet.paper") != "").alias("exact"))


def quantity_regions(rows: DataFrame, group: Sequence[str], spans: DataFrame) -> DataFrame:
    """(group, x0, x1, h, y): where a table's quantity cells are, for reading them again.

    rows: y, h of each row; spans: lo, hi, column of the table. Rows are evenly spaced, so their heights are put on the line
    fitted through them if its slope is within a tenth of the median gap; the text height is at most gap / 1.8.
    """
    region = spans.where(F.col("column").rlike(r"^qty\d*$")).groupBy(*group).agg(F.min("lo").alias("x0"), F.max("hi").alias("x1"))
    # all is windows over one order, so a task sorts its rows once; regions are dealt as the rows are
    n_rows = rows.count()
    rows, region = dealt(rows, group, n_rows), dealt(region, group, n_rows)
    order = Window.partitionBy(*group).orderBy("y")
    whole = Window.partitionBy(*group)
    gaps = rows.withColumn("gap", F.col("y") - F.lag("y").over(order)).withColumn("first", F.min("y").over(whole))
    spaced = gaps.withColumn("pitch", F.median(F.when(F.col("gap") > 0.5 * F.col("h"), F.col("gap"))).over(whole))
    placed = spaced.withColumn("k", F.round((F.col("y") - F.col("first")) / F.col("pitch")))
    # k grows with y: it is distinct in all rows if each is above the one before
    above = F.count_if(F.col("k").isNotNull() & (F.col("k_before").isNull() | (F.col("k") > F.col("k_before")))).over(whole)
    fit = placed.withColumn("k_before", F.lag("k").over(order)).withColumns({"slope": F.regr_slope("y", "k").over(whole), "at": F.regr_intercept("y", "k").over(whole), "n": F.count("*").over(whole), "m": above})
    joined = fit.join(region.hint("merge"), list(group))
    even = F.coalesce((F.col("n") >= 3) & (F.col("m") == F.col("n")) & F.col("slope").between(0.9 * F.col("pitch"), 1.1 * F.col("pitch")), F.lit(False))
    pitch = F.when(even, F.col("slope")).otherwise(F.col("pitch"))
    height = F.when(F.col("n") >= 3, F.least(F.col("h"), pitch / 1.8)).otherwise(F.col("h"))
    return joined.select(*group, "x0", "x1", height.alias("h"), F.when(even, F.col("at") + F.col("slope") * F.col("k")).otherwise(F.col("y")).alias("y"))


def better_reading(first: DataFrame, again: DataFrame, key: str, filled: Column, enough: float = 0.8) -> DataFrame:
    """Rows of the second reading for tables whose first has quantities in less than ``enough`` of its rows, if the second has
    as many rows and more quantities; else those of the first."""
    score = lambda df, n: df.groupBy(F.col(key).alias(f"{n}_key")).agg(F.count("*").alias(f"{n}_rows"), F.count_if(filled).alias(f"{n}_filled"))
    a, b = score(first, "a"), score(again, "b")
    better = (F.col("a_filled") < enough * F.col("a_rows")) & (F.col("b_rows") >= F.col("a_rows")) & (F.col("b_filled") > F.col("a_filled"))
    chosen = a.join(b, F.col("a_key") == F.col("b_key")).where(better).select(F.col("a_key").alias("c_key"))
    return first.join(chosen, F.col(key) == F.col("c_key"), "left_anti").unionByName(again.join(chosen, F.col(key) == F.col("c_key"), "left_semi"))


def reading_order(items: DataFrame, partition: Sequence[str]) -> DataFrame:
    """Adds place: from the top, by the upper edge rounded to tens, then from the left."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy(*partition).orderBy(F.desc(F.round(F.col("y") + F.col("h"), -1)), "x", "id")))
