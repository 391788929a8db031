"""Ruling lines of page bitmaps, from rows of dark pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written
from .geometry import dark_runs
from .graph import components

#: Columns that a rule may leave out, and the least length of a stroke of a rule in millimetres.
NEAR, LEAST_MM = 2, 3.0
MM_PER_INCH = 25.4


def ruling_lines(pixels: DataFrame, page: Sequence[str], column: str, row: str, dark: Column, least: int, near: int = NEAR) -> DataFrame:
    """(page, x, first, last, n_strokes): vertical rules of bitmaps given as pixels, rows counted from the top.

    A rule is a component of strokes, runs of at least ``least`` dark pixels in a column, where strokes of columns at most
    ``near`` apart whose rows overlap touch; so a tilted rule, which moves on by a column now and then, is one. x is the middle of its
    columns. Strokes of one column are apart, so each meets few of the next; pages are dealt over the cluster by column.
    """
    strokes = dark_runs(pixels, [*page, column], row, dark, least).select(*page, column, "first", "last").withColumn("id", F.monotonically_increasing_id())
    strokes = written(strokes, "strokes")
    ahead = strokes.select(*[F.col(p).alias(f"_{p}") for p in page], F.col(column).alias("_column"), F.col("first").alias("_first"), F.col("last").alias("_last"), F.col("id").alias("v"))
    behind = strokes.withColumn("_to", F.explode(F.sequence(F.col(column) + 1, F.col(column) + near)))
    same = (F.col("_to") == F.col("_column")) & (F.col("first") <= F.col("_last")) & (F.col("_first") <= F.col("last"))
    for p in page:
        same &= F.col(p).eqNullSafe(F.col(f"_{p}"))
    roots = components(behind.join(ahead, same).select(F.col("id").alias("u"), "v"))
    whole = strokes.join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    middle = (F.min(column) + F.max(column) + 1) / 2
    return whole.groupBy(*page, "root").agg(middle.alias("x"), F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("n_strokes")).drop("root")


def lone_ones(pixels: DataFrame, cell: Sequence[str], column: str, row: str, dark: Column, height: Column, tall: float = 0.25, ruled: float = 0.95, thin: float = 0.2) -> DataFrame:
    """(cell, x): cells whose only mark is tall and thin, like a handwritten one. ``height``: rows of the cell's bitmap.

    Columns that are dark almost all the way are rules and no marks; columns at most 2 apart are one mark. A mark counts if it
    spans a quarter of the cell; there must be one alone, at most a fifth as wide as it is tall, and 2 more.
    """
    by_column = pixels.where(dark).groupBy(*cell, column).agg(F.count("*").alias("n"), F.min(row).alias("first"), F.max(row).alias("last"), F.first(height).alias("rows"))
    marks = by_column.where(F.col("n") <= ruled * F.col("rows"))
    order = Window.partitionBy(*cell).orderBy(column)
    new = F.coalesce(F.col(column) - F.lag(column).over(order) > 2, F.lit(True)).cast("int")
    numbered = marks.withColumn("_new", new).withColumn("_mark", F.sum("_new").over(order))
    shapes = numbered.groupBy(*cell, "_mark").agg((F.max(column) - F.min(column) + 1).alias("wide"), (F.max("last") - F.min("first") + 1).alias("high"), F.avg(column).alias("x"), F.max("rows").alias("rows"))
    found = shapes.where(F.col("high") >= tall * F.col("rows")).groupBy(*cell).agg(F.count("*").alias("n"), F.max("wide").alias("wide"), F.max("high").alias("high"), F.max("x").alias("x"))
    return found.where((F.col("n") == 1) & (F.col("wide") <= thin * F.col("high") + 2)).select(*cell, "x")
