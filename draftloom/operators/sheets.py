"""Frames of print sheets, from the entities of a drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How level a line has to be, and how far apart two upright ones are to enclose something.
LEVEL, APART = 0.01, 1e-6
LINES = ("LINE", "LWPOLYLINE", "POLYLINE")


def frame_candidates(entities: DataFrame, key: str) -> DataFrame:
    """(key, w, h, x0, y0, x1, y1, origin): rectangles that may be a drawing's frame. entities: key, kind, closed, points (array of
    x, y in drawing order; of an INSERT the corners of what it shows).

    Three kinds: the extent of an INSERT, as frames often are blocks; a polyline that has 4 or 5 points, the first again when it is
    closed; and what the two longest level segments, and the two longest upright ones, of all lines enclose, if there are two of both.
    Longest by length, then by place. A drawing's segments are ranked, never gathered.
    """
    drawn = entities.where(F.col("kind").isin("INSERT", *LINES) & (F.size("points") > 0))
    ring = F.when((F.col("kind") != "LINE") & F.col("closed") & (F.col("kind") != "INSERT"), F.concat("points", F.slice("points", 1, 1))).otherwise(F.col("points"))
    drawn = drawn.select(key, "kind", ring.alias("points"))
    x, y = F.transform("points", lambda p: p.x), F.transform("points", lambda p: p.y)
    whole = (F.col("kind") == "INSERT") | (F.col("kind").isin("LWPOLYLINE", "POLYLINE") & F.size("points").isin(4, 5))
    boxes = drawn.where(whole).select(key, F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"), F.when(F.col("kind") == "INSERT", "block").otherwise("polyline").alias("origin"))
    pairs = F.arrays_zip(F.slice("points", F.lit(1), F.size("points") - 1).alias("a"), F.slice("points", F.lit(2), F.size("points") - 1).alias("b"))
    cut = drawn.where(F.col("kind").isin(*LINES) & (F.size("points") > 1)).select(key, F.explode(pairs).alias("s")).select(key, "s.a", "s.b")
    dx, dy = F.abs(F.col("b.x") - F.col("a.x")), F.abs(F.col("b.y") - F.col("a.y"))
    level, upright = (dy < LEVEL) & (dx > 0), (dx < LEVEL) & (dy > 0)
    lines = cut.where(level | upright).select(
        key, F.when(level, "level").otherwise("upright").alias("way"), F.when(level, dx).otherwise(dy).alias("size"),
        F.when(level, F.least("a.x", "b.x")).otherwise(F.least("a.y", "b.y")).alias("lo"), F.when(level, F.greatest("a.x", "b.x")).otherwise(F.greatest("a.y", "b.y")).alias("hi"),
        F.when(level, F.col("a.y")).otherwise(F.col("a.x")).alias("at"),
    )
    place = F.row_number().over(Window.partitionBy(key, "way").orderBy(F.desc("size"), F.desc("lo"), F.desc("hi"), F.desc("at")))
    two = lines.withColumn("place", place).where("place <= 2").groupBy(key, "way").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("at").alias("first"), F.max("at").alias("last")).where("n = 2")
    both = two.withColumn("ways", F.count("*").over(Window.partitionBy(key))).where("ways = 2").where((F.col("way") == "level") | (F.col("last") - F.col("first") > APART))
    is_level = F.col("way") == "level"
    enclosed = both.select(
        key, F.when(is_level, F.col("lo")).otherwise(F.col("first")).alias("x0"), F.when(is_level, F.col("first")).otherwise(F.col("lo")).alias("y0"),
        F.when(is_level, F.col("hi")).otherwise(F.col("last")).alias("x1"), F.when(is_level, F.col("last")).otherwise(F.col("hi")).alias("y1"), F.col("way").alias("origin"),
    )
    found = boxes.unionByName(enclosed)
    return found.select(key, (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), "x0", "y0", "x1", "y1", "origin")


def extents(entities: DataFrame, key: str) -> DataFrame:
    """(key, w, h) of all that a drawing shows."""
    p = entities.select(key, F.explode("points").alias("p"))
    return p.groupBy(key).agg((F.max("p.x") - F.min("p.x")).alias("w"), (F.max("p.y") - F.min("p.y")).alias("h"))
