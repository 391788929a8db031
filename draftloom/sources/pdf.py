"""Text layers and vector paths of pages, given as rows of characters and of path parts.

No PDF library is needed here: what reads the files delivers one row per character and per path part. Everything is windows,
joins and projections; a text run is one group of a window, a page one group of a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The gap at which characters are apart, how far before a character's end and above its base line a rule
# counts, in font sizes; how upright a rule is and how long, in page units.
GAP, RULE_SLACK = 0.6, 0.3
MAX_LEAN, MIN_LENGTH = 0.3, 0.5
#: Width of the bins of x in which characters meet rules.
BIN = 16.0
BLANK = r"(?U)[\s\x1c-\x1f]"


def vertical_rules(paths: DataFrame, page: Sequence[str]) -> DataFrame:
    """(page, x, low, high) of path parts: page, kind, x0, y0, x1, y1 (y downward) and the page's height.

    Lines (``l``) that are nearly upright, and both sides of rectangles (``re``). Parts of other kinds give nothing.
    """
    upright = (F.col("kind") == "l") & (F.abs(F.col("x0") - F.col("x1")) < MAX_LEAN) & (F.abs(F.col("y0") - F.col("y1")) > MIN_LENGTH)
    at = F.when(upright, F.array("x0")).when(F.col("kind") == "re", F.array("x0", "x1"))
    return paths.select(*page, F.explode(at).alias("x"), (F.col("height") - F.greatest("y0", "y1")).alias("low"), (F.col("height") - F.least("y0", "y1")).alias("high"))


def ruled_characters(chars: DataFrame, rules: DataFrame, page: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Keys of characters that a rule of their page separates from the one before. chars: page, key, before (where the one
    before ends), x0, x1, y, size. They meet in bins of x, so long rules of dense pages are not compared with all text."""
    low, high = F.col("before") - RULE_SLACK * F.col("size"), (F.col("x0") + F.col("x1")) / 2
    spans = chars.select(*page, *key, low.alias("lo"), high.alias("hi"), (F.col("y") + RULE_SLACK * F.col("size")).alias("at")).where("lo <= hi")
    binned = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / BIN), F.floor(F.col("hi") / BIN))))
    lines = rules.select(*[F.col(p).alias(f"r_{p}") for p in page], "x", "low", "high", F.floor(F.col("x") / BIN).alias("r_bin"))
    same = [F.col(p) == F.col(f"r_{p}") for p in page]
    met = binned.join(lines, [*same, F.col("bin") == F.col("r_bin"), F.col("x").between(F.col("lo"), F.col("hi")), F.col("at").between(F.col("low"), F.col("high"))], "left_semi")
    return met.select(*page, *key).distinct()


def text_pieces(chars: DataFrame, rules: DataFrame, page: Sequence[str], span: str) -> DataFrame:
    """(page, span, text, x, y, h): runs of text cut where characters are apart or a rule passes between them.

    chars: page, span, n (place in the span), c, x0, x1, y (base line, upward), size; rules: page, x, low, high. A piece starts
    at its first character that is no blank; pieces of blanks give nothing. Pages and spans are not null.
    """
    order = Window.partitionBy(*page, span).orderBy("n")
    gap = F.col("x0") - F.col("before")
    placed = chars.withColumn("before", F.lag("x1").over(order))
    near = placed.where(gap <= GAP * F.col("size"))
    ruled = ruled_characters(near, rules, page, [span, "n"]).withColumn("ruled", F.lit(True))
    cut = (F.coalesce(gap > GAP * F.col("size"), F.lit(False)) | F.coalesce("ruled", F.lit(False))).cast("int")
    joined = placed.join(ruled, [*page, span, "n"], "left")
    numbered = joined.withColumn("piece", F.sum(cut).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.when(~F.rlike("c", F.lit(f"^{BLANK}*$")), F.struct("n", "x0", "y", "size"))).alias("first")
    pieces = numbered.groupBy(*page, span, "piece").agg(first, F.sort_array(F.collect_list(F.struct("n", "c"))).alias("s")).where("first is not null")
    text = F.regexp_replace(F.array_join(F.transform("s", lambda p: p.c), ""), f"^{BLANK}+|{BLANK}+$", "")
    return pieces.select(*page, span, text.alias("text"), F.col("first.x0").alias("x"), F.col("first.y").alias("y"), F.col("first.size").alias("h"))
