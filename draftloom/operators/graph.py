"""Components of links and chains of successors, in rounds whose number grows with the logarithm of the longest path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written


def components(links: DataFrame) -> DataFrame:
    """node, root: for every node of a link (u, v: longs) the smallest node of its component.

    Each round gives a node the smallest root among its neighbours', then that root's own root. Rounds are tables; they end
    when no root changes. Minima are aggregated before they are shuffled.
    """
    both = links.where("u <> v").select("u", "v")
    both = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    now = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("root")), "roots")
    while True:
        of = now.select(F.col("node").alias("n"), F.col("root").alias("r"))
        seen = both.join(of, F.col("v") == F.col("n")).groupBy(F.col("u").alias("s_node")).agg(F.min("r").alias("least"))
        lower = now.join(seen, F.col("node") == F.col("s_node")).select("node", F.col("root").alias("was"), F.least("root", "least").alias("to"))
        after = written(lower.join(of, F.col("to") == F.col("n")).select("node", "was", F.least("to", "r").alias("root")), "roots")
        if after.where("root <> was").isEmpty():
            return after.select("node", "root")
        now = after.select("node", "root")


def chain(successors: DataFrame, starts: DataFrame, group: Sequence[str], value: str, after: str) -> DataFrame:
    """(group, value): what can be reached from ``starts`` (group, value), one a group, by ``successors`` (group, value, after),
    one a value.

    Pointer doubling: a round adds to the first n of a chain the n after them, and makes each successor skip twice as many.
    """
    keys = list(group)
    kept = written(starts.select(*keys, value), "chain")
    skip = written(successors.where(F.col(after).isNotNull()).select(*keys, value, after), "skip")
    while True:
        more = written(kept.join(skip, [*keys, value]).select(*keys, F.col(after).alias(value)), "more")
        if more.isEmpty():
            return kept
        kept = written(kept.unionByName(more), "chain")
        ahead = skip.select(*keys, F.col(value).alias(after), F.col(after).alias("_next"))
        skip = written(skip.join(ahead, [*keys, after]).select(*keys, value, F.col("_next").alias(after)), "skip")
