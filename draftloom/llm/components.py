"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_table, drop_table


def _lowest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("u").alias("m_u")).agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root: for every node of an edge (u, v) the smallest node of its component.

    Null ends and loops are ignored, repeated edges count once. A round links each node's larger neighbours, then its
    smaller ones, to the smallest it knows; minima are pre-aggregated, and neighbours meet them in a join that Spark can
    split, so a node with very many neighbours is no single task's work. The number of rounds grows with the logarithm
    of the largest component; a count and a checksum of the edges end the loop. Rounds are tables in the shared folder.
    """
    flat = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    now = as_table(flat, "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both).withColumn("m", F.least("m_u", "m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("m_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(_lowest(large), F.col("u") == F.col("m_u"))
        links = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        after = as_table(links, "edges")
        was, mark = mark, _mark(after)
        drop_table(now)
        now = after
        if mark == was:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
