"""Near copies by similarity: documents whose five-word shingles have a Jaccard similarity of 0.8 or more, and their components.

SimHash fingerprints of the same shingles, linked by :func:`simhash.links`, give the first candidates. Pairs at 0.8 differ in up
to 17 of 64 bits, where segments of a ring select nothing; so the others meet under bands of :mod:`minmax`. Whole sets decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minmax, simhash
from .shared import as_table, drop_table, drop_uses, release_shuffles

SHINGLE = 5


def _by_fingerprint(found: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets, as a table: those of one fingerprint with its lowest, and the lowest of linked fingerprints."""
    sets = found.where("n > 0").select("fp", "sid").distinct()
    of = as_table(sets.groupBy("fp").agg(F.min("sid").alias("low")), "of-fingerprint")
    same = sets.join(of, "fp").select(F.col("sid").alias("u"), F.col("low").alias("v"))
    linked = simhash.links(of)
    of_u, of_v = of.select(F.col("fp").alias("u"), F.col("low").alias("u_low")), of.select(F.col("fp").alias("v"), F.col("low").alias("v_low"))
    across = linked.join(of_u, "u").join(of_v, "v").select(F.col("u_low").alias("u"), F.col("v_low").alias("v"))
    pairs = as_table(same.unionByName(across).where("u <> v"), "pairs")
    drop_uses(linked)
    drop_table(of)
    return pairs


def group(docs: DataFrame) -> DataFrame:
    """doc_id, tie, root (a set of the component) for every row of ``docs``.

    Complete but for what :func:`minmax.similar_sets` states: whole sets decide, and a pair is missed with a probability of 5 in
    10^8 at a similarity of 0.8, less above. Null and empty texts and texts without words are one group. Repeated rows stay; very
    long texts are read whole; other columns are dropped; an empty table gives an empty result.
    """
    found = as_table(minmax.prints(docs, SHINGLE, simhash.vote), "prints")
    first = _by_fingerprint(found)
    roots = minmax.similar_sets(docs, found, SHINGLE, first).select(F.col("sid").alias("r_sid"), "root")
    drop_table(first)
    out = as_table(found.join(roots, F.col("sid") == F.col("r_sid"), "left").select("doc_id", "tie", F.coalesce("root", "sid").alias("root")), "groups")
    drop_table(found)
    release_shuffles(docs.sparkSession)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of which one document of each group stays: the smallest doc_id (null
    last), then by text; of identical rows one. Null and very long texts as in :func:`group`."""
    return simhash.keep_lowest(docs, group(docs))
