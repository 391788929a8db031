"""Bulk actions of administrators: each is an update of a table by the rows that were chosen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ingest import last_wins


def _marked(df: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with whether a row was chosen; keys that are chosen twice count once."""
    marks = chosen.select(*keys).distinct().withColumn("chosen", F.lit(True))
    return df.join(marks, list(keys), "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


def approve(dictionary: DataFrame, chosen: DataFrame, keys: Sequence[str] = ("term", "canonical")) -> DataFrame:
    """Chosen terms are approved; others stay as they are."""
    return _marked(dictionary, chosen, keys).withColumn("approved", F.col("chosen") | F.col("approved")).select(*dictionary.columns)


def reset(jobs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen jobs are queued anew, without attempts and error, whatever their state."""
    anew = {"state": F.lit("queued"), "attempts": F.lit(0), "error": F.lit("")}
    kinds = dict(jobs.dtypes)
    updates = {c: F.when(F.col("chosen"), v.cast(kinds[c])).otherwise(F.col(c)) for c, v in anew.items()}
    return _marked(jobs, chosen, ["id"]).withColumns(updates).select(*jobs.columns)


def fix_type(drawings: DataFrame, edits: DataFrame) -> DataFrame:
    """Types set by hand (edits: id, doc_type, at; the last one counts). A type that changes is locked against later rules."""
    last = last_wins(edits.select("id", F.col("doc_type").alias("new_type"), "at"), "id", [F.col("at")]).drop("at")
    changes = F.col("new_type").isNotNull() & ~F.col("new_type").eqNullSafe(F.col("doc_type"))
    edited = drawings.join(last, "id", "left").withColumn("doc_type_fixed", changes | F.col("doc_type_fixed"))
    return edited.withColumn("doc_type", F.coalesce("new_type", "doc_type")).select(*drawings.columns)
