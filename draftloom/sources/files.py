"""Directory listings as tables: what a crawl sees, without reading any content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import casefold, nfkc, strip


def crawl(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = (), extensions: Sequence[str] = ("dxf", "pdf")) -> DataFrame:
    """(path, size, mtime) of the files below a folder; the content column is pruned, so files are only listed.

    ``include`` names folders directly below the root, compared without regard to width and case; files that lie in the root
    itself are then left out. ``exclude`` are parts of ``/path``. Without ``extensions`` all files are listed.
    """
    either = ",".join(x for e in extensions for x in (e.lower(), e.upper()))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{either}}}" if extensions else "*").load(root).select("path", "length", "modificationTime")
    lead = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.concat(F.lit("^\\Q"), lead, F.lit("\\E/*")), F.lit(""))
    rows = listed.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return rows.where(kept(F.col("path"), include, exclude))


def kept(path: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    fold = lambda c: casefold(strip(nfkc(c)))
    out = F.lit(True)
    if include:
        wanted = F.array(*[fold(F.lit(i)) for i in include])
        out &= F.contains(path, F.lit("/")) & F.array_contains(wanted, fold(F.split_part(path, F.lit("/"), F.lit(1))))
    for part in exclude:
        out &= ~F.contains(F.concat(F.lit("/"), path), F.lit(part))
    return out


def is_safe(path: Column) -> Column:
    """Whether a path stays below its root: relative, and without parent steps."""
    return ~F.startswith(path, F.lit("/")) & ~F.array_contains(F.split(path, "/"), "..")


def export_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for the capped lists that people open."""
    df.coalesce(1).write.option("header", True).mode("overwrite").csv(path)
