"""Collapsing to files, list order, paging, trees and counts by path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_SIZE, MAX_CHILDREN = 50, 300


def collapse(df: DataFrame, key: str, page: Column, code: Column, *others: Column) -> DataFrame:
    """One row per file: first_page, hits, key_no (smallest code that is not blank, null when none), and more aggregates."""
    return df.groupBy(key).agg(F.min(page).alias("first_page"), F.count("*").alias("hits"), F.min(F.when(code != "", code)).alias("key_no"), *others)


def page_of(total: Column, page: int, size: int = PAGE_SIZE) -> Column:
    """The page number, clamped to the pages that there are."""
    return F.least(F.lit(max(page, 1)), F.greatest(F.ceil(total / size), F.lit(1)))


def page_rows(df: DataFrame, order: Sequence[Column], page: int, size: int = PAGE_SIZE) -> DataFrame:
    """A page in the order, out-of-range pages give the last: adds pos (from 0) and total.

    Only the first ``page * size`` rows can be asked for, so they are taken with a distributed top-k; a page beyond the
    end is found by the count, and is then the tail.
    """
    size_of = df.agg(F.count("*").alias("total"))
    top = df.orderBy(*order).limit(page * size)
    placed = top.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("bigint") - 1)
    start = (page_of(F.col("total"), page, size) - 1) * size
    return placed.join(size_of, F.lit(True)).where((F.col("pos") >= start) & (F.col("pos") < start + size))


def neighbours(df: DataFrame, partition: Sequence[str], order: Sequence[Column], item: str) -> DataFrame:
    """Adds prev, next, pos (from 1) and total of each item within its list."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumns({
        "prev": F.lag(item).over(w), "next": F.lead(item).over(w), "pos": F.row_number().over(w).cast("bigint"),
        "total": F.count("*").over(Window.partitionBy(*partition)),
    })


def page_numbers(current: int, last: int) -> list[int | None]:
    """First, last, and two around the current page; None stands for a gap."""
    shown = sorted({n for n in (1, last, *range(current - 2, current + 3)) if 1 <= n <= last})
    out: list[int | None] = []
    for n in shown:
        if out and n != out[-1] + 1:
            out.append(None)
        out.append(n)
    return out


def segments(path: Column) -> Column:
    """The parts of a path, without blank ones."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def crumbs(path: Column) -> Column:
    """All prefixes of a path, shortest first."""
    parts = segments(path)
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def folder_children(df: DataFrame, path: Column, prefix: str | Column) -> DataFrame:
    """Counts by the next segment below a prefix, a name or a column; files that lie directly in it are not children."""
    trimmed = F.trim(prefix if isinstance(prefix, Column) else F.lit(prefix), F.lit("/"))
    lead = F.when(trimmed == "", "").otherwise(F.concat(trimmed, F.lit("/")))
    rest = F.substring(path, F.length(lead) + 1, F.length(path))
    inside = df.where(F.startswith(path, lead) & F.contains(rest, F.lit("/")))
    return inside.groupBy(F.split_part(rest, F.lit("/"), F.lit(1)).alias("label")).agg(F.count("*").alias("n"))


def prefix_rollup(df: DataFrame, path: Column, depth: int) -> DataFrame:
    """Each row counted at every prefix up to ``depth`` segments."""
    each = F.explode(F.slice(crumbs(path), 1, depth))
    return df.select(each.alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n")).withColumn("depth", F.size(F.split("prefix", "/")))


def natural_key(text: Column) -> Column:
    """Sort key in which runs of digits compare as numbers and stand before text."""
    runs = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(runs, lambda r: F.struct(F.when(r.rlike(r"^\d"), 0).otherwise(1).alias("kind"), F.coalesce(r.try_cast("decimal(38,0)"), F.lit(0)).alias("number"), F.lower(r).alias("text")))


def capped_children(counts: DataFrame, parent: str, label: str, selected: Sequence[str] | Column = (), cap: int = MAX_CHILDREN) -> DataFrame:
    """Per parent the first ``cap`` labels and the selected ones (names, or a condition), then a row ``(more)`` with how many are not shown."""
    place = F.row_number().over(Window.partitionBy(parent).orderBy(natural_key(F.col(label)), label))
    ranked = counts.withColumn("place", place)
    chosen = selected if isinstance(selected, Column) else F.col(label).isin(*selected)
    shown = (F.col("place") <= cap) | F.coalesce(chosen, F.lit(False))
    rest = ranked.where(~shown).groupBy(parent).agg(F.count("*").alias("n")).select(parent, F.lit("(more)").alias(label), "n")
    return ranked.where(shown).select(parent, label, "n").unionByName(rest)


def top_groups(df: DataFrame, outer: str, inner: str, n_outer: int, n_inner: int) -> DataFrame:
    """The largest groups, each with its largest subgroups; ties by name."""
    counts = df.groupBy(outer, inner).agg(F.count("*").alias("n_inner"))
    totals = counts.groupBy(F.col(outer).alias("o")).agg(F.sum("n_inner").alias("n_outer")).orderBy(F.desc("n_outer"), "o").limit(n_outer)
    ranked = counts.join(totals, F.col(outer) == F.col("o")).withColumn("place", F.row_number().over(Window.partitionBy(outer).orderBy(F.desc("n_inner"), inner)))
    return ranked.where(F.col("place") <= n_inner).select(outer, "n_outer", inner, "n_inner", "place")


def heading_changes(df: DataFrame, order: Sequence[Column], heading: str, partition: Sequence[str] = ()) -> DataFrame:
    """Adds new_heading: whether a row's heading differs from the one before it in the list."""
    was = F.lag(heading).over(Window.partitionBy(*partition).orderBy(*order))
    return df.withColumn("new_heading", ~was.eqNullSafe(F.col(heading)))
