"""Roll-ups, quality counters and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .browse import crumbs

LIST_CHARS, WORST_ROWS = 1000, 3
EXPORT_DRAWINGS, LOW_CONFIDENCE = 5000, 0.8


def percent(part: Column, whole: Column) -> Column:
    """``NN%`` rounded half to even, ``-`` where there is nothing."""
    return F.when(whole > 0, F.concat(F.regexp_replace(F.format_number(part / whole * 100, 0), ",", ""), F.lit("%"))).otherwise("-")


def parts_rollup(rows: DataFrame) -> DataFrame:
    """(key, name, ref, material, n_drawings, qty, drawings): where parts are used.

    rows: drawing, row, order_code, part_no, name, qty, ref, material. The key is the part number, or the name without
    one; name, ref and material are those of the first row by code, drawing and row; a total of 0 is shown as null; the
    sorted list of drawings is cut to LIST_CHARS characters. Only as many drawings of a part are listed as the cut can show.
    """
    keyed = rows.withColumn("key", F.when(F.col("part_no") != "", F.col("part_no")).otherwise(F.col("name"))).where("key <> ''")
    order = F.struct("order_code", "drawing", "row")
    per_drawing = keyed.groupBy("key", "drawing").agg(F.sum(F.coalesce("qty", F.lit(0))).alias("qty"), F.min(F.struct(order.alias("o"), "name", "ref", "material")).alias("first"))
    out = per_drawing.groupBy("key").agg(F.count("*").alias("n_drawings"), F.sum("qty").alias("qty"), F.min("first").alias("first"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("drawing"))
    shown = per_drawing.select("key", "drawing").withColumn("place", place).where(F.col("place") <= LIST_CHARS // 2 + 1)
    lists = shown.groupBy(F.col("key").alias("l_key")).agg(F.sort_array(F.collect_list("drawing")).alias("list"))
    return out.join(lists, F.col("key") == F.col("l_key")).select(
        "key", "first.name", "first.ref", "first.material", "n_drawings", F.when(F.col("qty") != 0, F.col("qty")).alias("qty"),
        F.substring(F.array_join("list", ", "), 1, LIST_CHARS).alias("drawings"),
    )


def export_rows(drawings: DataFrame, rows: DataFrame) -> DataFrame:
    """The detail sheet: rows of the first EXPORT_DRAWINGS drawings that have any, by drawing number, drawing and row.

    drawings: id, drawing_no, title, model; rows: drawing, row, item_no, confidence; more stay. A row without an item number
    shows its place; rows of low confidence are flagged.
    """
    listed = drawings.join(rows.select("drawing"), F.col("id") == F.col("drawing"), "left_semi").orderBy("drawing_no", "id").limit(EXPORT_DRAWINGS)
    item = F.coalesce(F.nullif("item_no", F.lit("")), F.col("row").cast("string"))
    shown = listed.join(rows, F.col("id") == F.col("drawing")).withColumns({
        "item_no": item, "model": F.when(F.col("model") == "_", "").otherwise(F.col("model")),
        "is_low": F.col("confidence") < LOW_CONFIDENCE, "confidence": F.round("confidence", 2),
    })
    return shown.drop("drawing").orderBy("drawing_no", "id", "row")


def quality_counters(rows: DataFrame, kind: str, part: Column, good: Column, name: Column, qty: Column, ref: Column, found: Column, drawing: str) -> DataFrame:
    """Counts per kind of rows, filled fields, well-formed parts, references, resolved references and drawings."""
    counts = {"n_part": part != "", "n_good": (part != "") & good, "n_name": name != "", "n_qty": qty.isNotNull(), "n_ref": ref != "", "n_found": (ref != "") & found}
    return rows.groupBy(kind).agg(F.count("*").alias("n_rows"), *[F.count_if(c).alias(n) for n, c in counts.items()], F.count_distinct(drawing).alias("n_drawings"))


def fill_bands(rows: DataFrame, key: str, filled: Column) -> DataFrame:
    """How many keys have all, at least 0.8, some, or none of their rows filled."""
    ratio = F.count_if(filled) / F.count("*")
    per = rows.groupBy(key).agg(ratio.alias("ratio"))
    band = F.when(F.col("ratio") >= 0.999, "all").when(F.col("ratio") >= 0.8, "most").when(F.col("ratio") > 0, "some").otherwise("none")
    return per.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def folder_fill(rows: DataFrame, folder: Column, key: str, filled: Column, top: int = 25) -> DataFrame:
    """Rows, filled rows and keys per folder, the folders with most rows first."""
    per = rows.groupBy(folder.alias("folder"), key).agg(F.count("*").alias("r"), F.count_if(filled).alias("f"))
    out = per.groupBy("folder").agg(F.sum("r").alias("n_rows"), F.sum("f").alias("n_filled"), F.count("*").alias("n_keys"))
    return out.orderBy(F.desc("n_rows"), "folder").limit(top)


def worst(rows: DataFrame, key: str, bad: Column, no_name: Column, n: int) -> DataFrame:
    """Keys with at least WORST_ROWS rows, by the share of bad rows, of rows without a name, rows and key, all descending."""
    per = rows.groupBy(key).agg(F.count("*").alias("n_rows"), (F.count_if(bad) / F.count("*")).alias("bad_ratio"), (F.count_if(no_name) / F.count("*")).alias("no_name_ratio"))
    return per.where(F.col("n_rows") >= WORST_ROWS).orderBy(F.desc("bad_ratio"), F.desc("no_name_ratio"), F.desc("n_rows"), F.desc(key)).limit(n)


def worst_missing(rows: DataFrame, key: str, filled: Column, n: int) -> DataFrame:
    """Keys with at least WORST_ROWS rows, by how many rows are not filled, their share, rows and key, all descending."""
    per = rows.groupBy(key).agg(F.count("*").alias("n_rows"), F.count_if(~F.coalesce(filled, F.lit(False))).alias("n_missing"))
    share = 1 - (F.col("n_rows") - F.col("n_missing")) / F.col("n_rows")
    return per.where(F.col("n_rows") >= WORST_ROWS).withColumn("missing_ratio", share).orderBy(F.desc("n_missing"), F.desc("missing_ratio"), F.desc("n_rows"), F.desc(key)).limit(n)


def failure_summary(failed: DataFrame, error: Column, at: Column, top: int = 8) -> DataFrame:
    """Failures by the first line of the error, cut to 80 characters; the most frequent first, ties by text."""
    line = F.when(F.coalesce(error, F.lit("")) == "", "(none)").otherwise(F.substring(F.split_part(error, F.lit("\n"), F.lit(1)), 1, 80))
    return failed.groupBy(line.alias("error")).agg(F.count("*").alias("n"), F.max(at).alias("latest")).orderBy(F.desc("n"), "error").limit(top)


def transitions(df: DataFrame, before: Column, after: Column) -> DataFrame:
    """Counts by class before and after a change of rules."""
    return df.groupBy(before.alias("before"), after.alias("after")).agg(F.count("*").alias("n"))


def transition_totals(df: DataFrame, before: Column, after: Column, public: Column) -> DataFrame:
    """One row: how many rows there are, change their class, and become of the public class or stop being of it. ``public``
    is a class."""
    gone, come = (before == public) & (after != public), (before != public) & (after == public)
    return df.agg(F.count("*").alias("n"), F.count_if(~before.eqNullSafe(after)).alias("n_changed"), F.count_if(come).alias("n_published"), F.count_if(gone).alias("n_withdrawn"))


def drilldown(df: DataFrame, kind: str, reason: Column, example: str, k: int) -> DataFrame:
    """(kind, total, reason, n, examples) with the first k examples of each reason, in order.

    The head of a reason is its text before a full-width parenthesis. The examples are the k smallest, found with a rank
    that Spark limits before the shuffle.
    """
    tagged = df.select(kind, F.split_part(reason, F.lit("（"), F.lit(1)).alias("reason"), example)
    counts = tagged.groupBy(kind, "reason").agg(F.count("*").alias("n"))
    totals = counts.groupBy(F.col(kind).alias("t_kind")).agg(F.sum("n").alias("total"))
    first = tagged.withColumn("place", F.row_number().over(Window.partitionBy(kind, "reason").orderBy(example))).where(F.col("place") <= k)
    lists = first.groupBy(F.col(kind).alias("l_kind"), F.col("reason").alias("l_reason")).agg(F.array_join(F.sort_array(F.collect_list(example)).cast("array<string>"), ", ").alias("examples"))
    joined = counts.join(totals, F.col(kind) == F.col("t_kind")).join(lists, (F.col(kind) == F.col("l_kind")) & (F.col("reason") == F.col("l_reason")))
    return joined.select(kind, "total", "reason", "n", "examples")


def kind_folders(df: DataFrame, kind: str, path: Column, depth: int = 3, top: int = 15) -> DataFrame:
    """(kind, folder, n): the folders of each kind with most files, ties by name, files counted at most ``depth`` levels deep; blank for
    files that lie in no folder."""
    parts = F.split(path, "/")
    folder = F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(depth), F.size(parts) - 1)), "/")
    counts = df.groupBy(kind, folder.alias("folder")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(kind).orderBy(F.desc("n"), "folder"))
    return counts.withColumn("place", place).where(F.col("place") <= top).drop("place")


def extension_histogram(df: DataFrame, folder: Column, kind: Column, kinds: list[str], size: Column | None = None) -> DataFrame:
    """Counts per folder, a column for each kind, and with sizes their sums."""
    sums = [] if size is None else [*[F.sum(F.when(kind == k, size).otherwise(0)).alias(f"bytes_{k}") for k in kinds], F.sum(size).alias("bytes_all")]
    return df.groupBy(folder.alias("folder")).agg(*[F.count_if(kind == k).alias(f"n_{k}") for k in kinds], F.count("*").alias("n_all"), *sums)


def group_stats(df: DataFrame, path: Column, depth: int) -> DataFrame:
    return df.select(F.explode(F.slice(crumbs(path), 1, depth)).alias("prefix")).groupBy("prefix").count()


def first_texts(pages: DataFrame, key: str, page: str, text: str, n: int = 3, chars: int = 3000) -> DataFrame:
    """(key, body): the first n pages of a key, each cut, joined by line breaks."""
    first = pages.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(page))).where(F.col("place") <= n)
    cut = first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", F.substring(text, 1, chars).alias("t")))).alias("s"))
    return cut.select(key, F.array_join(F.transform("s", lambda x: x.t), "\n").alias("body"))


def confidence(filled: list[Column], numbered: Column) -> Column:
    """0.5, plus 0.1 for each filled field and a number, at most 1."""
    score = F.lit(0.5) + sum((F.when(c, 0.1).otherwise(0.0) for c in filled), F.when(numbered, 0.1).otherwise(0.0))
    return F.round(F.least(score, F.lit(1.0)), 2)
