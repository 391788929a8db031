"""Title-block fields from attributes, labels beside values and file names, and which of them counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm, norm_keep_case
from ..tables import dealt, written
from . import geometry

FIELDS = ("drawing_no", "revision", "title", "model", "material", "scale", "drawn_date", "sheet_title", "sheet_no", "job_no", "file_title")
# Attribute tags and printed labels of each field, printed words that are no values, words of part tables.
FIELD_TAGS = {
    "drawing_no": ["図番", "DWG_NO", "DWGNO", "DRAWING_NO", "DRAWINGNO", "ZUBAN", "DWG.NO"],
    "revision": ["REV", "REVISION", "改訂", "版", "差替"],
    "title": ["品名", "名称", "図名", "件名", "NAME"],
    "sheet_title": ["TITLE"],
    "model": ["型式", "TYPE", "TIPE", "MODEL"],
    "material": ["材質", "MATERIAL", "MAT"],
    "scale": ["尺度", "SCALE"],
    "drawn_date": ["日付", "作成日", "製図日", "年月日", "DATE"],
}
FIELD_LABELS = {
    "drawing_no": ["図番", "図面番号", "DWG NO", "DWG.NO", "DRAWING NO"],
    "revision": ["改訂", "REV", "REV.", "版"],
    "title": ["品名", "名称", "図名", "件名", "NAME"],
    "sheet_title": ["TITLE"],
    "model": ["型式", "TYPE", "TIPE", "MODEL"],
    "material": ["材質", "MATERIAL"],
    "scale": ["尺度", "SCALE"],
    "drawn_date": ["日付", "作成日", "製図日", "年月日", "DATE"],
}
FORM_WORDS = ["表面処理", "計算質量", "得意先", "製番", "特記", "認可", "点検", "製図", "尺度", "型式", "名称", "員数", "材質", "特記以外図番", "適用型式又は特記", "組立図番", "計画課", "GROUP", "USER", "DRAW", "CHECK", "三角法", "検査寸法"]
TABLE_WORDS = ["NO", "NO.", "品番", "部品番号", "数量", "個数", "員数", "QTY", "PART NO", "備考"]
#: How sure a code is, by where it comes from.
CONFIDENCE = {"attrib": 0.97, "filename": 0.9, "text": 0.85, "rule": 0.8, "guess": 0.6, "none": 0.3}


def _lookup(words: dict[str, Sequence[str]]) -> Column:
    return F.create_map(*[F.lit(x) for field, ws in words.items() for w in ws for x in (w, field)])


def from_attributes(attributes: DataFrame, key: str) -> DataFrame:
    """(key, field, value): of several values of a field the first that is not blank. attributes: key, pos, tag, text."""
    field = F.get(F.array(F.try_element_at(_lookup(FIELD_TAGS), norm(F.col("tag")))), 0)
    named = attributes.select(key, "pos", field.alias("field"), norm_keep_case(F.col("text")).alias("value")).where("field is not null and value <> ''")
    return named.groupBy(key, "field").agg(F.min(F.struct("pos", "value")).alias("s")).select(key, "field", "s.value")


def from_labels(items: DataFrame, key: str) -> DataFrame:
    """(key, field, value) from positioned text (key, id, text, x, y, h).

    ``label: value`` in one text comes first, then dates right after their label, then the nearest value right of or below a
    label. A label on a line with two more header words, one of them of a part table, heads a table and is none.
    """
    # normalised once, as a table that the joins read: the only Python on this path
    known = items.select(key, "id", norm_keep_case(F.col("text")).alias("text"), "x", "y", F.greatest("h", F.lit(1e-6)).alias("h")).withColumn("upper", F.upper("text"))
    known = written(known, "texts")
    known = dealt(known, [key], known.count())
    words = sorted({w for ws in FIELD_LABELS.values() for w in ws}, key=lambda w: (-len(w), w))
    pattern = "(?i)^(" + "|".join(w.replace(".", r"\.") for w in words) + r")\s*:\s*(.+)$"
    inline = known.select(key, "id", F.try_element_at(_lookup(FIELD_LABELS), F.upper(F.regexp_extract("text", pattern, 1))).alias("field"), F.regexp_extract("text", pattern, 2).alias("value"), F.lit(0).alias("rank"), F.lit(0.0).alias("distance"))
    date = r"^(?:年月日|日付|作成日|製図日)\s*:?\s*(\d{2,4}\s*[./-]\s*\d{1,2}\s*[./-]\s*\d{1,2})"
    dated = known.select(key, "id", F.lit("drawn_date").alias("field"), F.regexp_replace(F.regexp_extract("text", date, 1), r"\s+", "").alias("value"), F.lit(1).alias("rank"), F.lit(0.0).alias("distance"))
    bare = F.regexp_replace("upper", ":+$", "")
    labels = F.array(*[F.lit(w) for w in words])
    marked = known.withColumn("is_label", F.array_contains(labels, bare)).withColumn("is_form", bare.isin(*FORM_WORDS) | (bare == ""))
    heads = F.array_contains(F.array_union(labels, F.array(*map(F.lit, TABLE_WORDS))), F.col("o.upper"))
    # merge joins: items exploded from a small table look small to Spark, but grow with it
    row = marked.where("is_label").alias("l").join(known.alias("o").hint("merge"), (F.col(f"l.{key}") == F.col(f"o.{key}")) & (F.abs(F.col("o.y") - F.col("l.y")) < 0.6 * F.col("l.h")))
    of_table = row.groupBy(F.col(f"l.{key}").alias("t_key"), F.col("l.id").alias("t_id")).agg(F.count_if(heads).alias("n"), F.count_if(F.col("o.upper").isin(*TABLE_WORDS)).alias("m")).where("n >= 3 and m > 0")
    heading = F.col("t_key").isNotNull()
    told = marked.join(of_table.hint("merge"), (F.col(key) == F.col("t_key")) & (F.col("id") == F.col("t_id")), "left").withColumns({"is_label": F.col("is_label") & ~heading, "is_form": F.col("is_form") | heading})
    near = geometry.label_values(told, [key], F.col("is_label"), F.col("is_form"))
    beside = near.select(key, F.col("l_id").alias("id"), F.try_element_at(_lookup(FIELD_LABELS), F.upper(F.regexp_replace("label", ":+$", ""))).alias("field"), "value", F.lit(2).alias("rank"), "distance")
    every = inline.unionByName(dated).unionByName(beside).where("field is not null and value <> ''")
    best = every.groupBy(key, "field").agg(F.min(F.struct("rank", "id", "value")).alias("s")).select(key, "field", "s.value")
    # a drawing number of one to three digits is the number of the sheet
    sheet = (F.col("field") == "drawing_no") & F.col("value").rlike(r"^\d{1,3}$")
    return best.withColumn("field", F.when(sheet, "sheet_no").otherwise(F.col("field")))


def pivoted(fields: DataFrame, key: str) -> DataFrame:
    """One row per key with a column for each field."""
    return fields.groupBy(key).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS])


def resolve(a: str, f: str, p: str, rule: Column, base: Column) -> dict[str, Column]:
    """Columns of each field, its source and confidence. ``a``, ``f``, ``p`` are prefixes of struct columns with the fields of
    attributes, file name and positioned text; ``rule`` tells whether a file name rule fits; ``base`` names the text's source.

    Attributes come first; file names come second where a rule fits, else last. A title on the drawing comes before one of
    the file name, unless that names the drawing; the file's own title is then kept beside it.
    """
    get = lambda s, n: F.nullif(F.coalesce(F.col(f"{s}.{n}"), F.lit("")), F.lit(""))
    out = {n: F.coalesce(get(a, n), F.when(rule, F.coalesce(get(f, n), get(p, n))).otherwise(F.coalesce(get(p, n), get(f, n))), F.lit("")) for n in FIELDS}
    drawn = F.coalesce(get(a, "title"), get(p, "title"))
    title = F.when(drawn.isNotNull() & ~(rule & get(f, "drawing_no").isNotNull()), drawn).otherwise(out["title"])
    out["file_title"] = F.when(get(f, "title").isNotNull() & (get(f, "title") != title), get(f, "title")).otherwise("")
    out["title"] = F.when(title == "", out["sheet_title"]).otherwise(title)
    of = lambda source, c: F.struct(F.lit(source).alias("source") if isinstance(source, str) else source.alias("source"), F.lit(CONFIDENCE[c]).alias("confidence"))
    some = F.coalesce(*[get(p, n) for n in FIELDS]).isNotNull()
    out["origin"] = (
        F.when(get(a, "drawing_no").isNotNull(), of("attrib", "attrib"))
        .when(rule & get(f, "drawing_no").isNotNull(), of("filename", "filename"))
        .when(get(p, "drawing_no").isNotNull(), of(base, "text"))
        .when(rule, of(F.when(some, base).otherwise("filename"), "rule"))
        .when(get(f, "drawing_no").isNotNull(), of("filename", "guess"))
        .otherwise(of(base, "none"))
    )
    return out
