"""Table extraction and title-block queries on made-up layouts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bom, scans, titleblock
from ..tables import dealt
from .registry import query, table


def _lines(spark, sf_dir, each=200_000):
    """Lines by order, a bounded number a task: few bytes, but reading a drawing takes a part of a millisecond."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return dealt(lines, ["l_orderkey"], lines.count(), each)


def _drawings(spark, sf_dir):
    """Orders as drawings: lines as table rows, stacked upward from the header, as in the orders' own numbers."""
    line = _lines(spark, sf_dir)
    w = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    y = 100 + 8 * F.col("n").cast("double")
    cell = lambda text, x, y: F.struct(text.alias("text"), F.lit(float(x)).alias("x"), y.alias("y"), F.lit(3.0).alias("h"), F.lit(None).cast("double").alias("w"), F.lit(None).cast("double").alias("conf"), F.lit(None).cast("array<struct<text string, x double, y double, w double, h double>>").alias("tokens"))
    rows = line.withColumn("n", w).select(
        "l_orderkey", "n", F.array(
            cell(F.col("n").cast("string"), 1, y), cell(F.concat(F.lit("HB"), F.lpad(F.col("l_partkey").cast("string"), 6, "0")), 16, y),
            cell(F.concat(F.lit("PLATE "), F.col("l_suppkey").cast("string")), 66, y), cell(F.col("l_quantity").cast("int").cast("string"), 141, y), cell(F.lit("STEEL"), 161, y),
        ).alias("cells"),
    )
    head = F.array(*[cell(F.lit(t), x + 1, F.lit(100.0)) for x, t in ((0, "NO."), (15, "図番又は品番"), (65, "名称/規格"), (140, "員数"), (160, "材質"))])
    edges = F.array(*[F.lit(float(x)) for x in (-5, 14, 64, 139, 159, 190)])
    one = rows.groupBy("l_orderkey").agg(F.flatten(F.collect_list("cells")).alias("cells"), F.max("n").alias("last"))
    rules = F.transform(edges, lambda x: F.struct(x.alias("x"), F.lit(96.0).alias("y0"), (104 + 8 * F.col("last")).cast("double").alias("y1")))
    return one.select(F.col("l_orderkey").alias("drawing_id"), F.concat(head, F.col("cells")).alias("items"), rules.alias("vlines"))


_ROWS = """
SELECT l_orderkey AS drawing_id, CAST(n AS INTEGER) AS row, CAST(n AS VARCHAR) AS item_no, part_no, name, qty, 'STEEL' AS material, part_no AS ref_drawing_no, 1.0::DOUBLE AS confidence FROM (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, 'HB' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') AS part_no,
    'PLATE ' || l_suppkey AS name, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS qty FROM lineitem)
"""
_COLUMNS = ["drawing_id", "row", "item_no", "part_no", "name", "qty", "material", "ref_drawing_no", "confidence"]


@query(_ROWS)
def bom_extract(spark, sf_dir):
    """Orders laid out as drawings and read back as tables of parts."""
    return bom.extract_rows(_drawings(spark, sf_dir)).select(*_COLUMNS)


@query(_ROWS)
def bom_header_only(spark, sf_dir):
    """The same drawings without ruling lines: where the header's words stand tells the columns."""
    plain = _drawings(spark, sf_dir).withColumn("vlines", F.array().cast("array<struct<x double, y0 double, y1 double>>"))
    return bom.extract_rows(plain).select(*_COLUMNS)


def _scans(spark, sf_dir):
    """Orders as scans of the known form: words that OCR has read, a line a row, with ones read as strokes, codes read with dots, the
    number and the part as one word in every fourth row, and no number in every third; and the rules of the form."""
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    # a line is six words: fewer lines a task, which sorts them in memory
    lines = _lines(spark, sf_dir, 50_000)
    line = lines.withColumn("n", number)
    n, y = F.col("n"), 60 + 25 * F.col("n").cast("double")
    code = F.concat(F.lit("HB"), F.lpad(F.col("l_partkey").cast("string"), 6, "0"))
    dotted = F.when(n % 5 == 1, F.concat_ws(".", F.substring(code, 1, 4), F.substring(code, 5, 2), F.substring(code, 7, 2))).otherwise(code)
    said = F.translate(n.cast("string"), "1", "l")
    both = (n % 4 == 3) & (n % 3 > 0) & (n < 10)
    word = lambda text, x, w: F.struct(text.alias("text"), F.lit(float(x)).alias("x"), F.lit(float(w)).alias("w"))
    read = F.when((n % 3 > 0) & ~both, F.array(word(said, 90, 5))).otherwise(F.slice(F.array(word(said, 90, 5)), 1, 0))
    parts = F.when(both, F.array(word(F.concat(said, code), 95, 45))).otherwise(F.array(word(dotted, 105, 40)))
    others = [word(F.lit("PLATE"), 225, 25), word(F.col("l_suppkey").cast("string"), 255, 20), word(F.col("l_quantity").cast("int").cast("string"), 400, 8), word(F.lit("STEEL"), 464, 14)]
    words = line.select(F.col("l_orderkey").alias("drawing_id"), n.alias("line"), y.alias("y"), F.lit(10.0).alias("h"), F.posexplode(F.concat(read, parts, F.array(*others))).alias("n", "t")).select("drawing_id", "line", "n", "t.text", "t.x", "y", "t.w", "h")
    edges = F.explode(F.array(*[F.lit(100.0 + e) for e in scans.EDGES]))
    rules = lines.groupBy(F.col("l_orderkey").alias("drawing_id")).agg(F.count("*").alias("last")).select("drawing_id", "last", edges.alias("x")).select("drawing_id", "x", F.lit(0.0).alias("low"), (90 + 25 * F.col("last")).cast("double").alias("high"))
    return words, rules


@query(_ROWS)
def bom_scan(spark, sf_dir):
    """Scans without a readable header, by the form: words cut at rules and borders, repaired codes, rows numbered by their spacing."""
    return scans.form_rows(*_scans(spark, sf_dir), ["drawing_id"]).select(*_COLUMNS)


@query("SELECT p_partkey, f.field, CASE f.field WHEN 'title' THEN 'HOUSE ' || p_name ELSE 'HB' || p_partkey END AS value FROM part, (VALUES ('title'), ('drawing_no')) AS f(field)")
def attribute_fields(spark, sf_dir):
    """Attributes of title blocks: tags in any case, blank values passed over, the first value counts, other tags are none."""
    tag = lambda field: titleblock.FIELD_TAGS[field][0]
    key = F.col("p_partkey").cast("string")
    said = [(tag("title").lower(), F.lit(" ")), (tag("title"), F.concat(F.lit(" HOUSE "), "p_name")), (tag("title"), F.lit("OTHER")), (tag("drawing_no"), F.concat(F.lit("HB"), key)), ("NO SUCH TAG", key)]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("pos"), F.lit(t).alias("tag"), v.alias("text")) for n, (t, v) in enumerate(said)]))
    return titleblock.from_attributes(table(spark, sf_dir, "part").select("p_partkey", each.alias("a")).select("p_partkey", "a.*"), "p_partkey")


@query("""
SELECT part_no, CAST(sum(q) AS DECIMAL(20,2)) AS qty, count(*) AS n_rows FROM (SELECT 'HB' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') AS part_no, CAST(l_quantity AS INTEGER) AS q FROM lineitem) GROUP BY 1
""")
def bom_total(spark, sf_dir):
    return bom.summed_quantity(bom.extract_rows(_drawings(spark, sf_dir))).withColumn("qty", F.col("qty").cast("decimal(20,2)"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'A' || p_partkey WHEN p_partkey % 3 = 0 THEN 'HB' || lpad(CAST(p_partkey AS VARCHAR), 4, '0') WHEN p_partkey % 5 = 0 THEN 'T' || p_partkey ELSE '' END AS drawing_no,
  CASE WHEN p_partkey % 2 = 0 THEN 'attrib' WHEN p_partkey % 3 = 0 THEN 'filename' ELSE 'text' END AS source,
  CAST(CASE WHEN p_partkey % 2 = 0 THEN 0.97 WHEN p_partkey % 3 = 0 THEN 0.9 WHEN p_partkey % 5 = 0 THEN 0.85 ELSE 0.3 END AS DOUBLE) AS confidence FROM part
""")
def field_precedence(spark, sf_dir):
    """Codes from attributes, file names and text, with what counts and how sure it is."""
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    blank = {n: F.lit("").alias(n) for n in titleblock.FIELDS}
    side = lambda code: F.struct(*(blank | {"drawing_no": F.coalesce(code, F.lit("")).alias("drawing_no")}).values())
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", side(F.when(k % 2 == 0, F.concat(F.lit("A"), key))).alias("a"), side(F.when(k % 3 == 0, F.concat(F.lit("HB"), F.lpad(key, 4, "0")))).alias("f"),
        side(F.when(k % 5 == 0, F.concat(F.lit("T"), key))).alias("p"), (k % 3 == 0).alias("rule"),
    )
    out = titleblock.resolve("a", "f", "p", F.col("rule"), F.lit("text"))
    return rows.select("p_partkey", out["drawing_no"].alias("drawing_no"), out["origin"].alias("o")).select("p_partkey", "drawing_no", "o.source", "o.confidence")


@query("""
SELECT p_partkey AS g, f.field, CASE f.field WHEN 'title' THEN 'HOUSE ' || p_partkey WHEN 'drawing_no' THEN 'HB' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') WHEN 'scale' THEN '1/30' ELSE '2022.10.03' END AS value
FROM part CROSS JOIN (VALUES ('title'), ('drawing_no'), ('scale'), ('drawn_date')) AS f(field)
""")
def title_block_labels(spark, sf_dir):
    """Parts as drawings: labels with values right of and below them, inline, and a part table's header that is none."""
    rows = [("NAME", 0.0, 20.0), ("HOUSE {g}", 4.0, 17.0), ("DRAWING NO", 40.0, 20.0), ("HB{p}", 60.0, 20.0), ("SCALE：1/30", 0.0, 5.0), ("年月日 2022. 10. 03", 40.0, 5.0), ("品番", 0.0, 60.0), ("名称", 10.0, 60.0), ("数量", 20.0, 60.0), ("WRONG", 12.0, 57.0)]
    g = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("g"))
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("id"), F.lit(t).alias("text"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(2.0).alias("h")) for n, (t, x, y) in enumerate(rows)]))
    items = g.select("g", cells.alias("i")).select("g", "i.*").withColumn("text", F.replace(F.replace("text", F.lit("{g}"), F.col("g").cast("string")), F.lit("{p}"), F.lpad(F.col("g").cast("string"), 6, "0")))
    return titleblock.from_labels(items, "g")
