"""Projections, sheets, caches and payloads; and extensions beyond the engine's own dataflows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import geometry, ingest
from ..tables import dealt
from .registry import query, table


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN CAST(l_linenumber AS VARCHAR) ELSE l_returnflag END AS item, CASE WHEN l_linestatus = 'O' THEN '' ELSE l_linestatus END AS model,
  CAST(round(l_discount * 10, 1) AS DOUBLE) AS confidence, l_discount < 0.05 AS is_low FROM lineitem
""")
def display_projection(spark, sf_dir):
    """The row number stands in for a missing item number, the sentinel shows blank, low confidence is flagged."""
    item = F.nullif(F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")), F.lit(""))
    model = F.when(F.col("l_linestatus") == "O", fn.NONE).otherwise(F.col("l_linestatus"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.coalesce(item, F.col("l_linenumber").cast("string")).alias("item"), F.when(model == fn.NONE, "").otherwise(model).alias("model"),
        F.round(F.col("l_discount") * 10, 1).alias("confidence"), (F.col("l_discount") < 0.05).alias("is_low"),
    )


@query("SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS local_time FROM events")
def local_time_format(spark, sf_dir):
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Tokyo")
    return table(spark, sf_dir, "events").select("event_id", F.date_format(local, "yyyy-MM-dd HH:mm").alias("local_time"))


@query("""
WITH r AS (SELECT l_orderkey AS g, l_linenumber * 8.0 + CASE WHEN l_orderkey % 3 = 0 AND l_linenumber = 2 THEN 3.5 ELSE 0 END AS y FROM lineitem),
a AS (SELECT *, y - lag(y) OVER (PARTITION BY g ORDER BY y) AS gap, min(y) OVER (PARTITION BY g) AS first FROM r),
p AS (SELECT *, median(CASE WHEN gap > 1.5 THEN gap END) OVER (PARTITION BY g) AS pitch FROM a),
k AS (SELECT *, round((y - first) / pitch) AS k FROM p),
f AS (SELECT g, regr_slope(y, k) AS slope, regr_intercept(y, k) AS zero, count(*) AS n, count(DISTINCT k) AS m FROM k GROUP BY g),
e AS (SELECT k.*, f.slope, f.zero, f.n, coalesce(n >= 3 AND m = n AND slope BETWEEN 0.9 * pitch AND 1.1 * pitch, false) AS even FROM k JOIN f USING (g))
SELECT g, CAST(10 AS DOUBLE) AS x0, CAST(40 AS DOUBLE) AS x1, CAST(round(CASE WHEN n >= 3 THEN least(3.0, coalesce(CASE WHEN even THEN slope ELSE pitch END, 9) / 1.8) ELSE 3.0 END, 6) AS DOUBLE) AS h,
  CAST(round(CASE WHEN even THEN zero + slope * k ELSE y END, 6) AS DOUBLE) AS y FROM e
""")
def quantity_regions(spark, sf_dir):
    """All orders as tables: lines as rows, evenly spaced or not, with gaps and rows at one height."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("k"))
    rows = lines.select("g", (F.col("k") * 8.0 + F.when((F.col("g") % 3 == 0) & (F.col("k") == 2), 3.5).otherwise(0.0)).alias("y"), F.lit(3.0).alias("h"))
    spans = dealt(lines.select("g"), ["g"], lines.count()).distinct().select("g", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for c, a, b in (("qty", 10.0, 20.0), ("qty2", 20.0, 40.0), ("name", 0.0, 10.0))])).alias("s")).select("g", "s.*")
    found = geometry.quantity_regions(rows, ["g"], spans)
    return found.withColumns({"h": F.round("h", 6), "y": F.round("y", 6)})


@query("""
WITH a AS (SELECT l_orderkey AS g, l_linenumber AS k, CASE WHEN l_quantity > 25 THEN l_quantity END AS q FROM lineitem), b AS (SELECT l_orderkey AS g, l_linenumber AS k, CASE WHEN l_quantity > 10 THEN l_quantity END AS q FROM lineitem),
c AS (SELECT g FROM (SELECT g, count(*) AS n, count(q) AS f FROM a GROUP BY 1) JOIN (SELECT g, count(*) AS m, count(q) AS e FROM b GROUP BY 1) USING (g) WHERE f < 0.8 * n AND m >= n AND e > f)
SELECT * FROM a WHERE g NOT IN (SELECT g FROM c) UNION ALL SELECT * FROM b WHERE g IN (SELECT g FROM c)
""")
def better_reading(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("k"), F.col("l_quantity").alias("q"))
    read = lambda least: lines.withColumn("q", F.when(F.col("q") > least, F.col("q")))
    return geometry.better_reading(read(25), read(10), "g", F.col("q").isNotNull())


@query("""
SELECT l_orderkey AS g, l_partkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 50 DESC, l_partkey % 97, l_partkey) AS INTEGER) AS place FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem)
""")
def ocr_reading_order(spark, sf_dir):
    """Items by rounded height and position."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    placed = geometry.reading_order(items.select(F.col("l_orderkey").alias("g"), F.col("l_partkey").alias("id"), (F.col("l_partkey") % 97).alias("x"), (F.col("l_suppkey") % 50 * 10).alias("y"), F.lit(3).alias("h")), ["g"])
    return placed.select("g", "id", "place")


@query("""
WITH p AS (SELECT p_partkey, substr('図番双は&番赴格又品', CAST(1 + p_partkey % 10 AS INTEGER), CAST(p_size % 7 AS INTEGER)) || substr('図番又は品番', CAST(1 + p_partkey % 6 AS INTEGER), CAST(p_partkey % 4 AS INTEGER)) AS t FROM part),
c AS (SELECT *, len(list_distinct(list_filter(string_split(t, ''), lambda x: x IN ('図', '番', '又', 'は', '品')))) AS n FROM p)
SELECT p_partkey, t, CAST(CASE WHEN n >= 2 AND n / 5 >= 0.5 THEN n / 5 ELSE 0 END AS DOUBLE) AS s FROM c
""")
def header_likeness(spark, sf_dir):
    """Part names as header words read by OCR, with letters of the real one in part."""
    k = F.col("p_partkey")
    read = lambda text, at, n: F.substr(F.lit(text), (1 + at).cast("int"), n.cast("int"))
    words = table(spark, sf_dir, "part").select("p_partkey", F.concat(read("図番双は&番赴格又品", k % 10, F.col("p_size") % 7), read("図番又は品番", k % 6, k % 4)).alias("t"))
    return words.select("p_partkey", "t", F.round(fn.header_likeness(F.col("t"), "図番又は品番"), 4).alias("s"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'a b/' || o_orderkey END AS q, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE NULL END AS v FROM orders
""")
def query_values(spark, sf_dir):
    """Links of orders, built and read again."""
    k = F.col("o_orderkey")
    link = fn.query_string(q=F.when(k % 3 == 0, F.concat(F.lit("a b/"), k.cast("string"))), v=F.when(k % 2 == 0, F.col("o_orderpriority")))
    values = fn.query_values(link)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.try_element_at(values, F.lit("q")).alias("q"), F.try_element_at(values, F.lit("v")).alias("v"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN '' ELSE '?' || array_to_string(list_filter([CASE WHEN o_orderstatus <> 'P' THEN 'v=' || o_orderstatus END, CASE WHEN o_orderkey % 2 = 1 THEN 'q=a+b%2F' || o_orderkey END], lambda x: x IS NOT NULL), '&') END AS link FROM orders
""")
def query_string(spark, sf_dir):
    view = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise("")
    words = F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit("a b/"), F.col("o_orderkey").cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.query_string(v=view, q=words).alias("link"))


@query("SELECT doc_id, CAST(1 AS INTEGER) AS page_no FROM documents WHERE NOT (coalesce(lang, '') <> 'de' AND coalesce(n_chars, 0) > 1000)")
def cache_misses(spark, sf_dir):
    """Documents as pages: long ones are cached; German ones are cached in an older version."""
    docs = table(spark, sf_dir, "documents")
    keyed = docs.select("doc_id", "lang", "n_chars", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "text").cast("binary"), 256).alias("sha256"), F.lit(1).alias("page_no"), F.lit(300).alias("dpi"))
    cache = keyed.where("lang = 'de' or n_chars > 1000").select("sha256", "page_no", "dpi", F.when(F.col("lang") == "de", 1).otherwise(2).alias("version"))
    return ingest.cache_misses(keyed, cache, 2).select("doc_id", "page_no")


@query("SELECT o_orderkey AS job_id, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE n END AS INTEGER) AS page_no, 'HB' || o_orderkey AS drawing_no, o_orderstatus AS text FROM orders, (VALUES (1), (2)) AS v(n) WHERE o_orderkey % 2 = 1 OR n = 1")
def result_payloads(spark, sf_dir):
    """Results in the form with several drawings and in the older form with one."""
    one = F.struct(F.struct(F.concat(F.lit("HB"), F.col("o_orderkey").cast("string")).alias("drawing_no")).alias("drawing"), F.array(F.struct(F.col("o_orderstatus").alias("text"))).alias("pages"))
    entry = lambda n: F.struct(F.lit(n).alias("page_no"), one["drawing"].alias("drawing"), one["pages"].alias("pages"))
    data = F.when(F.col("o_orderkey") % 2 == 0, F.to_json(one)).otherwise(F.to_json(F.struct(F.array(entry(1), entry(2)).alias("drawings"))))
    payloads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), data.alias("data"))
    found = ingest.result_entries(payloads, "struct<drawing_no: string>", "array<struct<text: string>>", "array<struct<part_no: string>>")
    return found.select("job_id", "entry.page_no", "entry.drawing.drawing_no", F.get("entry.pages", 0)["text"].alias("text"))


@query("""
SELECT r_name, n_name, count(*) AS n, CAST(grouping(n_name) AS INTEGER) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)
""")
def ext_rollup(spark, sf_dir):
    """Extension: both levels of a tree and the whole in one pass."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    placed = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return placed.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.grouping("n_name").cast("int").alias("level"))


@query("SELECT o_custkey AS k, 'no' AS side FROM (SELECT c_custkey AS o_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT k, 'both' FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders)")
def ext_except_intersect(spark, sf_dir):
    """Extension: set difference and intersection of keys."""
    a, b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return a.subtract(b).withColumn("side", F.lit("no")).unionByName(a.intersect(b).withColumn("side", F.lit("both")))
