"""Report queries: lines as table rows, orders as drawings, events as jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access
from ..operators import reports as op
from .registry import query, table


@query("""
WITH r AS (
  SELECT 'P' || l_partkey AS key, 'O' || l_orderkey AS drawing, l_linenumber, l_orderkey, p_name AS name, l_returnflag AS ref, p_type AS material, CAST(l_quantity AS BIGINT) AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT key, CAST(count(DISTINCT drawing) AS BIGINT) AS n_drawings, CAST(sum(qty) AS BIGINT) AS qty, substr(string_agg(DISTINCT drawing, ', ' ORDER BY drawing), 1, 1000) AS drawings FROM r GROUP BY key),
f AS (SELECT key, name, ref, material FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY drawing, l_linenumber, name, ref) AS n FROM r) WHERE n = 1)
SELECT key, name, ref, material, n_drawings, qty, drawings FROM g JOIN f USING (key)
""")
def parts_rollup(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    drawing = F.concat(F.lit("O"), F.col("l_orderkey").cast("string"))
    return op.parts_rollup(rows.select(
        drawing.alias("drawing"), drawing.alias("order_code"), F.col("l_linenumber").alias("row"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("part_no"),
        F.col("p_name").alias("name"), F.col("l_quantity").cast("bigint").alias("qty"), F.col("l_returnflag").alias("ref"), F.col("p_type").alias("material"),
    ))


@query("""
WITH known AS (SELECT DISTINCT p_partkey FROM part WHERE p_size < 25)
SELECT l_linestatus AS kind, count(*) AS n_rows, count(*) FILTER (WHERE l_returnflag <> 'N') AS n_part, count(*) FILTER (WHERE l_returnflag <> 'N' AND l_partkey % 2 = 0) AS n_good,
  count(*) FILTER (WHERE l_tax > 0.02) AS n_name, count(*) FILTER (WHERE l_quantity > 5) AS n_qty, count(*) FILTER (WHERE l_returnflag = 'R') AS n_ref, count(*) FILTER (WHERE l_returnflag = 'R' AND p_partkey IS NOT NULL) AS n_found,
  count(DISTINCT l_orderkey) AS n_drawings
FROM lineitem LEFT JOIN known ON l_partkey = p_partkey GROUP BY 1
""")
def quality_counters(spark, sf_dir):
    known = table(spark, sf_dir, "part").where("p_size < 25").select("p_partkey").distinct()
    rows = table(spark, sf_dir, "lineitem").join(known, F.col("l_partkey") == F.col("p_partkey"), "left").withColumn("kind", F.col("l_linestatus"))
    text = lambda shown, value: F.when(shown, value).otherwise("")
    flag = F.col("l_returnflag")
    return op.quality_counters(
        rows, "kind", text(flag != "N", flag), F.col("l_partkey") % 2 == 0, text(F.col("l_tax") > 0.02, F.lit("name")), F.when(F.col("l_quantity") > 5, F.col("l_quantity")),
        text(flag == "R", flag), F.col("p_partkey").isNotNull(), "l_orderkey",
    )


@query("""
WITH r AS (SELECT l_orderkey, count_if(l_quantity > 10) / count(*) AS ratio FROM lineitem GROUP BY 1)
SELECT CASE WHEN ratio >= 0.999 THEN 'all' WHEN ratio >= 0.8 THEN 'most' WHEN ratio > 0 THEN 'some' ELSE 'none' END AS band, count(*) AS n FROM r GROUP BY 1
""")
def fill_rate_bands(spark, sf_dir):
    return op.fill_bands(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_quantity") > 10)


@query("""
WITH p AS (SELECT l_shipmonth AS folder, l_orderkey, count(*) AS r, count(*) FILTER (WHERE l_discount > 0.03) AS f FROM (SELECT strftime(l_shipdate, '%Y/%m') AS l_shipmonth, * FROM lineitem) GROUP BY 1, 2)
SELECT folder, CAST(sum(r) AS BIGINT) AS n_rows, CAST(sum(f) AS BIGINT) AS n_filled, count(*) AS n_keys FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25
""")
def folder_fill_top(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount", "l_shipdate")
    return op.folder_fill(rows, F.date_format("l_shipdate", "yyyy/MM"), "l_orderkey", F.col("l_discount") > 0.03)


@query("""
SELECT l_orderkey, count(*) AS n_rows, count_if(l_returnflag = 'R') / count(*) AS bad_ratio, count_if(l_tax = 0) / count(*) AS no_name_ratio FROM lineitem
GROUP BY 1 HAVING count(*) >= 3 ORDER BY 3 DESC, 4 DESC, 2 DESC, 1 DESC LIMIT 50
""")
def worst_n(spark, sf_dir):
    return op.worst(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R", F.col("l_tax") == 0, 50)


@query("""
WITH m AS (SELECT max(ts) AS last FROM events)
SELECT event_type || ' ' || (user_id % 20) AS error, count(*) AS n, max(ts) AS latest FROM events, m WHERE ts >= last - INTERVAL 3 DAY GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8
""")
def failure_summary(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("ts", "event_type", "user_id")
    last = events.agg(F.max("ts").alias("last"))
    recent = events.join(last, F.col("ts") >= F.col("last") - F.expr("INTERVAL 3 DAYS"))
    error = F.concat(F.concat_ws(" ", "event_type", (F.col("user_id") % 20).cast("string")), F.lit("\ntrace"))
    return op.failure_summary(recent, error, F.col("ts"))


@query("""
WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_quantity > 25) AS k FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, printf('%.0f%%', k / n * 100) AS share FROM g
""")
def percent_format(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 25).alias("k"))
    return counts.select("l_returnflag", "l_linestatus", op.percent(F.col("k"), F.col("n")).alias("share"))


_V1 = "CASE WHEN contains(lower(text), 'license') THEN 'license' WHEN n_chars < 300 THEN 'short' ELSE 'prose' END"
_V2 = "CASE WHEN n_chars < 500 THEN 'short' WHEN contains(lower(text), 'license') THEN 'license' ELSE 'prose' END"


@query(f"SELECT {_V1} AS before, {_V2} AS after, count(*) AS n FROM documents GROUP BY 1, 2")
def transition_matrix(spark, sf_dir):
    return op.transitions(table(spark, sf_dir, "documents"), F.expr(_V1), F.expr(_V2))


@query(f"""
SELECT count(*) AS n, count(*) FILTER (WHERE before <> after) AS n_changed, count(*) FILTER (WHERE before <> 'prose' AND after = 'prose') AS n_published, count(*) FILTER (WHERE before = 'prose' AND after <> 'prose') AS n_withdrawn
FROM (SELECT {_V1} AS before, {_V2} AS after FROM documents)
""")
def transition_totals(spark, sf_dir):
    return op.transition_totals(table(spark, sf_dir, "documents"), F.expr(_V1), F.expr(_V2), F.lit("prose"))


@query(f"""
WITH t AS (SELECT {_V1} AS kind, lang AS reason, doc_id FROM documents), c AS (SELECT kind, reason, count(*) AS n FROM t GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, reason ORDER BY doc_id) AS place FROM t),
e AS (SELECT kind, reason, string_agg(CAST(doc_id AS VARCHAR), ', ' ORDER BY doc_id) AS examples FROM r WHERE place <= 3 GROUP BY 1, 2)
SELECT kind, CAST(sum(n) OVER (PARTITION BY kind) AS BIGINT) AS total, reason, n, examples FROM c JOIN e USING (kind, reason)
""")
def type_drilldown(spark, sf_dir):
    tagged = table(spark, sf_dir, "documents").select(F.expr(_V1).alias("kind"), F.concat("lang", F.lit("（detail）")).alias("why"), "doc_id")
    return op.drilldown(tagged, "kind", F.col("why"), "doc_id", 3)


@query("""
SELECT regexp_extract(url, '^[a-z]+://[^/]*\\.([a-z]+)/', 1) AS folder, count(*) FILTER (WHERE contains(url, '/en/')) AS n_en, count(*) FILTER (WHERE contains(url, '/de/')) AS n_de,
  count(*) FILTER (WHERE contains(url, '/fr/')) AS n_fr, count(*) FILTER (WHERE contains(url, '/es/')) AS n_es, count(*) AS n_all FROM pages GROUP BY 1
""")
def ext_histogram(spark, sf_dir):
    lang = F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]+)/", 1)
    return op.extension_histogram(table(spark, sf_dir, "pages").select("url"), F.regexp_extract("url", r"^[a-z]+://[^/]*\.([a-z]+)/", 1), lang, ["en", "de", "fr", "es"])


@query("""
SELECT lang AS folder, count(*) FILTER (WHERE source = 'src1') AS n_src1, count(*) FILTER (WHERE source = 'src2') AS n_src2, count(*) AS n_all, CAST(sum(CASE WHEN source = 'src1' THEN n_chars ELSE 0 END) AS BIGINT) AS bytes_src1,
  CAST(sum(CASE WHEN source = 'src2' THEN n_chars ELSE 0 END) AS BIGINT) AS bytes_src2, CAST(sum(n_chars) AS BIGINT) AS bytes_all FROM documents GROUP BY 1
""")
def ext_histogram_bytes(spark, sf_dir):
    return op.extension_histogram(table(spark, sf_dir, "documents"), F.col("lang"), F.col("source"), ["src1", "src2"], F.col("n_chars"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations)
SELECT conv_id, string_agg(substr(text, 1, 3000), chr(10) ORDER BY turn) AS body FROM r WHERE place <= 3 GROUP BY conv_id
""")
def first3_pages_concat(spark, sf_dir):
    return op.first_texts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("""
SELECT event_type AS action, count(*) AS n, count(DISTINCT user_id) AS n_users, count(DISTINCT substr(props, 1, 1000)) AS n_targets, max(ts) AS latest FROM events GROUP BY 1
""")
def audit_summary(spark, sf_dir):
    """Entries of the audit log by action."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("props").alias("target"), "event_type", "ts")
    log = access.audit(events, F.col("event_type"), F.col("ts"))
    return log.groupBy("action").agg(F.count("*").alias("n"), F.count_distinct("user").alias("n_users"), F.count_distinct("target").alias("n_targets"), F.max("at").alias("latest"))


@query("""
SELECT l_orderkey, count(*) AS n_rows, count_if(l_quantity <= 10) AS n_missing, 1 - (count(*) - count_if(l_quantity <= 10)) / count(*) AS missing_ratio FROM lineitem
GROUP BY 1 HAVING count(*) >= 3 ORDER BY 3 DESC, 4 DESC, 2 DESC, 1 DESC LIMIT 50
""".replace("count_if(l_quantity <= 10) AS n_missing", "CAST(count_if(l_quantity <= 10) AS BIGINT) AS n_missing"))
def worst_missing(spark, sf_dir):
    """Orders with most lines without a quantity, as which small ones count."""
    return op.worst_missing(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_quantity") > 10, 50)


@query("""
WITH p AS (SELECT page_id % 4 AS kind, string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS parts FROM pages),
c AS (SELECT kind, array_to_string(parts[1:least(2, len(parts) - 1)], '/') AS folder, count(*) AS n FROM p GROUP BY 1, 2)
SELECT kind, folder, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, folder) AS place FROM c) WHERE place <= 15
""")
def type_folders(spark, sf_dir):
    """The folders with most pages of each kind, two levels deep."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return op.kind_folders(table(spark, sf_dir, "pages").select((F.col("page_id") % 4).alias("kind"), "url"), "kind", path, 2)


@query("""
SELECT l_returnflag, l_linestatus, CAST(round(0.5 + CASE WHEN l_quantity > 10 THEN 0.1 ELSE 0 END + CASE WHEN l_tax > 0 THEN 0.1 ELSE 0 END + CASE WHEN l_discount > 0 THEN 0.1 ELSE 0 END
  + CASE WHEN l_linenumber > 1 THEN 0.1 ELSE 0 END, 2) AS DOUBLE) AS confidence, count(*) AS n FROM lineitem GROUP BY 1, 2, 3
""")
def confidence_score(spark, sf_dir):
    score = op.confidence([F.col("l_quantity") > 10, F.col("l_tax") > 0, F.col("l_discount") > 0], F.col("l_linenumber") > 1)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", score.alias("confidence")).agg(F.count("*").alias("n"))


@query("""
SELECT o_orderpriority, count(*) AS n_all, count(*) FILTER (WHERE o_totalprice > 100000) AS n_high, CAST(floor(o_custkey / 1000) AS BIGINT) AS shard FROM orders GROUP BY 1, 4
""")
def blob_shards(spark, sf_dir):
    """Thousand-wide shards of ids, as thumbnails are laid out."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy("o_orderpriority", F.floor(F.col("o_custkey") / 1000).alias("shard")).agg(F.count("*").alias("n_all"), F.count_if(F.col("o_totalprice") > 100000).alias("n_high"))
