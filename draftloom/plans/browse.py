"""Browsing queries: lists, pages, trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access
from ..operators import browse as op
from ..operators import positions
from ..sources import files
from .registry import query, table

_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


def _paths(spark, sf_dir):
    """(page_id, path): URLs without scheme, query and fragment."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


@query("""
SELECT l_orderkey, min(l_linenumber) AS first_page, count(*) AS hits, min(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END) AS key_no,
  CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY l_orderkey
""")
def file_collapse(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    code = F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag"))
    return op.collapse(items, "l_orderkey", F.col("l_linenumber"), code, F.sum("l_quantity").alias("quantity"))


@query("""
WITH c AS (SELECT l_suppkey, min(l_orderkey) AS first_page, min(CASE WHEN l_linestatus = 'F' AND l_quantity < 2 THEN l_returnflag END) AS key_no FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, key_no, row_number() OVER (ORDER BY key_no NULLS LAST, first_page, l_suppkey) AS place FROM c
""")
def list_order_nulls_last(spark, sf_dir):
    code = F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") < 2), F.col("l_returnflag")).otherwise("")
    files = op.collapse(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_orderkey"), code)
    placed = positions.with_positions(files, [F.col("key_no").asc_nulls_last(), "first_page", "l_suppkey"], name="place")
    return placed.select("l_suppkey", "key_no", "place")


@query("""
WITH n AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS pos, count(*) OVER () AS total FROM orders)
SELECT o_orderkey, o_totalprice, pos, total FROM n WHERE pos >= 100 AND pos < 150
""")
def page_slice(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return op.page_rows(orders, [F.desc("o_totalprice"), F.col("o_orderkey")], page=3)


@query("""
SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS next, row_number() OVER w AS pos,
  count(*) OVER (PARTITION BY o_custkey) AS total
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def prev_next(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return op.neighbours(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").drop("o_orderdate")


@query("""
SELECT l_orderkey, first.p AS l_partkey, first.q AS l_quantity FROM (
  SELECT l_orderkey, min(struct_pack(n := l_linenumber, p := l_partkey, q := l_quantity)) AS first FROM lineitem GROUP BY l_orderkey)
""")
def representative_row(spark, sf_dir):
    first = F.min(F.struct("l_linenumber", "l_partkey", "l_quantity")).alias("first")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(first).select("l_orderkey", "first.l_partkey", "first.l_quantity")


@query("""
SELECT o.o_orderkey, c.n_all, count(*) AS n_hits FROM orders o JOIN lineitem l ON o_orderkey = l_orderkey
JOIN (SELECT l_orderkey AS k, count(*) AS n_all FROM lineitem GROUP BY 1) c ON c.k = o.o_orderkey
WHERE l.l_returnflag = 'R' GROUP BY o.o_orderkey, c.n_all
""")
def size_lookup(spark, sf_dir):
    """Hits of a filter beside the number of all lines, which the filter does not touch: one pass over the lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_all"), F.count_if(F.col("l_returnflag") == "R").alias("n_hits"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return orders.join(lines.where("n_hits > 0"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "n_all", "n_hits")


@query(f"""
WITH p AS (SELECT {_PATH} AS path FROM pages), h AS (SELECT min(split_part(path, '/', 1)) AS host FROM p),
r AS (SELECT substr(path, length(host) + 2) AS rest FROM p, h WHERE starts_with(path, host || '/'))
SELECT split_part(rest, '/', 1) AS label, count(*) AS n FROM r WHERE contains(rest, '/') GROUP BY 1
""")
def folder_children(spark, sf_dir):
    paths = _paths(spark, sf_dir)
    first = paths.agg(F.min(F.split_part("path", F.lit("/"), F.lit(1))).alias("host"))
    return op.folder_children(paths.join(first, F.lit(True)), F.col("path"), F.col("host"))


@query(f"""
WITH p AS (SELECT list_filter(string_split({_PATH}, '/'), lambda s: s <> '') AS parts FROM pages),
e AS (SELECT parts, unnest(range(1, least(len(parts), 3) + 1)) AS d FROM p)
SELECT array_to_string(parts[1:d], '/') AS prefix, count(*) AS n, CAST(d AS INTEGER) AS depth FROM e GROUP BY 1, 3
""")
def path_prefix_rollup(spark, sf_dir):
    return op.prefix_rollup(_paths(spark, sf_dir), F.col("path"), 3)


@query(f"""
WITH p AS (SELECT page_id, list_filter(string_split({_PATH}, '/'), lambda s: s <> '') AS parts FROM pages)
SELECT page_id, array_to_string(list_transform(range(1, len(parts) + 1), lambda d: array_to_string(parts[1:d], '/')), ' > ') AS crumbs FROM p
""")
def crumbs(spark, sf_dir):
    return _paths(spark, sf_dir).select("page_id", F.array_join(op.crumbs(F.col("path")), " > ").alias("crumbs"))


@query(f"""
WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), l AS (SELECT page_id, regexp_extract(path, '([^/]*)$', 1) AS leaf, regexp_extract(path, '^([^/]*)', 1) AS host FROM p)
SELECT page_id, leaf, row_number() OVER (PARTITION BY host ORDER BY CASE WHEN leaf = '' THEN -1 WHEN regexp_matches(leaf, '^[0-9]') THEN 0 ELSE 1 END,
  TRY_CAST(regexp_extract(leaf, '^([0-9]*)', 1) AS BIGINT), lower(leaf), page_id) AS place FROM l
""")
def natural_sort(spark, sf_dir):
    """Rank of URL leaves in natural order within each host; a host of very many pages is dealt to many tasks."""
    leaves = _paths(spark, sf_dir).select("page_id", F.regexp_extract("path", "([^/]*)$", 1).alias("leaf"), F.regexp_extract("path", "^([^/]*)", 1).alias("host"))
    leaves = leaves.withColumn("key", op.natural_key(F.col("leaf")))
    return positions.with_positions(leaves, ["key", "page_id"], by=["host"], name="place").select("page_id", "leaf", "place")


@query("SELECT o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE (n - 1) % 7 = 0")
def every_kth(spark, sf_dir):
    """Every seventh order by date: a spread sample that a trial run reads."""
    return positions.every_kth(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 7)


@query("""
WITH n AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS pos FROM lineitem)
SELECT * FROM n WHERE pos > (SELECT (count(*) - 1) // 50 * 50 FROM lineitem)
""")
def last_page(spark, sf_dir):
    """The last page of all lines by price, asked for by a number beyond the end."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return positions.page(lines, [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 1 << 30, 50)


@query("""
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) AS place FROM c)
SELECT p_brand, p_type, n FROM r WHERE place <= 2 OR p_type LIKE '%STEEL%'
UNION ALL SELECT p_brand, '(more)', count(*) FROM r WHERE NOT (place <= 2 OR p_type LIKE '%STEEL%') GROUP BY p_brand
""")
def tree_two_level_capped(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return op.capped_children(counts, "p_brand", "p_type", F.contains("p_type", F.lit("STEEL")), cap=2)


@query("""
WITH c AS (SELECT p_brand, p_type, count(*) AS n_inner FROM part GROUP BY 1, 2),
t AS (SELECT p_brand, CAST(sum(n_inner) AS BIGINT) AS n_outer FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5),
r AS (SELECT c.*, n_outer, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY n_inner DESC, p_type) AS INTEGER) AS place FROM c JOIN t USING (p_brand))
SELECT p_brand, n_outer, p_type, n_inner, place FROM r WHERE place <= 6
""")
def nested_top_groups(spark, sf_dir):
    return op.top_groups(table(spark, sf_dir, "part"), "p_brand", "p_type", 5, 6)


@query("""
SELECT o_custkey, o_orderkey, o_orderpriority, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS DISTINCT FROM o_orderpriority AS new_heading FROM orders
""")
def heading_on_change(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return op.heading_changes(orders, ["o_orderdate", "o_orderkey"], "o_orderpriority", ["o_custkey"]).drop("o_orderdate")


@query(f"""
WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/' || {_PATH} WHEN 1 THEN '../' || {_PATH} WHEN 2 THEN 'Ｅn/' || {_PATH} WHEN 3 THEN 'de/..x/' || {_PATH} ELSE {_PATH} END AS path FROM pages)
SELECT page_id, page_id % 5 IN (2, 3) AND NOT contains('/' || path, '/es/') AS is_kept, page_id % 5 > 1 AS is_safe FROM p
""")
def crawl_filter(spark, sf_dir):
    """Which paths a crawl keeps, by folders named without regard to width and case and by parts left out, and which are safe."""
    which, path = F.col("page_id") % 5, F.col("path")
    lead = F.when(which == 0, "/").when(which == 1, "../").when(which == 2, "Ｅn/").when(which == 3, "de/..x/").otherwise("")
    placed = _paths(spark, sf_dir).withColumn("path", F.concat(lead, path))
    return placed.select("page_id", files.kept(path, ["EN", "ｄｅ"], ["/es/"]).alias("is_kept"), files.is_safe(path).alias("is_safe"))


@query("SELECT user_id AS user, 'view' AS action, substr(props, 1, 1000) AS target, ts AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def audit_newest(spark, sf_dir):
    """The newest entries of an audit log made from events, newest first."""
    newest = table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200)
    return access.audit(newest.select(F.col("user_id").alias("user"), F.col("props").alias("target"), "ts"), "view", F.col("ts"))
