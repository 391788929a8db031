"""Geometry queries: prices, dates and sizes stand for positions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bitmap, sheets
from ..operators import geometry as op
from ..tables import dealt
from .registry import query, table


@query("""
WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 3 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS island FROM g)
SELECT user_id, island, count(*) AS n, min(ts) AS first, max(ts) AS last FROM i GROUP BY 1, 2
""")
def line_cluster(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    found = op.gap_islands(events, ["user_id"], "us", ["event_id"], F.lit(3 * 3600 * 1_000_000))
    return found.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("""
WITH h AS (SELECT l_orderkey, l_quantity, median(l_quantity) OVER (PARTITION BY l_orderkey) AS m, l_linenumber, l_partkey FROM lineitem),
g AS (SELECT *, CASE WHEN lag(l_quantity) OVER w - l_quantity <= 0.55 * m THEN 0 ELSE 1 END AS s FROM h WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey)),
i AS (SELECT *, sum(s) OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) - 1 AS line FROM g)
SELECT l_orderkey, CAST(line AS BIGINT) AS line, count(*) AS n FROM i GROUP BY 1, 2
""")
def text_lines(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("y"), F.col("l_quantity").alias("h"))
    items = dealt(items, ["l_orderkey"], items.count())
    return op.text_lines(items, ["l_orderkey"], ["l_linenumber", "l_partkey"]).groupBy("l_orderkey", "line").agg(F.count("*").alias("n"))


@query("""
WITH b AS (SELECT l_orderkey, CAST(l_partkey % 200 AS DOUBLE) AS x, CAST(l_partkey % 200 + l_linenumber AS DOUBLE) AS x1, CASE WHEN l_returnflag = 'N' THEN CAST(l_linenumber AS VARCHAR) ELSE l_returnflag END AS t FROM lineitem),
g AS (SELECT *, x - max(x1) OVER (PARTITION BY l_orderkey ORDER BY x, x1, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap, lag(t) OVER (PARTITION BY l_orderkey ORDER BY x, x1, t) AS was FROM b),
s AS (SELECT *, CASE WHEN gap IS NULL OR gap >= 12 OR (t SIMILAR TO '[0-9.,]+' AND was SIMILAR TO '[0-9.,]+') THEN 1 ELSE 0 END AS new FROM g),
c AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY x, x1, t ROWS UNBOUNDED PRECEDING) - 1 AS cell FROM s)
SELECT l_orderkey, CAST(cell AS BIGINT) AS cell, min(x) AS x, max(x1) AS x1, ltrim(string_agg(CASE WHEN gap > 6 THEN ' ' ELSE '' END || t, '' ORDER BY x, x1, CASE WHEN gap > 6 THEN ' ' ELSE '' END || t)) AS text FROM c GROUP BY 1, 2
""")
def cell_merge(spark, sf_dir):
    x = (F.col("l_partkey") % 200).cast("double")
    text = F.when(F.col("l_returnflag") == "N", F.col("l_linenumber").cast("string")).otherwise(F.col("l_returnflag"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", x.alias("x"), (x + F.col("l_linenumber")).alias("x1"), F.lit(10.0).alias("h"), text.alias("text"))
    return op.merge_cells(items, ["l_orderkey"])


@query("""
WITH b AS (SELECT user_id, epoch_us(ts) // 60000000 AS s, epoch_us(ts) // 60000000 + 30 + event_id % 200 AS e FROM events),
g AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 15 THEN 1 ELSE 0 END AS new FROM b),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, CAST(min(s) AS BIGINT) AS s, CAST(max(e) AS BIGINT) AS e, count(*) AS n FROM r GROUP BY user_id, run
""")
def interval_merge(spark, sf_dir):
    start = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60)
    spans = table(spark, sf_dir, "events").select("user_id", start.alias("s"), (start + 30 + F.col("event_id") % 200).alias("e"))
    return op.merge_intervals(spans, ["user_id"], "s", "e", F.lit(15))


@query("""
WITH RECURSIVE o AS (SELECT c_nationkey AS g, round(c_acctbal) AS v FROM customer),
k AS (SELECT g, min(v) AS v FROM o GROUP BY g UNION ALL SELECT k.g, (SELECT min(o.v) FROM o WHERE o.g = k.g AND o.v > k.v + 100) AS v FROM k WHERE (SELECT min(o.v) FROM o WHERE o.g = k.g AND o.v > k.v + 100) IS NOT NULL)
SELECT g AS c_nationkey, CAST(count(*) AS INTEGER) AS n, max(v) AS last FROM k GROUP BY g
""")
def boundary_greedy_dedupe(spark, sf_dir):
    kept = op.boundaries(table(spark, sf_dir, "customer").select("c_nationkey", F.round("c_acctbal").alias("v")), ["c_nationkey"], "v", 100.0)
    return kept.groupBy("c_nationkey").agg(F.count("*").cast("int").alias("n"), F.max("v").alias("last"))


@query("""
WITH RECURSIVE px AS (SELECT DISTINCT l_suppkey AS page, l_linenumber * 2 - l_partkey % 2 AS c, unnest(range(CAST(l_quantity AS BIGINT), CAST(l_quantity AS BIGINT) + 2 + l_orderkey % 9)) AS y FROM lineitem WHERE l_returnflag <> 'R'),
g AS (SELECT page, c, y, y - row_number() OVER (PARTITION BY page, c ORDER BY y) AS run FROM px),
s AS (SELECT page, c, min(y) AS first, max(y) AS last, row_number() OVER () AS id FROM g GROUP BY page, c, run HAVING count(*) >= 6),
e AS (SELECT a.id AS u, b.id AS v FROM s AS a JOIN s AS b ON a.page = b.page AND a.c <> b.c AND abs(a.c - b.c) <= 2 AND a.first <= b.last AND b.first <= a.last),
r AS (SELECT id AS node, id AS reached FROM s UNION SELECT r.node, e.v FROM r JOIN e ON r.reached = e.u),
k AS (SELECT node, min(reached) AS root FROM r GROUP BY node)
SELECT page, CAST((min(c) + max(c) + 1) / 2 AS DOUBLE) AS x, min(first) AS first, max(last) AS last, count(*) AS n_strokes FROM s JOIN k ON id = node GROUP BY page, root
""")
def ruling_lines(spark, sf_dir):
    """Lines of suppliers as dark pixels of a bitmap each: rules of strokes that touch."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'")
    top = F.col("l_quantity").cast("bigint")
    pixels = lines.select(F.col("l_suppkey").alias("page"), (F.col("l_linenumber") * 2 - F.col("l_partkey") % 2).alias("c"), F.explode(F.sequence(top, top + 1 + F.col("l_orderkey") % 9)).alias("y")).distinct()
    return bitmap.ruling_lines(pixels, ["page"], "c", "y", F.lit(True), 6)


@query("""
WITH b AS (SELECT o_orderkey AS g, CAST(200 + 25 * (o_orderkey % 30) AS DOUBLE) AS w, CAST(150 + 20 * (o_custkey % 35) AS DOUBLE) AS h FROM orders)
SELECT g, 'block' AS origin, w AS w, h AS h FROM b WHERE g % 3 = 0 UNION ALL SELECT g, 'polyline', w, h FROM b WHERE g % 2 = 0
UNION ALL SELECT g, 'level', w, CASE WHEN g % 5 < 3 AND g % 2 = 0 THEN 0 ELSE h END FROM b WHERE g % 5 < 3 OR g % 2 = 0 UNION ALL SELECT g, 'upright', w, h FROM b WHERE (g % 5 < 3) <> (g % 2 = 0)
""")
def frame_candidates(spark, sf_dir):
    """Orders as drawings with a frame that is a block, a closed polyline, or four lines beside shorter ones. Sides drawn twice are the two
    longest lines of their way, and enclose nothing."""
    return sheets.frame_candidates(_entities(spark, sf_dir), "g").select("g", "origin", "w", "h")


@query("""
WITH b AS (SELECT o_orderkey AS g, CAST(200 + 25 * (o_orderkey % 30) AS DOUBLE) AS w, CAST(150 + 20 * (o_custkey % 35) AS DOUBLE) AS h FROM orders),
p(paper, pw, ph, n) AS (VALUES ('A4', 297.0, 210.0, 1), ('A3', 420.0, 297.0, 2), ('A2', 594.0, 420.0, 3), ('A1', 841.0, 594.0, 4), ('A0', 1189.0, 841.0, 5)),
o AS (SELECT paper, pw, ph, false AS portrait FROM p UNION ALL SELECT paper, ph, pw, true FROM p),
f AS (SELECT g, arg_max(struct_pack(paper, portrait), struct_pack(a := w * h, b := paper, c := portrait)) AS s FROM b JOIN o ON w BETWEEN pw * 0.87 AND pw * 1.01 AND h BETWEEN ph * 0.87 AND ph * 1.01 GROUP BY g),
k AS (SELECT g, arg_min(paper, n) AS paper FROM b JOIN p ON greatest(w, h) <= pw AND least(w, h) <= ph GROUP BY g)
SELECT b.g, coalesce(f.s.paper, k.paper, '') AS paper, CASE WHEN f.g IS NOT NULL THEN f.s.portrait ELSE w < h END AS portrait,
  CAST(CASE WHEN f.g IS NULL AND k.g IS NULL THEN greatest(greatest(w, h) / 420.0, least(w, h) / 297.0) ELSE 1.0 END AS DOUBLE) AS factor, f.g IS NOT NULL OR k.g IS NOT NULL AS exact
FROM b LEFT JOIN f ON b.g = f.g LEFT JOIN k ON b.g = k.g
""")
def sheet_fallback(spark, sf_dir):
    """The sheets of these drawings: by a frame that fits, else by what holds all, else shrunk."""
    entities = _entities(spark, sf_dir)
    return op.sheet_of(sheets.extents(entities, "g"), "g", sheets.frame_candidates(entities, "g").select("g", "w", "h"), F.lit(None).cast("double"))


@query("""
WITH v AS (SELECT a.p_brand, a.p_partkey, a.p_size AS v, count(*) AS near FROM part a JOIN part b ON a.p_brand = b.p_brand AND abs(a.p_size - b.p_size) <= 2 GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY near DESC, v) AS n FROM v)
SELECT p_brand, v AS mode, near AS votes FROM r WHERE n = 1
""")
def tolerance_mode(spark, sf_dir):
    return op.tolerance_mode(table(spark, sf_dir, "part").select("p_brand", "p_size"), ["p_brand"], "p_size", 2)


@query("""
WITH s(name, lo, hi) AS (VALUES ('low', 0.0, 1000.0), ('middle', 900.0, 1500.0), ('high', 1400.0, 99999.0))
SELECT p_partkey, arg_max(name, length(name)) AS name FROM part JOIN s ON p_retailprice >= lo AND p_retailprice < hi GROUP BY 1
""")
def span_band_join(spark, sf_dir):
    """Prices in overlapping bands; the longer name wins."""
    spans = spark.createDataFrame([("low", 0.0, 1000.0), ("middle", 900.0, 1500.0), ("high", 1400.0, 99999.0)], "name string, lo double, hi double")
    points = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return op.contained(points, spans, F.col("p_retailprice"), [F.length("name").desc(), F.col("name")], ["p_partkey"]).select("p_partkey", "name")


_ITEMS = "i AS (SELECT l_orderkey AS g, l_partkey AS id, CAST(l_partkey % 97 AS DOUBLE) AS x, CAST(l_suppkey % 13 AS DOUBLE) AS y, 2.0 AS h, l_returnflag AS text, l_linenumber FROM lineitem)"


def _items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("g"), F.col("l_partkey").alias("id"), (F.col("l_partkey") % 97).cast("double").alias("x"), (F.col("l_suppkey") % 13).cast("double").alias("y"),
        F.lit(2.0).alias("h"), F.col("l_returnflag").alias("text"), "l_linenumber",
    )


@query(f"""
WITH {_ITEMS}, p AS (SELECT l.g, l.id AS l_id, l.text AS label, v.id, v.text AS value, abs(v.x - l.x) + 3 * abs(v.y - l.y) AS distance FROM i l JOIN i v ON l.g = v.g
  WHERE l.text = 'R' AND v.text <> 'R' AND v.l_linenumber <> 3 AND ((v.x > l.x AND v.x < l.x + 50 AND abs(v.y - l.y) < 1.6) OR (v.y - l.y > -8 AND v.y - l.y < -0.6 AND v.x - l.x > -4 AND v.x - l.x < 24))),
r AS (SELECT *, row_number() OVER (PARTITION BY g, l_id, label ORDER BY distance, id, value) AS n FROM p)
SELECT g, l_id, label, value, CAST(distance AS DOUBLE) AS distance FROM r WHERE n = 1
""")
def nearest_label(spark, sf_dir):
    return op.label_values(_items(spark, sf_dir), ["g"], F.col("text") == "R", F.col("l_linenumber") == 3)


@query(f"""
WITH {_ITEMS} SELECT g, id, x, y FROM i p WHERE l_linenumber > 1 AND NOT EXISTS (SELECT 1 FROM i b WHERE b.l_linenumber = 1 AND b.g = p.g AND p.x BETWEEN b.x - 20 AND b.x + 20 AND p.y BETWEEN b.y - 3 AND b.y + 3)
""")
def spatial_anti_join(spark, sf_dir):
    items = _items(spark, sf_dir)
    points = items.where("l_linenumber > 1").select("g", "id", F.col("x").alias("px"), F.col("y").alias("py"))
    boxes = items.where("l_linenumber = 1").select("g", (F.col("x") - 20).alias("x0"), (F.col("x") + 20).alias("x1"), (F.col("y") - 3).alias("y0"), (F.col("y") + 3).alias("y1"))
    return op.outside_boxes(points, boxes, ["g"]).select("g", "id", F.col("px").alias("x"), F.col("py").alias("y"))


@query("SELECT l_returnflag, l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, count(*) AS n FROM lineitem GROUP BY 1, 2")
def linear_fit(spark, sf_dir):
    fit = op.fit_line(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice")
    return fit.withColumns({"slope": F.round("slope", 3), "intercept": F.round("intercept", 2)})


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber + CASE WHEN l_orderkey % 4 = 0 THEN 2 ELSE 0 END AS number, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS position FROM lineitem),
v AS (SELECT l_orderkey, CAST(number - position AS BIGINT) AS k, count(*) AS votes FROM p GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY votes DESC, abs(k - 1), k DESC) AS n FROM v)
SELECT l_orderkey, CASE WHEN votes >= 2 THEN k ELSE 1 END AS shift, votes FROM r WHERE n = 1
""")
def renumber_vote(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") + F.when(F.col("l_orderkey") % 4 == 0, 2).otherwise(0)).alias("number"), place.alias("position"))
    return op.vote_offset(rows, ["l_orderkey"], F.col("number"), F.col("position"))


_EDGES = [0.0, 20.0, 138.0, 188.0, 208.0, 248.0, 268.0, 298.0]


@query("""
SELECT c_custkey AS g, CAST(c_custkey % 500 * 3 AS DOUBLE) AS shift, CAST(1.0 AS DOUBLE) AS scale, CAST(8 AS BIGINT) AS hits FROM customer WHERE c_custkey % 5 <> 0
""")
def template_fit(spark, sf_dir):
    """Customers as drawings with the lines of a form among others; every fifth lacks one line and so does not fit."""
    g = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("g"))
    edge = F.explode(F.array(*map(F.lit, _EDGES)))
    form = g.select("g", edge.alias("edge")).where("g % 5 <> 0 OR edge <> 248.0").select("g", (F.col("edge") + F.col("g") % 500 * 3).alias("x"))
    noise = g.select("g", F.explode(F.array(F.lit(11000.0), F.lit(11300.0), F.lit(11501.0))).alias("x"))
    return op.template_fits(dealt(form.unionByName(noise), ["g"], 11 * g.count()), ["g"], _EDGES, (1, 2), tolerance=0.5)


@query("""
WITH r AS (SELECT o_custkey AS id, CAST(200 + 25 * (o_orderkey % 30) AS DOUBLE) * f AS w, CAST(150 + 20 * (o_orderkey % 35) AS DOUBLE) * f AS h, CASE WHEN f > 1 THEN f END AS scale
  FROM (SELECT *, CAST(CASE WHEN o_custkey % 4 = 0 THEN 30 ELSE 1 END AS DOUBLE) AS f FROM orders)),
p(paper, a, b) AS (VALUES ('A4', 297.0, 210.0), ('A3', 420.0, 297.0), ('A2', 594.0, 420.0), ('A1', 841.0, 594.0), ('A0', 1189.0, 841.0)),
o AS (SELECT paper, a AS pw, b AS ph, false AS portrait FROM p UNION ALL SELECT paper, b, a, true FROM p),
f AS (SELECT *, CAST(1.0 AS DOUBLE) AS factor FROM r UNION SELECT *, coalesce(scale, 1.0) FROM r),
m AS (SELECT id, paper, portrait, factor, row_number() OVER (PARTITION BY id ORDER BY factor = 1 DESC, (w / factor) * (h / factor) DESC, paper DESC, portrait DESC) AS n FROM f JOIN o
  ON w / factor BETWEEN pw * (1 - 0.13) AND pw * (1 + 0.01) AND h / factor BETWEEN ph * (1 - 0.13) AND ph * (1 + 0.01))
SELECT id, paper, portrait, factor FROM m WHERE n = 1
""")
def paper_fit(spark, sf_dir):
    """Orders as frames of their customer's drawing; those of every fourth are drawn at thirty times their size."""
    times, k = F.when(F.col("o_custkey") % 4 == 0, 30.0).otherwise(1.0), F.col("o_orderkey")
    rects = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), ((200 + 25 * (k % 30)).cast("double") * times).alias("w"), ((150 + 20 * (k % 35)).cast("double") * times).alias("h"), F.when(times > 1, times).alias("scale"))
    return op.paper_fit(rects, "id", F.col("scale"))


@query("""
WITH p AS (SELECT l_partkey % 50 AS c, CAST(l_orderkey % 500 AS BIGINT) AS y FROM lineitem GROUP BY 1, 2), r AS (SELECT c, y, y - row_number() OVER (PARTITION BY c ORDER BY y) AS run FROM p)
SELECT c, min(y) AS first, max(y) AS last, count(*) AS n FROM r GROUP BY c, run HAVING count(*) >= 6
""")
def image_runs(spark, sf_dir):
    """Lines as dark pixels of a bitmap: vertical strokes of six or more."""
    pixels = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("c"), (F.col("l_orderkey") % 500).alias("y")).distinct()
    return op.dark_runs(pixels, ["c"], "y", F.lit(True), 6)


@query(f"WITH {_ITEMS} SELECT g, count(*) AS n, count(DISTINCT id) AS n_codes FROM i WHERE x >= 0.55 * 97 AND y <= 0.22 * 13 GROUP BY 1")
def title_block_region(spark, sf_dir):
    return op.title_block_region(_items(spark, sf_dir), F.lit(97.0), F.lit(13.0)).groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_codes"))


@query("""
SELECT conv_id, count(*) AS n_pages, count(*) FILTER (WHERE role = 'assistant') AS n_coded, count(*) FILTER (WHERE role = 'assistant') >= 2 AND 2 * count(*) FILTER (WHERE role = 'assistant') >= count(*) AS page_set FROM conversations GROUP BY 1
""")
def page_set_split(spark, sf_dir):
    return op.is_page_set(table(spark, sf_dir, "conversations"), "conv_id", F.col("role") == "assistant")


def _entities(spark, sf_dir):
    """Entities of orders as drawings: all of one size, some with a block or a closed polyline of it, some with its four sides as lines, and
    two short lines and a triangle in each."""
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero, w, h, g = F.lit(0.0), F.col("w"), F.col("h"), F.col("g")
    corners = [at(zero, zero), at(w, zero), at(w, h), at(zero, h)]
    one = lambda kind, closed, *points: F.struct(F.lit(kind).alias("kind"), F.lit(closed).alias("closed"), F.array(*points).alias("points"))
    sides = F.array(*[one("LINE", False, a, b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)])
    none = F.slice(sides, 1, 0)
    short = F.array(one("LINE", False, at(F.lit(5.0), F.lit(7.0)), at(F.lit(60.0), F.lit(7.0))), one("LINE", False, at(zero, zero), at(w, h)), one("LWPOLYLINE", False, at(F.lit(1.0), F.lit(1.0)), at(F.lit(9.0), F.lit(5.0)), at(F.lit(4.0), F.lit(8.0))))
    parts = F.concat(
        short, F.when(g % 3 == 0, F.array(one("INSERT", False, corners[0], corners[2]))).otherwise(none),
        F.when(g % 2 == 0, F.array(one("LWPOLYLINE", True, *corners))).otherwise(none), F.when(g % 5 < 3, sides).otherwise(none),
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("g"), (200 + 25 * (F.col("o_orderkey") % 30)).cast("double").alias("w"), (150 + 20 * (F.col("o_custkey") % 35)).cast("double").alias("h"))
    return orders.select("g", F.explode(parts).alias("e")).select("g", "e.*")
