"""What users and workers do at their desks: results stored, jobs reset, types fixed, lists shown, rows exported; and page layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import admin, ingest, reports, search
from ..sources import pdf
from .ingest import _JOBS, _jobs
from .registry import query, table
from .search import _EXPAND_SQL, _dictionary


def _completed(spark, sf_dir):
    """Results of every 50th job, running or not: pages 1 up to the rest of its number by three, also none. All users have two
    pages from before."""
    jobs = _jobs(spark, sf_dir).select("id", "path", "state", F.lit("e").alias("error"))
    users = jobs.select("path").distinct()
    files = users.select("path", F.lit("").alias("sha256"), F.lit("pending").alias("status"), F.lit("e").alias("error"))
    drawings = users.select("path", F.explode(F.array(F.lit(1), F.lit(2))).alias("page_no"), F.lit("old").alias("drawing_no"))
    entry = lambda n: F.struct(F.lit(n).alias("page_no"), F.concat(F.lit("D"), F.col("id").cast("string"), F.lit(f"-{n}")).alias("drawing_no"))
    entries = F.slice(F.array(entry(1), entry(2)), F.lit(1), (F.col("id") % 3).cast("int"))
    results = jobs.where("id % 50 = 0").select(F.col("id").alias("job_id"), F.col("id").alias("at"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("sha256"), entries.alias("entries"))
    return ingest.complete(jobs, files, drawings, results)


_DONE = f"{_JOBS}, done AS (SELECT id, path FROM jobs WHERE state = 'running' AND id % 50 = 0), latest AS (SELECT path, max(id) AS id FROM done GROUP BY 1)"


@query(f"""
WITH {_DONE}, old AS (SELECT DISTINCT path, n AS page_no, 'old' AS drawing_no FROM jobs, (VALUES (1), (2)) AS v(n))
SELECT * FROM old WHERE path NOT IN (SELECT path FROM latest) UNION ALL SELECT path, k, 'D' || id || '-' || k FROM latest, (VALUES (1), (2)) AS v(k) WHERE k <= id % 3
""")
def complete_drawings(spark, sf_dir):
    return _completed(spark, sf_dir)[2]


@query(f"""
WITH {_DONE} SELECT 'job' AS kind, CASE WHEN id IN (SELECT id FROM done) THEN 'done' ELSE state END AS state, CASE WHEN id IN (SELECT id FROM done) THEN '' ELSE 'e' END AS error, '' AS sha256, count(*) AS n FROM jobs GROUP BY ALL
UNION ALL SELECT 'file', CASE WHEN l.id IS NULL THEN 'pending' ELSE 'done' END, CASE WHEN l.id IS NULL THEN 'e' ELSE '' END, CASE WHEN l.id IS NULL THEN '' ELSE sha256(CAST(l.id AS VARCHAR)) END, count(*)
  FROM (SELECT DISTINCT path FROM jobs) f LEFT JOIN latest l USING (path) GROUP BY ALL
""")
def complete_states(spark, sf_dir):
    jobs, files, _ = _completed(spark, sf_dir)
    both = jobs.select(F.lit("job").alias("kind"), "state", "error", F.lit("").alias("sha256")).unionByName(files.select(F.lit("file").alias("kind"), F.col("status").alias("state"), "error", "sha256"))
    return both.groupBy("kind", "state", "error", "sha256").agg(F.count("*").alias("n"))


@query(f"WITH {_JOBS} SELECT id, CASE WHEN state = 'failed' THEN 'queued' ELSE state END AS state, CASE WHEN state = 'failed' THEN 0 ELSE attempts END AS attempts, CASE WHEN state = 'failed' THEN '' ELSE 'e' END AS error FROM jobs")
def reset_jobs(spark, sf_dir):
    jobs = _jobs(spark, sf_dir).select("id", "state", "attempts", F.lit("e").alias("error"))
    return admin.reset(jobs, jobs.where("state = 'failed'"))


@query("""
WITH e AS (SELECT user_id AS id, arg_max(event_type, event_id) AS t FROM events GROUP BY 1)
SELECT c_custkey AS id, coalesce(t, 'view') AS doc_type, c_acctbal < 0 OR coalesce(t, 'view') <> 'view' AS doc_type_fixed FROM customer LEFT JOIN e ON c_custkey = id
""")
def fix_types(spark, sf_dir):
    """Events as edits of the types of customers; all were views, debtors' fixed before."""
    drawings = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("view").alias("doc_type"), (F.col("c_acctbal") < 0).alias("doc_type_fixed"))
    edits = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("doc_type"), F.col("event_id").alias("at"))
    return admin.fix_type(drawings, edits)


@query("SELECT c_name AS term, c_mktsegment AS canonical, c_acctbal > 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS approved FROM customer")
def approve_terms(spark, sf_dir):
    """Customers as terms; those with an open order are chosen."""
    terms = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("term"), F.col("c_mktsegment").alias("canonical"), (F.col("c_acctbal") > 0).alias("approved"))
    chosen = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return admin.approve(terms, chosen, ["c_custkey"]).drop("c_custkey")


@query(f"""
WITH asked(word) AS (VALUES ('article'), ('insult')), {_EXPAND_SQL}
SELECT doc_id AS id, coalesce(lang, '') AS drawing_no, coalesce(source, '') AS revision FROM documents d WHERE coalesce(n_chars, 0) % 7 <> 0 AND coalesce(n_chars, 0) % 2 = 0
  AND NOT EXISTS (SELECT 1 FROM asked a WHERE NOT EXISTS (SELECT 1 FROM terms t WHERE t.word = a.word AND contains(lower(d.text), t.term)))
""")
def search_listing(spark, sf_dir):
    """Documents as drawings of files, of which some are missing; PDF files only."""
    size = F.coalesce("n_chars", F.lit(0))
    docs = table(spark, sf_dir, "documents")
    found = search.search(docs, F.col("text"), ["article", "insult"], _dictionary(spark))
    drawings = found.select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("drawing_no"), F.coalesce("source", F.lit("")).alias("revision"), F.when(size % 7 == 0, "missing").otherwise("done").alias("status"), F.when(size % 2 == 0, "pdf").otherwise("dxf").alias("kind"))
    return search.listing(drawings, "pdf").select("id", "drawing_no", "revision")


@query("""
WITH r AS (SELECT * FROM lineitem WHERE l_quantity > 25), d AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM r) ORDER BY o_orderpriority, o_orderkey LIMIT 5000)
SELECT o_orderkey AS id, o_orderpriority AS drawing_no, CAST(o_custkey AS VARCHAR) AS title, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS model, l_linenumber AS row, l_partkey AS part,
  CASE WHEN l_returnflag = 'N' THEN CAST(l_linenumber AS VARCHAR) ELSE l_returnflag END AS item_no, CAST(1 - l_linenumber / 8 AS DOUBLE) < 0.8 AS is_low, round(CAST(1 - l_linenumber / 8 AS DOUBLE), 2) AS confidence FROM d JOIN r ON o_orderkey = l_orderkey
""")
def export_detail(spark, sf_dir):
    model = F.when(F.col("o_orderstatus") == "P", "_").otherwise(F.col("o_orderstatus"))
    drawings = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("drawing_no"), F.col("o_custkey").cast("string").alias("title"), model.alias("model"))
    item = F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag"))
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("drawing"), F.col("l_linenumber").alias("row"), F.col("l_partkey").alias("part"), item.alias("item_no"), (1 - F.col("l_linenumber") / 8).alias("confidence"))
    return reports.export_rows(drawings, rows)


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag <> 'N' THEN l_returnflag ELSE l_linestatus || '（' || l_linenumber || '/' || count(*) OVER (PARTITION BY l_orderkey) || '）' END AS title FROM lineitem
""")
def page_titles(spark, sf_dir):
    """Lines as pages of an order; some have a title of their own."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    n = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    own = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("")
    return lines.join(n, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", fn.page_title(own, F.col("l_linestatus"), F.col("l_linenumber"), F.col("n")).alias("title"))


_PATHS = "p AS (SELECT l_orderkey AS page, l_returnflag = 'N' AS is_box, CAST(l_partkey % 100 AS DOUBLE) AS x0, l_partkey % 100 + CAST(0.25 AS DOUBLE) * (l_linenumber - 1) AS x1, l_quantity AS y0, l_quantity + CAST(0.25 AS DOUBLE) * (l_suppkey % 5) AS y1 FROM lineitem)"


@query(f"""
WITH {_PATHS} SELECT page, x0 AS x, 100 - y1 AS low, 100 - y0 AS high FROM p WHERE is_box OR (abs(x0 - x1) < 0.3 AND y1 - y0 > 0.5) UNION ALL SELECT page, x1, 100 - y1, 100 - y0 FROM p WHERE is_box
""")
def vector_rules(spark, sf_dir):
    """Lines of orders as path parts of pages: boxes and strokes."""
    x, y = (F.col("l_partkey") % 100).cast("double"), F.col("l_quantity")
    paths = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.when(F.col("l_returnflag") == "N", "re").otherwise("l").alias("kind"), x.alias("x0"), (x + 0.25 * (F.col("l_linenumber") - 1)).alias("x1"),
        y.alias("y0"), (y + 0.25 * (F.col("l_suppkey") % 5)).alias("y1"), F.lit(100.0).alias("height"),
    )
    return pdf.vertical_rules(paths, ["page"])


@query("""
WITH c AS (SELECT o_custkey AS page, o_orderstatus AS span, o_orderkey AS n, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE CAST(o_orderkey % 10 AS VARCHAR) END AS c, CAST(o_orderkey % 40 AS DOUBLE) AS x0, CAST(CASE o_orderstatus WHEN 'O' THEN 10 WHEN 'F' THEN 30 ELSE 50 END AS DOUBLE) AS y FROM orders),
l AS (SELECT *, lag(x0 + 5) OVER (PARTITION BY page, span ORDER BY n) AS was FROM c),
r AS (SELECT c_custkey AS page, CAST(c_custkey % 40 AS DOUBLE) AS x, CAST(c_nationkey * 4 AS DOUBLE) AS high FROM customer),
m AS (SELECT DISTINCT l.n FROM l JOIN r USING (page) WHERE x BETWEEN was - 3 AND x0 + 2.5 AND y + 3 BETWEEN 0 AND high),
p AS (SELECT *, sum(CASE WHEN x0 - was > 6 OR n IN (SELECT n FROM m) THEN 1 ELSE 0 END) OVER (PARTITION BY page, span ORDER BY n ROWS UNBOUNDED PRECEDING) AS piece FROM l)
SELECT page, span, trim(string_agg(c, '' ORDER BY n)) AS text, arg_min(x0, n) FILTER (WHERE c <> ' ') AS x, y, CAST(10 AS DOUBLE) AS h FROM p GROUP BY page, span, piece, y HAVING count(*) FILTER (WHERE c <> ' ') > 0
""")
def text_layer_pieces(spark, sf_dir):
    """Orders as characters on the pages of customers, each of which has a rule."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    x = (k % 40).cast("double")
    chars = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("page"), status.alias("span"), k.alias("n"), F.when(k % 7 == 0, " ").otherwise((k % 10).cast("string")).alias("c"),
        x.alias("x0"), (x + 5).alias("x1"), F.when(status == "O", 10.0).when(status == "F", 30.0).otherwise(50.0).alias("y"), F.lit(10.0).alias("size"),
    )
    rules = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), (F.col("c_custkey") % 40).cast("double").alias("x"), F.lit(0.0).alias("low"), (F.col("c_nationkey") * 4).cast("double").alias("high"))
    return pdf.text_pieces(chars, rules, ["page"], "span")
