"""Relation queries: orders stand for drawings, lines for table rows, parts and suppliers for codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relations as op
from .registry import query, table


def _drawings(spark, sf_dir):
    """Orders as drawings: the code is ``P<customer>``; notes name the previous customer's code, assemblies the code of a tenth."""
    o = table(spark, sf_dir, "orders")
    code = lambda x: F.concat(F.lit("P"), x.cast("string"))
    key = F.col("o_custkey")
    return o.select(
        F.col("o_orderkey").alias("id"), code(key).alias("drawing_no"), F.array(code(key - 1)).alias("note_refs"),
        F.when(F.col("o_orderkey") % 3 == 0, F.array(code(F.floor(key / 10)))).otherwise(F.array().cast("array<string>")).alias("assembly_refs"),
        F.col("o_orderstatus").alias("status"),
    )


def _bom(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    code = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    return l.select(F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "R", code).otherwise("").alias("ref_drawing_no"), F.when(F.col("l_returnflag") == "A", code).otherwise("").alias("part_no"))


_BASE = """
d AS (SELECT o_orderkey AS id, 'P' || o_custkey AS drawing_no, 'P' || (o_custkey - 1) AS note, CASE WHEN o_orderkey % 3 = 0 THEN 'P' || (o_custkey // 10) END AS asm, o_orderstatus AS status
  FROM orders),
v AS (SELECT * FROM d WHERE status <> 'P'),
b AS (SELECT l_orderkey AS id, CASE WHEN l_returnflag = 'R' THEN 'P' || l_partkey ELSE '' END AS ref, CASE WHEN l_returnflag = 'A' THEN 'P' || l_partkey ELSE '' END AS part FROM lineitem)
"""


@query(f"""
WITH {_BASE}, n AS (SELECT id, code, min(rank) AS rank FROM (SELECT id, ref AS code, 0 AS rank FROM b WHERE ref <> '' UNION ALL SELECT id, note, 1 FROM d) GROUP BY 1, 2),
t AS (SELECT DISTINCT n.id, n.code, n.rank, v.id AS target FROM n LEFT JOIN v ON v.drawing_no = n.code AND v.id <> n.id),
k AS (SELECT DISTINCT d.id, v.drawing_no AS code, v.id AS target FROM v JOIN d ON v.asm = d.drawing_no WHERE v.id <> d.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY code, target) AS place FROM k)
SELECT id, code, CASE rank WHEN 0 THEN 'bom' ELSE 'note' END AS kind, target FROM t
UNION ALL SELECT id, code, 'assembly', target FROM r WHERE place <= 200 AND NOT EXISTS (SELECT 1 FROM t WHERE t.id = r.id AND t.target = r.target)
""")
def uses_edges(spark, sf_dir):
    d = _drawings(spark, sf_dir)
    return op.uses(d, d.where("status <> 'P'"), _bom(spark, sf_dir)).select("id", "code", "kind", "target")


@query(f"""
WITH {_BASE}, e AS (
  SELECT d.id, b.id AS user_id, 0 AS rank FROM b JOIN d ON b.ref = d.drawing_no UNION ALL SELECT d.id, b.id, 0 FROM b JOIN d ON b.part = d.drawing_no
  UNION ALL SELECT d.id, v.id, 1 FROM v JOIN d ON v.note = d.drawing_no
  UNION ALL SELECT d.id, v.id, 2 FROM d JOIN v ON d.asm = v.drawing_no),
m AS (SELECT e.id, user_id, min(rank) AS rank FROM e WHERE e.id <> user_id GROUP BY 1, 2),
r AS (SELECT m.*, CAST(row_number() OVER (PARTITION BY m.id ORDER BY rank, v.drawing_no, user_id) AS INTEGER) AS place FROM m JOIN v ON v.id = user_id)
SELECT id, user_id, CASE rank WHEN 0 THEN 'bom' WHEN 1 THEN 'note' ELSE 'assembly' END AS kind, place FROM r WHERE place <= 100
""")
def used_by_edges(spark, sf_dir):
    d = _drawings(spark, sf_dir)
    return op.used_by(d, d.where("status <> 'P'"), _bom(spark, sf_dir))


@query("SELECT a.p_partkey, b.p_partkey AS other FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey")
def revision_self_join(spark, sf_dir):
    return op.same_code(table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size", "p_partkey"), ["p_brand", "p_type", "p_size"], "p_partkey")


@query("SELECT a.l_linenumber, b.l_linenumber AS other, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber GROUP BY 1, 2")
def sibling_self_join(spark, sf_dir):
    pairs = op.same_code(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber")
    return pairs.groupBy("l_linenumber", "other").agg(F.count("*").alias("n"))


@query("""
WITH known AS (SELECT DISTINCT p_partkey FROM part WHERE p_size < 25)
SELECT l_returnflag, count(*) AS n_refs, CAST(sum(CASE WHEN p_partkey IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_found FROM lineitem LEFT JOIN known ON l_partkey = p_partkey GROUP BY 1
""")
def ref_hit_ratio(spark, sf_dir):
    known = table(spark, sf_dir, "part").where("p_size < 25").select("p_partkey").distinct()
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag").join(known, F.col("l_partkey") == F.col("p_partkey"), "left")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n_refs"), F.count("p_partkey").alias("n_found"))


@query("""
WITH f AS (SELECT p_brand || p_type AS code, min(p_partkey) AS resolved FROM part WHERE p_size > 40 GROUP BY 1)
SELECT p.p_partkey, f.resolved FROM part p LEFT JOIN f ON p.p_brand || p.p_type = f.code
""")
def first_resolved_ref(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat("p_brand", "p_type").alias("ref"))
    targets = parts.where("p_size > 40").select(F.col("ref").alias("code"), F.col("p_partkey").alias("target"))
    return op.first_resolved(parts.select("p_partkey", "ref"), "ref", targets, "code", "target").select("p_partkey", "resolved")
