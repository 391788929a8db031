"""Search, selector and visibility queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as op
from .registry import query, table

DICTIONARY = [("idiot", "insult", True), ("moron", "insult", True), ("the", "article", True), ("der", "article", True), ("la", "article", False), ("das", "neuter", True), ("neuter", "article", True)]
_DICT_SQL = "SELECT * FROM (VALUES ('idiot','insult',true),('moron','insult',true),('the','article',true),('der','article',true),('la','article',false),('das','neuter',true),('neuter','article',true)) AS v(term, canonical, approved)"
_EXPAND_SQL = f"""
dict AS ({_DICT_SQL}), known AS (SELECT term, canonical FROM dict WHERE approved),
names AS (SELECT term AS name, canonical FROM known UNION SELECT canonical, canonical FROM known),
canon AS (SELECT DISTINCT word, canonical FROM asked JOIN names ON name = word),
members AS (SELECT canonical, term FROM known UNION SELECT canonical, canonical FROM known),
terms AS (SELECT word, term FROM canon JOIN members USING (canonical) UNION SELECT word, word FROM asked)
"""


def _dictionary(spark):
    return spark.createDataFrame(DICTIONARY, "term string, canonical string, approved boolean")


@query(f"""
WITH asked(word) AS (VALUES ('article'), ('insult')), {_EXPAND_SQL}, hits AS (
  SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (
    SELECT 1 FROM asked a WHERE NOT EXISTS (SELECT 1 FROM terms t WHERE t.word = a.word AND contains(lower(d.text), t.term)))
)
SELECT h.source, count(*) AS n_docs, CAST(sum(CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_toxic
FROM hits h JOIN labels l USING (doc_id) WHERE l.quality = 1 GROUP BY h.source
""")
def search_and_or_synonym(spark, sf_dir):
    """Documents with a term of each word, of those that labels make visible, counted by source."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "labels")
    typed = labels.withColumn("doc_type", F.when(F.col("quality") == 1, "drawing").otherwise("other"))
    seen = op.visible(typed, "Guest").select("doc_id", "toxic")
    hits = op.search(docs, F.col("text"), ["article", "insult"], _dictionary(spark)).select("doc_id", "source")
    return hits.join(seen, "doc_id").groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))


@query("""
WITH asked AS (SELECT DISTINCT lower(p_brand) AS word FROM part WHERE p_size > 25 UNION SELECT lower(c_mktsegment) FROM customer),
known AS (SELECT DISTINCT lower(p_brand) AS term, lower(p_type) AS canonical FROM part WHERE p_size % 5 > 0),
names AS (SELECT term AS name, canonical FROM known UNION SELECT canonical, canonical FROM known),
canon AS (SELECT DISTINCT word, canonical FROM asked JOIN names ON name = word),
members AS (SELECT canonical, term FROM known UNION SELECT canonical, canonical FROM known)
SELECT word, term FROM canon JOIN members USING (canonical) UNION SELECT word, word FROM asked
""")
def synonym_expand(spark, sf_dir):
    """Brands and market segments as words; brands are terms of the types they come in, approved by most parts."""
    part = table(spark, sf_dir, "part")
    dictionary = part.select(F.col("p_brand").alias("term"), F.col("p_type").alias("canonical"), (F.col("p_size") % 5 > 0).alias("approved"))
    asked = part.where("p_size > 25").select(F.col("p_brand").alias("word")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("word")))
    return op.expand_terms(asked, dictionary)


@query("SELECT page_id, url FROM pages WHERE starts_with(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/en/')")
def path_prefix_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.where(op.under_folder(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "/en"))


@query("""
WITH p AS (SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
s(selector) AS (VALUES (''), ('ASIA'), ('EUROPE/NATION_3'), ('ASIA/NATION_3'), ('NOWHERE'))
SELECT selector, n_name, count(*) AS n FROM p, s WHERE selector = '' OR r_name = selector OR (contains(selector, '/') AND n_name = split_part(selector, '/', 2)) GROUP BY 1, 2
""")
def two_level_selector(spark, sf_dir):
    """Customers by region and nation, as several selectors choose them; a second level counts alone."""
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    placed = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "n_name").agg(F.count("*").alias("n"))
    chosen = [F.when(op.two_level(F.col("r_name"), F.col("n_name"), s), F.lit(s)) for s in ("", "ASIA", "EUROPE/NATION_3", "ASIA/NATION_3", "NOWHERE")]
    return placed.select(F.explode(F.array_compact(F.array(*chosen))).alias("selector"), "n_name", "n").groupBy("selector", "n_name").agg(F.sum("n").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY event_type")
def enum_filter_fallback(spark, sf_dir):
    kind = op.enum_or_default("no such type", ["click", "view", "purchase", "error"], "click")
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""
SELECT lv.level, count(*) AS n_visible, CAST(sum(d.n_chars) AS BIGINT) AS chars
FROM (VALUES ('Admin'), ('User'), ('Guest'), ('Nobody')) AS lv(level) CROSS JOIN documents d JOIN labels l USING (doc_id)
WHERE lv.level IN ('Admin', 'User') OR l.toxic = 0 GROUP BY lv.level
""")
def rls_visible(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    typed = docs.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("doc_type", F.when(F.col("toxic") == 0, "drawing").otherwise("contract"))
    parts = [op.visible(typed, level).agg(F.count("*").alias("n_visible"), F.sum("n_chars").alias("chars")).withColumn("level", F.lit(level)) for level in ("Admin", "User", "Guest", "Nobody")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n_visible > 0").select("level", "n_visible", "chars")


@query("SELECT p_partkey, p_brand FROM part WHERE lower(p_brand) = lower('bRAND#13')")
def iexact_match(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand").where(op.same_text(F.col("p_brand"), F.lit("bRAND#13")))


@query("""
SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, CAST(round(sum(value), 2) AS DOUBLE) AS total
FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) IN (1, 3, 5) GROUP BY 1
""")
def json_property_filter(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = table(spark, sf_dir, "events").select(k.alias("k"), "value").where(F.col("k").isin(1, 3, 5))
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""
WITH refs AS (SELECT l_orderkey, list(DISTINCT CAST(l_partkey AS VARCHAR)) AS codes FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey FROM refs WHERE list_contains(codes, '7')
""")
def json_containment(spark, sf_dir):
    """Orders whose JSON attributes list a part code."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("code"))
    attributes = items.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_set("code").alias("assembly_refs"))).alias("attributes"))
    return attributes.where(op.json_has(F.col("attributes"), "assembly_refs", F.lit("7"))).select("l_orderkey")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45) GROUP BY o_orderstatus")
def child_exists_semi(spark, sf_dir):
    heavy = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(heavy, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) IN ((1, 1), (2, 2), (3, 1), (7, 3), (32, 4))")
def tuple_semi_join(spark, sf_dir):
    wanted = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (7, 3), (32, 4)], "l_orderkey bigint, l_linenumber int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").join(wanted, ["l_orderkey", "l_linenumber"], "left_semi")


@query("SELECT doc_id, substr(text, 1, 64) AS title, substr(source, 1, 4) AS short_source FROM documents")
def truncate_project(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 64).alias("title"), F.substring("source", 1, 4).alias("short_source"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), (SELECT lower(substr(min(p_name), 2, 6)) FROM part))")
def trigram_search(spark, sf_dir):
    """Parts whose name has a phrase, by the index of trigrams."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    phrase = part.agg(F.lower(F.substring(F.min("p_name"), 2, 6)).alias("p")).first()["p"] or ""
    name = F.lower("p_name")
    return op.trigram_search(part, op.trigram_postings(part, "p_partkey", name), "p_partkey", name, phrase)
