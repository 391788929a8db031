"""Text, code and classification queries. Codes, names and paths are made from part keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as fn
from .registry import query, table

@query("SELECT doc_id, strlen(lower(text)) AS n_bytes, md5(lower(trim(text, ' ' || chr(9) || chr(10) || chr(13)))) AS digest FROM documents")
def nfkc_normalise(spark, sf_dir):
    """Lower case instead of upper, as engines differ on the upper case of ß."""
    clean = F.lower(fn.norm_keep_case(F.col("text")))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.lower(fn.nfkc(F.col("text")))).cast("bigint").alias("n_bytes"), F.md5(clean.cast("binary")).alias("digest"))
    return docs


@query("SELECT page_id, CAST(length(html) AS INTEGER) AS before, CAST(length(regexp_replace(html || chr(1) || chr(27), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) AS INTEGER) AS after FROM pages")
def control_strip(spark, sf_dir):
    dirty = F.concat("html", F.chr(F.lit(1)), F.chr(F.lit(27)))
    return table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("before"), F.length(fn.strip_controls(dirty)).alias("after"))


def _codes(spark, sf_dir):
    """A sentence with two codes, a size that is none, and a ten-digit number, from each part."""
    k = F.col("p_partkey").cast("string")
    pad = lambda n: F.lpad(k, n, "0")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.lit("see HB"), pad(4), F.lit("XXXX and UH-"), pad(5), F.lit("-01, plate 914X"), pad(4), F.lit("X0.25; no "), pad(10), F.lit(" HB"), pad(4), F.lit("XXXX")).alias("sentence"),
        F.concat(F.when(F.col("p_partkey") % 3 == 0, "HB").when(F.col("p_partkey") % 3 == 1, "UH-").otherwise(""), F.when(F.col("p_partkey") % 3 == 2, pad(10)).when(F.col("p_partkey") % 2 == 0, pad(6)).otherwise(pad(4)), F.when(F.col("p_partkey") % 5 == 0, "-01").otherwise("")).alias("code"),
    )


_PAD = "lpad(CAST(p_partkey AS VARCHAR), {}, '0')"
_CODE_SQL = f"""(CASE p_partkey % 3 WHEN 0 THEN 'HB' WHEN 1 THEN 'UH-' ELSE '' END || CASE WHEN p_partkey % 3 = 2 THEN {_PAD.format(10)} WHEN p_partkey % 2 = 0 THEN {_PAD.format(6)} ELSE {_PAD.format(4)} END
  || CASE WHEN p_partkey % 5 = 0 THEN '-01' ELSE '' END)"""


@query(f"SELECT p_partkey, 'HB' || {_PAD.format(4)} || 'XXXX,UH-' || {_PAD.format(5)} || '-01,' || {_PAD.format(10)} AS codes FROM part")
def code_extract(spark, sf_dir):
    return _codes(spark, sf_dir).select("p_partkey", F.array_join(fn.find_codes(F.col("sentence")), ",").alias("codes"))


@query(f"SELECT p_partkey, regexp_full_match({_CODE_SQL}, '(?:[A-Z]{{1,5}}-?[0-9]{{3,8}}(?:X{{2,6}})?(?:-[0-9]{{1,3}})?[A-Z]?|[0-9]{{10}})') AS fits FROM part")
def code_shape_check(spark, sf_dir):
    return _codes(spark, sf_dir).select("p_partkey", fn.is_code(F.col("code")).alias("fits"))


@query(f"""
WITH c AS (SELECT p_partkey, {_CODE_SQL} AS code FROM part), m AS (SELECT *, regexp_extract(code, '^([A-Z]{{1,5}})', 1) AS letters, regexp_extract(code, '^[A-Z]+(-?)', 1) AS hyphen, regexp_extract(code, '^[A-Z]+-?([0-9]+)', 1) AS digits FROM c)
SELECT p_partkey, CASE WHEN letters <> '' THEN letters WHEN regexp_full_match(code, '[0-9]{{10}}') THEN '数字' ELSE '他' END AS prefix,
  CASE WHEN letters <> '' THEN letters || hyphen || substr(digits, 1, 4) WHEN regexp_full_match(code, '[0-9]{{10}}') THEN substr(code, 1, 6) ELSE code END AS series FROM m
""")
def series_of(spark, sf_dir):
    found = _codes(spark, sf_dir).select("p_partkey", fn.series_of(fn.norm(F.col("code"))).alias("s"))
    return found.select("p_partkey", "s.prefix", "s.series")


def _paths(spark, sf_dir):
    size = F.col("p_size").cast("string")
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("dxfCAK-"), size, F.lit("A plan.dxf"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("uh-3600 "), size, F.lit(".pdf"))).otherwise("scan.pdf")
    folder = F.when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("drawings/JH multi/PDF-"), size)).otherwise("drawings/miscellany")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(folder, F.lit("/"), name).alias("path"), F.when(F.col("p_partkey") % 8 == 3, F.lit("cag-x1 spare")).alias("attribute"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 8 = 3 THEN 'CAG' WHEN p_partkey % 4 = 0 THEN 'CAK' WHEN p_partkey % 4 = 2 THEN 'JH' ELSE '_' END AS family,
  CASE WHEN p_partkey % 8 = 3 THEN 'CAG-X1' WHEN p_partkey % 4 = 0 THEN 'CAK-' || p_size || 'A' WHEN p_partkey % 4 = 2 THEN 'JH' ELSE '_' END AS code FROM part
""")
def model_of(spark, sf_dir):
    found = _paths(spark, sf_dir).select("p_partkey", fn.model_of(fn.norm(F.col("path")), fn.norm(F.col("attribute"))).alias("m"))
    return found.select("p_partkey", "m.family", "m.code")


@query(f"""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'part' WHEN 1 THEN 'job' WHEN 2 THEN 'dated' ELSE '' END AS rule,
  CASE p_partkey % 4 WHEN 0 THEN 'HB' || {_PAD.format(4)} || 'XXXX' WHEN 3 THEN 'UH-' || {_PAD.format(4)} ELSE '' END AS drawing_no,
  CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN '2022-10-03' WHEN 3 THEN 'B' ELSE '' END AS revision,
  CASE p_partkey % 4 WHEN 0 THEN 'SPACER' WHEN 1 THEN 'FULL SET' WHEN 2 THEN 'HOUSE 36R' ELSE '' END AS title,
  CASE WHEN p_partkey % 4 = 1 THEN '20-032' ELSE '' END AS job_no, CASE p_partkey % 4 WHEN 1 THEN 'CAK-A' WHEN 2 THEN 'CAK-40A' ELSE '' END AS model, CASE WHEN p_partkey % 4 = 2 THEN '2022-10-03' ELSE '' END AS drawn_date FROM part
""")
def filename_rules(spark, sf_dir):
    pad, kind = F.lpad(F.col("p_partkey").cast("string"), 4, "0"), F.col("p_partkey") % 4
    name = (
        F.when(kind == 0, F.concat(F.lit("hb"), pad, F.lit("xxxx差替"), F.col("p_size").cast("string"), F.lit(" Spacer")))
        .when(kind == 1, F.lit("20-032 CAK-A full set"))
        .when(kind == 2, F.lit("dxfCAK-40A house 36R-221003"))
        .otherwise(F.concat(F.lit("plan uh-"), pad, F.lit("_b")))
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", fn.filename_fields(fn.norm(name)).alias("f"))
    return rows.select("p_partkey", "f.*")


@query("""
WITH o AS (SELECT o_orderkey, 1 + o_custkey % 50 AS n FROM orders)
SELECT o_orderkey, CAST(CASE o_orderkey % 6 WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN n WHEN 4 THEN 1 / n END AS DOUBLE) AS d FROM o
""")
def scale_denominator(spark, sf_dir):
    k, n = F.col("o_orderkey") % 6, (1 + F.col("o_custkey") % 50).cast("string")
    said = F.when(k == 0, F.concat(F.lit("1/"), n)).when(k == 1, F.concat(F.lit("S=1:"), n)).when(k == 2, F.concat(F.lit("１／"), n)).when(k == 3, "NTS").when(k == 4, F.concat(n, F.lit("/1"))).otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.scale_denominator(fn.nfkc(said)).alias("d"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) END AS value FROM orders")
def num_parse(spark, sf_dir):
    price = F.format_number(F.col("o_totalprice").cast("decimal(12,2)"), 2)
    said = F.when(F.col("o_orderkey") % 5 != 0, price).when(F.col("o_orderkey") % 3 == 0, "nan").when(F.col("o_orderkey") % 2 == 0, "123456789012").otherwise("12 pcs")
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.number(said).alias("value"))


_KINDS = {"contract": ["the this", "idiot"], "application": ["license", "the with"], "site": ["und der", "der die"], "general": ["la de", "el la"]}
_TITLE = ["the", "und", "les", "que"]


def _hit_sql(words):
    return f"list_filter({words!r}, lambda w: contains(body, w))"


def _words_sql(words):
    return f"list_filter({_hit_sql(words)}, lambda w: NOT list_bool_or(list_transform({_hit_sql(words)}, lambda o: o <> w AND contains(o, w))))"


def _kept_sql(words):
    return f"len({_words_sql(words)})"


@query(f"""
WITH d AS (SELECT doc_id, source, lang, substr(lower(text), 1, 6000) AS body, n_chars FROM documents),
h AS (SELECT *, {", ".join(f"{_kept_sql(w)} AS c{n}, {_words_sql(w)} AS w{n}" for n, w in enumerate(_KINDS.values()))}, {_kept_sql(_TITLE)} AS titled FROM d),
t AS (SELECT *, greatest(c0, c1, c2, c3) AS top, CASE greatest(c0, c1, c2, c3) WHEN c0 THEN 'contract' WHEN c1 THEN 'application' WHEN c2 THEN 'site' ELSE 'general' END AS best FROM h)
SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'contract' WHEN source = 'src3' THEN 'site' WHEN doc_id % 49 = 0 THEN 'drawing'
    WHEN lang = 'es' AND n_chars > 1000 THEN CASE WHEN top > 0 THEN best ELSE 'other' END
    WHEN source = 'src5' THEN CASE WHEN top > 0 THEN best WHEN doc_id % 2 = 0 AND titled >= 2 THEN 'drawing' ELSE 'other' END
    WHEN doc_id % 2 = 0 AND (lang = 'fr' OR n_chars > 2000) THEN 'drawing' WHEN top >= 2 THEN best WHEN lang = 'de' THEN 'drawing' WHEN doc_id % 2 = 0 THEN 'drawing' WHEN titled >= 2 THEN 'drawing' ELSE 'other' END AS doc_type,
  CASE WHEN doc_id % 50 = 0 THEN 'file name: contract' WHEN source = 'src3' THEN 'folder: site' WHEN doc_id % 49 = 0 THEN 'file name: drawing'
    WHEN lang = 'es' AND n_chars > 1000 THEN CASE WHEN top > 0 THEN 'several pages: body' ELSE 'several pages' END
    WHEN source = 'src5' THEN CASE WHEN top > 0 THEN 'document folder: body' WHEN doc_id % 2 = 0 AND titled >= 2 THEN 'document folder: code and title block' ELSE 'document folder' END
    WHEN doc_id % 2 = 0 AND (lang = 'fr' OR n_chars > 2000) THEN 'code' WHEN top >= 2 THEN 'body' WHEN lang = 'de' THEN 'dxf' WHEN doc_id % 2 = 0 THEN 'code, unsure' WHEN titled >= 2 THEN 'title block' ELSE 'no hint' END AS reason,
  CASE WHEN doc_id % 50 = 0 THEN 'idiot' WHEN source = 'src3' THEN 'und der@und der' WHEN doc_id % 49 = 0 THEN 'assembly'
    WHEN top > 0 AND ((lang = 'es' AND n_chars > 1000) OR source = 'src5' OR (top >= 2 AND NOT (doc_id % 2 = 0 AND (lang = 'fr' OR n_chars > 2000)) AND NOT (lang = 'es' AND n_chars > 1000)))
    THEN array_to_string((CASE best WHEN 'contract' THEN w0 WHEN 'application' THEN w1 WHEN 'site' THEN w2 ELSE w3 END)[1:3], '・') ELSE '' END AS words
FROM t
""")
def doc_type_cascade(spark, sf_dir):
    """The rule cascade over documents, with words of their languages."""
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    folder = F.when(F.col("source") == "src3", "und der").when(F.col("source") == "src5", "papers").otherwise("plans")
    name = F.when(k % 50 == 0, "idiot").when(k % 49 == 0, "assembly").otherwise("x")
    found = rules.classify(
        F.concat(F.lit("root/"), folder, F.lit("/"), name, F.lit(".pdf")), F.when(k % 2 == 0, F.concat(F.lit("HB"), k.cast("string"))).otherwise(""),
        F.when(F.col("lang") == "fr", "attrib").otherwise("text"), F.when(F.col("n_chars") > 2000, 0.9).otherwise(0.3),
        F.when(F.col("lang") == "es", "pdf").when(F.col("lang") == "de", "DXF").otherwise("txt"), F.lower("text"), F.when(F.col("n_chars") > 1000, 3).otherwise(1), F.lit(False),
        _KINDS, ["assembly"], _TITLE, ["papers"],
    )
    return docs.select("doc_id", found.alias("f")).select("doc_id", "f.doc_type", "f.reason", "f.words")


_NESTED = ["the", "thea", "then", "there", "an", "and", "andthe"]


@query(f"""
WITH d AS (SELECT doc_id, lower(text) AS body FROM documents), h AS (SELECT doc_id, {_hit_sql(_NESTED)} AS hit FROM d)
SELECT doc_id, array_to_string(list_filter(hit, lambda w: NOT list_bool_or(list_transform(hit, lambda o: o <> w AND contains(o, w)))), ',') AS words FROM h
""")
def keyword_suppression(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(fn.hits(F.lower("text"), _NESTED), ",").alias("words"))


@query(f"""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'UH-' || {_PAD.format(5)} ELSE '' END AS refs FROM part
""")
def note_refs(spark, sf_dir):
    pad = F.lpad(F.col("p_partkey").cast("string"), 5, "0")
    verb = F.when(F.col("p_partkey") % 3 == 0, "SEE ").otherwise("NOT ")
    lines = F.array(F.concat(F.lit("PLATE HB"), pad), F.concat(verb, F.lit("UH-"), pad, F.lit(" AND OWN1234")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(fn.note_refs(lines, ["SEE", "PER"], F.lit("OWN1234")), ",").alias("refs"))


@query("""
SELECT o_orderkey, lower(o_orderstatus || ' ' || o_orderpriority || coalesce(' ' || names, '')) AS body FROM orders
LEFT JOIN (SELECT l_orderkey, string_agg(p_name, ' ' ORDER BY l_linenumber, p_name) AS names FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON l_orderkey = o_orderkey
""")
def search_text_build(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    names = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "p_name"))).alias("n"))
    joined = table(spark, sf_dir, "orders").join(names, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    text = fn.search_text(F.col("o_orderstatus"), F.lit(" "), F.col("o_orderpriority"), F.array_join(F.transform("n", lambda x: x.p_name), " "))
    return joined.select("o_orderkey", F.lower(text).alias("body"))


@query(r"""
WITH c AS (SELECT doc_id, lower(regexp_replace(substr(text, 1, 6000), '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')) AS one, lower(regexp_replace(substr(source || text, 1, 6000), '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')) AS two FROM documents)
SELECT doc_id, md5(replace('d' || doc_id || CASE WHEN one <> '' THEN ' ' || one ELSE '' END || CASE WHEN two <> '' THEN ' ' || two ELSE '' END, 'ß', 'ss')) AS digest FROM c
""")
def page_search_text(spark, sf_dir):
    """Documents as two pages each, of which 6,000 characters are searched."""
    docs = table(spark, sf_dir, "documents")
    text = fn.search_text(F.concat(F.lit("d"), F.col("doc_id").cast("string")), pages=F.array("text", F.concat("source", "text")))
    return docs.select("doc_id", F.md5(F.lower(text).cast("binary")).alias("digest"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN d = '' THEN '' ELSE CAST(CAST(d AS BIGINT) AS VARCHAR) END AS item_no FROM (
  SELECT l_orderkey, l_linenumber, regexp_replace(translate(said, 'Il|!Oo', '111100'), '\\D', '', 'g') AS d FROM (
    SELECT l_orderkey, l_linenumber, translate(CAST(l_orderkey % 700 AS VARCHAR), '01', CASE l_linenumber % 4 WHEN 0 THEN 'OI' WHEN 1 THEN 'ol' WHEN 2 THEN '0|' ELSE 'O!' END)
      || CASE l_linenumber % 3 WHEN 0 THEN '.' WHEN 1 THEN '' ELSE ' x' END AS said FROM lineitem))
""")
def ocr_code_fix(spark, sf_dir):
    """Row numbers as OCR reads them: strokes for ones, rings for noughts, and marks behind."""
    line = table(spark, sf_dir, "lineitem")
    digits = (F.col("l_orderkey") % 700).cast("string")
    misread = F.lit(None).cast("string")
    for k, signs in enumerate(("OI", "ol", "0|", "O!")):
        misread = F.when(F.col("l_linenumber") % 4 == k, F.translate(digits, "01", signs)).otherwise(misread)
    behind = F.when(F.col("l_linenumber") % 3 == 0, ".").when(F.col("l_linenumber") % 3 == 1, "").otherwise(" x")
    return line.select("l_orderkey", "l_linenumber", fn.ocr_item_no(F.concat(misread, behind)).alias("item_no"))


@query("""
SELECT p_partkey, '員数' || p_size || ',5PCS' AS head, p_size || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || '.5' AS qty, 'φ' || p_size || '° plate 5% ±1' AS symbols FROM part
""")
def cell_texts(spark, sf_dir):
    """Keys of headers, first quantities and drawing symbols."""
    size, low = F.col("p_size").cast("string"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")
    return table(spark, sf_dir, "part").select(
        "p_partkey", fn.header_key(F.concat(F.lit(" 員　数 "), size, F.lit("，5 pcs"))).alias("head"), fn.first_quantity(F.concat(F.lit("約 "), size, F.lit(","), low, F.lit(".5 個 7"))).alias("qty"),
        fn.drawing_symbols(F.concat(F.lit("%%c"), size, F.lit("%%D %%Uplate%%u 5%%% %%p1"))).alias("symbols"),
    )


@query("SELECT doc_id, sha256(text) AS content_key, sha1('p/' || doc_id || '|' || n_chars) AS cache_key FROM documents")
def content_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_key"), F.sha1(F.concat(F.lit("p/"), F.col("doc_id").cast("string"), F.lit("|"), F.col("n_chars").cast("string")).cast("binary")).alias("cache_key"))
