"""Registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, binary_search, bpe, chat, minmax, mixing, quality, repair, simhash, suffix, url_filter, vector_codes, warc
from .shared import load, shared_path


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, depends = chat.conversation_calls(load(spark, sf_dir, "conversations"))
    return chat.link_calls(calls, results, chat.QUERY_SCHEMAS, depends)


def op2_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.group(load(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    written, resolved = shared_path(spark, "warc"), shared_path(spark, "warc-resolved")
    warc.write_archive(warc.records(load(spark, sf_dir, "pages")), written)
    warc.deduplicate_archive(spark, written, resolved)
    return warc.read_archive(spark, resolved, blocks=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_digests(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.by_position(mixing.mix(load(spark, sf_dir, "documents")))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies", F.round("position", 9).alias("position"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), binary_search.sign_code(F.col("embedding")).alias("code"))
    return binary_search.search(codes, codes.where("id % 100 = 0"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(load(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(load(spark, sf_dir, "pages").select("page_id", "url"), url_filter.QUERY_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.text_audio_features(load(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = load(spark, sf_dir, "conversations")
    return repair.repair(repair.damage(conversations), conversations)


def op12_minmax_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_copies(load(spark, sf_dir, "documents"))


def op13_ball_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(load(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}


OP1_SQL = """
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS seq, coalesce(role, '') AS role, text FROM conversations
), u AS (
  SELECT *, 'call-' || conv_id || '-' || seq AS call_id, seq - 2 * row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS run FROM t WHERE role = 'user'
), c AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, run ORDER BY seq) - 1 AS INTEGER) AS level FROM u
), r AS (
  SELECT *, CASE WHEN role = 'assistant' THEN 'call-' || conv_id || '-' || (seq - 1) END AS call_id FROM t WHERE role <> 'user'
)
SELECT conv_id, seq, 'call' AS kind, call_id, EXISTS (SELECT 1 FROM r WHERE r.call_id = c.call_id) AS linked, level, seq AS call_seq, text IS NOT NULL AS valid,
  CASE WHEN text IS NULL THEN 'missing text' ELSE '' END AS errors,
  '{"arguments":{"text":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"turn":' || seq || '},"id":"' || call_id || '","name":"reply","type":"call"}' AS message
FROM c
UNION ALL
SELECT r.conv_id, r.seq, 'result', r.call_id, c.call_id IS NOT NULL, coalesce(c.level, -1), coalesce(c.seq, r.seq), c.call_id IS NOT NULL, CASE WHEN c.call_id IS NULL THEN 'no call' ELSE '' END,
  '{"content":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || ',"id":' || coalesce('"' || r.call_id || '"', 'null') || ',"type":"result"}'
FROM r LEFT JOIN c ON r.call_id = c.call_id
"""

OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), 'string_agg', '') AS payload_digest
  FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM m
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS hash FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM s
), c AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS remain,
    CAST(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest
  FROM w
), f AS (
  SELECT *, weight * remain > 3 * source_size * rest AS cut FROM c
), u AS (
  SELECT arg_min(remain, source_size / weight) AS r0, arg_min(rest, source_size / weight) AS w0 FROM f WHERE NOT cut
), t AS (
  SELECT source, source_size, weight, CASE WHEN cut THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(weight * r0 AS DOUBLE) / CAST(w0 AS DOUBLE) END AS target
  FROM f CROSS JOIN u
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.weight,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY hash, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
    CAST(floor(t.target + 0.5) AS BIGINT) AS goal
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS whole FROM p
), h AS (
  SELECT *, greatest(0, least(size, goal - whole * source_size - start)) AS part FROM g
)
SELECT doc_id, size, source_size, target, CAST(whole * size + part AS BIGINT) AS taken,
  CAST(CASE WHEN size > 0 THEN whole + CASE WHEN 2 * part >= size OR (whole = 0 AND start = 0 AND part > 0) THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS copies,
  CASE WHEN whole * size + part > 0 THEN round(CASE weight
    WHEN 1 THEN 2 * (start / target) / (1.5 + sqrt(2.25 - 2 * (start / target)))
    WHEN 2 THEN start / target
    ELSE 2 * (start / target) / (0.5 + sqrt(0.25 + 2 * (start / target))) END, 9) END AS position
FROM h
"""

OP6_SQL = """
WITH e AS (
  SELECT vec_id AS id, array_to_string(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 AND NOT isnan(embedding[i + 1]) THEN '1' ELSE '0' END), '') AS code
  FROM embeddings WHERE embedding IS NOT NULL
), d AS (
  SELECT q.id AS query_id, e.id, CAST(hamming(q.code, e.code) AS INTEGER) AS distance FROM e AS q CROSS JOIN e WHERE q.id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank, id, distance FROM d
)
SELECT query_id, rank, id, distance FROM r WHERE rank <= 10
"""

OP9_SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), r(r_host, r_path, r_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), m AS (
  SELECT u.*, r_host || r_path AS rule, r_verdict,
    row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(r_host) DESC NULLS LAST, length(r_path) DESC) AS n
  FROM u LEFT JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM m WHERE n = 1
"""


def _add(key: str, cost: str, letter: str) -> str:
    """SQL of a key, ten digits of cost and the letters so far, with one more edit."""
    return f"lpad(CAST(CAST(substr({key}, 1, 10) AS BIGINT) + {cost} AS VARCHAR), 10, '0') || substr({key}, 11) || '{letter}'"


def _stays(key: str, initial: str) -> str:
    """SQL of a key after a turn that stays: kept, if it has the initial that is due, or reroled, which a system turn can't be."""
    cut = "CASE WHEN fault = 'cut' THEN 5 ELSE 0 END"
    kept = f"CASE WHEN fault IN ('', 'cut') AND initial = '{initial}' THEN {_add(key, cut, 'K')} END"
    return kept if initial == "s" else f"{kept}, CASE WHEN fault IN ('', 'cut') THEN {_add(key, '1 + ' + cut, 'R')} END"


def _inserted(rows: str) -> str:
    """SQL of keys after turns that may be inserted."""
    user = f"least(k2, {_add('k0', '5', 'I')}, {_add('k1', '5', 'I')}, {_add('k3', '5', 'I')})"
    return f"SELECT conv, pos, k0, k1, k2, least(k3, {_add('k2', '5', 'I')}) AS k3 FROM (SELECT conv, pos, k0, k1, {user} AS k2, k3 FROM ({rows}))"


_BEGIN = "SELECT DISTINCT conv, CAST(0 AS BIGINT) AS pos, '0000000000' AS k0, CAST(NULL AS VARCHAR) AS k1, CAST(NULL AS VARCHAR) AS k2, CAST(NULL AS VARCHAR) AS k3 FROM f"
_NEXT = f"""
    SELECT w.conv, f.pos, {_add("k0", "2", "D")} AS k0, least({_add("k1", "2", "D")}, {_stays("k0", "s")}) AS k1,
      least({_add("k2", "2", "D")}, {_stays("k0", "u")}, {_stays("k1", "u")}, {_stays("k3", "u")}) AS k2,
      least({_add("k3", "2", "D")}, {_stays("k2", "a")}) AS k3
    FROM w JOIN f ON w.conv IS NOT DISTINCT FROM f.conv AND f.pos = w.pos + 1"""
#: Keys k0 to k3: of the ways to each state the cheapest, then the least in ASCII.
OP11_SQL = f"""
WITH RECURSIVE t AS (
  SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), x AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step
), d AS (
  SELECT conv, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(substr(name, CAST(i AS INTEGER), 1)) AS BIGINT))),
    lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]))) % 20 AS kind FROM t, x
), m AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS time FROM d WHERE kind <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text)) AS pos, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM m
), f AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'cut' ELSE '' END AS fault,
    substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY pos) AS before FROM o
), w AS (
  {_inserted(_BEGIN)}
  UNION ALL
  {_inserted(_NEXT)}
), e AS (
  SELECT w.conv, least(k0, k3) AS key FROM w JOIN (SELECT conv, max(pos) AS pos FROM f GROUP BY conv) AS z ON w.conv IS NOT DISTINCT FROM z.conv AND w.pos = z.pos
), l AS (
  SELECT conv, i, substr(key, CAST(10 + i AS INTEGER), 1) AS letter FROM (SELECT conv, key, unnest(range(1, length(key) - 9)) AS i FROM e)
), n AS (
  SELECT *, count_if(letter <> 'I') OVER c AS pos, count_if(letter <> 'D') OVER c AS made FROM l WINDOW c AS (PARTITION BY conv ORDER BY i)
), g AS (
  SELECT n.*, role, text, max(CASE WHEN made = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv) AS system
  FROM n LEFT JOIN f ON n.letter <> 'I' AND n.conv IS NOT DISTINCT FROM f.conv AND n.pos = f.pos
), h AS (
  SELECT conv, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (made - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY i)) AS digest
  FROM g WHERE letter <> 'D' GROUP BY conv
), s AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'cut') AS truncated,
    count_if(pos > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(CAST(substr(key, 1, 10) AS BIGINT), 0) AS cost, coalesce(substr(key, 11), '') AS audit,
  coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN s ON c.conv_id IS NOT DISTINCT FROM s.conv LEFT JOIN e ON c.conv_id IS NOT DISTINCT FROM e.conv LEFT JOIN h ON c.conv_id IS NOT DISTINCT FROM h.conv
"""

OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g
  FROM d
), n AS (
  SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM l
), s AS (
  SELECT doc_id, unnest(g) AS g FROM l
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), r AS (
  SELECT doc_id AS node, doc_id AS reached FROM d UNION SELECT r.node, e.y FROM r JOIN e ON r.reached = e.x
)
SELECT node AS doc_id, any_value(n) AS n_shingles, min(reached) AS component_id, node = min(reached) AS kept FROM r JOIN n ON n.doc_id = node GROUP BY node
"""


def _coded(books: str) -> str:
    """SQL of the nearest entry of each part among the entries of the table ``books``."""
    square = " + ".join(f"(p.x{k} - b.x{k}) * (p.x{k} - b.x{k})" for k in range(4))
    return f"SELECT vec_id, label, part, min(struct_pack(d := d, entry := entry)) AS m FROM (SELECT p.*, entry, {square} AS d FROM p JOIN {books} AS b ON p.part = b.part) GROUP BY ALL"


def _books(books: str, coded: str) -> str:
    """SQL of the entries of ``books`` after they moved to the floor of the mean of their parts."""
    mean = ", ".join(f"CAST(floor(sum(x{k}) / count(*)) AS BIGINT) AS x{k}" for k in range(4))
    moved = f"SELECT part, m.entry AS entry, {mean} FROM {coded} JOIN p USING (vec_id, part) GROUP BY part, m.entry"
    return f"SELECT b.part, b.entry, {', '.join(f'coalesce(n.x{k}, b.x{k}) AS x{k}' for k in range(4))} FROM {books} AS b LEFT JOIN ({moved}) AS n ON b.part = n.part AND b.entry = n.entry"


OP13_SQL = f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT vec_id, label, part, {", ".join(f"v[4 * part + {k + 1}] AS x{k}" for k in range(4))} FROM k, range(16) AS r(part)
), b0 AS (
  SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS BIGINT) AS entry, x0, x1, x2, x3 FROM p QUALIFY entry < 64
), c0 AS ({_coded("b0")}), b1 AS ({_books("b0", "c0")}), c1 AS ({_coded("b1")}), b2 AS ({_books("b1", "c1")}), c2 AS ({_coded("b2")}),
o AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM c2 GROUP BY vec_id
), h AS (
  SELECT sha256(string_agg(x0 || ',' || x1 || ',' || x2 || ',' || x3, ',' ORDER BY part, entry)) AS digest FROM b2
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM o, h
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_conversation_repair": OP11_SQL, "op12_minmax_hashing": OP12_SQL, "op13_ball_tree_codes": OP13_SQL,
        "op1_chat_formatting": OP1_SQL, "op3_warc_revisits": OP3_SQL, "op5_source_mixing": OP5_SQL, "op6_exact_top_k": OP6_SQL, "op9_url_filter": OP9_SQL,
    }
