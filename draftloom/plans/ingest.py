"""Ingestion and queue queries: orders stand for crawled files, events for jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as op
from ..streaming import scan
from ..tables import scratch_path
from .registry import query, table


def _known(spark, sf_dir):
    """Files known before: all orders but every 7th; every 11th was missing."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0")
    return o.select(F.concat(F.lit("f/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("path"), F.col("o_totalprice").cast("bigint").alias("size"), F.col("o_orderdate").alias("mtime"), F.when(F.col("o_orderkey") % 11 == 0, "missing").otherwise("done").alias("status"), F.col("o_custkey").alias("last_seen"))


def _seen(spark, sf_dir):
    """The crawl: all orders but every 13th; every 5th a byte larger, every 3rd touched by 1.5 s, every 2nd by 0.4 s."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 13 <> 0")
    k = F.col("o_orderkey")
    mtime = F.col("o_orderdate") + F.when(k % 3 == 0, F.expr("INTERVAL '1.5' SECOND")).when(k % 2 == 0, F.expr("INTERVAL '0.4' SECOND")).otherwise(F.expr("INTERVAL '0' SECOND"))
    return o.select(F.concat(F.lit("f/"), k.cast("string"), F.lit(".pdf")).alias("path"), (F.col("o_totalprice").cast("bigint") + F.when(k % 5 == 0, 1).otherwise(0)).alias("size"), mtime.alias("mtime"))


_FILES = """
known AS (SELECT 'f/' || o_orderkey || '.pdf' AS path, o_orderkey % 11 = 0 AS was_missing, o_custkey AS last_seen, CAST(trunc(o_totalprice) AS BIGINT) AS k_size FROM orders WHERE o_orderkey % 7 <> 0),
seen AS (SELECT 'f/' || o_orderkey || '.pdf' AS path, o_orderkey AS k, CAST(trunc(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS size FROM orders WHERE o_orderkey % 13 <> 0),
diff AS (SELECT coalesce(seen.path, known.path) AS path, coalesce(seen.size, k_size) AS size, was_missing, last_seen,
  CASE WHEN known.path IS NULL THEN 'created' WHEN seen.path IS NULL THEN 'absent' WHEN k % 5 = 0 OR k % 3 = 0 OR was_missing THEN 'changed' ELSE 'unchanged' END AS change
  FROM seen FULL OUTER JOIN known ON seen.path = known.path)
"""


@query(f"WITH {_FILES} SELECT path, change, size FROM diff")
def snapshot_diff(spark, sf_dir):
    return op.snapshot_diff(_known(spark, sf_dir), _seen(spark, sf_dir)).select("path", "change", "size")


@query(f"""
WITH {_FILES} SELECT CASE WHEN change IN ('created', 'changed') THEN 'pending' WHEN was_missing THEN 'missing' ELSE 'done' END AS status,
  count(*) AS n, CAST(sum(CASE WHEN change = 'absent' THEN last_seen ELSE 99 END) AS BIGINT) AS seen FROM diff GROUP BY 1
""")
def scan_upsert(spark, sf_dir):
    files = op.upsert(_known(spark, sf_dir), _seen(spark, sf_dir), F.lit(99).cast("bigint"))
    return files.groupBy("status").agg(F.count("*").alias("n"), F.sum("last_seen").alias("seen"))


@query("SELECT event_type, count(*) FILTER (WHERE event_id % 4 >= 2) AS n_changed, count(*) FILTER (WHERE event_id % 4 < 2) AS n_same FROM events GROUP BY 1")
def mtime_tolerance(spark, sf_dir):
    """Times moved by 0, 0.999999, 1 and 2 seconds: from a second on a file counts as changed."""
    moved = F.col("ts") + F.expr("CASE event_id % 4 WHEN 0 THEN INTERVAL '0' SECOND WHEN 1 THEN INTERVAL '0.999999' SECOND WHEN 2 THEN INTERVAL '1' SECOND ELSE INTERVAL '2' SECOND END")
    events = table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    one = F.lit(1)
    flagged = events.withColumn("changed", op.changed(one, moved, one, F.col("ts"), F.lit("done")))
    return flagged.groupBy("event_type").agg(F.count_if("changed").alias("n_changed"), F.count_if(~F.col("changed")).alias("n_same"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def batch_last_wins(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return op.last_wins(events, "user_id", [F.col("ts"), F.col("event_id")]).drop("ts")


@query("""
SELECT CASE WHEN c_acctbal > 0 AND c_custkey < 500 THEN 'missing' ELSE 'done' END AS status, count(*) AS n FROM customer GROUP BY 1
""")
def mark_missing(spark, sf_dir):
    """Customers as files: a negative balance means never seen (null), and stays."""
    files = table(spark, sf_dir, "customer").select(F.lit("done").alias("status"), F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).alias("last_seen"))
    return op.mark_missing(files, F.lit(500), complete=True).groupBy("status").agg(F.count("*").alias("n"))


_JOBS = "jobs AS (SELECT event_id AS id, user_id AS path, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' WHEN 'view' THEN 'queued' ELSE 'done' END AS state, ts AS updated_at, event_id % 3 AS priority, event_id % 4 AS attempts FROM events)"


def _jobs(spark, sf_dir):
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "queued").otherwise("done")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("path"), state.alias("state"), F.col("ts").alias("updated_at"),
        (F.col("event_id") % 3).alias("priority"), (F.col("event_id") % 4).alias("attempts"), F.lit("parse").alias("stage"),
    )


@query(f"WITH {_JOBS} SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT path FROM jobs WHERE state IN ('queued', 'running'))")
def busy_anti_join(spark, sf_dir):
    jobs = _jobs(spark, sf_dir).withColumnRenamed("path", "c_custkey")
    return op.without_busy(table(spark, sf_dir, "customer").select("c_custkey"), jobs, "c_custkey")


@query(f"""
WITH {_JOBS}, m AS (SELECT max(updated_at) AS now FROM jobs), r AS (SELECT id, priority, attempts FROM jobs, m WHERE state = 'queued' OR (state = 'running' AND updated_at < now - INTERVAL 30 MINUTE))
SELECT id, priority, attempts + 1 AS attempts, 'running' AS state FROM r ORDER BY priority, id LIMIT 20
""")
def lease_claim_topk(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    now = jobs.agg(F.max("updated_at").alias("now"))
    return op.claim(jobs.join(now, F.lit(True)), F.col("now"), 50).select("id", "priority", "attempts", "state")


@query(f"WITH {_JOBS} SELECT CASE WHEN attempts < 3 AND id % 5 <> 0 THEN 'queued' ELSE 'failed' END AS next, count(*) AS n FROM jobs WHERE state = 'failed' GROUP BY 1")
def retry_transition(spark, sf_dir):
    failed = _jobs(spark, sf_dir).where("state = 'failed'")
    return failed.groupBy(op.after_failure(F.col("attempts"), F.col("id") % 5 == 0).alias("next")).agg(F.count("*").alias("n"))


@query("""
WITH new AS (SELECT l_orderkey, l_linenumber, l_partkey + 1 AS l_partkey FROM lineitem WHERE l_orderkey % 10 = 0 AND l_linenumber <= 2)
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM new) UNION ALL SELECT * FROM new
""")
def replace_upsert(spark, sf_dir):
    """New results for every tenth order, with fewer rows: what they had goes."""
    old = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    new = old.where("l_orderkey % 10 = 0 AND l_linenumber <= 2").withColumn("l_partkey", F.col("l_partkey") + 1)
    return op.replace(old, new, "l_orderkey")


@query(f"""
WITH {_JOBS} SELECT c_name AS path, 'queued' AS state, 200 AS priority FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'
  AND c_custkey NOT IN (SELECT path FROM jobs WHERE state IN ('queued', 'running')) ORDER BY c_name LIMIT 40
""")
def requeue_plan(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    files = customers.select(F.col("c_name").alias("path"), F.when(F.col("c_acctbal") > 0, "done").otherwise("missing").alias("status"), "c_mktsegment")
    jobs = _jobs(spark, sf_dir).join(customers.select(F.col("c_custkey").alias("path"), "c_name"), "path").select(F.col("c_name").alias("path"), "state")
    return op.requeue(files, jobs, F.col("c_mktsegment") == "BUILDING", 40)


@query(f"WITH {_JOBS} SELECT priority, count(*) FILTER (WHERE state = 'queued') AS queued, count(*) FILTER (WHERE state = 'running') AS running, count(*) FILTER (WHERE state = 'failed') AS failed FROM jobs GROUP BY 1")
def job_state_pivot(spark, sf_dir):
    counts = _jobs(spark, sf_dir).groupBy("priority").pivot("state", ["queued", "running", "failed"]).agg(F.count("id"))
    return counts.fillna(0, ["queued", "running", "failed"])


@query("SELECT o_custkey, sha1(arg_max(o_orderkey || '|' || o_orderpriority, o_orderkey)) AS cache_key, max(o_orderkey) AS at FROM orders GROUP BY 1")
def cache_newest(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("at", F.col("o_orderkey"))
    return op.newest_by_key(orders, "o_custkey", F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority"), "at")


def _stream_path(sf_dir):
    """As a pattern, so that a stream takes a table that is one file as well as one that is a folder."""
    return f"{sf_dir}/events.parque[t]"


@query("""
SELECT user_id AS path, CAST(arg_max(event_id, ts) AS BIGINT) AS size, max(ts) AS mtime, 'pending' AS status FROM (
  SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY 1, 2) GROUP BY 1
""")
def stream_scan_upsert(spark, sf_dir):
    """Events as a stream of crawled files, drained in micro-batches into a table: each user's last event."""
    schema = table(spark, sf_dir, "events").schema
    root = scratch_path(spark, "scan")
    to_files = lambda b: b.select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("size"), F.col("ts").alias("mtime"), F.struct("ts", "event_id").alias("arrival"))
    scan.upsert_stream(spark, _stream_path(sf_dir), schema, f"{root}/files", f"{root}/checkpoint", to_files)
    files = scan.latest_version(spark, f"{root}/files")
    return files.select(F.col("path").cast("bigint").alias("path"), "size", "mtime", "status")


@query("""
WITH RECURSIVE w AS (SELECT (epoch_us(max(ts)) // 1000 - 3600000) * 1000 + 999 AS now FROM events),
e AS (
  SELECT user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n, epoch_us(ts) AS us,
    CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'done' WHEN 'error' THEN 'fail' ELSE 'requeue' END AS action
  FROM events, w WHERE epoch_us(ts) <= now
), s AS (
  SELECT DISTINCT job, CAST(0 AS BIGINT) AS n, 'queued' AS state, CAST(0 AS BIGINT) AS attempts, CAST(-1 AS BIGINT) AS since FROM e
  UNION ALL
  SELECT job, n, CASE WHEN state = 'queued' AND action = 'claim' THEN 'running' WHEN state = 'running' AND action = 'done' THEN 'done' WHEN state = 'running' AND action = 'fail' THEN CASE WHEN attempts < 3 THEN 'queued' ELSE 'failed' END
      WHEN state IN ('failed', 'done') AND action = 'requeue' THEN 'queued' ELSE state END,
    CASE WHEN state = 'queued' AND action = 'claim' THEN attempts + 1 ELSE attempts END,
    CASE WHEN (state = 'queued' AND action = 'claim') OR (state = 'running' AND action IN ('done', 'fail')) OR (state IN ('failed', 'done') AND action = 'requeue') THEN us ELSE since END
  FROM (SELECT e.job, e.n, e.us, e.action, s.attempts, CASE WHEN s.state = 'running' AND us - since > 1800000000 THEN 'queued' ELSE s.state END AS state,
    CASE WHEN s.state = 'running' AND us - since > 1800000000 THEN since + 1800000000 ELSE since END AS since FROM s JOIN e ON e.job = s.job AND e.n = s.n + 1)
), l AS (SELECT job, arg_max(state, n) AS state, arg_max(attempts, n) AS attempts, arg_max(since, n) AS since FROM s GROUP BY job)
SELECT job, CASE WHEN state = 'running' AND now - since > 1800000000 THEN 'queued' ELSE state END AS state, attempts, CASE WHEN state = 'running' AND now - since > 1800000000 THEN since + 1800000000 ELSE since END AS since FROM l, w WHERE since >= 0
""")
def stream_job_state(spark, sf_dir):
    """Events as actions on jobs through the stateful stream: the state of each job an hour before the last event."""
    kind = F.col("event_type")
    action = F.when(kind == "view", "claim").when(kind == "click", "done").when(kind == "error", "fail").otherwise("requeue")
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(_stream_path(sf_dir))
    with scan.with_timers(spark):
        return scan.drained(scan.job_states(stream.select(F.col("user_id").alias("job"), action.alias("action"), F.col("ts").alias("at"), F.col("event_id").alias("event"))), "job", scratch_path(spark, "jobs"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext_tumbling(spark, sf_dir):
    """Extension: tumbling windows."""
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return scan.windowed_counts(events, "ts", "event_type", "6 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""
WITH w AS (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * k) AS start FROM events, (VALUES (0), (1)) AS v(k))
SELECT start, event_type, count(*) AS n FROM w GROUP BY 1, 2
""")
def ext_sliding(spark, sf_dir):
    """Extension: 12-hour windows every 6 hours."""
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return scan.windowed_counts(events, "ts", "event_type", "12 hours", "6 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, s
""")
def ext_session(spark, sf_dir):
    """Extension: sessions of a user, two hours apart."""
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    found = scan.sessions(events, "ts", "user_id", "2 hours")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
