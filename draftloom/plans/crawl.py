"""What a crawl lists, counts and finds changed; who may administer it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import access, ingest, positions
from ..sources import listing
from ..tables import scratch_path
from .ingest import _FILES, _known, _seen
from .registry import query, table

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(f"SELECT name, true AS listed FROM (VALUES {', '.join(f"('{t}')" for t in _TABLES)}) AS v(name)")
def directory_listing(spark, sf_dir):
    """The folder of the tables, listed, against the names that are known: new, gone and unreadable ones would be rows of their own."""
    found = listing.list_files(spark, sf_dir)
    names = found.select(F.regexp_replace(F.split_part("path", F.lit("/"), F.lit(1)), r"\.parquet$", "").alias("name"), F.col("error").isNull().alias("ok")).groupBy("name").agg(F.bool_and("ok").alias("listed"))
    known = table(spark, sf_dir, "region").select(F.explode(F.array(*map(F.lit, _TABLES))).alias("k_name")).distinct()
    return known.join(names, F.col("k_name") == F.col("name"), "full").select(F.coalesce("k_name", "name").alias("name"), F.coalesce("listed", F.lit(False)).alias("listed"))


@query("""
SELECT c.event_id AS change_id, r.event_id AS run_id FROM events c JOIN events r ON c.user_id = r.user_id AND c.ts >= r.ts AND c.ts < r.ts + to_minutes(CAST(30 + r.event_id % 600 AS BIGINT))
WHERE c.event_type = 'error' AND r.event_type = 'view'
""")
def changed_in_runs(spark, sf_dir):
    """Errors of users that fall into the half hour to ten hours and a half after a view of theirs."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    changes = events.where("event_type = 'error'").select(F.col("user_id").alias("path"), F.col("ts").alias("at"), F.col("event_id").alias("change_id"))
    ended = F.col("ts") + F.make_dt_interval(mins=(30 + F.col("event_id") % 600).cast("int"))
    runs = events.where("event_type = 'view'").select(F.col("user_id").alias("path"), F.col("ts").alias("started"), ended.alias("ended"), F.col("event_id").alias("run_id"))
    return ingest.changed_in_runs(changes, runs).select("change_id", "run_id")


@query(f"""
WITH {_FILES} SELECT count(*) AS files, CAST(count_if(change = 'created') AS BIGINT) AS created, CAST(count_if(change = 'changed') AS BIGINT) AS changed, CAST(count_if(change = 'unchanged') AS BIGINT) AS unchanged,
  CAST(count_if(change = 'absent') AS BIGINT) AS absent, CAST(sum(size) AS BIGINT) AS bytes FROM diff
""")
def crawl_totals(spark, sf_dir):
    """The totals of a crawl, counted while its result is written."""
    diff = ingest.snapshot_diff(_known(spark, sf_dir), _seen(spark, sf_dir)).select("path", "change", "size")
    counts = {c: F.count_if(F.col("change") == c) for c in ("created", "changed", "unchanged", "absent")}
    return ingest.written_with_totals(diff, scratch_path(spark, "crawl"), files=F.count("*"), **counts, bytes=F.sum("size"))


@query("""
WITH o AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders), t AS (SELECT k FROM o WHERE (n - 1) % 5 = 0),
r AS (SELECT k, count(l_orderkey) AS rows, count_if(l_returnflag = 'R') AS refs, coalesce(bool_or(l_quantity = 50), false) AS error FROM t LEFT JOIN lineitem ON l_orderkey = k GROUP BY k)
SELECT count(*) AS files, CAST(count_if(NOT error AND rows > 0) AS BIGINT) AS with_rows, CAST(coalesce(sum(CASE WHEN error THEN 0 ELSE rows END), 0) AS BIGINT) AS rows,
  CAST(coalesce(sum(CASE WHEN error THEN 0 ELSE refs END), 0) AS BIGINT) AS refs, CAST(count_if(error) AS BIGINT) AS errors FROM r
""")
def trial_totals(spark, sf_dir):
    """A trial of every fifth order as a file: those with rows, their rows and references, and errors, counted while they are written."""
    picked = positions.every_kth(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 5)
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("rows"), F.count_if(F.col("l_returnflag") == "R").alias("refs"), F.bool_or(F.col("l_quantity") == 50).alias("error"))
    read = picked.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("refs", F.lit(0)).alias("refs"), F.coalesce("error", F.lit(False)).alias("error"))
    good = lambda c: F.coalesce(F.sum(F.when(~F.col("error"), F.col(c)).otherwise(0)), F.lit(0))
    return ingest.written_with_totals(read, scratch_path(spark, "trial"), files=F.count("*"), with_rows=F.count_if(~F.col("error") & (F.col("rows") > 0)), rows=good("rows"), refs=good("refs"), errors=F.count_if("error"))


@query("""
WITH RECURSIVE c AS (SELECT user_id AS u, event_type = 'signup' AS joins, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE event_type IN ('signup', 'error')),
s AS (
  SELECT CAST(0 AS BIGINT) AS n, [min(user_id)] AS admins, [min(user_id)] AS members FROM events
  UNION ALL
  SELECT c.n, CASE WHEN joins THEN list_distinct(list_append(admins, u)) WHEN len(admins) > 1 THEN list_filter(admins, lambda x: x <> u) ELSE admins END,
    CASE WHEN joins THEN list_distinct(list_append(members, u)) ELSE list_filter(members, lambda x: x <> u) END FROM s JOIN c ON c.n = s.n + 1
), l AS (SELECT arg_max(admins, n) AS admins, arg_max(members, n) AS members FROM s)
SELECT DISTINCT user_id AS user, list_contains(members, user_id) AS in_group, list_contains(admins, user_id) AS is_superuser FROM events, l WHERE event_type IN ('signup', 'error') OR user_id = (SELECT min(user_id) FROM events)
""")
def settled_admins(spark, sf_dir):
    """Sign-ups and errors as users that join and leave the administrators, of whom the first user is one."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), "event_type", F.col("event_id").alias("n"))
    changes = events.where("event_type in ('signup', 'error')").select("user", (F.col("event_type") == "signup").alias("joins"), "n")
    return access.settle_admins(events.agg(F.min("user").alias("user")), changes)


@query("""
SELECT event_id, '{"a":[{"k' || event_id || '":"x' || event_type || '"},["' || event_id || '","\\\\u0001"]],"p":' || props || '}' AS cleaned FROM events
""")
def nested_clean(spark, sf_dir):
    """Control characters in keys and values of nested results go, at any depth; escaped backslashes stay."""
    key = F.col("event_id").cast("string")
    json = F.concat(F.lit('{"a\\u0000":[{"\\u001Fk'), key, F.lit('":"x\\u0002'), F.col("event_type"), F.lit('\\b"},["'), key, F.lit('\\u000b","\\\\u0001"]],"p":'), F.col("props"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", fn.clean_json(json).alias("cleaned"))
