"""Snapshot ingestion and the job queue, as table transformations.

One writer at a time is assumed: Spark has no row locks, so two claims that run at once could take the same jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

MTIME_TOLERANCE, STALE_AFTER = "INTERVAL 1 SECOND", "INTERVAL 30 MINUTES"
MAX_ATTEMPTS, MAX_CLAIM = 3, 20
NEW_PRIORITY, REQUEUE_PRIORITY = 100, 200
#: Extensions that are taken in, and the kind they stand for.
KINDS = {"dxf": "dxf", "pdf": "pdf"}


def last_wins(batch: DataFrame, key: str, arrival: Sequence[Column]) -> DataFrame:
    """One row per key: the last to arrive. A maximum over structs, so partial results shrink before the shuffle."""
    rest = [c for c in batch.columns if c != key]
    last = F.max(F.struct(*[a.alias(f"a{n}") for n, a in enumerate(arrival)], *rest)).alias("s")
    return batch.groupBy(key).agg(last).select(key, *[F.col(f"s.{c}") for c in rest])


def accepted(batch: DataFrame) -> DataFrame:
    """Rows of a crawl (path, size, mtime) that are valid: known extension, whole size, finite time; paths made uniform."""
    path = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), "^/+", "")
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    kind = F.coalesce(*[F.when(extension == e, k) for e, k in KINDS.items()])
    return batch.withColumn("path", path).withColumn("kind", kind).where("kind is not null and path <> '' and size is not null and mtime is not null")


def changed(size: Column, mtime: Column, known_size: Column, known_mtime: Column, status: Column) -> Column:
    """A different size, a time a second or more apart, or a file that had been missing."""
    apart = F.abs(F.unix_micros(mtime.cast("timestamp")) - F.unix_micros(known_mtime.cast("timestamp"))) >= 1_000_000
    return (size != known_size) | apart | (status == "missing")


def snapshot_diff(known: DataFrame, seen: DataFrame) -> DataFrame:
    """(path, change, size, mtime): created, changed, unchanged, or absent from the snapshot. Both sides: path, size, mtime;
    known also status. A single full outer join on path."""
    k = known.select("path", F.col("size").alias("k_size"), F.col("mtime").alias("k_mtime"), F.col("status").alias("k_status"))
    both = seen.select("path", "size", "mtime").join(k, "path", "full_outer")
    differs = changed(F.col("size"), F.col("mtime"), F.col("k_size"), F.col("k_mtime"), F.col("k_status"))
    change = F.when(F.col("k_size").isNull(), "created").when(F.col("size").isNull(), "absent").when(differs, "changed").otherwise("unchanged")
    return both.select("path", change.alias("change"), F.coalesce("size", "k_size").alias("size"), F.coalesce("mtime", "k_mtime").alias("mtime"))


def upsert(known: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """The new table of files: path, size, mtime, status, last_seen. Created and changed files are pending; unchanged files
    keep their status; absent files stay as they were."""
    k = known.select("path", F.col("size").alias("k_size"), F.col("mtime").alias("k_mtime"), F.col("status").alias("k_status"), F.col("last_seen").alias("k_seen"))
    both = seen.select("path", "size", "mtime").join(k, "path", "full_outer")
    absent, new = F.col("size").isNull(), F.col("k_size").isNull()
    differs = changed(F.col("size"), F.col("mtime"), F.col("k_size"), F.col("k_mtime"), F.col("k_status"))
    take = ~absent & (new | differs)
    return both.select(
        "path", F.when(take, F.col("size")).otherwise(F.col("k_size")).alias("size"), F.when(take, F.col("mtime")).otherwise(F.col("k_mtime")).alias("mtime"),
        F.when(take, "pending").otherwise(F.col("k_status")).alias("status"), F.when(absent, F.col("k_seen")).otherwise(now).alias("last_seen"),
    )


def mark_missing(files: DataFrame, started: Column, complete: bool) -> DataFrame:
    """After a complete crawl, files not seen since it started are missing; a null last_seen compares as unknown and stays."""
    if not complete:
        return files
    return files.withColumn("status", F.when(F.col("last_seen") < started, "missing").otherwise(F.col("status")))


def without_busy(files: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """Files with no queued or running job."""
    busy = jobs.where(F.col("state").isin("queued", "running")).select(F.col(key).alias("busy_key"))
    return files.join(busy, F.col(key) == F.col("busy_key"), "left_anti")


def reclaimed(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs that have not moved for STALE_AFTER are queued again."""
    stale = (F.col("state") == "running") & (F.col("updated_at") < now - F.expr(STALE_AFTER))
    return jobs.withColumn("state", F.when(stale, "queued").otherwise(F.col("state")))


def claim(jobs: DataFrame, now: Column, limit: int, stages: Sequence[str] = ("parse",)) -> DataFrame:
    """The jobs that a worker gets: the first by priority and id, at most MAX_CLAIM, with one more attempt."""
    n = max(1, min(limit, MAX_CLAIM))
    ready = reclaimed(jobs, now).where((F.col("state") == "queued") & F.col("stage").isin(*stages))
    return ready.orderBy("priority", "id").limit(n).withColumns({"state": F.lit("running"), "attempts": F.col("attempts") + 1})


def after_failure(attempts: Column, permanent: Column) -> Column:
    """State of a job that failed: queued again below MAX_ATTEMPTS unless the failure is permanent."""
    return F.when((attempts < MAX_ATTEMPTS) & ~permanent, "queued").otherwise("failed")


def replace(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """Rows of owners that have a new result are replaced as a whole, also by fewer rows; others stay."""
    owners = new.select(F.col(owner).alias("new_owner")).distinct()
    return old.join(owners, F.col(owner) == F.col("new_owner"), "left_anti").unionByName(new)


def requeue(files: DataFrame, jobs: DataFrame, where: Column, limit: int) -> DataFrame:
    """New low-priority jobs for files that are not missing, fit the filter and have no open job; the first by path."""
    idle = without_busy(files.where((F.col("status") != "missing") & where), jobs, "path")
    return idle.orderBy("path").limit(limit).select("path", F.lit("queued").alias("state"), F.lit(REQUEUE_PRIORITY).alias("priority"))


def newest_by_key(rows: DataFrame, owner: str, key: Column, at: str) -> DataFrame:
    """Cache entries to keep: per owner the newest, under a hash of what the entry was made from."""
    return last_wins(rows.select(owner, F.sha1(key.cast("binary")).alias("cache_key"), at), owner, [F.col(at)])


def cache_misses(files: DataFrame, cache: DataFrame, version: int) -> DataFrame:
    """Pages whose result is not cached: by content hash, page and resolution, in the current version of the results."""
    known = cache.where(F.col("version") == version).select("sha256", "page_no", "dpi")
    return files.join(known, ["sha256", "page_no", "dpi"], "left_anti")


def result_entries(payloads: DataFrame, drawing: str, pages: str, bom: str) -> DataFrame:
    """(job_id, entry): the drawings of a result; the older form, with one drawing at the top level, is its page 1.

    payloads: job_id, data (JSON). ``drawing``, ``pages`` and ``bom`` are the Spark types of the parts.
    """
    parts = f"drawing: {drawing}, pages: {pages}, bom: {bom}"
    parsed = F.from_json("data", f"struct<drawings: array<struct<page_no: int, {parts}>>, {parts}>")
    rows = payloads.select("job_id", parsed.alias("p"))
    single = F.array(F.struct(F.lit(1).alias("page_no"), "p.drawing", "p.pages", "p.bom"))
    return rows.select("job_id", F.explode(F.coalesce("p.drawings", single)).alias("entry"))


def complete(jobs: DataFrame, files: DataFrame, drawings: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, files, drawings) after results arrived.

    jobs: id, path, state, error; files: path, sha256, status, error; drawings: path, page_no and what entries have; results:
    job_id, at, sha256, entries (array of structs: page_no and the other columns of drawings). Only results of running jobs
    count, the first one of a job, and of several jobs of a file the last. Its file is done and holds the result's drawings
    alone: pages that it does not name go, also all of them; a page without a number is page 1, of a page named twice the
    last entry stays.
    """
    first = results.groupBy("job_id").agg(F.min_by(F.struct("sha256", "entries"), "at").alias("r"))
    done = jobs.where("state = 'running'").select("id", "path").join(first, F.col("id") == F.col("job_id")).select("id", "path", "r")
    ended = jobs.join(done.select(F.col("id").alias("done_id")), F.col("id") == F.col("done_id"), "left")
    has = F.col("done_id").isNotNull()
    new_jobs = ended.withColumns({"state": F.when(has, "done").otherwise(F.col("state")), "error": F.when(has, "").otherwise(F.col("error"))}).drop("done_id")

    latest = done.groupBy(F.col("path").alias("done_path")).agg(F.max_by("r", "id").alias("r"))
    stored = files.join(latest.select("done_path", F.substring(F.coalesce("r.sha256", F.lit("")), 1, 64).alias("new_sha")), F.col("path") == F.col("done_path"), "left")
    known = F.col("done_path").isNotNull()
    values = {"sha256": F.col("new_sha"), "status": F.lit("done"), "error": F.lit("")}
    new_files = stored.withColumns({c: F.when(known, v).otherwise(F.col(c)) for c, v in values.items()}).select(*files.columns)

    rest = [c for c in drawings.columns if c not in ("path", "page_no")]
    entries = latest.select(F.col("done_path").alias("path"), F.posexplode("r.entries").alias("place", "e"))
    paged = entries.select("path", F.coalesce("e.page_no", F.lit(1)).alias("page_no"), "place", F.struct(*[F.col(f"e.{c}") for c in rest]).alias("d"))
    pages = paged.groupBy("path", "page_no").agg(F.max_by("d", "place").alias("d")).select("path", "page_no", *[F.col(f"d.{c}") for c in rest])
    kept = drawings.join(latest.select("done_path"), F.col("path") == F.col("done_path"), "left_anti")
    return new_jobs, new_files, kept.unionByName(pages)


def changed_in_runs(changes: DataFrame, runs: DataFrame, longest: int = 1800) -> DataFrame:
    """Changes (path, at) that fall into a run (path, started, ended) of the same file, with both rows' columns: what the run saw is
    already old, so the file has to be queued again. From the start on, up to before the end.

    Both sides meet in cells of ``longest`` seconds, a run in each one that it touches, so a file of very many changes and runs is
    many small groups; a run no longer than that touches two.
    """
    cell = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (longest * 1_000_000))
    during = runs.withColumnRenamed("path", "run_path").withColumn("cell", F.explode(F.sequence(cell(F.col("started")), cell(F.col("ended")))))
    at = changes.withColumn("at_cell", cell(F.col("at")))
    met = at.join(during, (F.col("path") == F.col("run_path")) & (F.col("at_cell") == F.col("cell")) & (F.col("at") >= F.col("started")) & (F.col("at") < F.col("ended")))
    return met.drop("run_path", "cell", "at_cell")


def written_with_totals(rows: DataFrame, path: str, /, **totals: Column) -> DataFrame:
    """Write ``rows`` as Parquet and return one row of totals that were counted as they were written: no second pass over them."""
    seen = Observation()
    rows.observe(seen, *[c.alias(n) for n, c in totals.items()]).write.mode("overwrite").parquet(path)
    found = seen.get
    kinds = rows.limit(0).agg(*[c.alias(n) for n, c in totals.items()]).schema
    return rows.sparkSession.createDataFrame([tuple(found[n] for n in totals)], kinds)
