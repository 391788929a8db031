"""Streaming forms of ingestion: micro-batch upserts and the job state machine."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators import ingest

#: How long a job may run without news, in microseconds; times of states are microseconds too, watermarks milliseconds.
LEASE = 30 * 60 * 1_000_000
#: What moves a job from a state; everything else leaves it.
MOVES = {("queued", "claim"): "running", ("running", "done"): "done", ("failed", "requeue"): "queued", ("done", "requeue"): "queued"}


def upsert_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, to_files, files_per_batch: int = 1) -> None:
    """Drain a folder of Parquet files into versions of a table of files below ``target``.

    ``to_files`` turns a micro-batch into rows of path, size, mtime, arrival. A batch writes its version under its own
    number, so a batch that is run again after a failure overwrites the same version: the result is exactly-once.
    """
    incoming = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def merge(batch: DataFrame, number: int) -> None:
        seen = ingest.last_wins(to_files(batch), "path", [F.col("arrival")])
        known = _version(spark, target, number - 1) if number else None
        if known is None:
            known = spark.createDataFrame([], "path string, size bigint, mtime timestamp_ntz, status string, last_seen bigint")
        ingest.upsert(known, seen, F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{target}/v={number}")

    query = incoming.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _version(spark: SparkSession, target: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{target}/v={number}")


def latest_version(spark: SparkSession, target: str) -> DataFrame:
    """The newest version that a stream has written."""
    versions = spark.read.option("basePath", target).parquet(target)
    last = versions.agg(F.max("v").alias("v")).first()["v"]
    return _version(spark, target, last)


class _JobStates(StatefulProcessor):
    """A job's state and the events that are not settled yet. Everything up to the watermark is settled, in order of event time, when
    a timer fires: one stands at the oldest event that waits, one at the end of a running job's lease."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "state string, attempts long, at long")
        self.waiting = handle.getListState("waiting", "at long, event long, action string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            times = batch["at"].astype("datetime64[us]").astype("int64")
            self.waiting.appendList([(int(at), int(e), str(a)) for at, e, a in zip(times, batch["event"], batch["action"], strict=True)])
            first = int(times.min()) if first is None else min(first, int(times.min()))
        self.handle.registerTimer(first // 1_000)
        yield _no_states()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1_000 + 999
        before = tuple(self.job.get()) if self.job.exists() else ("queued", 0, -1)
        waiting = sorted(tuple(w) for w in self.waiting.get()) if self.waiting.exists() else []
        found = before
        for at, _, action in waiting:
            if at > now:
                break
            found = leased(found, at)
            state, attempts = advance(found[0], found[1], action)
            if (state, attempts) != found[:2]:
                found = (state, attempts, at)
        found = leased(found, now)
        later = [w for w in waiting if w[0] > now]
        if len(later) < len(waiting):
            self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self.handle.registerTimer(later[0][0] // 1_000)
        if found == before:
            yield _no_states()
            return
        self.job.update(found)
        if found[0] == "running":
            self.handle.registerTimer((found[2] + LEASE) // 1_000 + 1)
        yield pd.DataFrame([(key[0], *found)], columns=["job", "state", "attempts", "since"])

    def close(self) -> None:
        pass


def _no_states() -> pd.DataFrame:
    return pd.DataFrame({"job": pd.Series(dtype="int64"), "state": pd.Series(dtype="str"), "attempts": pd.Series(dtype="int64"), "since": pd.Series(dtype="int64")})


def leased(job: tuple[str, int, int], now: int) -> tuple[str, int, int]:
    """A job (state, attempts, at) by a time: one that has run for longer than its lease without news waits again."""
    return ("queued", job[1], job[2] + LEASE) if job[0] == "running" and now - job[2] > LEASE else job


def job_states(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(job, state, attempts, since): a row for each change of a job's state that the watermark has passed; since is its event time in
    microseconds. ``events``: job, action, at (timestamp), event (orders events of one time).

    Events are settled in order of event time, across micro-batches, and leases end by event time, so the states do not depend on
    how events are dealt to micro-batches, as long as none is later than ``late``. Needs the RocksDB state store, see
    :func:`with_timers`.
    """
    timed = events.select("job", "action", F.col("at").cast("timestamp").alias("at"), "event").withWatermark("at", late)
    return timed.groupBy("job").transformWithStateInPandas(_JobStates(), "job long, state string, attempts long, since long", "Update", "EventTime")


@contextmanager
def with_timers(spark: SparkSession) -> Iterator[None]:
    """The state store that timers and lists need, for streams that are started within; the session's own comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def drained(stream: DataFrame, key: str, root: str) -> DataFrame:
    """The last row of each key that an update stream gives until its source is drained; batches are written under their own number
    below ``root``, so a batch that runs again writes the same files."""
    spark, out = stream.sparkSession, f"{root}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/b={number}")

    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return ingest.last_wins(spark.read.parquet(f"{out}/b=*"), key, [F.col("batch")]).drop("batch")


def advance(state: str, attempts: int, action: str) -> tuple[str, int]:
    """One move of the state machine: a failed job is queued again until it has had its attempts."""
    if (state, action) == ("running", "fail"):
        return ("queued" if attempts < ingest.MAX_ATTEMPTS else "failed"), attempts
    if (state, action) == ("queued", "claim"):
        return "running", attempts + 1
    return MOVES.get((state, action), state), attempts


def windowed_counts(events: DataFrame, at: str, key: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling or sliding counts with a watermark; the same on a stream and on a table."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    counted = events.withWatermark(at, late).groupBy(w, key).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def sessions(events: DataFrame, at: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Session counts with a watermark."""
    counted = events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")
