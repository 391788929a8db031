"""Helpers of the corpus operators: tables in the cluster's shared folder, and null-safe inputs."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as all operators here count them: a run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where none is named, a temporary one is set in local mode,
    as in tests; on a cluster that is an error, as executors would write to disks of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="draftloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/draftloom/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear_tables(spark: SparkSession) -> None:
    """Delete all tables that this application has written, once no result is read from them any more."""
    drop_path(spark, _own_dir(spark))


def as_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage durably."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table of :func:`as_table` that no later plan reads."""
    drop_path(df.sparkSession, df._table_path)


def drop_uses(df: DataFrame) -> None:
    """Delete the tables that a lazy result reads, once it has been written."""
    for table in df._uses:
        drop_table(table)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffle files of jobs that are over, before the next large job writes its own.

    The listeners of the last job hold its plan until they have run, so they are waited for, for a second at most.
    """
    gc.collect()
    context = spark.sparkContext._jsc.sc()
    try:
        context.listenerBus().waitUntilEmpty(1_000)
    except Py4JJavaError:  # still busy: the next call releases what this one can't
        pass
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


#: Rows of a batch that a Python worker gets: with texts of some kilobytes a few MB. Spark's own default is ten times that.
BATCH_ROWS = 1_000
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose batches for Python workers are small; a setting other than Spark's default stays."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return df


def text_bytes(col: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
