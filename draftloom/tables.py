"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; in a temporary folder where none is set, in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{found.rstrip('/')}/draftloom/{name}-{uuid.uuid4().hex}" if found else f"file://{tempfile.mkdtemp(prefix='draftloom-')}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table that survives lost executors and is not computed anew by later plans."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, by: Sequence[str], rows: int, each: int = 200_000) -> DataFrame:
    """``df`` dealt by hash of ``by`` to about ``each`` of its ``rows`` a task. Adaptive execution joins shuffled partitions by
    their bytes, and numbers that compress well would be few tasks that sort very many rows; it leaves these as they are."""
    return df.repartition(max(-(-rows // each), df.sparkSession.sparkContext.defaultParallelism), *by)
