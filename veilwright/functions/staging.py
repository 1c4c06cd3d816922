"""Durable cuts in a job: tables written to the shared scratch folder.

A staged table survives lost executors, freezes what was computed (so that ids derived from partitions
stay what they were), and tells Catalyst its true size, so joins against it are broadcast only when it is
really small.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


_staged: list[str] = []
_local_root: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="veilwright-"))
    return _local_root[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/veilwright/{label}-{uuid.uuid4().hex}"


TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs meanwhile go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)


def stage(df: DataFrame, label: str = "stage", tidy: bool = False) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads it back. ``tidy``: remove its shuffle files at once; not for jobs that
    run side by side in one session."""
    return stage_parts([df], label, tidy)


def stage_parts(parts: Iterable[DataFrame], label: str = "stage", tidy: bool = False) -> DataFrame:
    """Write DataFrames of one schema, each before the next one is asked for, and return a DataFrame that reads all of them."""
    path = None
    for df in parts:
        if path is None:
            spark, schema = df.sparkSession, df.schema
            path = scratch_path(spark, label)
            _staged.append(path)
        with _tidied(spark) if tidy else nullcontext():
            df.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; for a staged table the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(spark: SparkSession) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes; 0 when broadcasting is off."""
    return max(0, int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()))


def release(spark: SparkSession) -> int:
    """Delete the tables this process has staged; call it once their results are written. Returns how many."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    count = 0
    while _staged:
        path = hadoop.Path(_staged.pop())
        count += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return count
