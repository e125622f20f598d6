"""Folders for tables that a query writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_WRITTEN: list[str] = []


def folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one (``spark.checkpoint.dir``); only where none is set
    in a local session, as in tests, below a temporary one of this machine, removed at exit."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="trellis-"))
            atexit.register(shutil.rmtree, _OWN[0], True)
        base = f"file://{_OWN[0]}"
    _WRITTEN.append(f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def release(spark: SparkSession) -> int:
    """Remove all folders that this process was given and has not released yet, once what was
    built on them has been used; returns how many there were."""
    n = 0
    while _WRITTEN:
        where = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return n


#: With it, Spark removes an execution's shuffle files as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below the shared folder and read back, so that it is worked out once,
    whatever is built on it, and the planner knows its size. Its shuffle files go at once."""
    spark = df.sparkSession
    path = folder(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)
