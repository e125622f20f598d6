"""Shared folder handling and small helpers of the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder that ``spark.checkpoint.dir`` names.

    Only where that setting is missing (a local session, as in tests) a temporary
    folder of this machine is made, and removed at exit.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="trellis-"))
            atexit.register(shutil.rmtree, _OWN[0], True)
        base = f"file://{_OWN[0]}"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: With it, Spark removes an execution's shuffle files as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later steps neither
    recompute it nor depend on the executors that made it, so its shuffle files go at once."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def join_frequent(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, total: int, pieces: int = 1024) -> DataFrame:
    """``rows`` joined with ``facts``, one row a key, whose column ``count`` says how many of
    the ``total`` rows have the key. Keys of more than a ``pieces``-th of all rows, of which
    there are fewer than ``pieces``, are broadcast, so the shuffled join has no hot key."""
    often = F.col(count) > F.lit(max(1, total // pieces))
    big = F.broadcast(facts.where(often))
    rest = rows.join(F.broadcast(facts.where(often).select(*keys)), keys, "left_anti")
    return rows.join(big, keys).unionByName(rest.join(facts.where(~often), keys))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that ``df`` does not use: ``names``, with underscores before them where needed."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def without(df: DataFrame, name: str) -> DataFrame:
    """``df`` without a column ``name``, in whatever case."""
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() != name.lower()])


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed: orders rows that repeat a key the same way in
    every run."""
    plain = [df[f"`{f.name}`"] for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return F.xxhash64(*plain)


def arrow_batches(spark: SparkSession, rows: int = 4000, size: int = 8 << 20) -> None:
    """Keep Arrow batches small enough that a batch of long texts fits a worker. The settings
    stay, as the plans that need them run later."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(c: Column) -> Column:
    """Number of maximal runs of characters other than blank, tab, LF, VT, FF, CR; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fold(id_col: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id is in fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string")) % k, F.lit(0))
