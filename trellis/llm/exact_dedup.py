"""Exact dedup as a stateful stream.

A Structured Streaming aggregation without watermark keeps one state row per digest, in
the disk-backed state store, and never expires it: the number of rows seen, the largest
(stable id, content locator) and thereby the row that stays. The state lives with the
query's checkpoint, so a restarted or grown input only adds to it. Afterwards the state
is read back as a table. Digests that were hit are checked on full bytes: their texts, and
only theirs, are grouped by digest and text, which a map task combines before the shuffle.
Which rows those are is told by a bitmap of the hit digests; it is of one size whatever
the input, so with very many hits some other texts pass as well, which changes no result.
If texts differ under one digest, they are grouped by the text itself.

Only DataFrame and SQL functions are used. Equal texts meet as one partial row per map
task, and the few digests with many rows get their keeper by a broadcast of bounded size,
so a text that makes up a third of all rows is no hot key.

Defined results: a null text counts as empty; of rows that repeat id and text one stays;
a null id is smaller than any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.llm.common import join_frequent, lower_ascii, materialize, shared_dir

#: State on disk, and no space set aside for each of many small stores.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def _rows(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, locator, norm, digest); the locator is the file and the row in it."""
    norm = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    return df.select(
        F.col(id_col).alias("doc_id"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator"),
        norm.alias("norm"),
        digest(norm).alias("digest"),
    )


def track(stream: DataFrame, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Run the stream over what is there now and return its whole state:
    digest, group_size, keep struct<doc_id, locator>. A second call with the same
    checkpoint reads only new files."""
    spark = stream.sparkSession
    keyed = _rows(stream, id_col, text_col, digest)
    seen = keyed.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count("*").alias("group_size"))
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        if not spark.read.format("state-metadata").load(checkpoint).take(1):
            return spark.createDataFrame([], T.StructType([T.StructField("digest", T.StringType()), *seen.select("group_size", "keep").schema.fields]))
        state = spark.read.format("statestore").load(checkpoint)
        digest_name, (keep, count) = state.schema["key"].dataType.names[0], state.schema["value"].dataType.names
        return materialize(state.select(F.col("key")[digest_name].alias("digest"), F.col("value")[count].alias("group_size"), F.col("value")[keep].alias("keep")), "exact-dedup-state")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _place(digest: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(1 << bits))


def _marked(rows: DataFrame, hits: DataFrame, bits: int) -> DataFrame:
    """Rows whose digest has the place of one of ``hits``, by a bitmap of 2 ** bits places."""
    p = _place(F.col("digest"), bits)
    bitmaps = hits.groupBy(F.bitmap_bucket_number(p).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("bitmap"))
    at = F.bitmap_bit_position(p)
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    both = rows.withColumn("bucket", F.bitmap_bucket_number(p)).join(F.broadcast(bitmaps), "bucket")
    return both.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", checkpoint: str | None = None, digest: Callable[[Column], Column] = sha256, mark_bits: int = 24) -> DataFrame:
    """One row per row of the Parquet table at ``path``: doc_id, keep_id, group_size, kept,
    text_sha256. ``checkpoint``: keep the stream's state there for later runs; by default a
    fresh folder below the shared one. ``mark_bits``: size of the bitmap of hits."""
    table = spark.read.parquet(path)
    either = f"{path[:-1]}[{path[-1]}]"  # as a pattern, a stream takes one file as well as a folder of them
    state = track(spark.readStream.schema(table.schema).parquet(either), checkpoint or shared_dir(spark, "exact-dedup"), id_col, text_col, digest)
    rows = _rows(table, id_col, text_col, digest)
    total = state.agg(F.sum("group_size")).first()[0] or 0

    # Full bytes on hits: rows of one digest must share one text.
    texts = _marked(rows, state.where("group_size > 1"), mark_bits).groupBy("digest", "norm").agg(F.count("*").alias("n"))
    clash = texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    clash = materialize(clash, "exact-dedup-clash")

    sha = F.col("digest") if digest is sha256 else sha256(F.col("norm"))
    skinny = materialize(rows.select("doc_id", "locator", "digest", sha.alias("text_sha256")), "exact-dedup-rows")
    if clash.take(1):
        split = rows.join(clash, "digest", "left_semi").groupBy("digest", sha256(F.col("norm")).alias("text_sha256"), "norm").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count("*").alias("group_size")).drop("norm")
        clear = skinny.join(clash, "digest", "left_anti")
        out = join_frequent(clear, state.join(clash, "digest", "left_anti"), ["digest"], "group_size", total).unionByName(join_frequent(skinny, materialize(split, "exact-dedup-split"), ["digest", "text_sha256"], "group_size", total))
    else:
        out = join_frequent(skinny, state, ["digest"], "group_size", total)
    return out.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("locator") == F.col("keep.locator")).alias("kept"),
        "text_sha256",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: exact dedup of documents; of equal texts the largest id stays."""
    return dedup(spark, f"{sf_dir}/documents.parquet")


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
