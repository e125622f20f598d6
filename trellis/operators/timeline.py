"""Logs of many keys in the order of time, cut into blocks of about as many rows each.

A block is a range of (key, order), so a key with a third of all rows is spread over many blocks
and many keys share one. Each block is worked on alone; what comes before it for its
first key is the only thing it needs of others, and only keys that cross a border have it: at most
one a block. That is told by summaries of blocks, chained key by key.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellis.sources.scratch import keep

LEAST_ROWS = 10_000


def blocked(rows: DataFrame, key: str, order: list[str], block_rows: int | None = None) -> DataFrame:
    """``rows``, written, with ``block``. Blocks have about the square root of the number of rows,
    so that neither a block nor the chain of summaries grows as fast as the log."""
    own = keep(rows, "timeline")
    n = own.count()
    parts = max(1, math.ceil(n / (block_rows or max(LEAST_ROWS, math.isqrt(n)))))
    return keep(own.repartitionByRange(parts, key, *order).withColumn("block", F.spark_partition_id()), "timeline-blocks")


def asof(events: DataFrame, facts: DataFrame, key: str, order: str, value: str, name: str, block_rows: int | None = None) -> DataFrame:
    """``events`` with ``name``, the ``value`` of the last fact of the same key at or before ``order``; null
    if there is none, if the event has no key, or if that value is null. Of facts at one time
    the largest value counts."""
    marked = events.select(F.struct(*events.columns).alias("_e"), F.col(key).alias("_k"), F.col(order).alias("_o"), F.lit(1).alias("_kind")).withColumn("_v", F.lit(None).cast(facts.schema[value].dataType))
    told = facts.where(F.col(key).isNotNull()).select(F.lit(None).cast(marked.schema["_e"].dataType).alias("_e"), F.col(key).alias("_k"), F.col(order).alias("_o"), F.lit(0).alias("_kind"), F.col(value).alias("_v"))
    rows = blocked(marked.where("_k is not null and _o is not null").unionByName(told.where("_o is not null")), "_k", ["_o", "_kind", "_v"], block_rows)
    seen = F.when(F.col("_kind") == 0, F.struct(F.col("_v").alias("v")))
    inside = F.last(seen, ignorenulls=True).over(Window.partitionBy("block", "_k").orderBy("_o", "_kind", "_v").rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.groupBy("_k", "block").agg(F.max(F.when(F.col("_kind") == 0, F.struct("_o", F.struct(F.col("_v").alias("v")).alias("s"))))["s"].alias("_s"))
    before = F.last("_s", ignorenulls=True).over(Window.partitionBy("_k").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.withColumn("_before", before).where("_before is not null").select("_k", "block", "_before")
    found = rows.withColumn("_in", inside).where("_kind = 1").join(F.broadcast(carried), ["_k", "block"], "left")  # at most a row a block
    out = found.select("_e.*", F.coalesce("_in", "_before")["v"].alias(name))
    rest = events.where(F.col(key).isNull() | F.col(order).isNull()).select("*", F.lit(None).cast(facts.schema[value].dataType).alias(name))
    return out.unionByName(rest)
