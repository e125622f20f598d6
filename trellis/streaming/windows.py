"""Windows in event time over audit entries and task events, on a stream or a table.

A stream's watermark is the largest time seen less the ``delay``. A row is late, and left out, if
its window had closed by the watermark of the micro-batch before it; what is not late is counted,
however disordered it comes. A window is emitted once, when the watermark has passed its end,
and its state goes then, so state holds open windows only. Rows without a time belong to none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, delay: str) -> DataFrame:
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null")
    return own.withWatermark("ts", delay) if events.isStreaming else own


def counts(events: DataFrame, keys: list[str], width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(start, keys, n): entries of each fixed window and key. Counts are combined before the
    shuffle, so a key with a third of all entries is a row from each map task."""
    own = _timed(events, delay).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"))
    return own.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(key, start, end, n): spells of activity of each key, with no more than ``gap`` between two
    entries; the end is the last entry's time plus the gap."""
    own = _timed(events, delay).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return own.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
