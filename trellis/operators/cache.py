"""Replay of the query cache over a log of requests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from trellis.schema import CONFIG
from trellis.sources.scratch import folder

#: No entry ends as late.
FOREVER = 2**63 - 1


def _blocks(log: DataFrame, order: list[str], label: str) -> DataFrame:
    """The log cut into blocks of about as many rows each by ``order``, whatever the keys, and
    written once, as the blocks are read twice and a second cut could differ."""
    spark = log.sparkSession
    path = folder(spark, label)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    log.repartitionByRange(parts, *order).withColumn("block", F.spark_partition_id()).write.parquet(path)
    return spark.read.schema(StructType([*log.schema.fields, StructField("block", IntegerType())])).parquet(path)


def _runs(b: pd.DataFrame) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """(key, first row, times, rows that are a miss for certain) of each key of a sorted block."""
    key, at, miss = b["k"].to_numpy(), b["at"].to_numpy(np.int64), b["miss"].to_numpy(bool)
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(b) else np.zeros(0, int)
    for lo, hi in zip(starts, np.append(starts[1:], len(b)), strict=True):
        yield key[lo], lo, at[lo:hi], miss[lo:hi]


def _next_misses(at: np.ndarray, miss: np.ndarray, ttl: int) -> np.ndarray:
    """The row of the miss after a miss at each row, or the number of rows."""
    sure = np.append(np.flatnonzero(miss), len(at))
    own = np.arange(len(at))
    old = np.maximum(own + 1, np.searchsorted(at, at + ttl))
    return np.minimum(old, sure[np.searchsorted(sure, own, "right")])


def _expire(log: DataFrame, ttl: int) -> DataFrame:
    """``log`` (k, at, seq, miss and others) with ``hit``: in each key an entry lives for
    ``ttl`` from its miss, and rows with ``miss`` are misses in any case.

    A block's effect on a key is a step function: from when the entry before it ends to when
    the entry after it was stored. Blocks are summarised and replayed side by side, and only
    these functions are chained by key. A function has a step for each later entry that can
    follow, so no more than the key's requests in its first ``ttl`` of the block."""
    blocks = _blocks(log, ["k", "at", "seq"], "cache-ttl")

    def summarise(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, _, at, miss in _runs(b.sort_values(["k", "at", "seq"], kind="stable")):
            after = _next_misses(at, miss, ttl)
            last = at.copy()
            for i in range(len(at) - 1, -1, -1):
                if after[i] < len(at):
                    last[i] = last[after[i]]
            # the first row that is a miss is one of these
            n = min(len(at), int(np.searchsorted(at, at[0] + ttl)) + 1)
            sure = np.flatnonzero(miss[:n])
            n = int(sure[0]) + 1 if len(sure) else n
            until = at[:n].copy()
            if len(sure):
                until[-1] = FOREVER
            ends = np.flatnonzero(np.append(last[1:n] != last[: n - 1], True))
            out.append((k, key[0], until[ends], last[ends]))
        return pd.DataFrame(out, columns=["k", "block", "until", "last"])

    def chain(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        out, stored = [], None
        for block, until, last in b.sort_values("block")[["block", "until", "last"]].itertuples(index=False):
            out.append((key[0], block, stored))
            i = 0 if stored is None else int(np.searchsorted(until, stored + ttl))
            stored = int(last[i]) if i < len(last) else stored
        return pd.DataFrame({"k": [x[0] for x in out], "block": [x[1] for x in out], "stored": pd.array([x[2] for x in out], "Int64")})

    def replay(b: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        stored = {k: int(t) for k, t in zip(before["k"], before["stored"], strict=True) if not pd.isna(t)}
        b = b.sort_values(["k", "at", "seq"], kind="stable")
        hit = np.ones(len(b), bool)
        for k, lo, at, miss in _runs(b):
            after = _next_misses(at, miss, ttl)
            sure = np.append(np.flatnonzero(miss), len(at))
            i = min(int(np.searchsorted(at, stored[k] + ttl)), int(sure[0])) if k in stored else 0
            while i < len(at):
                hit[lo + i] = False
                i = int(after[i])
        return b.assign(hit=hit)[names]

    steps = blocks.groupBy("block").applyInPandas(summarise, "k string, block int, until array<long>, last array<long>")
    before = steps.groupBy("k").applyInPandas(chain, "k string, block int, stored long")
    out = StructType([*log.schema.fields, StructField("hit", BooleanType())])
    names = out.names
    return blocks.groupBy("block").cogroup(before.where("stored is not null").groupBy("block")).applyInPandas(replay, out)


def _name(*cols: str) -> Column:
    """One text for the values of ``cols``, null included."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in cols]))


def replay_ttl(log: DataFrame, ttl: int = CONFIG.cache_ttl_s) -> DataFrame:
    """Hit or miss of each request if entries end by age alone: a miss stores the entry, a
    hit doesn't renew it. A request without a time is a miss and stores nothing."""
    rows = log.select(_name("cache_key").alias("k"), "cache_key", F.col("at").cast("long").alias("at"), "seq", F.lit(False).alias("miss"))
    timed = _expire(rows.where("at is not null"), ttl).select("cache_key", "seq", "hit")
    return timed.unionByName(rows.where("at is null").select("cache_key", "seq", F.lit(False).alias("hit")))


def replay_lru(log: DataFrame, size: int = CONFIG.cache_size, ttl: int = CONFIG.cache_ttl_s) -> DataFrame:
    """Hit or miss of each request with both limits. Any use renews a key's place, expired or
    not, so a cache holds its last ``size`` different keys: a block of the log is summarised by
    these, and its start is the last ``size`` of all blocks before. With that, evictions are
    found side by side, and then age counts by key, where a request of an evicted key is a
    miss. Logs of several caches run side by side by ``cache``."""
    named = log if "cache" in log.columns else log.withColumn("cache", F.lit("all"))
    rows = named.select("cache", _name("cache").alias("c"), _name("cache", "cache_key").alias("k"), F.col("at").cast("long").alias("at"), "seq")
    blocks = _blocks(rows, ["c", "at", "seq"], "cache-lru")

    def summarise(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["c", "at", "seq"], kind="stable", na_position="first").drop_duplicates("k", keep="last").groupby("c", sort=False).tail(size)
        return pd.DataFrame({"c": b["c"], "block": key[0], "place": np.arange(len(b)), "k": b["k"]})

    def chain(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        out, own = [], {}
        for block, some in b.sort_values(["block", "place"]).groupby("block"):
            out += [(key[0], block, i, k) for i, k in enumerate(own)]
            for k in some["k"]:
                own.pop(k, None)
                own[k] = None
            own = dict.fromkeys(list(own)[-size:] if size > 0 else [])
        return pd.DataFrame(out, columns=["c", "block", "place", "k"])

    def evictions(b: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        own: dict[str, dict[str, None]] = {}
        for c, k in before.sort_values(["c", "place"])[["c", "k"]].itertuples(index=False):
            own.setdefault(c, {})[k] = None
        b = b.sort_values(["c", "at", "seq"], kind="stable", na_position="first")
        gone = []
        for c, k in zip(b["c"], b["k"], strict=True):
            held = own.setdefault(c, {})
            gone.append(k not in held)
            held.pop(k, None)
            held[k] = None  # dictionaries keep the order of use
            if len(held) > size:
                held.pop(next(iter(held)))
        return b.assign(miss=gone, at=b["at"].astype("Int64"))[names]

    places = blocks.groupBy("block").applyInPandas(summarise, "c string, block int, place int, k string")
    before = places.groupBy("c").applyInPandas(chain, "c string, block int, place int, k string")
    out = StructType([*rows.schema.fields, StructField("miss", BooleanType())])
    names = out.names
    marked = blocks.groupBy("block").cogroup(before.groupBy("block")).applyInPandas(evictions, out).select("cache", "k", "at", "seq", "miss")
    timed = _expire(marked.where("at is not null"), ttl).select("cache", "seq", "hit")
    return timed.unionByName(marked.where("at is null").select("cache", "seq", F.lit(False).alias("hit")))


def entries(log: DataFrame) -> DataFrame:
    """The latest entry of each key."""
    return log.groupBy("cache_key").agg(F.max_by(F.struct("at", "doc_ids"), F.struct("at", "seq")).alias("e")).select("cache_key", "e.at", "e.doc_ids")


def without(cache: DataFrame, doc_id: str) -> DataFrame:
    return cache.where(~F.array_contains("doc_ids", doc_id))


def younger(cache: DataFrame, now: int, ttl: int = CONFIG.cache_ttl_s) -> DataFrame:
    return cache.where(F.lit(now) - F.col("at") < ttl)


def stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries")).select("entries", F.lit(CONFIG.cache_size).alias("max_entries"), F.lit(CONFIG.cache_ttl_s).alias("ttl_seconds"), F.lit(True).alias("enabled"))
