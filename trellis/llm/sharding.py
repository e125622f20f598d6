"""Sharding by sampled splitters.

Records get the key (hash of the text, hash of the id). A size-weighted sample of keys
gives quantile boundaries; records fall into the ranges between them. The exact bytes of
every range are then counted, and ranges that hold too much are subdivided with a sample
of their own until none does. All that reaches the driver is the sample and one row a
range, both bounded by parameters.

Ranges are placed, the largest first, in the shard with the fewest bytes so far. Equal
texts share the first part of their key. The ranges of one group of equal texts, however
many, are placed together, so the group stays in one shard; only a group of more bytes than
a shard's fair part is spread, over as few shards as hold it. Slots are numbered range by
range, so no task holds a whole shard or group.

Defined results: a null text has no bytes; a null id is an id like any other; ids may be of
any type; an empty table gives no rows; repeated rows each get a slot; columns of the input
that are not named are dropped, or with ``carry`` kept unless they have the name of a result.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.llm.common import arrow_batches, materialize, table

ROW_BYTES = 8
Key = tuple[int, int]


def sized_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, h, g) and the columns ``carry``: h orders the groups of equal
    texts, g their members. The last bits of g tell rows of one id apart, so that these can
    be subdivided too."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 44)
    own = F.shiftleft(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(17)), 20)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        own.bitwiseOR(row).alias("g"),
        *[F.col(f"`{c}`") for c in carry],
    )


def _range_of(bounds: list[Key], h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Number of boundaries that are <= (h, g), in key order."""
    bh = np.array([b[0] for b in bounds], np.int64)
    bg = np.array([b[1] for b in bounds], np.int64)
    lo, hi = np.searchsorted(bh, h, "left"), np.searchsorted(bh, h, "right")
    out = hi.copy()
    for v in np.unique(h[hi > lo]):
        at = h == v
        i, j = np.searchsorted(bh, v, "left"), np.searchsorted(bh, v, "right")
        out[at] = i + np.searchsorted(bg[i:j], g[at], "right")
    return out


def with_range(keyed: DataFrame, bounds: list[Key]) -> DataFrame:
    """Add ``rng``, the index of the range between boundaries; ``bounds`` is of bounded length."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rng = _range_of(bounds, b.column("h").to_numpy(), b.column("g").to_numpy()) if bounds else np.zeros(len(b), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rng.astype(np.int32))], [*b.schema.names, "rng"])

    return keyed.mapInArrow(assign, T.StructType([*keyed.schema.fields, T.StructField("rng", T.IntegerType())]))


def _sample(keyed: DataFrame, total: int, expect: int, seed: int) -> list[Key]:
    """Keys drawn with probability in proportion to size, each at most once; sorted. The draw
    hashes the key, so reruns and retried tasks agree."""
    u = F.pmod(F.xxhash64("h", "g", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    w = F.col("size") * F.lit(expect / max(1, total))
    drawn = keyed.where(u < w).select("h", "g", F.greatest(F.lit(1), F.floor(w)).alias("n")).collect()
    return sorted(k for r in drawn for k in [(r["h"], r["g"])] * min(int(r["n"]), expect))


def _quantiles(sample: list[Key], parts: int, whole: bool, both: bool = False) -> list[Key]:
    """Boundaries that cut the sample in ``parts``; with ``whole`` only between different h,
    and on both sides of an h that several quantiles fall into (``both``: that any does)."""
    cuts = [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []
    if not whole:
        return sorted(set(cuts))
    heavy = {h for h, _ in cuts} if both else {x[0] for x, y in zip(cuts, cuts[1:], strict=False) if x[0] == y[0]}
    return [(h, -(1 << 63)) for h in sorted({h for h, _ in cuts} | {h + 1 for h in heavy if h < (1 << 63) - 1})]


def _measure(ranged: DataFrame) -> dict[int, dict]:
    rows = ranged.groupBy("rng").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("g").alias("g0"), F.max("g").alias("g1")).collect()
    return {r["rng"]: r.asDict() for r in rows}


def splitters(keyed: DataFrame, shards: int, per_shard: int = 64, oversample: int = 12) -> tuple[list[Key], dict[int, tuple[int, int]]]:
    """(boundaries, shard and first slot of each range)."""
    total = keyed.agg(F.sum("size")).first()[0] or 0
    parts = shards * per_shard
    bounds = _quantiles(_sample(keyed, total, parts * oversample, 1), parts, True)
    fair = total / parts
    seed = 1
    while True:  # each round cuts every range that is over, so the rounds end
        found = _measure(with_range(keyed, bounds))
        over = {i: r for i, r in found.items() if r["bytes"] > 1.5 * fair and (r["h0"], r["g0"]) < (r["h1"], r["g1"])}
        if not over:
            return bounds, _place(found, shards, total)
        seed += 1
        mass = sum(r["bytes"] for r in over.values())
        want = sum(int(np.ceil(r["bytes"] / fair)) for r in over.values()) * oversample
        inside = with_range(keyed, bounds).where(F.col("rng").isin([int(i) for i in over]))
        drawn = _sample(inside, mass, want, seed)
        more: set[Key] = set()
        for i, r in over.items():
            lo = bounds[i - 1] if i else (-(1 << 63), -(1 << 63))
            hi = bounds[i] if i < len(bounds) else ((1 << 63) - 1, (1 << 63) - 1)
            own = drawn[bisect.bisect_left(drawn, lo) : bisect.bisect_left(drawn, hi)]
            several = r["h0"] < r["h1"]
            # a group that a quantile falls into is set apart, as it may be what fills the range
            more |= set(_quantiles(own, int(np.ceil(r["bytes"] / fair)), several, several))
            # the last group alone, or the middle of a single one
            more |= {(r["h1"], -(1 << 63)) if several else (r["h0"], (r["g0"] + r["g1"]) // 2 + 1)}
        bounds = sorted(set(bounds) | more)


def _place(found: dict[int, dict], shards: int, total: int) -> dict[int, tuple[int, int]]:
    """Shard and first slot of each range: ranges of one group together, unless they hold more
    than a shard's fair part; the largest first, each where the fewest bytes are."""
    most = max(1.0, total / shards)
    groups: list[list[int]] = []
    for i in sorted(found):
        r, before = found[i], found[groups[-1][-1]] if groups else None
        if before and before["h0"] == before["h1"] == r["h0"] == r["h1"]:
            groups[-1].append(i)
        else:
            groups.append([i])
    units: list[tuple[int, list[int]]] = []
    for own in groups:
        size = sum(found[i]["bytes"] for i in own)
        pieces, so_far = int(np.ceil(size / most)), 0
        cut: list[list[int]] = [[] for _ in range(pieces)]
        for i in own:
            cut[min(pieces - 1, int((so_far + found[i]["bytes"] / 2) * pieces / size))].append(i)
            so_far += found[i]["bytes"]
        units += [(sum(found[i]["bytes"] for i in c), c) for c in cut if c]
    load = [(0, s) for s in range(shards)]
    shard_of: dict[int, int] = {}
    for size, own in sorted(units, key=lambda u: (-u[0], u[1])):
        held, s = heapq.heappop(load)
        heapq.heappush(load, (held + size, s))
        shard_of |= dict.fromkeys(own, s)
    out, slots = {}, [0] * shards
    for i in sorted(found):
        s = shard_of[i]
        out[i] = (s, slots[s])
        slots[s] += found[i]["n"]
    return out


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, **how) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard).

    ``carry``: with all other columns of ``docs`` too, less those that have one of these names.
    ``how``: parameters of :func:`splitters`. Shards get near-equal bytes; slots follow the
    key order.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    named = ("doc_id", "size", "text_crc32", "shard", "slot", "h", "g", "rng", "nth", "first")
    more = tuple(c for c in docs.columns if c != id_col and c.lower() not in named) if carry else ()
    keyed = materialize(sized_keys(docs, id_col, text_col, more), "shard-keys")
    bounds, places = splitters(keyed.select("h", "g", "size"), shards, **how)
    place = spark.createDataFrame([(i, s, first) for i, (s, first) in places.items()], "rng int, shard int, first long")
    nth = F.row_number().over(Window.partitionBy("rng").orderBy("h", "g", "doc_id"))
    return (
        with_range(keyed, bounds)
        .withColumn("nth", nth)
        .join(F.broadcast(place), "rng")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).alias("slot"), *[f"`{c}`" for c in more])
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents in shards 0 to 23 of near-equal bytes."""
    out = shard(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
