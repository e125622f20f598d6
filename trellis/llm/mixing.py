"""Mixing sources to target weights over fixed-length token blocks.

The words of each source, its documents in hashed order, are packed into blocks of
``block`` words; a source whose target is less than a few hundred blocks is packed in
shorter ones, so that it can come near its target as well. Each output shard draws from a
multinomial how many blocks it takes from each source. The draws go down a binary tree of
the shards: at a node, a multinomial over the blocks that are still to be taken says what
the first half of its shards gets, and the other half gets the rest. So each shard's counts
are random, each source comes out at its target, and any shard can be drawn by itself.

The draws are slots of each source, and a keyed permutation of 0..n-1 for each pass over
the source maps slot to block, so a pass uses every block once. Slots and document pieces
meet in an equi-join on (source, block).

Only one row a source and one a (shard, source) reach the driver or a single task; the
number of sources is checked against ``max_sources``. Positions are summed in three levels
of parts, so a source that holds a third of all rows is spread over many tasks.

Defined results: a null or empty text has no words and is never taken; null is a source
of its own, after all others; a source of another type counts by its text; repeated rows are separate documents, told apart by a hash of
all their columns; an empty table gives no rows; other columns are ignored by :func:`takes`
and kept by :func:`mixed`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.llm.common import arrow_batches, fresh, materialize, n_words, row_hash, table
from trellis.llm.textvec import give_back
from trellis.llm.textvec import mix as mix64

WEIGHTS = (5, 2, 1)
#: Rows in a part of a source, parts in a part of those, and blocks a target has at least.
PART_ROWS, PART_PARTS, LEAST_BLOCKS = 128, 1024, 256


@dataclass
class Source:
    name: str | None
    index: int
    words: int
    rows: int
    target: float
    block: int  # words in its blocks

    @property
    def blocks(self) -> int:
        return -(-self.words // self.block)

    def wanted(self, limit: int) -> int:
        """Blocks that come nearest to the target, of the mean size of a block."""
        return min(limit * self.blocks, round(self.target * self.blocks / self.words)) if self.words else 0


def block_words(target: float, block: int) -> int:
    """``block``, or as large a power of two as leaves the target LEAST_BLOCKS blocks."""
    return max(1, min(block, 1 << max(0, math.floor(math.log2(max(1.0, target / LEAST_BLOCKS))))))


def targets(sizes: list[int], weights: list[float], total: float, limit: float = 3.0) -> list[float]:
    """Shares of ``total`` by weight; none above ``limit`` times its size, the excess shared
    again by weight among the others until none is above."""
    out, rest, open_ = [0.0] * len(sizes), float(total), set(range(len(sizes)))
    while open_:
        mass = sum(weights[i] for i in open_)
        full = {i for i in open_ if rest * weights[i] / mass > limit * sizes[i]}
        if not full:
            for i in open_:
                out[i] = rest * weights[i] / mass
            break
        for i in full:
            out[i] = limit * sizes[i]
        rest -= sum(out[i] for i in full)
        open_ -= full
    return out


def permute(slot: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Image of each slot under the permutation of 0..n-1 that ``key`` names: a Feistel
    network over the next even number of bits, walked on until the image is below n."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = slot.astype(np.uint64).copy(), np.ones(len(slot), bool)
    n, key = n.astype(np.uint64), key.astype(np.uint64)
    while todo.any():
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = x[todo] >> h, x[todo] & m
        for r in range(rounds):
            left, right = right, left ^ (mix64(right ^ mix64(k, r), r) & m)
        x[todo] = (left << h) | right
        todo[todo] = x[todo] >= n[todo]
    return x.astype(np.int64)


def draws(wanted: np.ndarray, shards: int, seed: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots of each source before it, blocks it takes of each) for the shards from
    ``first`` to ``last`` - 1 of all; the same whichever range they are drawn in."""
    slots = int(wanted.sum())
    before = lambda k: slots * k // shards

    def walk(lo: int, hi: int, rest: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if hi <= first or lo >= last:
            return
        if hi - lo == 1:
            yield lo, start, rest
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        take, left = np.zeros_like(rest), before(mid) - before(lo)
        while left:  # what a draw puts above the rest of a source is drawn again
            room = rest - take
            take += np.minimum(room, rng.multinomial(left, room / (room.sum() * (1 + 1e-9))))
            left = before(mid) - before(lo) - int(take.sum())
        yield from walk(lo, mid, take, start)
        yield from walk(mid, hi, rest - take, start + take)

    yield from walk(0, shards, wanted, np.zeros_like(wanted))


def placements(spark: SparkSession, sources: list[Source], per_shard: int, limit: int, seed: int) -> DataFrame:
    """(shard, sid, block, pass): the mixture, one row for each block of an output shard."""
    wanted = np.array([s.wanted(limit) for s in sources], np.int64)
    blocks = np.array([max(1, s.blocks) for s in sources], np.int64)
    shards = max(1, math.ceil(wanted.sum() / per_shard))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy()
            for shard, start, take in draws(wanted, shards, seed, int(ids[0]), int(ids[-1]) + 1) if len(ids) else ():
                sid = np.repeat(np.arange(len(take)), take)
                slot = np.arange(len(sid)) + np.repeat(start - np.cumsum(take) + take, take)
                n = blocks[sid]
                turn = slot // n
                key = mix64(sid.astype(np.uint64) * np.uint64(1 << 32) + turn.astype(np.uint64), seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sid), shard)), pa.array(sid.astype(np.int32)), pa.array(permute(slot % n, n, key)), pa.array(turn.astype(np.int32))], ["shard", "sid", "block", "pass"])

    tasks = max(min(shards, spark.sparkContext.defaultParallelism), -(-shards // 64))
    return spark.range(0, shards, 1, tasks).mapInArrow(draw, "shard long, sid int, block long, pass int")


def _before(size: str, keys: list[str], order: str) -> Column:
    return F.sum(size).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)


def _placed_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, limit: int, block: int, max_sources: int) -> tuple[DataFrame, list[Source]]:
    """Documents with sid, blk (words in the source's blocks) and pos, the words of the source
    before them. Parts of a source have PART_ROWS rows and are summed by parts of parts."""
    spark = docs.sparkSession
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("h"), row_hash(docs).alias("r")), "mix-sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources only as far as the driver can hold one row each")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["words"] for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], sum(sizes), limit)
    sources = [Source(r["source"], i, r["words"], r["rows"], g, block_words(g, block)) for i, (r, g) in enumerate(zip(found, goal, strict=True))]
    known = spark.createDataFrame([(s.name, s.index, s.words, float(s.target), s.block, -(-s.rows // PART_ROWS)) for s in sources], "name string, sid int, source_size long, target double, blk int, parts long")
    own = (
        sized.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("name")))
        .withColumn("at", F.xxhash64("doc_id", "h"))
        .withColumn("part", F.pmod("at", "parts"))
        .withColumn("group", F.floor(F.col("part") / PART_PARTS))
        .drop("name", "parts")
    )
    parts = own.groupBy("sid", "group", "part").agg(F.sum("size").alias("own"))
    groups = parts.groupBy("sid", "group").agg(F.sum("own").alias("all"))
    groups = groups.select("sid", "group", _before("all", ["sid"], "group").alias("base"))
    base = parts.join(groups, ["sid", "group"]).select("sid", "part", (F.col("base") + _before("own", ["sid", "group"], "part")).alias("base"))
    within = own.withColumn("pos", F.sum("size").over(Window.partitionBy("sid", "part").orderBy("at", "doc_id", "h", "r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    within = within.withColumn("dup", F.row_number().over(Window.partitionBy("sid", "part", "doc_id", "h").orderBy("r", "pos")))
    return within.join(base, ["sid", "part"]).withColumn("pos", F.col("pos") + F.col("base")).drop("base", "at", "part", "group", "r"), sources


def pieces(placed: DataFrame) -> DataFrame:
    """One row for each block that a document reaches into: block, a, b (words a..b-1 of it)."""
    end, blk = F.col("pos") + F.col("size"), F.col("blk")
    reach = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("pos") / blk), F.floor((end - 1) / blk)))
    cut = placed.withColumn("block", F.explode_outer(reach))
    return cut.withColumn("a", F.greatest(F.lit(0), F.col("block") * blk - F.col("pos"))).withColumn("b", F.least(F.col("size"), (F.col("block") + 1) * blk - F.col("pos")))


def takes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, limit: int = 3, block: int = 128, per_shard: int = 8192, seed: int = 11, max_sources: int = 50_000) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    spark = docs.sparkSession
    arrow_batches(spark, 10_000)
    placed, sources = _placed_documents(docs, id_col, text_col, source_col, weights, limit, block, max_sources)
    uses = placements(spark, sources, per_shard, limit, seed).groupBy("sid", "block").agg(F.count("*").alias("uses"))
    key = ["sid", "pos", "doc_id", "h", "dup", "size", "source_size", "target"]
    joined = pieces(placed).join(uses.hint("merge"), ["sid", "block"], "left")  # the draws look small, the slots are not
    taken = F.coalesce(F.sum((F.col("b") - F.col("a")) * F.col("uses")), F.lit(0)).cast("long").alias("taken")
    return joined.groupBy(*key).agg(taken).select("doc_id", "size", "source_size", "target", "taken")


def _cut(text: pd.Series, spans: pd.Series) -> pd.Series:
    def one(t: str, own) -> str:
        at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        runs: list[list[int]] = []
        for s in own:
            if runs and runs[-1][1] == s["a"]:
                runs[-1][1] = s["b"]
            else:
                runs.append([s["a"], s["b"]])
        return "\n".join(t[at[a][0] : at[b - 1][1]] for a, b in runs)

    out = pd.Series([one(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)
    give_back()
    return out


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars", weights=WEIGHTS, limit: int = 3, block: int = 128, per_shard: int = 8192, seed: int = 11, max_sources: int = 50_000) -> DataFrame:
    """The mixture as documents: one row for each document and pass over its source, with
    the words that the pass takes as its text and all other columns as they were."""
    spark = docs.sparkSession
    arrow_batches(spark)
    placed, sources = _placed_documents(docs, id_col, text_col, source_col, weights, limit, block, max_sources)
    used = placements(spark, sources, per_shard, limit, seed).select("sid", "block", "pass")
    id_, h_, source_, dup_, size_, cuts_, words_, key_, row_, nth_ = fresh(docs, "_mix_id", "_mix_h", "_mix_source", "_mix_dup", "_mix_size", "_mix_cuts", "_mix_words", "_mix_key", "_mix_row", "_mix_nth")
    spans = (
        pieces(placed.where("size > 0"))
        .join(used.hint("merge"), ["sid", "block"])
        .groupBy("doc_id", "h", "source", "dup", "size", "pass")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")))).alias("cuts"), F.sum(F.col("b") - F.col("a")).alias("words"))
        .select(*[F.col(c).alias(n) for c, n in (("doc_id", id_), ("h", h_), ("source", source_), ("dup", dup_), ("size", size_), ("cuts", cuts_), ("words", words_))])
    )
    whole = F.col(words_) == F.col(size_)
    texts = docs.withColumn(key_, F.xxhash64(text_col)).withColumn(row_, row_hash(docs)).withColumn(nth_, F.row_number().over(Window.partitionBy(id_col, key_, source_col).orderBy(row_)))
    both = texts.join(spans.hint("merge"), texts[id_col].eqNullSafe(spans[id_]) & (texts[key_] == spans[h_]) & texts[source_col].cast("string").eqNullSafe(spans[source_]) & (texts[nth_] == spans[dup_]))
    out = both.where(whole).unionByName(both.where(~whole).withColumn(text_col, F.pandas_udf(_cut, T.StringType())(F.col(text_col), F.col(cuts_))))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*[out[c] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents mixed by the weights 5, 2, 1 in turn, at most three passes."""
    return takes(table(spark, sf_dir, "documents"))
