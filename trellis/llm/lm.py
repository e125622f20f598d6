"""Interpolated modified Kneser-Ney model of two or three words, counted in Spark and scored
from memory-mapped sorted hash arrays.

Counting. Map tasks turn texts into 64-bit word hashes and send (key, count) arrays, summed
within the task and packed small, to parts by key; one group of a part adds them up and
writes sorted arrays to the shared folder. The first pass gives the vocabulary (hash,
count); a word's id is its place in the sorted hashes. The second gives the pairs, with the
key id of the context << 32 | id of the word, and the number of different pairs that end in
each word. Parts of pairs are ranges of context ids, which are in hashed order, so what
follows a context lies together and its kinds (continuations seen once, twice, more) are an
array by id. Contexts so frequent that they would fill a part are spread over all parts by
word instead, and only their sums meet.

With ``order`` 3 a third pass counts what follows each pair, in parts by the pair's hash, and
says of each pair before how many different words it stands. These numbers take the place of
the pair's counts below the highest order; pairs at the start of a text, which nothing stands
before, keep their counts.

Scoring. Workers map the arrays and look up the distinct words, contexts and pairs of a
slice of texts, each in ascending order, part by part as they occur; the model is never in
their own memory. The number of parts grows with the input. The driver gets two numbers a
part, and the sums of the frequent contexts, of which there are fewer than parts.

The shared folder has to be a mounted one (``file:``), as memory mapping needs a file.
Files are written under a temporary name and renamed, so a retried task does no harm.
Counts are summed in 64 bits; more words than ids have bits for are an error.

Defined results: a null or empty text is the end token alone; with no training text every
token is unknown; repeated rows count and are scored each; other columns are ignored.
"""

from __future__ import annotations

import math
import mmap
import os
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import textvec
from trellis.llm.common import arrow_batches, fold, materialize, shared_dir, table

PACKED = "part int, n long, keys binary, counts binary"
FLUSH = 2_000_000
#: Bytes of text that are looked up at once, and arrays that a worker keeps mapped.
SLICE, MAPPED = 1 << 21, 4096
_ID, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


@dataclass
class Model:
    """Where the arrays lie and the few numbers that hold for all of them."""

    path: str
    parts: int
    words: int = 0
    tokens: int = 0
    texts: int = 0
    discounts: tuple[tuple[float, ...], ...] = ((0.0,) * 4,) * 3
    kinds: int = 0  # different pairs
    end_before: int = 0  # different words before the end
    unigram_rest: float = 1.0
    hot: dict[int, tuple[int, ...]] = field(default_factory=dict)  # context id: its kinds
    order: int = 2
    # with order 3, of frequent contexts of one and of two words: kinds and sum
    hot_one: dict[int, tuple[int, ...]] = field(default_factory=dict)
    hot_two: dict[int, tuple[int, ...]] = field(default_factory=dict)

    @property
    def offsets(self) -> np.ndarray:
        """The first id of each vocabulary part, and the number of words."""
        return _load(self.path, "offsets")

    def first_context(self, part: int) -> int:
        return -(-part * (self.words + 2) // self.parts)


def _pack(x: np.ndarray) -> bytes:
    """Bytes of an integer array, byte planes together and compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()
    return pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def _unpack(raw: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw, n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(n)


def _summed(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.add.reduceat(counts.astype(np.int64), at)


def _emit(keys: np.ndarray, counts: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """A row for each part that any of the (ascending) keys goes to. Counts of one task."""
    order = np.argsort(part, kind="stable")
    keys, counts, part = keys[order], counts[order].astype(np.uint32), part[order]
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    rows = [(int(part[i]), int(j - i), _pack(np.diff(keys[i:j], prepend=np.uint64(0))), _pack(counts[i:j])) for i, j in zip(at, np.append(at, len(part))[1:], strict=True)]
    cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["part", "n", "keys", "counts"])


def _merged(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for n, k, c in zip(group.column("n").to_pylist(), group.column("keys").to_pylist(), group.column("counts").to_pylist(), strict=True):
        keys.append(np.cumsum(_unpack(k, n, np.uint64), dtype=np.uint64))
        counts.append(_unpack(c, n, np.uint32))
    return _summed(np.concatenate(keys), np.concatenate(counts))


def _small(counts: np.ndarray) -> np.ndarray:
    """In 32 bits if they fit."""
    return counts.astype(np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.uint64)


def _save(path: str, name: str, x: np.ndarray) -> None:
    tmp = f"{path}/.{name}-{uuid.uuid4().hex}"
    with open(tmp, "wb") as f:
        np.save(f, x)
    os.replace(tmp, f"{path}/{name}.npy")


_open: OrderedDict[str, np.ndarray] = OrderedDict()


def _mapped(at: str) -> np.ndarray:
    """The array of a file, mapped into memory without keeping the file open."""
    with open(at, "rb") as f:
        version = np.lib.format.read_magic(f)
        shape, _, kind = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
        if not math.prod(shape):
            return np.zeros(shape, kind)
        try:
            raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
        except TypeError:  # before Python 3.13
            raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        return np.frombuffer(raw, kind, math.prod(shape), f.tell()).reshape(shape)


def _load(path: str, name: str) -> np.ndarray:
    """The array, mapped once while it is among those last used; empty if there is none."""
    at = f"{path}/{name}.npy"
    if at in _open:
        _open.move_to_end(at)
        return _open[at]
    if not os.path.exists(at):
        return np.zeros(0, np.uint64)
    _open[at] = _mapped(at)
    if len(_open) > MAPPED:
        _open.popitem(last=False)
    return _open[at]


def _streams(w: textvec.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each word, place of each end) in the slice's token stream, and its length a row."""
    n = w.count + 1
    first = textvec.run_starts(n)
    return np.arange(len(w.start)) + w.row, first + w.count, n


def _part_of_hash(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> _ID) * np.uint64(parts) >> _ID).astype(np.int64)


def _flushing(batches: Iterator[pa.RecordBatch], keys_of: Callable, part_of: Callable) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for b in batches:
        for w in textvec.words(b.column("text"), size=SLICE):
            held.append(keys_of(w))
            size += len(held[-1])
            if size >= FLUSH:
                keys, counts = _summed(np.concatenate(held), None)
                yield _emit(keys, counts, part_of(keys))
                held, size = [], 0
    if size:
        keys, counts = _summed(np.concatenate(held), None)
        yield _emit(keys, counts, part_of(keys))


def _runs(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, first, last + 1) of each run of equal parts."""
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    yield from zip(part[at].tolist(), at.tolist(), np.append(at, len(part))[1:].tolist(), strict=True)


def _find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``known``, whether found) of ascending keys."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


def word_ids(h: np.ndarray, model: Model) -> np.ndarray:
    """Vocabulary ids of ascending hashes; the number of words + 2 for an unknown one."""
    out = np.full(len(h), model.words + 2, np.int64)
    for p, i, j in _runs(_part_of_hash(h, model.parts)):
        at, hit = _find(_load(model.path, f"words-{p}"), h[i:j])
        out[i:j][hit] = at[hit] + model.offsets[p]
    return out


def _by_id(ids: np.ndarray, model: Model, name: str) -> np.ndarray:
    """Entries of an array in vocabulary parts, for ids whose words are in ascending order of
    their hashes; 0 for other ids."""
    out = np.zeros(len(ids), np.int64)
    known = np.flatnonzero(ids < model.words)
    for p, i, j in _runs(np.searchsorted(model.offsets, ids[known], "right") - 1):
        x = _load(model.path, f"{name}-{p}")
        if len(x):
            out[known[i:j]] = x[ids[known[i:j]] - model.offsets[p]]
    return out


def _distinct(w: textvec.Words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the slice's distinct words, in order of their hashes; which each word is)."""
    h, back = np.unique(w.hashes(), return_inverse=True)
    return word_ids(h, model), back


def _pairs(w: textvec.Words, ids_of: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context id, token id) of each token of the slice, and the tokens of each row, from
    the ids of its words. The end has the number of words as its id, the start one more."""
    at, ends, n = _streams(w)
    ids = np.empty(int(n.sum()), np.int64)
    ids[at] = ids_of
    ids[ends] = model.words
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[textvec.run_starts(n)] = model.words + 1
    return before, ids, n


def _part_of_context(ctx: np.ndarray, model: Model) -> np.ndarray:
    return ctx.astype(np.int64) * model.parts // (model.words + 2)


def _is_hot(ctx: np.ndarray, model: Model) -> np.ndarray:
    hot = np.array(sorted(model.hot), np.uint64)
    return _find(hot, ctx)[1]


def _spread(keys: np.ndarray, model: Model) -> np.ndarray:
    return _part_of_hash(textvec.mix(keys, 40), model.parts)


def _part_of_pair(keys: np.ndarray, model: Model) -> np.ndarray:
    ctx = keys >> _ID
    return np.where(_is_hot(ctx, model), _spread(keys, model), _part_of_context(ctx, model))


def _discounts(n: list[int]) -> tuple[float, ...]:
    """Discounts of counts 0, 1, 2, 3 or more from the numbers of counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return (0.0, *(min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1)))


def _count_counts(c: np.ndarray) -> list[int]:
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


def _sums(df: DataFrame, n: int) -> list[int]:
    """Sums of the entries of the column ``facts``."""
    return [int(x or 0) for x in df.agg(*[F.sum(F.col("facts")[i]) for i in range(n)]).first()]


def train(docs: DataFrame, text_col: str = "text", part_tokens: int = 2_000_000, order: int = 2) -> Model:
    """Count ``docs`` and write the arrays. ``part_tokens``: about so many tokens a part."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = docs.sparkSession
    arrow_batches(spark)
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    where = shared_dir(spark, "lm")
    if not where.startswith(("file:", "/")):
        raise ValueError(f"the arrays are memory-mapped, so the shared folder must be mounted, not {where}")
    path = "/" + where.removeprefix("file:").lstrip("/")
    os.makedirs(path)
    parts = max(8, math.ceil(size[0] / 6 / part_tokens))
    model = Model(path, parts, texts=size[1], order=order)

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _flushing(batches, lambda w: w.hashes(), lambda k: _part_of_hash(k, parts))

    def add_words(group: pa.Table) -> pa.Table:
        p = group.column("part")[0].as_py()
        keys, counts = _merged(group)
        _save(path, f"words-{p}", keys)
        _save(path, f"counts-{p}", _small(counts))
        return pa.table({"part": pa.array([p], pa.int32()), "n": [len(keys)], "tokens": [int(counts.sum())]})

    sizes = np.zeros(parts, np.int64)
    model.tokens = model.texts
    for r in texts.mapInArrow(vocabulary, PACKED).groupBy("part").applyInArrow(add_words, "part int, n long, tokens long").collect():
        sizes[r["part"]] = r["n"]
        model.tokens += r["tokens"]
    model.words = int(sizes.sum())
    if model.words + 3 >= 1 << 32:
        raise ValueError(f"{model.words} words are more than ids of 32 bits tell apart")
    _save(path, "offsets", np.append(0, np.cumsum(sizes)))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [np.flatnonzero(_load(path, f"counts-{p}") > model.tokens / parts) + model.offsets[p] for p in b.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at).astype(np.int64) if at else [], pa.int64())], ["id"])

    tasks = max(1, min(parts, spark.sparkContext.defaultParallelism))
    hot = [r["id"] for r in spark.range(0, parts, 1, tasks).mapInArrow(frequent, "id long").collect()]
    model.hot = dict.fromkeys([*hot, model.words + 1], (0, 0, 0))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys(w: textvec.Words) -> np.ndarray:
            ids, back = _distinct(w, model)
            before, ids, _ = _pairs(w, ids[back], model)
            return (before.astype(np.uint64) << _ID) | ids.astype(np.uint64)

        return _flushing(batches, keys, lambda k: _part_of_pair(k, model))

    def add_pairs(group: pa.Table) -> pa.Table:
        p = group.column("part")[0].as_py()
        keys, counts = _merged(group)
        _save(path, f"pairs-{p}", keys)
        _save(path, f"pair-counts-{p}", _small(counts))
        ctx = keys >> _ID
        at = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1]))
        kinds = np.stack([np.add.reduceat(k.astype(np.int64), at) for k in (counts == 1, counts == 2, counts > 2)], axis=1)
        own = ~_is_hot(ctx[at], model)
        lo = model.first_context(p)
        table = np.zeros((model.first_context(p + 1) - lo, 3), np.uint32)
        table[ctx[at][own].astype(np.int64) - lo] = kinds[own]
        _save(path, f"kinds-{p}", table)
        word, before = np.unique(keys & _LOW, return_counts=True)
        last = word == model.words
        sent = pa.Table.from_batches([_emit(word[~last], before[~last], np.searchsorted(model.offsets, word[~last], "right") - 1)])
        facts = [len(keys), int(before[last].sum()), *_count_counts(counts)]
        hot_rows = [[int(c), *map(int, k)] for c, k in zip(ctx[at][~own], kinds[~own], strict=True)]
        sent = sent.append_column("facts", pa.array([None] * len(sent), pa.list_(pa.int64()))).append_column("hot", pa.array([None] * len(sent), pa.list_(pa.list_(pa.int64()))))
        told = pa.table({"part": pa.array([-1], pa.int32()), "n": pa.array([0], pa.int64()), "keys": pa.array([None], pa.binary()), "counts": pa.array([None], pa.binary()), "facts": pa.array([facts], pa.list_(pa.int64())), "hot": pa.array([hot_rows], pa.list_(pa.list_(pa.int64())))})
        return pa.concat_tables([sent, told])

    second = materialize(texts.mapInArrow(pairs, PACKED).groupBy("part").applyInArrow(add_pairs, PACKED + ", facts array<long>, hot array<array<long>>"), "lm-before")
    sums = _sums(second.where("part < 0"), 6)
    model.kinds, model.end_before = sums[0], sums[1]
    for c, *k in second.where("part < 0").select(F.explode("hot").alias("h")).groupBy(F.col("h")[0]).agg(*[F.sum(F.col("h")[i]) for i in (1, 2, 3)]).collect():
        model.hot[c] = tuple(k)

    def add_before(group: pa.Table) -> pa.Table:
        p = group.column("part")[0].as_py()
        ids, n = _merged(group)
        lo, hi = model.offsets[p : p + 2]
        out = np.zeros(hi - lo, np.int64)
        out[ids.astype(np.int64) - lo] = n
        _save(path, f"before-{p}", _small(out))
        return pa.table({"part": pa.array([p], pa.int32()), "facts": pa.array([[*_count_counts(n), int((n > 2).sum())]], pa.list_(pa.int64()))})

    ends = _sums(second.where("part >= 0").select("part", "n", "keys", "counts").groupBy("part").applyInArrow(add_before, "part int, facts array<long>"), 5)
    model.discounts = (_discounts(ends[:4]), _discounts(sums[2:6]), (0.0,) * 4)
    d = model.discounts[0]
    end_d = d[min(3, model.end_before)]
    model.unigram_rest = (d[1] * ends[0] + d[2] * ends[1] + d[3] * ends[4] + end_d) / model.kinds if model.kinds else 1.0
    if order == 3:
        _count_triples(texts, model)
    return model


PACKED_TWO = "part int, n long, keys binary, words binary, counts binary"


def _contexts_of_two(before: np.ndarray, n: np.ndarray, start: int) -> np.ndarray:
    """The two ids before each token of a stream, the farther one in the high bits."""
    far = np.empty_like(before)
    far[1:] = before[:-1]
    far[textvec.run_starts(n)] = start
    return (far.astype(np.uint64) << _ID) | before.astype(np.uint64)


def _summed_two(keys: np.ndarray, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((words, keys))
    keys, words, counts = keys[order], words[order], counts[order]
    at = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (words[1:] != words[:-1])))[: len(keys)]
    return keys[at], words[at], np.add.reduceat(counts.astype(np.int64), at) if len(at) else counts.astype(np.int64)


def _part_of_two(keys: np.ndarray, words: np.ndarray, model: Model) -> np.ndarray:
    """Parts of triples: by their context, those of frequent contexts by the word as well."""
    hot = _find(np.array(sorted(model.hot_two), np.uint64), keys)[1]
    return _part_of_hash(textvec.mix(np.where(hot, textvec.mix(keys, 61) ^ textvec.mix(words, 62), keys), 63), model.parts)


def _emit_two(keys: np.ndarray, words: np.ndarray, counts: np.ndarray, model: Model) -> pa.RecordBatch:
    part = _part_of_two(keys, words, model)
    order = np.argsort(part, kind="stable")
    keys, words, counts = keys[order], words[order].astype(np.uint32), counts[order].astype(np.uint32)
    rows = [(p, j - i, _pack(np.diff(keys[i:j], prepend=np.uint64(0))), _pack(words[i:j]), _pack(counts[i:j])) for p, i, j in _runs(part[order])]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "n", "keys", "words", "counts"])


def _kinds(counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each run of counts that starts at ``at``: how many are 1, 2 and more, and their sum."""
    if not len(at):
        return np.zeros((0, 4), np.int64)
    return np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (counts == 1, counts == 2, counts > 2, counts)], axis=1)


def _least(counts: np.ndarray) -> np.ndarray:
    """In as few bytes as they need."""
    return counts.astype(np.min_scalar_type(int(counts.max()))) if counts.size else counts.astype(np.uint8)


def _hot_sums(df: DataFrame) -> dict[int, tuple[int, ...]]:
    """Sums of (context, kinds and sum) rows of the column ``hot``; there are fewer than parts."""
    rows = df.select(F.explode("hot").alias("h")).groupBy(F.col("h")[0].alias("k")).agg(*[F.sum(F.col("h")[i]).alias(f"s{i}") for i in range(1, 5)]).collect()
    return {int(r["k"]) & (2**64 - 1): tuple(int(r[f"s{i}"]) for i in range(1, 5)) for r in rows}


_TOLD = ", facts array<long>, hot array<array<long>>"


def _count_triples(texts: DataFrame, model: Model) -> None:
    spark, parts, path, start = texts.sparkSession, model.parts, model.path, model.words + 1
    tasks = max(1, min(parts, spark.sparkContext.defaultParallelism))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_load(path, f"pairs-{p}")[np.flatnonzero(_load(path, f"pair-counts-{p}") > model.tokens / parts)] for p in b.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], ["id"])

    hot = [r["id"] & (2**64 - 1) for r in spark.range(0, parts, 1, tasks).mapInArrow(frequent, "id long").collect()]
    model.hot_two = dict.fromkeys([*hot, start << 32 | start], (0, 0, 0, 0))

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, words = (np.concatenate(x) for x in zip(*held, strict=True))
            return _emit_two(*_summed_two(keys, words, np.ones(len(keys), np.int64)), model)

        for b in batches:
            for w in textvec.words(b.column("text"), size=SLICE):
                ids, back = _distinct(w, model)
                before, own, n = _pairs(w, ids[back], model)
                held.append((_contexts_of_two(before, n, start), own.astype(np.uint64)))
                size += len(own)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def add_triples(group: pa.Table) -> pa.Table:
        p = group.column("part")[0].as_py()
        cols = [[_unpack(x, n, kind) for x, n in zip(group.column(c).to_pylist(), group.column("n").to_pylist(), strict=True)] for c, kind in (("keys", np.uint64), ("words", np.uint32), ("counts", np.uint32))]
        keys, words, counts = _summed_two(np.concatenate([np.cumsum(k, dtype=np.uint64) for k in cols[0]]), np.concatenate(cols[1]).astype(np.uint64), np.concatenate(cols[2]))
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        place = np.repeat(np.arange(len(at), dtype=np.uint64), np.diff(np.append(at, len(keys))))
        _save(path, f"contexts-{p}", keys[at])
        _save(path, f"triples-{p}", (place << _ID) | words)
        _save(path, f"triple-counts-{p}", _least(counts))
        kinds = _kinds(counts, at)
        _save(path, f"triple-kinds-{p}", _least(kinds))
        known = _find(np.array(sorted(model.hot_two), np.uint64), keys[at])[1]
        hot_rows = [[int(k), *map(int, x)] for k, x in zip(keys[at][known].view(np.int64), kinds[known], strict=True)]
        inner = (keys & _LOW) != np.uint64(start)
        ends, before = _summed(((keys & _LOW)[inner] << _ID) | words[inner], None)
        sent = pa.Table.from_batches([_emit(ends, before, _part_of_pair(ends, model))])
        sent = sent.append_column("facts", pa.array([None] * len(sent), pa.list_(pa.int64()))).append_column("hot", pa.array([None] * len(sent), pa.list_(pa.list_(pa.int64()))))
        told = pa.table({"part": pa.array([-1], pa.int32()), "n": pa.array([0], pa.int64()), "keys": pa.array([None], pa.binary()), "counts": pa.array([None], pa.binary()), "facts": pa.array([_count_counts(counts)], pa.list_(pa.int64())), "hot": pa.array([hot_rows], pa.list_(pa.list_(pa.int64())))})
        return pa.concat_tables([sent, told])

    third = materialize(texts.mapInArrow(triples, PACKED_TWO).groupBy("part").applyInArrow(add_triples, PACKED + _TOLD), "lm-triples")
    highest = _sums(third.where("part < 0"), 4)
    model.hot_two |= _hot_sums(third.where("part < 0"))

    def add_ends(group: pa.Table) -> pa.Table:
        """How many different words stand before each pair of a part."""
        p = group.column("part")[0].as_py()
        pairs = _load(path, f"pairs-{p}")
        counts = np.zeros(len(pairs), np.int64)
        some = group.filter(pa.compute.greater(group.column("n"), 0))
        if len(some):
            keys, n = _merged(some)
            counts[_find(pairs, keys)[0]] = n
        ctx = pairs >> _ID
        first = ctx == np.uint64(start)
        counts[first] = _load(path, f"pair-counts-{p}")[first] if first.any() else 0
        _save(path, f"ends-{p}", _least(counts))
        at = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1]))[: len(ctx)]
        kinds, own = _kinds(counts, at), ~_is_hot(ctx[at], model)
        lo = model.first_context(p)
        table = np.zeros((model.first_context(p + 1) - lo, 4), np.int64)
        table[ctx[at][own].astype(np.int64) - lo] = kinds[own]
        _save(path, f"end-kinds-{p}", _least(table))
        hot_rows = [[int(c), *map(int, k)] for c, k in zip(ctx[at][~own], kinds[~own], strict=True)]
        return pa.table({"part": pa.array([p], pa.int32()), "facts": pa.array([_count_counts(counts)], pa.list_(pa.int64())), "hot": pa.array([hot_rows], pa.list_(pa.list_(pa.int64())))})

    every = spark.range(0, parts, 1, tasks).select(F.col("id").cast("int").alias("part"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("counts"))
    ends = third.where("part >= 0").select("part", "n", "keys", "counts").unionByName(every)
    told = materialize(ends.groupBy("part").applyInArrow(add_ends, "part int" + _TOLD), "lm-ends")
    model.hot_one = _hot_sums(told)
    model.discounts = (model.discounts[0], _discounts(_sums(told, 4)), _discounts(highest))


def _discounted(c: np.ndarray, d: tuple[float, ...]) -> np.ndarray:
    return np.maximum(0.0, c - np.array(d)[np.minimum(c, 3)])


def _rest(ctx: np.ndarray, model: Model) -> np.ndarray:
    """What a context's discounts leave for the lower order, for ascending context ids."""
    d = np.array(model.discounts[1][1:])
    out = np.zeros(len(ctx))
    known = np.flatnonzero(ctx < model.words + 2)
    for p, i, j in _runs(_part_of_context(ctx[known], model)):
        x = _load(model.path, f"kinds-{p}")
        if len(x):
            out[known[i:j]] = x[ctx[known[i:j]] - model.first_context(p)] @ d
    for i in np.flatnonzero(_is_hot(ctx.astype(np.uint64), model)):
        out[i] = np.dot(model.hot[int(ctx[i])], d)
    return out


def _end_kinds(ctx: np.ndarray, model: Model) -> np.ndarray:
    """Kinds and sum of ascending contexts of one word, with order 3."""
    out = np.zeros((len(ctx), 4), np.int64)
    known = np.flatnonzero(ctx < model.words + 2)
    for p, i, j in _runs(_part_of_context(ctx[known], model)):
        x = _load(model.path, f"end-kinds-{p}")
        if len(x):
            out[known[i:j]] = x[ctx[known[i:j]] - model.first_context(p)]
    for i in np.flatnonzero(_is_hot(ctx.astype(np.uint64), model)):
        out[i] = model.hot_one.get(int(ctx[i]), (0,) * 4)
    return out


def _triples(keys: np.ndarray, words: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(counts of triples, kinds and sum of their contexts) in the order given."""
    counts, kinds = np.zeros(len(keys), np.int64), np.zeros((len(keys), 4), np.int64)
    part = _part_of_two(keys, words, model)
    order = np.lexsort((words, keys, part))
    for p, i, j in _runs(part[order]):
        own = order[i:j]
        at, hit = _find(_load(model.path, f"contexts-{p}"), keys[own])
        own, at = own[hit], at[hit]
        if len(own):
            kinds[own] = _load(model.path, f"triple-kinds-{p}")[at]
            place, there = _find(_load(model.path, f"triples-{p}"), (at.astype(np.uint64) << _ID) | words[own])
            counts[own[there]] = _load(model.path, f"triple-counts-{p}")[place[there]]
    hot = np.array(sorted(model.hot_two), np.uint64)
    at, hit = _find(hot, keys)
    if hit.any():
        kinds[hit] = np.array([model.hot_two[int(k)] for k in hot])[at[hit]]
    return counts, kinds


def _pair_counts(keys: np.ndarray, model: Model, name: str = "pair-counts") -> np.ndarray:
    """Counts of ascending pairs; 0 for an unknown one."""
    out = np.zeros(len(keys), np.int64)
    ctx = keys >> _ID
    hot = _is_hot(ctx, model)
    cold = np.flatnonzero(~hot)
    spread = np.flatnonzero(hot)
    part = _spread(keys[spread], model)
    order = np.argsort(part, kind="stable")
    for at, part in ((cold, _part_of_context(ctx[cold], model)), (spread[order], part[order])):
        for p, i, j in _runs(part):
            place, hit = _find(_load(model.path, f"pairs-{p}"), keys[at[i:j]])
            if hit.any():
                out[at[i:j][hit]] = _load(model.path, f"{name}-{p}")[place[hit]]
    return out


def token_scores(w: textvec.Words, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(probability, count, tokens of each row, first token of each row) of a slice. Distinct
    words, and after them the end and the start, are looked up once, and so are pairs."""
    size = model.words
    ids, back = _distinct(w, model)
    kind = len(ids)  # the end is kind, the start kind + 1
    count = np.append(_by_id(ids, model, "counts"), [model.texts, model.texts])
    ahead = np.append(_by_id(ids, model, "before"), [model.end_before, 0])
    ids = np.append(ids, [size, size + 1])
    order = np.argsort(ids, kind="stable")
    rest, followed = np.empty(len(ids)), count.copy()
    if model.order == 2:
        rest[order] = _rest(ids[order], model)
    else:
        kinds = _end_kinds(ids[order], model)
        rest[order], followed[order] = kinds[:, :3] @ np.array(model.discounts[1][1:]), kinds[:, 3]
    uniform = 1 / (size + 2)  # all words, the end, and one for all unknown ones
    p1 = _discounted(ahead, model.discounts[0]) / max(1, model.kinds) + model.unigram_rest * uniform

    at, ends, n = _streams(w)
    own = np.empty(int(n.sum()), np.int64)
    own[at] = back
    own[ends] = kind
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[textvec.run_starts(n)] = kind + 1
    known = (ids[before] <= size + 1) & (ids[own] <= size) & (count[before] > 0)
    keys, pair = np.unique((ids[before[known]].astype(np.uint64) << _ID) | ids[own[known]].astype(np.uint64), return_inverse=True)
    seen = np.zeros(len(own), np.int64)
    seen[known] = _pair_counts(keys, model, "pair-counts" if model.order == 2 else "ends")[pair]
    total = np.where(ids[before] <= size + 1, followed[before], 0)
    p = np.where(total > 0, (_discounted(seen, model.discounts[1]) + rest[before] * p1[own]) / np.maximum(1, total), p1[own])
    if model.order == 3:
        two = _contexts_of_two(ids[before], n, size + 1)
        far = (two >> _ID).astype(np.int64)
        known = np.flatnonzero((ids[before] <= size + 1) & (far <= size + 1))
        seen, kinds = _triples(two[known], np.minimum(ids[own[known]], size + 2).astype(np.uint64), model)
        total, rest = kinds[:, 3], kinds[:, :3] @ np.array(model.discounts[2][1:])
        p[known] = np.where(total > 0, (_discounted(seen, model.discounts[2]) + rest * p[known]) / np.maximum(1, total), p[known])
    told = np.append(count[: kind + 1], 0)
    return p, told[own], n, textvec.run_starts(n)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, perplexity of each document."""
    arrow_batches(docs.sparkSession)
    base = model.tokens + model.words + 1 + (model.texts > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in textvec.words(b.column("text"), size=SLICE):
                p, count, n, first = token_scores(w, model)
                log = np.add.reduceat(np.log10(p), first)
                plain = np.add.reduceat(np.log10((count + 1) / base), first)
                known = np.add.reduceat((count > 0).astype(np.int64), first)
                cols = [b.column("doc_id")[w.rows[0] : w.rows[1]], pa.array(n), pa.array(known), pa.array(plain), pa.array(log), pa.array(10 ** np.minimum(300.0, -log / n))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double, perplexity double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all documents scored by the model of those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold(F.col("doc_id"), 7) != 2))
    out = score(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
