"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of two and of four tiles of 16 words. Their TF-IDF vectors are kept
on the words that the benchmark uses, as no other word adds to a product with an item;
document frequencies are counted over the tiles of all documents. A randomised SVD, by
subspace iteration on the products A'A of all tiles A of all documents, gives the latent space.
The benchmark's items are in it too, weighted up to half of the total energy. The benchmark's
words of all tiles are written once as numbers; of vocabularies up to ``dense`` words, A'A itself
is then added up in one pass over them, of larger ones its two products with a basis in a
pass each, in which single products of words are added up before they meet the basis. All passages of all documents are then projected, and those with a cosine of ``cosine`` or more to an item are
its candidates. A candidate is a leak if the longest common subsequence with the item's
words covers ``strong`` of the item, or covers ``weak`` of it and holds the item's answer
(an answer column, or else the last sentence, however short) to ``strong``.

The benchmark is the only thing shipped to the tasks, in parts of about ``max_items``
items, each searched by itself. Everything over the documents is one pass of map tasks, so
neither frequent passages nor copies meet in one task.

Defined results: null and empty texts have no passage and no leak; items without a word
are ignored; items or documents that repeat are each searched; without items nothing is
found; ties go to the first window; ids may be of any type that can be ordered; columns of
the input that are not named are kept by :func:`search` and :func:`clear`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from trellis.llm import textvec
from trellis.llm.common import arrow_batches, fresh, shared_dir, table, without

TILE, SPANS = 16, (2, 4)
#: Frequent words whose products a task keeps in a matrix, and products of others it lists at once.
SQUARE, LISTED = 4_096, 1 << 20
_FOUND = T.StructType([T.StructField("cosine", T.DoubleType()), T.StructField("lcs", T.DoubleType()), T.StructField("answer", T.BooleanType()), T.StructField("start", T.IntegerType()), T.StructField("words", T.IntegerType())])


@dataclass
class Bench:
    """The benchmark: its ids, words and answers, sorted vocabulary, and what was fitted."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vocab: np.ndarray
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    space: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    latent: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    #: The space times the words' weights, with a row of zeros for no word.
    weighted: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    bits: dict[int, dict[int, int]] = field(default_factory=dict)
    id_type: T.DataType = field(default_factory=T.LongType)

    def where(self, j: int) -> dict[int, int]:
        """:func:`places` of item j, found once in each task."""
        if j not in self.bits:
            self.bits[j] = places(self.words[j])
        return self.bits[j]


def _hashed(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for w in textvec.words(pa.array(texts, pa.string()), True, True):
        out += np.split(w.hashes(), np.cumsum(w.count)[:-1])
    return out


def load(items: DataFrame, id_col: str = "item_id", text_col: str = "text", answer_col: str | None = None, max_items: int = 4_000) -> list[Bench]:
    """The items in parts of about ``max_items``, each of which is searched by itself, so that
    what is shipped to a task stays small however many there are."""
    own = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("a"))
    first = own.limit(max_items + 1).collect()
    parts = [first]
    if len(first) > max_items:
        n = -(-own.count() // max_items)
        part = F.pmod(F.xxhash64("t"), F.lit(n))
        parts = [own.where(part == k).collect() for k in range(n)]
    found = [_bench(rows, items.schema[id_col].dataType) for rows in parts]
    return [b for b in found if len(b.ids)]


def _bench(rows: list, id_type: T.DataType) -> Bench:
    rows.sort(key=lambda r: (r["i"] is None, 0 if r["i"] is None else r["i"], r["t"]))
    last = [r["a"] or ([s for s in re.split(r"(?<=[.!?])\s+", r["t"]) if s.strip()] or [""])[-1] for r in rows]
    words = _hashed([r["t"] for r in rows])
    answers = _hashed(last)
    keep = [i for i, w in enumerate(words) if len(w)]
    vocab = np.unique(np.concatenate([words[i] for i in keep])) if keep else np.zeros(0, np.uint64)
    return Bench([rows[i]["i"] for i in keep], [words[i] for i in keep], [answers[i] for i in keep], vocab, id_type=id_type)


def _tiles(w: textvec.Words, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, vocabulary index or -1, tile of each word, first tile of each row)."""
    h = w.hashes()
    i = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
    i = np.where(vocab[i] == h, i, -1)
    per = -(-w.count // TILE)
    first = textvec.run_starts(per)
    tile = first[w.row] + (np.arange(len(h)) - textvec.run_starts(w.count)[w.row]) // TILE
    return h, i, tile, first


def _encoded(docs: DataFrame, bench: Bench) -> DataFrame:
    """(word, filled), a row for each slice of texts, written once: the places in the vocabulary of
    the known words of all tiles, one tile after the other, and how many of them each tile has."""
    vocab = bench.vocab
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in textvec.words(b.column("text"), True, True):
                if len(w.start):
                    _, i, tile, _ = _tiles(w, vocab)
                    filled = np.bincount(tile[i >= 0], minlength=int(tile[-1]) + 1)
                    yield pa.RecordBatch.from_arrays([pa.array([i[i >= 0].astype(_code(vocab)).tobytes()], pa.binary()), pa.array([filled.astype(np.uint8).tobytes()], pa.binary())], ["word", "filled"])

    path = shared_dir(spark, "op7-tiles")
    docs.mapInArrow(encode, "word binary, filled binary").write.parquet(path)
    return spark.read.schema("word binary, filled binary").parquet(path)


def _code(vocab: np.ndarray) -> type:
    return np.uint16 if len(vocab) <= 1 << 16 else np.uint32


def _read(batches: Iterator[pa.RecordBatch], vocab: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of the known words, number of them in each tile) of each slice."""
    for b in batches:
        for word, filled in zip(b.column("word"), b.column("filled"), strict=True):
            yield np.frombuffer(word.as_buffer(), _code(vocab)).astype(np.int64), np.frombuffer(filled.as_buffer(), np.uint8).astype(np.int64)


def _frequencies(coded: DataFrame, bench: Bench) -> tuple[np.ndarray, int]:
    """Number of tiles that hold each word of the vocabulary, and of all tiles."""
    vocab = bench.vocab

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, tiles = np.zeros(len(vocab), np.int64), 0
        for i, filled in _read(batches, vocab):
            tiles += len(filled)
            df += np.bincount(np.unique(np.repeat(np.arange(len(filled)), filled) * len(vocab) + i) % len(vocab), minlength=len(vocab))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], tiles))], ["i", "n"])

    df = np.zeros(len(vocab), np.int64)
    total = 0
    for r in coded.mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        if r["i"] < 0:
            total = r["n"]
        else:
            df[r["i"]] = r["n"]
    return df, total


def _added(parts: DataFrame, n: int) -> list[tuple[int, np.ndarray]]:
    """The sums of the arrays y of each part, of ``n`` parts, added up in Spark."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for p, y in zip(b.column("part").to_pylist(), b.column("y"), strict=True):
                sums[p] = sums.get(p, 0) + np.frombuffer(y.as_buffer(), np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["part", "y"])

    return [(r["part"], np.frombuffer(r["y"])) for r in parts.repartition(n, "part").mapInArrow(add, "part int, y binary").collect()]


def _pairs(slices: Iterator[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word, word, share) of any two known words of a tile, once, where the share is one over the
    tile's squared length. A word with itself has half of it, as it is both words. So the sum of
    the shares of two words in either order, times their weights, is their entry in A'A."""
    square = idf**2
    for i, filled in slices:
        # tiles with more known words first, and the words of each side by side
        order = np.argsort(-filled, kind="stable")
        order = order[: np.count_nonzero(filled)]
        if not len(order):
            continue
        start, size = (np.cumsum(filled) - filled)[order], filled[order]
        having = [int(np.searchsorted(-size, -k, "left")) for k in range(int(size[0]))]
        word = [i[start[:m] + k] for k, m in enumerate(having)]
        share = np.zeros(len(size))
        for w in word:
            share[: len(w)] += square[w]
        share = 1 / share
        for b, w in enumerate(word):
            own = share[: len(w)]
            yield w, w, own / 2
            for a in word[:b]:
                yield a[: len(w)], w, own


def _products(coded: DataFrame, bench: Bench, parts: int = 16) -> np.ndarray:
    """A'A for all tiles A: the products of any two words of a tile are added up by task, then in
    Spark by blocks of rows of the upper triangle, so that the driver gets one matrix."""
    vocab, idf, n = bench.vocab, bench.idf, len(bench.vocab)
    cuts = np.linspace(0, n, parts + 1).astype(int)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = np.zeros(n * n)
        for a, b, share in _pairs(_read(batches, vocab), idf):
            np.add.at(y, a * n + b, share)
        if y.any():
            y = y.reshape(n, n)
            y += y.T.copy()
            y *= idf
            y *= idf[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([y[p:q, p:].astype(np.float32).tobytes() for p, q in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["part", "y"])

    out = np.zeros((n, n))
    for p, y in _added(coded.mapInArrow(multiply, "part int, y binary"), parts):
        lo, hi = cuts[p], cuts[p + 1]
        out[lo:hi, lo:] = y.reshape(hi - lo, n - lo)
        out[lo:, lo:hi] = out[lo:hi, lo:].T
    return out


def _windows(x: np.ndarray, span: int) -> np.ndarray:
    """Sums of ``span`` consecutive rows, one for each row; those past the end are zero."""
    out = x.copy()
    for k in range(1, span):
        out[:-k] += x[k:]
    return out


def _gram(coded: DataFrame, bench: Bench, basis: np.ndarray, parts: int = 16) -> np.ndarray:
    """A'A basis for all tiles A: partial sums by task, added up in Spark by blocks of rows, so
    that the driver gets one matrix. A task adds up single products of words, and meets the basis
    with sums only: those of two of the ``SQUARE`` most frequent words are a matrix, which is
    multiplied once; those with a rarer word are summed and multiplied ``LISTED`` at a time."""
    vocab, n = bench.vocab, len(bench.vocab)
    near, listed = min(n, SQUARE), LISTED
    # words by falling frequency
    by = np.argsort(bench.idf, kind="stable")
    rank = np.argsort(by)
    idf = bench.idf[by]
    z = (basis[by] * idf[:, None]).astype(np.float32)
    cuts = np.linspace(0, n, parts + 1).astype(int)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, often = np.zeros(z.shape), np.zeros(near * near)
        rare: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0
        for a, b, share in _pairs(((rank[i], filled) for i, filled in _read(batches, vocab)), idf):
            if n > near:
                far = np.maximum(a, b) >= near
                if far.any():
                    rare.append((a[far], b[far], share[far]))
                    waiting += len(rare[-1][0])
                    if waiting >= listed:
                        _add_listed(y, z, rare)
                        rare, waiting = [], 0
                    a, b, share = a[~far], b[~far], share[~far]
            np.add.at(often, a * near + b, share)
        if rare:
            _add_listed(y, z, rare)
        often = often.reshape(near, near)
        for lo in range(0, near, 512):
            hi = min(near, lo + 512)
            y[lo:hi] += (often[lo:hi] + often[:, lo:hi].T).astype(np.float32) @ z[:near]
        y *= idf[:, None]
        if y.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([y[p:q].astype(np.float32).tobytes() for p, q in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["part", "y"])

    out = np.zeros(basis.shape)
    for p, y in _added(coded.mapInArrow(multiply, "part int, y binary"), parts):
        out[by[cuts[p] : cuts[p + 1]]] = y.reshape(-1, basis.shape[1])
    return out


def _add_listed(y: np.ndarray, z: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
    """Adds to ``y`` the products of :func:`_pairs` with ``z``, after pairs that repeat are summed."""
    a, b, share = (np.concatenate(x) for x in zip(*pairs, strict=True))
    key, place = np.unique(np.minimum(a, b) * len(z) + np.maximum(a, b), return_inverse=True)
    share = np.bincount(place, share).astype(np.float32)
    for row, other in (key // len(z), key % len(z)), (key % len(z), key // len(z)):
        order = np.argsort(row, kind="stable")
        for lo in range(0, len(order), 4096):
            own = order[lo : lo + 4096]
            at = np.flatnonzero(np.append(True, row[own][1:] != row[own][:-1]))
            y[row[own[at]]] += np.add.reduceat(z[other[own]] * share[own][:, None], at, axis=0)


@dataclass
class Rows:
    """A sparse matrix by rows: the place and value of each entry, and where a row starts."""

    place: np.ndarray
    value: np.ndarray
    start: np.ndarray

    def blocks(self, size: int = 256) -> Iterator[tuple[slice, slice]]:
        ends = np.append(self.start, len(self.place))
        for lo in range(0, len(self.start), size):
            hi = min(len(self.start), lo + size)
            yield slice(lo, hi), slice(ends[lo], ends[hi])

    def times(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(self.start), x.shape[1]))
        for own, at in self.blocks():
            out[own] = np.add.reduceat(x[self.place[at]] * self.value[at][:, None], self.start[own] - at.start, axis=0)
        return out

    def turned_times(self, x: np.ndarray, rows: int) -> np.ndarray:
        """The transposed matrix, of ``rows`` rows, times x."""
        out = np.zeros((rows, x.shape[1]))
        row = np.repeat(np.arange(len(self.start)), np.diff(np.append(self.start, len(self.place))))
        for _, at in self.blocks():
            np.add.at(out, self.place[at], x[row[at]] * self.value[at][:, None])
        return out


def _item_rows(bench: Bench) -> Rows:
    """TF-IDF of the items, each of length one."""
    place, value, start = [], [], []
    for w in bench.words:
        at, n = np.unique(np.searchsorted(bench.vocab, w), return_counts=True)
        v = n * bench.idf[at]
        start.append(sum(map(len, place[-1:])) + (start[-1] if start else 0))
        place.append(at)
        value.append(v / np.linalg.norm(v))
    return Rows(np.concatenate(place), np.concatenate(value), np.array(start))


def fit(docs: DataFrame, bench: Bench, rank: int = 256, over: int = 16, text_col: str = "text", seed: int = 3, dense: int = 2_048) -> Bench:
    """Document frequencies, and the latent space, over all tiles of ``docs`` and the items."""
    arrow_batches(docs.sparkSession)
    coded = _encoded(docs.select(F.col(text_col).alias("text")), bench)
    df, tiles = _frequencies(coded, bench)
    bench.idf = np.log((tiles + 1) / (df + 0.5)).clip(0.05)
    items = _item_rows(bench)
    energy = lambda x: items.turned_times(items.times(x), len(bench.vocab))
    width = min(len(bench.vocab), min(rank, len(bench.ids)) + over)
    omega = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(bench.vocab), width)))[0]
    # A row of A has length 1, so the energy of all is their number.
    up = max(1.0, tiles) / len(bench.ids)
    products = _products(coded, bench) if len(bench.vocab) <= dense else None
    gram = lambda x: _gram(coded, bench, x) if products is None else products @ x
    first = gram(omega) + up * energy(omega)
    q = np.linalg.qr(first)[0]
    second = gram(q) + up * energy(q)
    core = q.T @ second
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    top = np.argsort(values)[::-1][: min(rank, len(bench.ids))]
    bench.space = (q @ vectors[:, top]).astype(np.float32)
    bench.weighted = np.vstack([bench.space * bench.idf[:, None], np.zeros((1, len(top)))]).astype(np.float32)
    latent = items.times(bench.space)
    bench.latent = (latent / np.maximum(1e-9, np.linalg.norm(latent, axis=1, keepdims=True))).astype(np.float32)
    return bench


def places(a: np.ndarray) -> dict[int, int]:
    """The places of each word of ``a`` as bits."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << i)
    return where


def lcs_length(a: np.ndarray, b: np.ndarray, where: dict[int, int] | None = None, least: float = 0) -> int:
    """Length of the longest common subsequence, a bit for each word of ``a``, whose
    :func:`places` may be given; 0 where fewer than ``least`` words of ``b`` are in ``a``,
    as it can then not reach ``least``."""
    where = places(a) if where is None else where
    met = [m for m in map(where.get, b.tolist()) if m]
    if len(met) < least:
        return 0
    full = (1 << len(a)) - 1
    s = full
    for m in met:
        u = s & m
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def _candidates(w: textvec.Words, bench: Bench, cosine: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(row, first word, last word + 1, item, cosine) of windows near an item.

    Each row's tiles are followed by as many empty ones as a window reaches, so windows are
    plain sums of tiles, and so are their products with the items.
    """
    _, i, tile, first = _tiles(w, bench.vocab)
    pad = SPANS[-1] - 1
    rows = np.arange(len(w.count))
    per = -(-w.count // TILE)
    n_tiles = int((per + pad).sum())
    known = i >= 0
    if not known.any():
        return
    place = np.arange(len(i)) - textvec.run_starts(w.count)[w.row]
    begin = first + pad * rows
    i, tile, place = i[known], (tile + pad * w.row)[known], place[known] % TILE
    filled = np.bincount(tile, minlength=n_tiles)
    used = np.flatnonzero(filled)
    own = np.full(n_tiles, -1)
    own[used] = np.arange(len(used))
    # the words of each tile, side by side; the last row of ``space`` is zero
    word = np.full((TILE, len(used)), len(bench.vocab))
    word[place, own[tile]] = i
    space = bench.weighted
    vec = np.zeros((n_tiles, space.shape[1]), np.float32)
    for lo in range(0, len(used), 512):
        some = word[:, lo : lo + 512]
        x = space[some[0]]
        for k in range(1, TILE):
            x += space[some[k]]
        vec[used[lo : lo + 512]] = x
    score = vec @ bench.latent.T
    row_of = np.repeat(rows, per + pad)
    for span in SPANS:
        at = np.flatnonzero(_windows(filled, span))
        for lo in range(0, len(at), 1024):
            own = at[lo : lo + 1024]
            x, sim = vec[own], score[own]
            for k in range(1, span):
                t = np.minimum(own + k, n_tiles - 1)
                x += vec[t]
                sim += score[t]
            sim /= np.maximum(1e-9, np.sqrt(np.einsum("ij,ij->i", x, x)))[:, None]
            for a, j in zip(*np.nonzero(sim >= cosine), strict=True):
                t, r = int(own[a]), int(row_of[own[a]])
                lo_word = (t - int(begin[r])) * TILE
                yield r, max(0, lo_word - TILE), min(int(w.count[r]), lo_word + (span + 1) * TILE), int(j), float(sim[a, j])


def _hits(w: textvec.Words, bench: Bench, cosine: float, strong: float, weak: float) -> list[list[dict]]:
    out: list[dict[int, dict]] = [{} for _ in w.count]
    h, first = w.hashes(), textvec.run_starts(w.count)
    for r, a, b, j, sim in _candidates(w, bench, cosine):
        best = out[r].get(j)
        if best and best["lcs"] >= 1.0:
            continue
        item, answer = bench.words[j], bench.answers[j]
        # a candidate may start or end inside an item that is longer than the window
        reach = max(0, len(item) - (b - a) // 2)
        a, b = max(0, a - reach), min(int(w.count[r]), b + reach)
        own = h[first[r] + a : first[r] + b]
        share = lcs_length(item, own, bench.where(j), weak * len(item)) / len(item)
        if share < weak or best and best["lcs"] >= share:
            continue
        told = len(answer) > 0 and lcs_length(answer, own) >= strong * len(answer)
        if share >= strong or told:
            out[r][j] = {"item_id": bench.ids[j], "cosine": sim, "lcs": share, "answer": told, "start": a, "words": b - a}
    return [[x[j] for j in sorted(x)] for x in out]


def search(docs: DataFrame, bench: Bench, cosine: float = 0.45, strong: float = 0.7, weak: float = 0.55, text_col: str = "text", out: str = "hits") -> DataFrame:
    """``docs`` with a column ``out``: the leaks of each document, one for each item. A column
    of that name is replaced."""
    arrow_batches(docs.sparkSession)
    own = without(docs, out)
    hit = T.StructType([T.StructField("item_id", bench.id_type), *_FOUND.fields])
    fields = T.StructType([*own.schema.fields, T.StructField(out, T.ArrayType(hit))])
    kind = to_arrow_type(fields[out].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[list[dict]] = []
            for w in textvec.words(b.column(text_col), True, True):
                found += _hits(w, bench, cosine, strong, weak)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], [*b.schema.names, out])

    return own.mapInArrow(run, fields)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", answer_col: str | None = None, max_items: int = 4_000, **how) -> DataFrame:
    """One row for each document and item that leaks into it."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = [search(own, fit(own, b), **how) for b in load(items, item_col, answer_col=answer_col, max_items=max_items)]
    if not found:
        hit = T.StructType([T.StructField("item_id", items.schema[item_col].dataType), *_FOUND.fields])
        return own.sparkSession.createDataFrame([], T.StructType([own.schema["doc_id"], *hit.fields]))
    return reduce(DataFrame.unionByName, [x.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*") for x in found])


def clear(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that no item leaks into, with all their columns."""
    (hits,) = fresh(docs, "_hits")
    for b in load(items, **how):
        found = search(docs, fit(docs, b, text_col=text_col), text_col=text_col, out=hits)
        docs = found.where(F.size(hits) == 0).drop(hits)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the benchmark items that leak into documents."""
    out = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.lit(True).alias("contaminated"), "cosine", "lcs", "answer", "start", "words")
