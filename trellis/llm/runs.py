"""Periodic runs of words: all maximal repetitions of each text, and the text without them.

A run is a stretch of words that repeats itself with a smallest period q, is at least
``max(min_words, 2 q)`` words long, and cannot be made longer to either side. The longest
Lyndon word that starts at a word, under an order of the words or the opposite one, is the
root of every run that has one there, so each word gives two candidates of a period. How far
a candidate goes on is told by longest common extensions: to the right in Ukkonen's suffix
tree of the words, to the left in that of their reversal. An extension is the depth of the
lowest common ancestor of two leaves, a range minimum over the Euler tour, answered in
constant time by a sparse table; of the tour only its lowest places between neighbouring
leaves are kept, as no other can be the minimum. All candidates are answered at once.

Trees are built only where a run can be. Of a run of at least 12 words, and of at least twice
its period, L - q >= 6 words have a copy q words on, so each of its words lies in a stretch of
six words that the text holds more than once. Words outside of such stretches end the
string; what is left of fewer than ``min_words`` words holds no run. Nothing is lost by this,
and texts that do not repeat themselves cost one sort of their words' windows. Batches are
sent as Arrow; a text is one row, worked on by one task, as a run does not cross texts.

Defined results: a null text has no words; a text without runs keeps its words and has null
for the longest; runs that overlap are all counted, and a word goes if any run has it after its
first period; repeated rows are each worked on; a null id is never rewritten by the query; no
rows, no result rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import arrow_batches, table

#: Words of the windows that tell where a run can be; runs of fewer than twice as many words
#: are not looked for.
WINDOW = 6


class SuffixTree:
    """Ukkonen's tree of integers from 0 on, and common extensions of their suffixes."""

    def __init__(self, symbols: list[int]) -> None:
        self.n = len(symbols)
        self._grow(symbols)

    def _grow(self, symbols: list[int]) -> None:
        end = max(symbols, default=-1) + 1  # stands once, behind the last
        s, wide = [*symbols, end], end + 1
        n = len(s)
        child: dict[int, int] = {}  # node * wide + first symbol of the edge
        start, length, link = [0], [0], [0]
        node = edge = held = pending = 0  # the active point: node, first symbol's place, symbols held
        leaf_of = [0] * n
        leaves = 0
        for i, c in enumerate(s):
            pending += 1
            last = 0  # the inner node made before in this step
            while pending:
                if not held:
                    edge = i
                key = node * wide + s[edge]
                to = child.get(key)
                if to is None:
                    leaf = len(start)
                    start.append(i)
                    length.append(n - i)
                    link.append(0)
                    child[key] = leaf
                    leaf_of[leaves] = leaf
                    leaves += 1
                    if last:
                        link[last] = node
                        last = 0
                else:
                    size = length[to]
                    if held >= size:  # walk down
                        node = to
                        edge += size
                        held -= size
                        continue
                    if s[start[to] + held] == c:
                        held += 1
                        if last:
                            link[last] = node
                        break
                    mid = len(start)
                    leaf = mid + 1
                    start += (start[to], i)
                    length += (held, n - i)
                    link += (0, 0)
                    child[key] = mid
                    child[mid * wide + c] = leaf
                    start[to] += held
                    length[to] = size - held
                    child[mid * wide + s[start[to]]] = to
                    leaf_of[leaves] = leaf
                    leaves += 1
                    if last:
                        link[last] = mid
                    last = mid
                pending -= 1
                if node:
                    node = link[node]
                elif held:
                    held -= 1
                    edge = i - pending + 1
        self.size = len(start)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        kids = np.fromiter(child.values(), np.int64, len(child))
        self.parent = np.zeros(self.size, np.int64)
        self.parent[kids] = keys // wide
        first = keys % wide
        first[first == end] = -1  # the end comes before all symbols, in either order
        self.kids, self.parents, self.first = kids, keys // wide, first
        self.length, self.leaf_of = np.array(length, np.int64), np.array(leaf_of, np.int64)

    def _tour(self, descending: bool) -> tuple[np.ndarray, np.ndarray]:
        """Nodes in the order they are met, children by their symbols, and their depths."""
        first = np.where(self.first < 0, -(1 << 62), -self.first if descending else self.first)
        order = np.lexsort((-first, self.parents))  # the last comes first off the stack
        kids = self.kids[order].tolist()
        bounds = np.searchsorted(self.parents[order], np.arange(self.size + 1)).tolist()
        length = self.length.tolist()
        met, depth, stack = [], [0] * self.size, [0]
        parent = self.parent.tolist()
        while stack:
            v = stack.pop()
            met.append(v)
            depth[v] = depth[parent[v]] + length[v]
            lo, hi = bounds[v], bounds[v + 1]
            if lo < hi:
                stack += kids[lo:hi]
        return np.array(met, np.int64), np.array(depth, np.int64)

    def rank(self, descending: bool = False) -> np.ndarray:
        """Places of the suffixes, the empty one too, in lexicographic order of the symbols, or
        of the symbols' opposite order; a prefix comes before what it begins in both."""
        met, depth = self._tour(descending)
        suffix = np.full(self.size, -1, np.int64)
        suffix[self.leaf_of] = np.arange(self.n + 1)
        at = suffix[met]
        here = np.flatnonzero(at >= 0)
        rank = np.empty(self.n + 1, np.int64)
        rank[at[here]] = np.arange(self.n + 1)
        if not descending:  # the ancestors' depths between neighbouring leaves
            valley = depth[self.parent[met[here[:-1] + 1]]]
            self.rows, k = [valley.astype(np.int32)], 1
            while 2 * k <= len(valley):
                low = self.rows[-1]
                self.rows.append(np.minimum(low[: len(low) - k], low[k:]))
                k *= 2
            self.place = rank
        return rank

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at ``i`` and at ``j``, which differ, have in common; after
        :meth:`rank`."""
        a, b = self.place[i], self.place[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.rows[k]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(k))])
        return out


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each suffix but the empty one, where the next smaller suffix starts."""
    r, out, stack = rank.tolist(), [0] * (len(rank) - 1), []
    for i, x in enumerate(r):
        while stack and r[stack[-1]] > x:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def repetitions(symbols: list[int], min_length: int = 1) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``min_length`` symbols, ascending."""
    n = len(symbols)
    if n < 2:
        return []
    ahead, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    ranks = ahead.rank(), ahead.rank(descending=True)
    back.rank()
    i = np.arange(n)
    found = []
    for rank in ranks:
        j = _next_smaller(rank)  # from i to j: the longest Lyndon word at i
        right = ahead.common(i, j)
        left = back.common(n - i, n - j)
        start, length, period = i - left, left + (j - i) + right, j - i
        ok = (length >= 2 * period) & (length >= min_length)
        found.append(np.stack([start[ok], length[ok], period[ok]], axis=1))
    return [tuple(x) for x in np.unique(np.concatenate(found), axis=0).tolist()]


def _stretches(ids: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Where runs can be: stretches of words, each in a window that occurs more than once."""
    n = len(ids)
    if n < min_words:
        return []
    with np.errstate(over="ignore"):
        h = np.zeros(n - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : n - WINDOW + 1 + k].astype(np.uint64)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    twice = np.zeros(len(h) + 1, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(edge[:n]) > 0, [0]]).astype(np.int8)
    step = np.diff(inside)
    return [(a, b) for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True) if b - a >= min_words]


def word_runs(words: list[bytes], min_words: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of words, by start, then period."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    out = []
    for a, b in _stretches(ids, min_words):
        own = np.unique(ids[a:b], return_inverse=True)[1].tolist()
        out += [(a + s, length, q) for s, length, q in repetitions(own, min_words)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run has after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


_OUT = pa.schema([("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("n_words", pa.int64()), ("collapsed", pa.string())])


def find(docs: DataFrame, min_words: int = 12, id_col: str = "doc_id", text_col: str = "text", edit: Callable[[list[bytes], object], list[bytes]] | None = None, texts: bool = True) -> DataFrame:
    """doc_id, runs array<struct<start, length, period>> by start, then period, n_words,
    collapsed (the kept words with a blank between) and collapsed_sha256 of each document.
    ``edit``: words and id of a row to the words that are searched instead; ``texts``: whether
    collapsed itself is returned, else it is null."""
    if min_words < 2 * WINDOW:
        raise ValueError(f"min_words must be at least {2 * WINDOW}")
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 256):
                ids, out, shas = b.column("doc_id")[lo : lo + 256], [], []
                for d, t in zip(ids, b.column("text")[lo : lo + 256], strict=True):
                    words = t.as_py().split()  # bytes are split at blank, tab, LF, VT, FF and CR only
                    if edit:
                        words = edit(words, d.as_py())
                    found = word_runs(words, min_words)
                    kept = b" ".join(collapse(words, found))
                    shas.append(hashlib.sha256(kept).hexdigest())
                    out.append({"runs": [{"start": s, "length": n, "period": q} for s, n, q in found], "n_words": len(words), "collapsed": kept.decode() if texts else None})
                cols = pa.RecordBatch.from_pylist(out, _OUT)
                yield pa.RecordBatch.from_arrays([ids, *cols.columns, pa.array(shas, pa.string())], ["doc_id", *_OUT.names, "collapsed_sha256"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, runs array<struct<start: long, length: long, period: long>>, n_words long, collapsed string, collapsed_sha256 string")


def report(found: DataFrame) -> DataFrame:
    """The number of runs, the longest one (then the first, then the shortest period), and
    digests of all runs and of the kept words."""
    runs = F.col("runs")
    order = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text = F.concat(lines, F.when(F.size(runs) > 0, "\n").otherwise(""))
    return found.withColumn("_best", order).select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        (-F.col("_best.n")).alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("(1000 * -_best.n) div _best.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


def plant(words: list[bytes], doc_id: object) -> list[bytes]:
    """Words with a periodic end where 10 divides the crc32 of the id in decimals."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: runs of the words of all documents, a tenth of them made periodic at the end."""
    return report(find(table(spark, sf_dir, "documents"), edit=plant, texts=False))
