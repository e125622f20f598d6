"""Token counts by a linear longest-match automaton.

The vocabulary is a trie of byte strings. Each trie node has a failure link and the number
of pieces that are popped when the scan fails there, so that a word is scanned once, from
left to right, and its number of greedy longest-match pieces comes out without any piece
being built. Words of a batch are scanned side by side, one byte of all of them at a time;
words met before in a task are looked up.

A word is a run of characters other than blank, tab, LF, VT, FF, CR, and is matched with
``mark`` before it, by default the blank with which such vocabularies write the start of a
word. White space itself counts no pieces. The vocabulary file is read on the driver (it
is checked against ``max_pieces``) and shipped as a few arrays.

Defined results: null and empty texts have no pieces; a word with a byte that no piece
starts with counts as one unknown piece; repeated rows are counted each; no rows, no
result rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import textvec
from trellis.llm.common import arrow_batches, table

#: Where the query looks for its vocabulary, unless TRELLIS_VOCABULARY names another file.
VOCABULARY = os.environ.get("TRELLIS_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
_MEMO, _LONG = 400_000, 256


@dataclass
class Automaton:
    """edge: sorted node * 256 + byte; to: the node it leads to; fail, pops: of each node
    (fail -1: no way on); ends: pieces that are left when a word ends in the node (-1: none)."""

    edge: np.ndarray
    to: np.ndarray
    fail: np.ndarray
    pops: np.ndarray
    ends: np.ndarray
    mark: bytes
    #: The same for words that are walked alone: made on first use.
    steps: dict[int, int] = field(default_factory=dict)
    links: list[tuple[int, int]] = field(default_factory=list)

    def walk(self, state: int, count: int, data: bytes) -> tuple[int, int]:
        """State and count after the bytes of one long word, in plain integers."""
        if not self.steps:
            self.steps = dict(zip(self.edge.tolist(), self.to.tolist(), strict=True))
            self.links = list(zip(self.fail.tolist(), self.pops.tolist(), strict=True))
        steps, links = self.steps, self.links
        for c in data:
            to = steps.get(state * 256 + c)
            while to is None and state >= 0:
                state, n = links[state]
                count += n
                to = steps.get(state * 256 + c) if state >= 0 else None
            if state < 0:
                return state, count
            state = to
        return state, count


def read_vocabulary(path: str, max_pieces: int = 2_000_000) -> list[bytes]:
    """Pieces of a file of lines "base64 rank"."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary at {path}; give the path of a file of lines 'base64 rank'")
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    if len(pieces) > max_pieces:
        raise ValueError(f"more than {max_pieces} pieces")
    return pieces


def build(pieces: Iterable[bytes], mark: bytes = b" ") -> Automaton:
    goto: list[dict[int, int]] = [{}]
    up: list[tuple[int, int]] = [(-1, -1)]
    piece = [False]
    for p in pieces:
        v = 0
        for c in p:
            nxt = goto[v].get(c)
            if nxt is None:
                nxt = len(goto)
                goto[v][c] = nxt
                goto.append({})
                up.append((v, c))
                piece.append(False)
            v = nxt
        piece[v] = piece[v] or v > 0
    n = len(goto)
    fail, pops, ends = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
    ends[0] = 0
    level = list(goto[0].values())
    while level:  # by depth, as a node's link builds on its parent's
        below = []
        for v in level:
            u, c = up[v]
            if piece[v]:
                fail[v], pops[v] = 0, 1
            else:
                z, k = int(fail[u]), int(pops[u])
                while z >= 0 and c not in goto[z]:
                    k += int(pops[z])
                    z = int(fail[z])
                if z >= 0:
                    fail[v], pops[v] = goto[z][c], k
            if fail[v] >= 0 and ends[fail[v]] >= 0:
                ends[v] = pops[v] + ends[fail[v]]
            below += goto[v].values()
        level = below
    edges = sorted((v * 256 + c, t) for v, g in enumerate(goto) for c, t in g.items())
    return Automaton(np.array([e for e, _ in edges], np.int64), np.array([t for _, t in edges], np.int64), fail, pops, ends, mark)


def _step(a: Automaton, state: np.ndarray, c: np.ndarray, count: np.ndarray) -> np.ndarray:
    """States after reading a byte each; -1 where no piece can go on."""
    todo = np.flatnonzero(state >= 0)
    while len(todo):
        key = state[todo] * 256 + c[todo]
        i = np.minimum(np.searchsorted(a.edge, key), len(a.edge) - 1)
        hit = a.edge[i] == key
        state[todo[hit]] = a.to[i[hit]]
        todo = todo[~hit]
        count[todo] += a.pops[state[todo]]
        state[todo] = a.fail[state[todo]]
        todo = todo[state[todo] >= 0]
    return state


def count_pieces(a: Automaton, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Greedy pieces of each word data[start:end], with the mark before it."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    state, count = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    for c in a.mark:
        state = _step(a, state, np.full(len(state), c, np.int64), count)
    live = len(order)
    for p in range(int(min(size[0], _LONG)) if len(size) else 0):
        live = int(np.searchsorted(-size, -p, "left"))  # words longer than p come first
        state[:live] = _step(a, state[:live].copy(), data[start[:live] + p].astype(np.int64), count[:live])
    for w in np.flatnonzero((size > _LONG) & (state >= 0)):
        state[w], count[w] = a.walk(int(state[w]), int(count[w]), data[start[w] + _LONG : start[w] + size[w]].tobytes())
    left = np.where(state >= 0, a.ends[state], -1)
    out = np.empty(len(order), np.int64)
    out[order] = np.where(left >= 0, count + left, 1)
    return out


class _Memo:
    """Counts of words met before in this task; a bounded cache, without effect on results."""

    def __init__(self) -> None:
        self.hash, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def counts(self, a: Automaton, w: textvec.Words) -> np.ndarray:
        h, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
        out = np.zeros(len(h), np.int64)
        new = np.ones(len(h), bool)
        if len(self.hash):
            i = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            new = self.hash[i] != h
            out[~new] = self.count[i[~new]]
        at = first[new]
        out[new] = count_pieces(a, w.data, w.start[at], w.end[at])
        if len(self.hash) < _MEMO:
            keys, order = np.unique(np.concatenate([self.hash, h[new]]), return_index=True)
            self.hash, self.count = keys, np.concatenate([self.count, out[new]])[order]
        return out[back]


def count(docs: DataFrame, pieces: Iterable[bytes], mark: bytes = b" ", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_pieces, n_bytes, max_word_pieces of each document."""
    arrow_batches(docs.sparkSession)
    spark, a = docs.sparkSession, build(pieces, mark)
    shipped = spark.sparkContext.broadcast(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo()
        for b in batches:
            for w in textvec.words(b.column("text"), lower=False):
                n = memo.counts(shipped.value, w) if len(w.start) else np.zeros(0, np.int64)
                rows = len(w.count)
                most = np.zeros(rows, np.int64)
                np.maximum.at(most, w.row, n)
                lo, hi = w.rows
                cols = [b.column("doc_id")[lo:hi], pa.array(w.count.astype(np.int64)), pa.array(np.bincount(w.row, weights=n, minlength=rows).astype(np.int64)), b.column("n_bytes")[lo:hi], pa.array(most)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_pieces", "n_bytes", "max_word_pieces"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_words long, n_pieces long, n_bytes long, max_word_pieces long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: greedy piece counts of all documents."""
    return count(table(spark, sf_dir, "documents"), read_vocabulary(VOCABULARY))
