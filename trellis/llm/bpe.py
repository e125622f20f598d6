"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

A text is cut into pieces by the tokenizer's pattern. For each prefix of a piece's bytes the
last token of that prefix's encoding is stored. It is unique: of the tokens that end at a
place, the one which BPE would leave next to the last token of what is before it. Whether two
tokens can stand side by side is told by undoing their merges from the youngest on: if a
merge over their border was due before one of them, they cannot. Hence

* the tokens are read back from the end, in one pass and time linear in the bytes;
* appending bytes leaves all that is stored as it is (:meth:`Prefixes.extend`);
* after an edit only what follows it is worked out again, and only until as many places in a row
  as the longest token has bytes are as before (:meth:`Prefixes.replace`).

The rank file says which byte strings are tokens; lower ranks merge first. A piece that is a
token as a whole is that token. Tokens that merging does not lead to stand for such pieces only.
Ranks are read on the driver (checked against ``max_tokens``) and shipped; tasks stream their
texts piece by piece in bounded runs, so a very long text needs no list of its own, and
pieces met before in a task are looked up.

Defined results: a null text is empty, an empty text has no tokens; special tokens are ordinary
text; repeated rows are encoded each; an id that is not in the vocabulary cannot be decoded
and is an error; no rows, no result rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.common import arrow_batches, table

#: Pieces handled at once, entries of a generation of looked-up pieces, letters of such a piece.
_RUN, _MEMO, _MEMO_BYTES = 1 << 15, 1 << 17, 64


class Vocabulary:
    """Tokens by id, and what encoding needs; the latter is built on first use in a process, see
    :meth:`build`."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError("every single byte must be a token")
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        if len(self.token) != len(ranks):
            raise ValueError("two tokens have one rank")
        self.longest = max(map(len, ranks))
        self.go: dict[int, int] | None = None

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["ranks"])

    def build(self) -> Vocabulary:
        """``split``: the two tokens that a token's last merge joins (none: a single byte).
        ``go``: state * 256 + byte to the next state of an automaton over the reachable tokens;
        ``ending``: of each state the (token, bytes) that end there, the longest first."""
        if self.go is not None:
            return self
        self.split, self.pairs = {}, {}
        go: dict[int, int] = {}
        own: list[tuple] = [()]
        nodes: list[tuple[int, int, int]] = []  # state, the one before it, byte; by depth below
        depth = [0]
        for t, i in self.ranks.items():
            parts = merge(t, self.ranks, 2) if len(t) > 1 else [t]
            if len(t) > 1 and len(parts) > 2:
                continue  # merging does not lead to it
            self.split[i] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(t) > 1 else None
            at = 0
            for b in t:
                to = go.get(at << 8 | b)
                if to is None:
                    to = go[at << 8 | b] = len(own)
                    nodes.append((to, at, b))
                    own.append(())
                    depth.append(depth[at] + 1)
                at = to
            own[at] = ((i, len(t)),)
        self.back = [0] * len(own)
        self.go, self.ending, self.edges = go, own, len(go)
        for state, before, b in sorted(nodes, key=lambda x: depth[x[0]]):
            if before:
                self.back[state] = self.step(self.back[before], b)
            own[state] += own[self.back[state]]
        return self

    def step(self, state: int, b: int) -> int:
        """The state of the longest ending that is the start of a token, one byte on."""
        to = self.go.get(state << 8 | b)
        if to is None:
            to = self.step(self.back[state], b) if state else 0
            if len(self.go) - self.edges < 4 * _MEMO:
                self.go[state << 8 | b] = to
        return to

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether BPE of the two tokens' bytes leaves just these two."""
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) >= 4 * _MEMO:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        ranks, token, split = self.ranks, self.token, self.split
        due = float("inf")  # merges over the border must come later than this one
        while True:
            over = ranks.get(token[a] + token[b])
            if over is not None and over < due:
                return False
            # undo the younger of the two; of two equal merges the right one is the younger, and a
            # merge over the border of the same rank is younger than one left of it
            left, right = split[a], split[b]
            if left is not None and (right is None or a > b):
                due, a = a, left[1]
            elif right is not None:
                due, b = b + 1, right[0]
            else:
                return True


def merge(data: bytes, ranks: dict[bytes, int], leave: int = 1) -> list[bytes]:
    """The parts of ``data`` by merging, always the pair of the lowest rank, the leftmost first,
    until ``leave`` parts are left or nothing merges."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > leave:
        best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1)))
        if best[0] == 1 << 62:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


class Prefixes:
    """The last token of every prefix of some bytes. ``last[i]`` belongs to the first i + 1."""

    def __init__(self, v: Vocabulary, data: bytes = b"") -> None:
        self.v, self.data, self.last, self._states = v.build(), bytearray(), [], [0]
        self.extend(data)

    def _grow(self, data: bytes | bytearray) -> None:
        """Last tokens of the prefixes that end with each of the next bytes."""
        v, last, state = self.v, self.last, self._states[-1]
        go, ending, pairs, add, keep = v.go.get, v.ending, v.pairs.get, last.append, self._states.append
        end = len(last)
        for b in data:
            to = go(state << 8 | b)
            state = v.step(state, b) if to is None else to
            for t, n in ending[state]:  # the longest first, as it mostly is the one
                if n > end:
                    break
                before = last[end - n]
                fits = pairs(before << 32 | t)
                if v.side_by_side(before, t) if fits is None else fits:
                    break
            else:
                raise AssertionError("no token fits")
            add(t)
            keep(state)
            end += 1

    def extend(self, data: bytes) -> None:
        """Append bytes; nothing that is stored changes."""
        self.data += data
        self._grow(data)

    def cut(self, n: int) -> None:
        """Keep the first ``n`` bytes and what is stored of them."""
        del self.data[n:], self.last[n:], self._states[n + 1 :]

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` in place of the bytes from ``start`` to ``stop``; returns for how many
        places the last token was worked out."""
        if not 0 <= start <= stop <= len(self.data):
            raise ValueError("start and stop must lie in the data, in this order")
        old, states = self.last[stop:], self._states[stop + 1 :]
        rest = self.data[stop:]
        self.cut(start)
        self.extend(data)
        same = 0
        for j in range(len(rest)):  # the places in what followed the edit
            self.extend(rest[j : j + 1])
            same = same + 1 if old[j] == self.last[-1] else 0
            if same >= self.v.longest:
                done = len(self.last) - start
                self.data += rest[j + 1 :]
                self.last += old[j + 1 :]
                self._states += states[j + 1 :]
                return done
        return len(self.last) - start

    def tokens(self, whole: bool = True) -> list[int]:
        """The encoding; with ``whole``, of a piece that may be a token itself."""
        if whole and self.data:
            one = self.v.ranks.get(bytes(self.data))
            if one is not None:
                return [one]
        out, end = [], len(self.last)
        while end:
            t = self.last[end - 1]
            out.append(t)
            end -= len(self.v.token[t])
        return out[::-1]


class Encoder:
    """Pieces of texts to ids, or to what ``make`` makes of their ids. What it remembers of pieces
    met before is bounded: two generations, of which the older goes when the younger is full.
    New pieces are worked on in order, so that each keeps what it has in common with the one before."""

    def __init__(self, v: Vocabulary, pattern: str, make: Callable[[list[int]], object] = list) -> None:
        self.v, self.pattern, self.make = v.build(), regex.compile(pattern), make
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def known(self, pieces: Iterable[str]) -> dict[str, object]:
        """What is made of each of some matches of the pattern."""
        out: dict[str, object] = {}
        new: list[tuple[bytes, str]] = []
        for p in set(pieces):
            found = self.young.get(p)
            if found is None:
                found = self.old.get(p)
                if found is None:
                    new.append((p.encode("utf-8", "replace"), p))
                    continue
                self._remember(p, found)
            out[p] = found
        ranks, held, before = self.v.ranks, Prefixes(self.v), b""
        new.sort()
        for raw, p in new:
            one = ranks.get(raw)
            if one is None:
                n = 0
                for x, y in zip(before, raw, strict=False):
                    if x != y:
                        break
                    n += 1
                held.cut(n)
                held.extend(raw[n:])
                before = raw
            out[p] = found = self.make(held.tokens(False) if one is None else [one])
            self._remember(p, found)
        return out

    def _remember(self, p: str, found: object) -> None:
        if len(p) <= _MEMO_BYTES:
            if len(self.young) >= _MEMO:
                self.old, self.young = self.young, {}
            self.young[p] = found

    def runs(self, text: str) -> Iterator[list]:
        """What is made of consecutive pieces, a bounded number at a time."""
        matches = (m.group() for m in self.pattern.finditer(text))
        while run := list(islice(matches, _RUN)):
            yield list(map(self.known(run).__getitem__, run))

    def many(self, texts: Iterable[str]) -> Iterator[Iterable[list]]:
        """:meth:`runs` of each text; those of short ones are looked up together."""
        some = [(t, self.pattern.findall(t) if len(t) <= _RUN and not self.pattern.groups else None) for t in texts]
        get = self.known(chain.from_iterable(pieces for _, pieces in some if pieces)).__getitem__
        for t, pieces in some:
            yield self.runs(t) if pieces is None else [list(map(get, pieces))] if pieces else []


@contextmanager
def _no_cycles() -> Iterator[None]:
    """No search for cyclic garbage meanwhile: there is none, and it takes a third of the time to
    walk over the look-up tables again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def read_ranks(path: str, max_tokens: int = 2_000_000) -> dict[bytes, int]:
    """Tokens and ranks of a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if len(ranks) > max_tokens:
        raise ValueError(f"more than {max_tokens} tokens")
    return ranks


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each document."""
    arrow_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(Vocabulary(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _no_cycles():
            yield from encoded(batches)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(shipped.value, pattern)
        for b in batches:
            for lo in range(0, len(b), 256):
                texts = b.column("text")[lo : lo + 256]
                rows = [pa.array([t for r in runs for ids in r for t in ids], pa.int32()) for runs in e.many(texts.to_pylist())]
                offsets = pa.array([0, *_sums(map(len, rows))], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo : lo + 256], pa.ListArray.from_arrays(offsets, pa.concat_arrays(rows))], ["doc_id", "ids"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def _sums(n: Iterable[int]) -> Iterator[int]:
    total = 0
    for k in n:
        total += k
        yield total


def decode(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, data): the bytes of each row's ids; null ids give no bytes."""
    shipped = encoded.sparkSession.sparkContext.broadcast(Vocabulary(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shipped.value.token
        for b in batches:
            ids = b.column("ids")
            data = [b"".join([token[t] for t in x.as_py() or []]) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    own = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, data binary")


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document: encoded, and its ids
    decoded again, run by run, so that no text's ids are held as a whole."""
    arrow_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(Vocabulary(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _no_cycles():
            yield from digested(batches)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, token = {i: str(i) for i in shipped.value.token}, shipped.value.token
        e = Encoder(shipped.value, pattern, lambda ids: (len(ids), ",".join([name[t] for t in ids]), b"".join([token[t] for t in ids])))
        for b in batches:
            rows = []
            for lo in range(0, len(b), 256):
                for runs in e.many(b.column("text")[lo : lo + 256].to_pylist()):
                    n, ids_sha, bytes_sha = 0, hashlib.sha256(), hashlib.sha256()
                    for run in runs:
                        count, ids, data = zip(*run, strict=True)
                        ids_sha.update((("," if n else "") + ",".join(ids)).encode())
                        bytes_sha.update(b"".join(data))
                        n += sum(count)
                    rows.append((n, ids_sha.hexdigest(), bytes_sha.hexdigest()))
            cols = [b.column("doc_id"), *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all documents by the multilingual vocabulary, encoded and decoded again."""
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
