"""Near-duplicate classes by DartMinHash and banding.

Texts are multisets (or, with ``weights="set"``, sets) of shingles of five words, and a
shingle weighs as much as it occurs. Every
element owns a plane of weight and rank over which a fixed hash throws darts, one expected
in each cell of area one. Cells are as wide as high for weights below one, and twice as wide and
half as high from each power of two on, so a text visits about as many cells as it has darts, and
for each element the logarithm of its weight, however heavy elements are. A text takes the darts under its elements' weights whose rank is below
a bound chosen so that about k ln k + 2k darts fall in; each dart belongs to one of k
coordinates, and the lowest rank of a coordinate is its signature. Two texts agree in a
coordinate with a probability equal to their weighted Jaccard similarity. Texts with an
empty coordinate throw again with the bound doubled, which changes no filled one; a coordinate
that no throw fills counts as the highest rank, which all such texts share.

Signatures are cut into bands. First, texts with the same words fall together by a 128-bit
digest, whatever the size of the group. Then each text is compared with the smallest of
each of its buckets, which joins most classes at linear cost. Buckets that still hold
several classes are looked at again: those of at most ``wide`` texts by all pairs across
classes; larger ones with four leaders each, which joins most of what belongs together,
and then the texts of those with several classes left by an exact join. Two sets at the threshold share one of
the first elements of each, in any order that holds for all sets; elements that only one
class has come first, then rare ones. So texts meet where they share such an element, are
of different classes and can still reach the threshold by their sizes and the elements'
places. No bucket is cut, and no link within one is lost. Every comparison is of the whole
shingle sets. Classes are the connected components of the pairs at or above ``threshold``.

Defined results: null and empty texts are one class of their own; texts of one to four
words have one shingle, all their words; a class is named by its smallest id (nulls are
last); of repeated rows one is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellis.llm import textvec
from trellis.llm.common import arrow_batches, fresh, join_frequent, materialize, row_hash, table
from trellis.llm.graph import components

SHINGLE = 5
_RANK_BITS, _FRACTION_BITS, _ROWS = 46, 32, 1 << 6
#: 2 ** 20 cells of one byte are the table of ranks that tasks get.
_CELL_BITS = 20
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])


def shingles(w: textvec.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``size`` words in a row, or of all words if there are fewer."""
    h = w.hashes()
    if not len(h):
        return h, w.row
    c = textvec.mix(np.arange(1, size + 1, dtype=np.uint64), 3) | np.uint64(1)
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    first, last = textvec.run_starts(w.count), np.cumsum(w.count)
    left = last[w.row] - np.arange(len(h))
    with np.errstate(over="ignore"):
        s = np.zeros(len(h), np.uint64)
        for i in range(size):
            s += np.where(left > i, padded[i : i + len(h)], np.uint64(0)) * c[i]
    good = (left >= size) | (np.arange(len(h)) == first[w.row])
    return textvec.mix(s[good], 4), w.row[good]


def weighted(s: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each row with their number of occurrences."""
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    new = np.append(True, (s[1:] != s[:-1]) | (row[1:] != row[:-1])) if len(s) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return s[at], row[at], np.diff(np.append(at, len(s))).astype(float)


def dart_minhash(s: np.ndarray, row: np.ndarray, weight: np.ndarray | None, rows: int, k: int) -> np.ndarray:
    """rows x k signatures; 0 in rows without elements. Without weights all are 1, and
    repeated elements count once."""
    out = np.zeros((rows, k), np.uint64)
    for lo in range(0, rows, _ROWS):
        i, j = np.searchsorted(row, lo), np.searchsorted(row, min(rows, lo + _ROWS))
        if j > i:
            out[lo : lo + _ROWS] = _throw(s[i:j], row[i:j] - lo, None if weight is None else weight[i:j], min(rows - lo, _ROWS), k)
    return out


def _throw(s: np.ndarray, row: np.ndarray, weight: np.ndarray | None, rows: int, k: int) -> np.ndarray:
    out = np.zeros((rows, k), np.uint64)
    darts = k * math.log(k) + 2 * k
    while len(s):
        mass = np.bincount(row, weights=weight, minlength=rows)
        bound = np.minimum(darts / np.maximum(mass, 1e-12), float(1 << (_RANK_BITS - _FRACTION_BITS - 1)))
        # region 0 holds weights from 0 to 1, region g those from 2 ** (g - 1) to 2 ** g
        regions = np.ones(len(s), np.int64) if weight is None else 1 + np.ceil(np.log2(np.maximum(weight, 1.0))).astype(np.int64)
        e = np.repeat(np.arange(len(s)), regions)
        region = np.arange(len(e)) - np.repeat(np.cumsum(regions) - regions, regions)
        flat = np.maximum(region - 1, 0)  # halvings of the height
        cells = np.ceil(np.ldexp(bound[row[e]], flat)).astype(np.int64)
        c = np.repeat(np.arange(len(e)), cells)
        rank = np.arange(len(c)) - np.repeat(np.cumsum(cells) - cells, cells)
        h = textvec.mix(s[e[c]] ^ textvec.mix((region[c] << 32) | rank, 6))
        n = np.searchsorted(_POISSON, (h >> np.uint64(11)).astype(float) * 2.0**-53, "right")
        at = np.repeat(np.arange(len(c)), n)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        d = textvec.mix(h[at] + nth.astype(np.uint64), 8)
        of = c[at]
        r = ((rank[at].astype(np.uint64) << np.uint64(_FRACTION_BITS)) | (d >> np.uint64(64 - _FRACTION_BITS))) >> flat[of].astype(np.uint64)
        own = row[e[of]]
        keep = r < (bound[own] * 2.0**_FRACTION_BITS).astype(np.uint64)
        if weight is not None:
            high = (textvec.mix(d, 9) >> np.uint64(11)).astype(float) * 2.0**-53
            keep &= np.ldexp((region[of] > 0) + high, flat[of]) < weight[e[of]]
        r, own, d = r[keep], own[keep], d[keep]
        slot = own * k + ((d & np.uint64(0xFFFFFFFF)) % np.uint64(k)).astype(np.int64)
        packed = np.sort((slot.astype(np.uint64) << np.uint64(_RANK_BITS)) | (r + np.uint64(1))) if rows * k < 1 << (64 - _RANK_BITS) else None
        if packed is None:
            order = np.lexsort((r, slot))
            slot, r = slot[order], r[order] + np.uint64(1)
        else:
            slot, r = (packed >> np.uint64(_RANK_BITS)).astype(np.int64), packed & np.uint64((1 << _RANK_BITS) - 1)
        low = np.append(True, slot[1:] != slot[:-1]) if len(slot) else np.zeros(0, bool)
        out.reshape(-1)[slot[low]] = r[low]
        empty = (out == 0).any(axis=1) & (mass > 0)
        again = empty[row]
        s, row, weight, darts = s[again], row[again], None if weight is None else weight[again], darts * 2
        if len(s) and darts > k * float(1 << 20):
            left = empty[:, None] & (out == 0)
            out[left] = (1 << _RANK_BITS) - 1
            break
    return out


def band_keys(sig: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    """rows x bands keys, each of its own band's coordinates and number."""
    c = textvec.mix(np.arange(per_band, dtype=np.uint64), 12) | np.uint64(1)
    with np.errstate(over="ignore"):
        mixed = (textvec.mix(sig.reshape(len(sig), bands, per_band), 13) * c).sum(axis=2, dtype=np.uint64)
    return textvec.mix(mixed ^ textvec.mix(np.arange(bands, dtype=np.uint64), 14), 15)


def digest(w: textvec.Words) -> np.ndarray:
    """128 bits (rows x 2) of each row's sequence of words."""
    h, rows = w.hashes(), w.rows[1] - w.rows[0]
    out = np.zeros((rows, 2), np.uint64)
    if len(h):
        pos = np.arange(len(h)) - textvec.run_starts(w.count)[w.row]
        some = w.count > 0
        for i in (0, 1):
            with np.errstate(over="ignore"):
                out[some, i] = np.add.reduceat(textvec.mix(h ^ textvec.mix(pos, 20 + i), 22 + i), textvec.run_starts(w.count)[some])
    for i in (0, 1):
        out[:, i] = textvec.mix(out[:, i] ^ textvec.mix(w.count, 24), 26 + i)
    return out


def _binary(d: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(d.astype(">u8"))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(d), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def signatures(docs: DataFrame, bands: int, per_band: int, weights: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, v, keys): h hashes the text, v is the digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in textvec.words(b.column("text")):
                s, row = shingles(w)
                mass = None
                if weights == "count":
                    s, row, mass = weighted(s, row)
                keys = band_keys(dart_minhash(s, row, mass, len(w.count), bands * per_band), bands, per_band)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
                lo, hi = w.rows
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], b.column("h")[lo:hi], _binary(digest(w)), pa.array(w.count.astype(np.int64)), lists], ["doc_id", "h", "v", "n", "keys"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, h long, v binary, n long, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, weights: str, id_col: str, text_col: str) -> DataFrame:
    """(v, items): sorted elements of the documents in ``wanted`` (doc_id, h, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in textvec.words(b.column("text")):
                s, row, mass = weighted(*shingles(w))
                if weights == "count":  # the i-th occurrence is an element of its own
                    n = mass.astype(np.int64)
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    s, row = textvec.mix(np.repeat(s, n) ^ textvec.mix(nth, 30)), np.repeat(row, n)
                off = np.append(0, np.cumsum(np.bincount(row, minlength=len(w.count)))).astype(np.int32)
                lo, hi = w.rows
                yield pa.RecordBatch.from_arrays([b.column("v")[lo:hi], pa.ListArray.from_arrays(pa.array(off), pa.array(s.view(np.int64)))], ["v", "items"])

    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).withColumn("_h", F.xxhash64(F.coalesce("text", F.lit(""))))
    pick = own.join(wanted, own["_id"].eqNullSafe(wanted["doc_id"]) & (own["_h"] == wanted["h"])).select("v", "text")
    return pick.mapInArrow(run, "v binary, items array<long>").dropDuplicates(["v"])


def _links(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets reach the threshold, with their similarity."""
    left = sets.select(F.col("v").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("v").alias("b"), F.col("items").alias("y"))
    both = pairs.join(right, "b").where(F.size("y") > 0).join(left, "a")
    nx, ny = F.size("x"), F.size("y")
    could = F.least(nx, ny) >= F.lit(threshold) * F.greatest(nx, ny) - 1e-9
    same = F.size(F.array_intersect("x", "y"))
    return both.where(could).select("a", "b", (same / (nx + ny - same)).alias("sim")).where(F.col("sim") >= threshold - 1e-9)


def _open(label: DataFrame, wide: int, total: int) -> DataFrame:
    """Members (key, v, comp, m) of buckets with several classes and m members; narrow: few."""
    mixed = label.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("m")).where("c0 <> c1")
    return materialize(join_frequent(label, mixed.select("key", "m", (F.col("m") <= wide).alias("narrow")), ["key"], "m", total), "near-open")


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _across(label: DataFrame) -> DataFrame:
    """All pairs of different classes of each bucket; buckets are of bounded size here."""
    lists = label.groupBy("key").agg(F.collect_list(F.struct("v", "comp")).alias("m"))
    first = lists.select("m", F.explode("m").alias("x"))
    both = first.select("x", F.explode(F.filter("m", lambda y: (y["v"] > F.col("x.v")) & (y["comp"] != F.col("x.comp")))).alias("y"))
    return both.select(*_pair("x.v", "y.v"))


def _rotated(label: DataFrame, total: int, leaders: int = 4) -> DataFrame:
    """Each member with ``leaders`` members of its bucket picked by different hashes."""
    picks = F.array(*[F.min(F.struct(F.xxhash64("v", F.lit(i)).alias("o"), "v", "comp")).alias(f"l{i}") for i in range(leaders)]).alias("picks")
    led = label.groupBy("key").agg(picks, F.max("m").alias("m"))
    both = join_frequent(label.select("key", "v", "comp"), led, ["key"], "m", total).select("v", "comp", F.explode("picks").alias("l")).where(F.col("comp") != F.col("l.comp"))
    return both.select(*_pair("v", "l.v"))


def _cells(items: np.ndarray) -> np.ndarray:
    return (textvec.mix(items.view(np.uint64), 50) >> np.uint64(64 - _CELL_BITS)).astype(np.int64)


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(elements, row of each, number in each row) of the column ``items``."""
    lists = b.column("items")
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), n), n


def _ranks(members: DataFrame, parts: int = 16) -> np.ndarray:
    """A rank for each hashed cell of elements: 0 if all its elements are of one class, else
    more the more texts hold them. A table of one size, whatever the number of texts."""
    cut = _CELL_BITS - int(math.log2(parts))
    kind = "part int, cell binary, low binary, high binary, n binary"

    def merged(cell: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        return [cell[at]] + [f.reduceat(x[order], at) if len(at) else x for f, x in ((np.minimum, low), (np.maximum, high), (np.add, n))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        for b in batches:
            items, row, _ = _flat(b)
            own = b.column("c").to_numpy()[row]
            new = merged(_cells(items), own, own, np.ones(len(own), np.int64))
            held = merged(*[np.concatenate(x) for x in zip(held, new, strict=True)])
        bounds = np.searchsorted(held[0] >> cut, np.arange(parts + 1))
        for i in np.flatnonzero(np.diff(bounds)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *[pa.array([x[bounds[i] : bounds[i + 1]].tobytes()], pa.binary()) for x in held]], ["part", "cell", "low", "high", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        for b in batches:
            for i in range(b.num_rows):
                new = [np.frombuffer(b.column(k)[i].as_py(), np.int64) for k in ("cell", "low", "high", "n")]
                held = merged(*[np.concatenate(x) for x in zip(held, new, strict=True)])
        cell, low, high, n = held
        mixed = low != high
        rank = (1 + np.minimum(200, 8 * np.log2(np.maximum(1, n[mixed])))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([cell[mixed].astype(np.int32).tobytes()], pa.binary()), pa.array([rank.tobytes()], pa.binary())], ["cell", "rank"])

    out = np.zeros(1 << _CELL_BITS, np.uint8)
    for r in members.select("c", "items").mapInArrow(count, kind).repartition(parts, "part").mapInArrow(add, "cell binary, rank binary").collect():
        out[np.frombuffer(r["cell"], np.int32)] = np.frombuffer(r["rank"], np.uint8)
    return out


def _prefixes(members: DataFrame, ranks: np.ndarray, threshold: float) -> DataFrame:
    """(v, c, n, item, place, short): the first elements of each text, by rank and hash, one of
    which it must share with any text at the threshold (``short``: with any as large). Those
    of one class alone come first and need no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items, row, n = _flat(b)
            rank = ranks[_cells(items)]
            order = np.lexsort((items, rank, row))
            items, rank = items[order], rank[order]
            place = np.arange(len(items)) - textvec.run_starts(n)[row]
            size = n[row]
            left = size - np.ceil(threshold * size - 1e-6) - place
            short = size - np.ceil(2 * threshold / (1 + threshold) * size - 1e-6) - place
            at = np.flatnonzero((left >= 0) & (rank > 0))
            yield pa.RecordBatch.from_arrays([b.column("v").take(pa.array(row[at])), b.column("c").take(pa.array(row[at])), pa.array(size[at]), pa.array(items[at]), pa.array(place[at]), pa.array(short[at] >= 0)], ["v", "c", "n", "item", "place", "short"])

    return members.select("v", "c", "items").mapInArrow(run, "v binary, c long, n long, item long, place long, short boolean")


def _joined(members: DataFrame, threshold: float) -> DataFrame:
    """All pairs of ``members`` (v, c, items) of different classes c that can reach the
    threshold: an exact join on the elements that such pairs must share."""
    found = materialize(_prefixes(members, _ranks(members), threshold), "near-prefixes")
    small = found.where("short").select("item", *[F.col(x).alias(f"{x}1") for x in ("v", "c", "n", "place")])
    both = found.join(small, "item").where((F.col("c") != F.col("c1")) & (F.col("n1") <= F.col("n")) & (F.col("n1") >= F.lit(threshold) * F.col("n") - 1e-6))
    most = F.least(F.col("n") - F.col("place"), F.col("n1") - F.col("place1"))
    return both.where(most >= F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("n1")) - 1e-6).select(*_pair("v", "v1"))


def classes(docs: DataFrame, threshold: float = 0.8, bands: int = 30, per_band: int = 6, weights: str = "count", wide: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, h (hash of the text), class_id, class_size, kept, n_words."""
    arrow_batches(docs.sparkSession)
    signed = materialize(signatures(docs, bands, per_band, weights, id_col, text_col).withColumn("rowid", F.monotonically_increasing_id()), "near-signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "rowid"))
    texts = materialize(signed.groupBy("v").agg(first.alias("one"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"), F.count("*").alias("copies")), "near-texts")
    rows, kinds = (r[0] or 0 for r in texts.agg(F.array(F.sum("copies"), F.count("*")).alias("n")).select(F.explode("n")).collect())
    member = texts.where("n > 0").select("v", F.explode("keys").alias("key"))
    shared = member.groupBy("key").agg(F.min("v").alias("a"), F.count("*").alias("n")).where("n > 1")
    bucket = materialize(join_frequent(member, shared, ["key"], "n", kinds), "near-buckets")
    stars = bucket.where("v <> a").select("a", F.col("v").alias("b")).distinct()
    met = bucket.select("v").distinct()
    wanted = texts.join(met, "v").select("v", "one.doc_id", "one.h")
    sets = materialize(_sets(docs, wanted, weights, id_col, text_col), "near-sets")
    links = materialize(_links(stars, sets, threshold), "near-links")
    comp = components(links)

    label = materialize(bucket.join(comp, "v", "left").select("key", "v", F.coalesce("comp", "v").alias("comp")), "near-labels")
    open_ = _open(label, wide, kinds)
    broad = open_.where("not narrow")
    pairs = _across(open_.where("narrow")).unionByName(_rotated(broad, kinds)).distinct()
    more = materialize(_links(pairs.join(stars, ["a", "b"], "left_anti"), sets, threshold), "near-links")
    if more.take(1):
        links = links.unionByName(more)
        comp = components(links)

    # what the leaders left apart in wide buckets: each text once, with the class it has so far
    label = broad.select("key", "v").join(comp, "v", "left").select("key", "v", F.coalesce("comp", "v").alias("comp"))
    apart = _open(label, wide, kinds).select("v", F.xxhash64("comp").alias("c")).distinct()
    members = materialize(apart.join(sets, "v").select("v", "c", "items"), "near-wide")
    rest = materialize(_links(_joined(members, threshold).distinct(), sets, threshold), "near-links")
    if rest.take(1):
        comp = components(links.unionByName(rest))

    # classes are summed over texts, then given to each text and each row; large classes and
    # texts with many copies get theirs by a broadcast of bounded size
    named = materialize(texts.select("v", "one", "copies").join(comp, "v", "left").withColumn("comp", F.coalesce("comp", "v")), "near-named")
    size = named.groupBy("comp").agg(F.min("one").alias("one"), F.sum("copies").alias("class_size"), F.count("*").alias("texts"))
    each = materialize(join_frequent(named.select("v", "copies", "comp"), size, ["comp"], "texts", kinds).select("v", "copies", "one", "class_size"), "near-classes")
    out = join_frequent(signed.select("doc_id", "h", "v", "rowid", F.col("n").alias("n_words")), each, ["v"], "copies", rows)
    return out.select("doc_id", "h", F.col("one.doc_id").alias("class_id"), "class_size", (F.col("rowid") == F.col("one.rowid")).alias("kept"), "n_words")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, with all their columns. Of rows with
    the same id and text the first by a hash of all columns stays."""
    id_, h_, key_, row_, nth_ = fresh(docs, "_near_id", "_near_h", "_near_key", "_near_row", "_near_nth")
    stay = classes(docs, id_col=id_col, text_col=text_col, **how).where("kept").select(F.col("doc_id").alias(id_), F.col("h").alias(h_))
    own = docs.withColumn(key_, F.xxhash64(F.coalesce(text_col, F.lit("")))).withColumn(row_, row_hash(docs))
    found = own.join(stay, own[id_col].eqNullSafe(stay[id_]) & (own[key_] == stay[h_]), "left_semi")
    nth = F.row_number().over(Window.partitionBy(id_col, key_).orderBy(row_))
    return found.withColumn(nth_, nth).where(F.col(nth_) == 1).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: near-duplicate classes of all documents."""
    return classes(table(spark, sf_dir, "documents")).drop("h")
