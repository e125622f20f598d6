"""Line dedup by a deletion-neighbourhood join.

A line goes if an earlier line (by document id, then place) is equal to it or within one
edit of it; lines without a word stay, as do lines within one edit but shorter than
``min_chars`` characters. Equal lines first fall together under a 128-bit digest. Of two
lines one edit apart, one deletion from one or both makes them equal, so lines emit hashes
of themselves and of themselves with a character left out, and equal hashes are joined.

A line of 300 characters has 300 such variants, so only those are emitted that can meet
another line: if an edit lies in the i-th of ``parts`` parts of a line, everything before
and after that part is shared. Lines send the hashes of these two ends together; only
where two different lines share them are variants with a deletion inside that part emitted.
This loses no pair. A hash that many lines share is joined with its earliest line alone, as
each other line needs one earlier neighbour only; pairs are checked by edit distance.

The input should be a written table (or another with a fixed order of rows), as it is read
twice and its rows are told apart by their place.

Defined results: null and empty texts have one empty line, which stays; ids may be of any
type that can be ordered; a null id comes after all others; repeated rows are told apart by their order in a written table, the later
one losing its lines; an empty table gives no rows; other columns are kept by :func:`clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellis.llm import textvec
from trellis.llm.common import arrow_batches, fresh, join_frequent, materialize, table

_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.append(np.uint64(1), np.full(n, base)), dtype=np.uint64)


class Lines:
    """The lines of a slice of texts as flat arrays of code points.

    row, nth: text and place of each line; start, size: in ``code``. Sums of
    code * base**place, taken as differences of one running sum, hash any run of characters.
    """

    def __init__(self, texts: list[str]) -> None:
        joined = "".join(t + "\n" for t in texts)
        self.code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        end = np.flatnonzero(self.code == 10)
        self.start = np.append(0, end[:-1] + 1) if len(end) else np.zeros(0, np.int64)
        self.size = end - self.start
        stop = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        self.row = np.searchsorted(stop, end, "left") if len(end) else np.zeros(0, np.int64)
        self.row = np.searchsorted(stop - 1, end, "left") if len(end) else self.row
        count = np.bincount(self.row, minlength=len(texts))
        self.nth = np.arange(len(end)) - textvec.run_starts(count)[self.row]
        word = (self.code > 32) | ((self.code < 32) & ((self.code < 9) | (self.code > 13)))
        self.word = np.add.reduceat(word.astype(np.int64), self.start) > 0 if len(end) else np.zeros(0, bool)
        self.up, self.down = _powers(_BASE, len(self.code)), _powers(_INVERSE, len(self.code))
        # two independent sums, of mixed code points
        self.sums = []
        for seed in (31, 32):
            with np.errstate(over="ignore"):
                self.sums.append(np.append(np.uint64(0), np.cumsum(textvec.mix(self.code, seed) * self.up[: len(self.code)], dtype=np.uint64)))

    def run(self, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
        """Hash sum of the characters a..b-1, as if the run began at place 0."""
        with np.errstate(over="ignore"):
            return (self.sums[which][b] - self.sums[which][a]) * self.down[a]

    def digest(self, which: int) -> np.ndarray:
        return textvec.mix(self.run(self.start, self.start + self.size, which) ^ textvec.mix(self.size, 33), 34 + which)


def _ends(size: np.ndarray, base: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(characters before, characters after) part i of lines compared as ``base`` long."""
    return base * i // parts, base * (parts - 1 - i) // parts


def _end_keys(x: Lines, parts: int) -> np.ndarray:
    """lines x 2 parts: hashes of both ends around each part, as of the line's own length
    and as of one less (for a partner that is one shorter)."""
    out = np.empty((len(x.start), 2 * parts), np.uint64)
    for j, base in enumerate((x.size, x.size - 1)):
        base = np.maximum(base, 0)
        for i in range(parts):
            before, after = _ends(x.size, base, i, parts)
            stop = x.start + x.size
            with np.errstate(over="ignore"):
                both = x.run(x.start, x.start + before) ^ textvec.mix(x.run(stop - after, stop), 36)
            out[:, j * parts + i] = textvec.mix(both ^ textvec.mix(base * parts + i, 37), 38)
    return out


def _slices(b: pa.RecordBatch, size: int = 1 << 20) -> Iterator[tuple[int, int, list[str]]]:
    """Rows lo..hi-1 and their texts, about ``size`` characters at a time."""
    texts = [t or "" for t in b.column("text").to_pylist()]
    lo = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield lo, i + 1, texts[lo : i + 1]
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts), texts[lo:]


def _ints(*cols: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in cols]


def lines(docs: DataFrame, parts: int, min_chars: int) -> DataFrame:
    """(doc, nth, h1, h2, size, word, keys) of each line of ``docs`` (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in _slices(b):
                x = Lines(texts)
                keys = _end_keys(x, parts)
                n = np.where(x.word & (x.size >= min_chars), 2 * parts, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(keys[n > 0].reshape(-1).view(np.int64)))
                cols = _ints(x.nth, x.digest(0), x.digest(1), x.size)
                yield pa.RecordBatch.from_arrays([b.column("doc")[lo:hi].take(pa.array(x.row)), *cols, pa.array(x.word), lists], ["doc", "nth", "h1", "h2", "size", "word", "keys"])

    return docs.mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, nth long, h1 long, h2 long, size long, word boolean, keys array<long>")


def variants(found: DataFrame, parts: int) -> DataFrame:
    """(h1, h2, full, key): for the lines and parts in ``found`` (h1, h2, text, part), where
    part is the place of the shared ends among the line's keys: the line itself (full) and
    the line less one character inside the part, tagged once with the place of the deletion,
    which meets a substitution, and once without, which meets an insertion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in _slices(b):
                x = Lines(texts)
                part = b.column("part")[lo:hi].to_numpy(zero_copy_only=False)
                base = np.where(part >= parts, x.size - 1, x.size)
                i = part % parts
                before, after = base * i // parts, base * (parts - 1 - i) // parts
                n = np.maximum(0, x.size - after - before)
                line = np.repeat(np.arange(len(n)), n)
                at = before[line] + np.arange(len(line)) - np.repeat(textvec.run_starts(n), n)
                a = x.start[line]
                with np.errstate(over="ignore"):
                    cut = x.run(a, a + at) + x.run(a + at + 1, a + x.size[line]) * x.up[at]
                gone = textvec.mix(cut ^ textvec.mix(x.size[line] - 1, 33), 34)
                same_size = part[line] < parts
                # of the line's own length: substitutions at the same place; of one less: this line is the longer one
                tagged = textvec.mix(gone ^ textvec.mix(at, 39), 40)
                whole = np.flatnonzero(part < parts)
                key = np.concatenate([np.where(same_size, tagged, gone), x.digest(0)[whole]])
                who = np.concatenate([line, whole])
                full = np.concatenate([np.zeros(len(line), bool), np.ones(len(whole), bool)])
                h1, h2 = (b.column(c)[lo:hi].to_numpy() for c in ("h1", "h2"))
                yield pa.RecordBatch.from_arrays([*_ints(h1[who], h2[who]), pa.array(full), pa.array(key.view(np.int64))], ["h1", "h2", "full", "key"])

    return found.mapInArrow(run, "h1 long, h2 long, full boolean, key long").distinct()


def verdicts(docs: DataFrame, parts: int = 2, min_chars: int = 0, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lines, rows): every line with ``goes``; and the numbered rows (doc, text) they come from."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rowid")).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    each = materialize(lines(rows, parts, min_chars), "line-all")
    first = F.min(F.struct("doc", "nth")).alias("first")
    kinds = materialize(each.where("word").groupBy("h1", "h2").agg(first, F.any_value("keys").alias("keys"), F.count("*").alias("times")), "line-kinds")
    n_lines, n_ends = (r[0] or 0 for r in kinds.agg(F.array(F.sum("times"), F.sum(F.size("keys"))).alias("n")).select(F.explode("n")).collect())

    # a line, its ends and its variants may be very frequent: such keys are joined apart
    ends = kinds.select("h1", "h2", F.posexplode("keys").alias("part", "end"))
    shared = ends.groupBy("end").agg(F.count("*").alias("n")).where("n > 1")
    met = join_frequent(ends, shared, ["end"], "n", n_ends).select("h1", "h2", "part").distinct()
    wanted = materialize(met.groupBy("h1", "h2").agg(F.collect_set("part").alias("parts")).join(kinds.select("h1", "h2", "first"), ["h1", "h2"]), "line-wanted")
    # texts of the lines in question: each document hands out its own
    asked = wanted.groupBy("first.doc").agg(F.collect_list(F.struct(F.col("first.nth").alias("nth"), "h1", "h2", "parts")).alias("asked"))
    own = rows.select(F.col("doc.rowid").alias("rowid"), "text").join(asked.select(F.col("doc.rowid").alias("rowid"), "asked").hint("merge"), "rowid").withColumn("all", F.split("text", "\n"))
    texts = own.select("all", F.explode("asked").alias("a")).select("a.h1", "a.h2", "a.parts", F.element_at("all", (F.col("a.nth") + 1).cast("int")).alias("text"))
    texts = materialize(texts, "line-texts")

    emitted = variants(texts.select("h1", "h2", "text", F.explode("parts").alias("part")), parts)
    keyed = materialize(emitted.join(kinds.select("h1", "h2", "first"), ["h1", "h2"]), "line-variants")
    # the earliest with each hash: of the lines themselves, and of those less a character
    early = keyed.groupBy("key").agg(F.min(F.when(F.col("full"), F.struct("first", "h1", "h2"))).alias("whole"), F.min(F.when(~F.col("full"), F.struct("first", "h1", "h2"))).alias("less"), F.count("*").alias("n")).where("n > 1")
    near = join_frequent(keyed, early, ["key"], "n", keyed.count())
    # a whole line meets lines less a character; those meet the whole line and each other
    pair = near.withColumn("other", F.explode(F.array_compact(F.when(F.col("full"), F.array("less")).otherwise(F.array("whole", "less"))))).where(F.col("other.first") < F.col("first"))
    pair = pair.select("h1", "h2", F.col("other.h1").alias("o1"), F.col("other.h2").alias("o2")).distinct()
    left = texts.select("h1", "h2", F.col("text").alias("a"))
    right = texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("text").alias("b"))
    true = pair.join(left, ["h1", "h2"]).join(right, ["o1", "o2"]).where(F.levenshtein("a", "b", 1).between(0, 1)).select("h1", "h2").distinct().withColumn("near", F.lit(True))

    kind = materialize(kinds.select("h1", "h2", "first", "times").join(true, ["h1", "h2"], "left"), "line-verdicts")
    plain = each.drop("keys")
    goes = F.coalesce(F.col("near") | (F.struct("doc", "nth") != F.col("first")), F.lit(False))
    told = join_frequent(plain.where("word"), kind, ["h1", "h2"], "times", n_lines).select("doc", "nth", goes.alias("goes"), F.coalesce("near", F.lit(False)).alias("near"))
    return told.unionByName(plain.where("not word").select("doc", "nth", F.lit(False).alias("goes"), F.lit(False).alias("near"))), rows


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the lines that go taken out of their texts. Null texts stay null."""
    found, _ = verdicts(docs, id_col=id_col, text_col=text_col, **how)
    row_, gone_ = fresh(docs, "_line_row", "_line_gone")
    gone = found.where("goes").groupBy(F.col("doc.rowid").alias(row_)).agg(F.collect_list("nth").alias(gone_))
    own = docs.withColumn(row_, F.monotonically_increasing_id()).join(gone, row_, "left")
    numbered = F.transform(F.split(text_col, "\n"), lambda t, i: F.struct(t.alias("t"), i.cast("long").alias("i")))
    kept = F.transform(F.filter(numbered, lambda s: ~F.array_contains(gone_, s["i"])), lambda s: s["t"])
    return own.withColumn(text_col, F.when(F.col(gone_).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the lines of each document that go."""
    found, _ = verdicts(table(spark, sf_dir, "documents"))
    per = found.groupBy("doc").agg(F.count("*").alias("n_lines"), F.sum(F.col("goes").cast("long")).alias("n_gone"), F.sum((F.col("goes") & F.col("near")).cast("long")).alias("n_near"), F.sort_array(F.collect_list(F.when(F.col("goes"), F.col("nth").cast("int")))).alias("gone"))
    return per.select("doc.doc_id", "n_lines", (F.col("n_lines") - F.col("n_gone")).alias("n_kept"), "n_near", "gone")
