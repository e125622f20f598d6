"""Toxicity by maximum-scoring segments.

Each token gets a log-odds weight, toxic against clean, from a chain of Dirichlet priors:
its first 4 bytes, 5 bytes, 6 bytes and the whole word, each level shrunk towards the one
above, the first towards the base rate. What is counted is not occurrences but distinct
(token, following word) contexts of a class, so copies and shared passages count once.
Tokens whose log-odds are significant score them; every other token costs ``drift``.

A linear scan finds all maximal scoring segments of a text: no segment of the result can
be made larger in score by growing or shrinking it. Segment scores are turned into
E-values with the extreme-value law of such scores on clean texts, and the best and the
sum of the significant segments into a probability by a logistic curve.

Bounds: weights are learned from at most ``max_train`` labelled rows (those smallest by a
hash of the id); so the weight table that is shipped to the tasks is bounded too. All
documents are scored whole. Only the text is an input of a score.

Defined results: null and empty texts, and texts without a weighted token, get the
probability of "no segment"; null labels are ignored; rows with several labels count as
toxic if one says so; without both classes of labels every score is the base rate (0 if
there are no labels); repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.llm import textvec
from trellis.llm.common import arrow_batches, fold, materialize, table, without

LEVELS: tuple[int | None, ...] = (4, 5, 6, None)


@dataclass
class Weights:
    """Per level the known tokens' hashes, sorted, and their scores (0: not significant)."""

    hashes: list[np.ndarray]
    scores: list[np.ndarray]
    drift: float
    rate: float
    lam: float = 1.0
    k: float = 1.0
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)


@dataclass
class Segment:
    start: int
    end: int
    score: float


def maximal_segments(at: np.ndarray, gain: np.ndarray, n: int, drift: float) -> list[Segment]:
    """All maximal scoring segments of n tokens that score ``gain`` at the positions ``at``
    (ascending, positive) and -drift elsewhere. Linear in the number of positions, as each
    open segment is looked at again only when it is merged away."""
    open_: list[list[float]] = []  # start, end, sum before it, sum up to its end
    total, last = 0.0, -1
    for p, g in zip(at.tolist(), gain.tolist(), strict=True):
        total -= drift * (p - last - 1)
        here = [p, p + 1, total, total + g]
        total += g
        last = p
        while True:
            j = len(open_) - 1
            while j >= 0 and open_[j][2] >= here[2]:
                j = int(open_[j][4])
            if j < 0 or open_[j][3] >= here[3]:
                here = [*here[:4], float(j)]
                open_.append(here)
                break
            here = [open_[j][0], here[1], open_[j][2], here[3]]
            del open_[j:]
    return [Segment(int(s), int(e), b - a) for s, e, a, b, _ in open_]


def _levels(w: textvec.Words) -> list[np.ndarray]:
    return [w.hashes(k) for k in LEVELS]


def token_scores(w: textvec.Words, model: Weights) -> np.ndarray:
    """Score of the deepest known level of each token; 0 where that is not significant."""
    out = np.zeros(len(w.start))
    some = np.arange(len(w.start))
    for level, (known, score) in enumerate(zip(model.hashes, model.scores, strict=True)):
        if not len(known) or not len(some):
            break
        part = textvec.Words(w.rows, w.data, w.start[some], w.end[some], w.row[some], w.count, w.text)
        h = part.hashes(LEVELS[level])
        i = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[i] == h
        out[some[hit]] = score[i[hit]]
        if level == 0:
            some = some[hit]
    return out


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        toxic = b.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for w in textvec.words(b.column("text"), True, True):
            if not len(w.start):
                continue
            h = _levels(w)
            after = np.append(h[-1][1:], np.uint64(0))
            after[np.append(w.row[1:] != w.row[:-1], True)] = 0
            cls = toxic[w.rows[0] + w.row].astype(np.uint64)
            once = np.unique(textvec.mix(h[-1] ^ textvec.mix(after, 3) ^ cls, 5), return_index=True)[1]
            cols = [pa.array(x[once].view(np.int64)) for x in (*h, after)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(cls[once].astype(np.int8))], ["p4", "p5", "p6", "w", "nxt", "toxic"])


def _nodes(train: DataFrame) -> DataFrame:
    """(level, h, parent, p4, pos, neg): contexts of each token at each level, by class."""
    seen = train.select("text", "toxic").mapInArrow(_contexts, "p4 long, p5 long, p6 long, w long, nxt long, toxic byte").distinct()
    chain = F.array(*[F.struct(F.lit(i).alias("level"), F.col(c).alias("h"), F.col(p).alias("parent")) for i, (c, p) in enumerate((("p4", "p4"), ("p5", "p4"), ("p6", "p5"), ("w", "p6")))])
    each = seen.select("p4", "toxic", F.explode(chain).alias("n")).select("p4", "toxic", "n.*")
    return each.groupBy("level", "h", "parent", "p4").agg(F.sum(F.col("toxic").cast("long")).alias("pos"), F.sum((1 - F.col("toxic")).cast("long")).alias("neg"))


def learn(train: DataFrame, alpha: float = 20.0, z_min: float = 3.0) -> Weights:
    """Weights from rows of (text, toxic); ``train`` is a bounded sample."""
    nodes = materialize(_nodes(train), "toxic-nodes")
    pos, neg = nodes.where("level = 3").agg(F.coalesce(F.sum("pos"), F.lit(0)), F.coalesce(F.sum("neg"), F.lit(0))).first()
    none = Weights([np.zeros(0, np.uint64)] * 4, [np.zeros(0)] * 4, 0.05, pos / max(1, pos + neg))
    if not pos or not neg:
        return none
    base = pos / (pos + neg)
    telling = nodes.where((F.col("pos") >= 4) & (F.col("pos") > 2.5 * base * (F.col("pos") + F.col("neg")))).select("p4").distinct()
    rows = nodes.join(F.broadcast(telling), "p4", "left_semi").select("level", "h", "parent", "pos", "neg").toPandas()
    logit = lambda p: np.log(p) - np.log1p(-p)
    hashes, scores, above = [], [], None
    hit = 0.0
    for level in range(len(LEVELS)):
        own = rows[rows.level == level]
        h = own.h.to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(h)
        h, own = h[order], own.iloc[order]
        prior = np.full(len(own), base)
        if above is not None and len(above[0]) and len(own):
            up = own.parent.to_numpy().astype(np.int64).view(np.uint64)
            i = np.minimum(np.searchsorted(above[0], up), len(above[0]) - 1)
            prior = np.where(above[0][i] == up, above[1][i], base)
        p, n = own.pos.to_numpy(float) + alpha * prior, own.neg.to_numpy(float) + alpha * (1 - prior)
        rho = p / (p + n)
        delta = logit(rho) - logit(base)
        spread = np.sqrt(1 / (own.pos.to_numpy(float) + alpha * base) + 1 / (own.neg.to_numpy(float) + alpha * (1 - base)))
        good = (delta > 1) & (delta / spread >= z_min)
        above = (h, rho)
        hashes.append(h)
        scores.append(np.where(good, delta, 0.0))
        if level == len(LEVELS) - 1:
            hit = float(own.pos.to_numpy(float)[good].sum())
    return Weights(hashes, scores, max(0.05, hit / pos), base)


def _by_row(row: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The positions of each row that has any."""
    rows, cut = np.unique(row, return_index=True)
    ends = np.append(cut, len(at))[1:]
    for r, i, j in zip(rows.tolist(), cut, ends, strict=True):
        yield r, at[i:j]


def _scan(model: Weights, text_col: str, out: str):
    """Arrow function that adds to each row what its segments say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.zeros(len(b), np.int64)
            segs: list[list[Segment]] = [[] for _ in range(len(b))]
            for w in textvec.words(b.column(text_col), True, True):
                n[w.rows[0] : w.rows[1]] = w.count
                s = token_scores(w, model)
                at = np.flatnonzero(s > 0)
                first = textvec.run_starts(w.count)
                for r, own in _by_row(w.row[at], at):
                    segs[w.rows[0] + r] = maximal_segments(own - first[r], s[own], int(w.count[r]), model.drift)
            yield pa.RecordBatch.from_arrays([*b.columns, _summary(n, segs, model)], [*b.schema.names, out])

    return run


def _evalue(model: Weights, n: float, score: float) -> float:
    return model.k * max(1.0, n) * math.exp(-min(700.0, model.lam * score))


def _evidence(model: Weights, n: int, segs: list[Segment]) -> tuple[float, float]:
    """-log P of the best segment, and the summed -log E of all significant ones."""
    if not segs:
        return 0.0, 0.0
    p = -math.expm1(-_evalue(model, n, max(s.score for s in segs)))
    bits = [-math.log(max(1e-300, _evalue(model, n, s.score))) for s in segs]
    return min(60.0, -math.log(max(p, 1e-30))), math.log1p(sum(x for x in bits if x > 0))


def _probability(model: Weights, n: int, segs: list[Segment]) -> float:
    x1, x2 = _evidence(model, n, segs)
    a, b, c = model.curve
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, a + b * x1 + c * x2))))


FOUND = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_segments", T.IntegerType()), T.StructField("best_start", T.IntegerType()), T.StructField("best_end", T.IntegerType()), T.StructField("best_score", T.DoubleType()), T.StructField("best_e", T.DoubleType())])


def _summary(n: np.ndarray, segs: list[list[Segment]], model: Weights) -> pa.Array:
    best = [max(s, key=lambda x: (x.score, -x.start), default=None) for s in segs]
    cols = [
        pa.array([_probability(model, int(k), s) for k, s in zip(n, segs, strict=True)], pa.float64()),
        pa.array(n),
        pa.array([sum(_evalue(model, int(k), x.score) < 1 for x in s) for k, s in zip(n, segs, strict=True)], pa.int32()),
        pa.array([x and x.start for x in best], pa.int32()),
        pa.array([x and x.end for x in best], pa.int32()),
        pa.array([x and x.score for x in best], pa.float64()),
        pa.array([x and _evalue(model, int(k), x.score) for k, x in zip(n, best, strict=True)], pa.float64()),
    ]
    return pa.StructArray.from_arrays(cols, FOUND.names)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def calibrate(train: DataFrame, model: Weights) -> Weights:
    """Fit the extreme-value law on the clean rows and the logistic curve on all of the
    bounded sample ``train``; per row a few numbers come to the driver."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in textvec.words(b.column("text"), True, True):
                s = token_scores(w, model)
                at = np.flatnonzero(s > 0)
                first = textvec.run_starts(w.count)
                out: list[list[float]] = [[] for _ in w.count]
                gains: list[dict[float, int]] = [{} for _ in w.count]
                for r, own in _by_row(w.row[at], at):
                    out[r] = [x.score for x in maximal_segments(own - first[r], s[own], int(w.count[r]), model.drift)]
                    gains[r] = dict(zip(*(x.tolist() for x in np.unique(s[own], return_counts=True)), strict=True))
                yield pa.RecordBatch.from_arrays([b.column("toxic")[w.rows[0] : w.rows[1]], pa.array(w.count.astype(np.int64)), pa.array(out, pa.list_(pa.float64())), pa.array([list(g.items()) for g in gains], pa.map_(pa.float64(), pa.int64()))], ["toxic", "n", "segs", "gains"])

    rows = train.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(segments, "toxic int, n long, segs array<double>, gains map<double,bigint>").collect()
    clean = [r for r in rows if not r["toxic"]]
    tokens = sum(r["n"] for r in clean)
    gains: dict[float, int] = {}
    for r in clean:
        for g, n in r["gains"].items():
            gains[g] = gains.get(g, 0) + n
    # lam solves sum p_i exp(lam s_i) = 1 over the clean tokens; one more token of the mean
    # weight is added, so that weights that no clean text has still leave a finite law
    more = np.mean(np.concatenate([s[s > 0] for s in model.scores])) if any((s > 0).any() for s in model.scores) else 1.0
    seen, often = np.array([*gains, more]), np.array([*gains.values(), 1.0])
    share = 1 / max(2, tokens + 1)
    f = lambda lam: share * (often * np.exp(np.minimum(700, lam * seen))).sum() + max(0.0, 1 - share * often.sum()) * math.exp(-lam * model.drift) - 1
    lo, hi = 1e-6, 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    model.lam = min(5.0, max(0.05, hi))
    scores = np.array([s for r in clean for s in r["segs"]])
    cut = float(np.median(scores)) if len(scores) else float(np.average(seen, weights=often))
    model.k = max(1, (scores >= cut).sum()) / (max(1, tokens) * math.exp(-model.lam * cut))
    x = np.array([_evidence(model, r["n"], [Segment(0, 0, s) for s in r["segs"]]) for r in rows]).reshape(-1, 2)
    y = np.array([float(r["toxic"]) for r in rows])
    if len(y) and 0 < y.mean() < 1:
        model.curve = _logistic(x, y)
    else:
        p = min(1 - 1e-9, max(1e-9, float(y.mean()) if len(y) else 0.0))
        model.curve = (math.log(p / (1 - p)), 0.0, 0.0)
    return model


def train_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = 12_000) -> Weights:
    """Learn and calibrate on the labelled rows outside the held-out fold (remainder 1 of 3).
    ``max_train``: at most so many labelled documents, those first by a hash of the id."""
    arrow_batches(docs.sparkSession)
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 3) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(max_train)
    train = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(own), "doc_id")
    train = materialize(train.select("text", F.col("toxic").cast("int").alias("toxic")), "toxic-train")
    return calibrate(train, learn(train))


def annotate(docs: DataFrame, model: Weights, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a struct ``out``: score, n_tokens, n_segments (those with E below 1), and
    first and last token, score and E of the best segment; a column of that name is replaced."""
    arrow_batches(docs.sparkSession)
    own = without(docs, out)
    return own.mapInArrow(_scan(model, text_col, out), T.StructType([*own.schema.fields, T.StructField(out, FOUND)]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: toxicity of all documents."""
    docs = table(spark, sf_dir, "documents")
    out = annotate(docs.select("doc_id", "text"), train_model(docs, table(spark, sf_dir, "labels"))).select("doc_id", "toxicity.*")
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_tokens", "n_segments", "best_start", "best_end", "best_score", "best_e")
