"""Quality by hierarchical empirical Bayes.

A logistic curve over text statistics gives each document's own evidence. Every host and
every path of a host gets a posterior share of good documents from grouped sums over all
documents: labelled rows of the training folds count with their label, all others with
their evidence at the weight ``soft``. Beta priors are fitted to the spread between hosts
and between the paths of a host, so a path with few rows is drawn to its host, and a host
with few rows to the global share. A document's own row is taken out of its site's sums.
The score adds the site's log-odds to the document's, less the global ones counted twice.

``host`` and ``path`` are any two columns, as :func:`sites` makes of an address; ``documents`` has no address, so the query takes
source as host and language as path. Labels are learned only from rows outside the held-out
fold (remainder 1 of 3), and the curve from at most ``max_train`` of them.

Defined results: null and empty texts have zero statistics; a null host or path is a site of
its own; null labels are ignored, several labels of a row are averaged; without labels of
both kinds the evidence is the share of good labels (one half without any); an empty table
gives no rows; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import textvec
from trellis.llm.common import arrow_batches, fold, join_frequent, materialize, table

NAMES = ("log_words", "word_length", "symbols", "upper", "digits", "distinct", "repeats", "short", "line_length", "wide")


def statistics(w: textvec.Words) -> np.ndarray:
    """rows x len(NAMES): statistics of each text of a slice, all between about 0 and 3."""
    rows, data = len(w.count), w.data
    n = np.maximum(1, w.count)
    out = np.zeros((rows, len(NAMES)))
    if not len(data) or not len(w.start):
        return out
    h = w.hashes()
    mean = lambda x: np.bincount(w.row, weights=x, minlength=rows) / n
    per = lambda mask: np.add.reduceat(np.append(mask, False).astype(np.int64), w.start)[: len(w.start)]
    size = (w.end - w.start).astype(float)
    letters = ((data | 32) >= 97) & ((data | 32) <= 122)
    digits = (data >= 48) & (data <= 57)
    plain = letters | digits | (data >= 128) | (data <= 32) | np.isin(data, np.frombuffer(b".,", np.uint8))
    same = np.append(False, (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1]))
    order = np.lexsort((h, w.row))
    first = np.append(True, (h[order][1:] != h[order][:-1]) | (w.row[order][1:] != w.row[order][:-1]))
    chars = np.bincount(w.row, weights=size, minlength=rows)
    out[:, 0] = np.log1p(w.count) / 5
    out[:, 1] = mean(np.minimum(size, 40)) / 10
    out[:, 2] = mean(per(~plain) / size)
    out[:, 3] = mean(per(letters & (data < 97)) / size)
    out[:, 4] = mean(per(digits) / size)
    out[:, 5] = np.bincount(w.row[order][first], minlength=rows) / n
    out[:, 6] = mean(same)
    out[:, 7] = mean(size <= 3)
    lines = np.bincount(w.row, weights=per(data == 10), minlength=rows) + 1
    out[:, 8] = np.log1p(chars / lines) / 5
    out[:, 9] = mean(per(data >= 128) / size)
    return out


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic curve, the constant first."""
    share = min(1 - 1e-6, max(1e-6, float(y.mean()) if len(y) else 0.5))
    w = np.zeros(x.shape[1] + 1)
    w[0] = math.log(share / (1 - share))
    if len(np.unique(y)) < 2:
        return w
    x = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([1e-6, *[0.01] * (x.shape[1] - 1)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-7:
            break
    return w


def _expand(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, x**2, np.sqrt(x)])


def evidence(docs: DataFrame, labels: DataFrame, max_train: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights of the curve, from a bounded sample of labelled rows."""
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 3) != 1)).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    own = own.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in textvec.words(b.column("text"), lower=False):
                yield pa.RecordBatch.from_arrays([b.column("y")[w.rows[0] : w.rows[1]], pa.array(statistics(w).tolist(), pa.list_(pa.float64()))], ["y", "x"])

    train = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(own), "doc_id").select("text", "y")
    rows = train.mapInArrow(run, "y double, x array<double>").collect()
    y = np.array([float(r["y"] >= 0.5) for r in rows])
    x = np.array([r["x"] for r in rows]).reshape(-1, len(NAMES))
    return _fit(_expand(x), y)


def _precision(sites: DataFrame, centre: str) -> float:
    """Strength of the Beta prior around ``centre`` from sites (n, k), by moments."""
    rate, m = F.col("k") / F.col("n"), F.col(centre)
    r = sites.where("n > 0").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count("*").alias("s"), F.sum(F.col("n") * (rate - m) ** 2).alias("ss"), F.sum(F.col("n") * m * (1 - m)).alias("v")).first()
    if not r["n"] or r["s"] < 2 or r["n"] - r["n2"] / r["n"] <= 0:
        return 1e4
    v = r["v"] / r["n"]
    between = (r["ss"] - (r["s"] - 1) * v) / (r["n"] - r["n2"] / r["n"])
    return float(min(1e4, max(1.0, v / between - 1))) if between > 0 and v > 0 else 1e4


def sites(address: Column) -> tuple[Column, Column]:
    """(host, path) of web addresses: the host in lower case without "www." and port, and the first
    folder of the path; null for what is no address."""
    host = F.regexp_replace(F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")
    path = F.regexp_extract(address, r"^[^:]+://[^/?#]*/([^/?#]+)/", 1)
    return F.when(host != "", host), F.when(host != "", path)


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", soft: float = 0.2, max_train: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, evidence (probability by text alone), site (the posterior share of
    its path without the row itself), score."""
    arrow_batches(docs.sparkSession)
    weights = evidence(docs, labels, max_train, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in textvec.words(b.column("text"), lower=False):
                z = weights[0] + (_expand(statistics(w)) @ weights[1:] if len(w.count) else np.zeros(0))
                p = 1 / (1 + np.exp(-np.clip(z, -12, 12)))
                lo, hi = w.rows
                yield pa.RecordBatch.from_arrays([b.column(c)[lo:hi] for c in ("doc_id", "host", "path")] + [pa.array(p)], ["doc_id", "host", "path", "p"])

    site = lambda c: F.concat(F.when(F.col(c).isNull(), "0").otherwise("1"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    own = docs.select(F.col(id_col).alias("doc_id"), site(host).alias("host"), site(path).alias("path"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    known = labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id"), 3) != 1)).groupBy("doc_id").agg(F.avg("quality").cast("double").alias("y"))
    seen = own.mapInArrow(run, f"doc_id {kind}, host string, path string, p double").join(known, "doc_id", "left")
    seen = materialize(seen.withColumn("wt", F.when(F.col("y").isNull(), soft).otherwise(1.0)).withColumn("good", F.col("wt") * F.coalesce("y", "p")), "quality-evidence")

    paths = seen.groupBy("host", "path").agg(F.sum("wt").alias("n"), F.sum("good").alias("k"), F.count("*").alias("rows"))
    paths = materialize(paths, "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("rows").alias("rows"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    mu = min(1 - 1e-6, max(1e-6, whole["k"] / whole["n"])) if whole["n"] else 0.5
    s_host = _precision(hosts.withColumn("mu", F.lit(mu)), "mu")
    within = paths.join(hosts.select("host", (F.col("k") / F.col("n")).alias("rate"), F.col("n").alias("host_n"), F.col("k").alias("host_k")), "host")
    s_path = _precision(within, "rate")

    sites = within.select("host", "path", F.col("n").alias("path_n"), F.col("k").alias("path_k"), "host_n", "host_k", paths["rows"].alias("rows"))
    both = join_frequent(seen, sites, ["host", "path"], "rows", whole["rows"])
    host_mean = (F.col("host_k") - F.col("good") + s_host * mu) / (F.col("host_n") - F.col("wt") + s_host)
    path_mean = (F.col("path_k") - F.col("good") + s_path * host_mean) / (F.col("path_n") - F.col("wt") + s_path)
    clip = lambda c: F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), c))
    logit = lambda c: F.log(clip(c) / (1 - clip(c)))
    z = logit(F.col("p")) + logit(path_mean) - F.lit(math.log(mu / (1 - mu)))
    return both.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("p").alias("evidence"), clip(path_mean).alias("site"), (1 / (1 + F.exp(-z))).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: quality of all documents; those of a score of one half or more are kept."""
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= 0.5).alias("keep"), "evidence", "site")
