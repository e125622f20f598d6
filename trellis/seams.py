"""What the engine leaves to a model: functions of columns, with deterministic defaults.

A model is plugged in as an iterator pandas UDF, so that it is loaded once a worker and
fed Arrow batches; see :func:`batched`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.operators.vector import normalise


def extractive_summary(title: Column, content: Column) -> Column:
    """The first 300 characters, on one line; the fixed sentence if there are none."""
    body = F.left(F.regexp_replace(F.regexp_replace(content, r"(?md)^#+\s+.*$", " "), r"\s+", " "), F.lit(300))
    return F.coalesce(F.when(F.trim(body) != "", F.trim(body)), F.concat(F.lit("Summary unavailable for section: "), title))


def batched(load: Callable[[], Callable[[list[str]], list[str]]]) -> Callable[[Column], Column]:
    """A column function from ``load``, which makes the model in the worker."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            yield pd.Series(model(b.tolist()), dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return lambda c: F.pandas_udf(run, T.StringType())(c)


def embed(nodes: DataFrame, vectors: DataFrame | None = None, encode: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """Fill missing embeddings of nodes with a summary: from (tree_id, node_id, vector), or
    by an encoder in batches of Arrow rows. What is filled in is scaled to length one, as
    all scores expect."""
    if vectors is not None:
        found = vectors.select("tree_id", "node_id", normalise(F.col("vector")).cast(nodes.schema["embedding"].dataType).alias("_v"))
        new = F.when(F.coalesce(F.col("summary"), F.lit("")) != "", F.col("_v"))
        return nodes.join(found, ["tree_id", "node_id"], "left").withColumn("embedding", F.coalesce(F.when(F.size("embedding") > 0, F.col("embedding")), new)).drop("_v")

    def unit(texts: list[str]) -> Iterator[np.ndarray]:
        v = np.asarray(encode(texts), float) if texts else np.zeros((0, 1))
        return iter(v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), np.finfo(float).tiny))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            todo = [s if s and (e is None or not len(e)) else None for s, e in zip(b["summary"], b["embedding"], strict=True)]
            got = unit([s for s in todo if s is not None])
            yield b.assign(embedding=[next(got) if s is not None else (None if e is None or not len(e) else e) for s, e in zip(todo, b["embedding"], strict=True)])

    return nodes.mapInPandas(run, nodes.schema)
