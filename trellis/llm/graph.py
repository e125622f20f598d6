"""Connected components of an edge table, without ever gathering it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(v, comp) for every vertex of ``edges`` (a, b); comp is the smallest vertex of its
    component. Labels spread to neighbours by a map-side combined minimum and then jump to
    their label's label, so chains shorten by half a round; each round is written down."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("comp")), "cc-labels")
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("comp").alias("m"))
        low = labels.join(near, labels["v"] == near["a"]).select("v", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        up = labels.select(F.col("v").alias("u"), F.col("comp").alias("top"))
        nxt = materialize(low.join(up, F.col("comp") == F.col("u")).select("v", "was", F.least("comp", "top").alias("comp")), "cc-labels")
        done = not nxt.where("was <> comp").take(1)
        labels = nxt.select("v", "comp")
        if done:
            return labels
