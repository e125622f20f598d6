"""From ranked nodes to context, answer and citations; each query has at most top_k rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellis.operators.vector import dot, embedded
from trellis.schema import CONFIG, NOT_FOUND, RetrievalConfig
from trellis.sources.scratch import keep


PARTS = ["parent_id", "title", "content", "embedding"]


def attached(ranked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ranked rows with what the later steps need of their nodes, looked up once; nodes without a
    column, as contents, do for steps that do without it."""
    return ranked if set(PARTS) <= set(ranked.columns) else ranked.join(nodes.select("tree_id", "node_id", *[c for c in PARTS if c in nodes.columns]), ["tree_id", "node_id"])


def near_duplicates(ranked: DataFrame, nodes: DataFrame, cfg: RetrievalConfig = CONFIG) -> DataFrame:
    """Ranked rows less those too close to a better row that was kept; greedy by rank.
    Rows without an embedding always stay and are never compared with. Ranks and vectors alone
    go through the list; contents are joined to what is kept."""
    full = attached(ranked, nodes)
    lists = full.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "embedding"))).alias("rows"))

    def step(kept, x):
        close = F.exists(kept, lambda k: embedded(k["embedding"]) & embedded(x["embedding"]) & (dot(k["embedding"], x["embedding"]) >= cfg.near_duplicate))
        return F.when(close, kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.transform(F.aggregate("rows", F.slice("rows", 1, 0), step), lambda r: r["rank"])
    own = full.select("query_id", "rank", "tree_id", "node_id", "score", *[c for c in PARTS if c in full.columns])
    return own.join(lists.select("query_id", F.explode(kept).alias("rank")), ["query_id", "rank"])


def diversified(ranked: DataFrame, nodes: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """k of the ranked rows of each query, picked one after the other: the next one has the most of
    ``weight`` times its score less (1 - weight) times its largest similarity to what is picked;
    then the better rank. ``pick`` numbers them. Rows without an embedding are similar to none.
    What is compared are the ranked rows of one query, which are few; contents stay out of it."""
    vectors = ranked.select("query_id", "tree_id", "node_id", "rank", "score").join(nodes.select("tree_id", "node_id", "embedding"), ["tree_id", "node_id"])
    lists = vectors.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "embedding"))).alias("rows"))

    def worth(x, picked):
        near = F.array_max(F.transform(picked, lambda p: F.when(embedded(p["embedding"]) & embedded(x["embedding"]), dot(p["embedding"], x["embedding"])).otherwise(0.0)))
        return F.round(F.lit(weight) * x["score"] - F.lit(1 - weight) * F.coalesce(near, F.lit(0.0)), 9)

    def step(picked, _):
        left = F.filter("rows", lambda x: ~F.exists(picked, lambda p: p["rank"] == x["rank"]))
        best = F.array_max(F.transform(left, lambda x: F.struct(worth(x, picked).alias("worth"), (-x["rank"]).alias("rank"))))
        return F.concat(picked, F.filter("rows", lambda x: F.coalesce(x["rank"] == -best["rank"], F.lit(False))))

    picked = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.slice("rows", 1, 0), step)
    found = lists.select("query_id", F.posexplode(F.transform(picked, lambda p: p["rank"])).alias("pick", "rank"))
    return ranked.join(found.withColumn("pick", F.col("pick") + 1), ["query_id", "rank"])


def prune_parents(kept: DataFrame) -> DataFrame:
    """Kept rows without those that have a kept child."""
    above = F.collect_set("parent_id").over(Window.partitionBy("query_id", "tree_id"))
    return kept.withColumn("_above", above).where(~F.array_contains("_above", F.col("node_id"))).drop("_above")


def joined_in_order(df: DataFrame, keys: list[str], order: str, text, sep: str, name: str) -> DataFrame:
    """The texts of each group, in order, as one; for groups of bounded size."""
    lists = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, text.alias("part")))).alias("parts"))
    return lists.select(*keys, F.array_join("parts.part", sep).alias(name))


def contexts(final: DataFrame, nodes: DataFrame, cfg: RetrievalConfig = CONFIG) -> DataFrame:
    """(query_id, context): titles and contents in rank order, cut to the limit."""
    part = F.concat(F.lit("["), F.coalesce("title", F.lit("")), F.lit("]\n"), F.coalesce("content", F.lit("")))
    whole = joined_in_order(attached(final, nodes), ["query_id"], "rank", part, "\n\n---\n\n", "context")
    return whole.withColumn("context", F.left("context", F.lit(cfg.context_chars)))


def citations(ranked: DataFrame, nodes: DataFrame, meta: DataFrame) -> DataFrame:
    """(query_id, sources): every ranked node in order; the file name falls back to the id."""
    full = attached(ranked, nodes).join(meta.select(F.col("doc_id").alias("tree_id"), "filename"), "tree_id", "left")
    src = F.struct("rank", F.col("tree_id").alias("doc_id"), "node_id", "title", F.coalesce("filename", "tree_id").alias("filename"))
    return full.groupBy("query_id").agg(F.sort_array(F.collect_list(src)).alias("s")).select("query_id", F.transform("s", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["node_id"].alias("node_id"), x["title"].alias("title"), x["filename"].alias("filename"))).alias("sources"))


def guard(answer):
    """The fixed sentence in place of an empty answer."""
    return F.coalesce(F.when(F.trim(answer) != "", answer), F.lit(NOT_FOUND))


def answers(queries: DataFrame, ranked: DataFrame, nodes: DataFrame, meta: DataFrame, generate=None, cfg: RetrievalConfig = CONFIG) -> DataFrame:
    """One row a query: context, answer, sources. ``generate`` maps (query text, context) to
    an answer; without one the context is the answer."""
    ranked = keep(attached(ranked, nodes), "ranked")
    final = prune_parents(near_duplicates(ranked, nodes, cfg))
    asked = queries.groupBy("query_id").agg(F.min_by("query_text", "variant_no").alias("query_text"))
    both = asked.join(contexts(final, nodes, cfg), "query_id", "left").join(citations(ranked, nodes, meta), "query_id", "left")
    text = generate(F.col("query_text"), F.col("context")) if generate else F.col("context")
    found = F.when(F.coalesce("context", F.lit("")) != "", text)
    return both.select("query_id", "query_text", "context", guard(found).alias("answer"), "sources")
