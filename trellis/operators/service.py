"""Questions from the cache or through the whole chain, a batch at a time.

Equal questions over equal documents are one: they share a cache key and are worked on once,
however often they are asked. What the cache has is answered from the nodes it names, looked up
anew, so no stale text is shown; the rest is rewritten, varied, searched and answered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellis.functions import scalar
from trellis.operators import context, retrieve
from trellis.schema import CONFIG, NO_DOCUMENTS, RetrievalConfig
from trellis.sources.scratch import keep

ENTRY = "cache_key string, at long, doc_ids array<string>, nodes array<struct<tree_id: string, node_id: string>>"
PAIRS = "array<struct<tree_id: string, node_id: string>>"


def no_variants(query: Column) -> Column:
    return F.array().cast("array<string>")


def ask(
    questions: DataFrame,
    nodes: DataFrame,
    meta: DataFrame,
    cached: DataFrame,
    now: int,
    encode: Callable[[DataFrame], DataFrame],
    rewrite: Callable[[Column], Column] | None = None,
    vary: Callable[[Column], Column] = no_variants,
    generate: Callable[[Column, Column], Column] | None = None,
    scorer=None,
    cfg: RetrievalConfig = CONFIG,
) -> tuple[DataFrame, DataFrame]:
    """Answers (query_id, hit, answer, sources, thinking) of questions (query_id, query_text,
    doc_ids: null or empty for all documents), and the entries (``ENTRY``) to put in the cache.

    ``encode`` adds query_vec to (query_id, variant_no, query_text); ``rewrite`` and ``vary`` make
    of a question its other form and a few variants; ``generate`` makes of question and context an
    answer, which is the context by default. A question that is empty or too long gets null for
    all. An entry is used if it is younger than the time to live and at least one of its nodes
    is still there; it is found under the documents that were asked for (not those that were
    cited) and names nodes with their documents. Without any document all are told so."""
    kept = keep(questions.select("query_id", "query_text", "doc_ids", scalar.cache_key(F.col("query_text"), F.col("doc_ids")).alias("cache_key"), scalar.valid_query(F.col("query_text")).alias("ok")), "questions")
    first = Window.partitionBy("cache_key").orderBy("query_id")
    unique = keep(kept.where("ok").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "ok").withColumnRenamed("query_id", "asked"), "asked")
    empty = not nodes.take(1)

    # what the cache has
    fresh = cached.where(F.lit(now) - F.col("at") < cfg.cache_ttl_s).select("cache_key", "at", F.posexplode("nodes").alias("place", "n"))
    named = unique.join(fresh, "cache_key").select("asked", "at", "place", "n.tree_id", "n.node_id")
    found = named.join(nodes.select("tree_id", "node_id", "ord"), ["tree_id", "node_id"])
    rank = F.row_number().over(Window.partitionBy("asked").orderBy("place"))
    hits = keep(found.withColumn("rank", rank).select(F.col("asked").alias("query_id"), "tree_id", "node_id", "ord", F.lit(0.0).alias("score"), "rank", "at"), "hits")
    ages = hits.groupBy(F.col("query_id").alias("asked")).agg((F.lit(now) - F.max("at")).alias("age"))

    # the rest
    todo = unique.join(ages, "asked", "left_anti")
    q = F.col("query_text")
    better = scalar.guarded_rewrite(q, rewrite(q) if rewrite else F.lit(None).cast("string"))
    forms = keep(todo.withColumn("better", better).withColumn("more", scalar.clean_variants(q, vary(q))), "forms")
    each = forms.select(F.col("asked").alias("query_id"), F.posexplode(scalar.query_set(F.col("better"), F.col("more"))).alias("variant_no", "query_text"))
    wanted = forms.where(F.size(F.coalesce("doc_ids", F.array().cast("array<string>"))) > 0).select(F.col("asked").alias("query_id"), F.explode("doc_ids").alias("tree_id")).distinct()
    limited = wanted.select("query_id").distinct()
    per = retrieve.single(nodes, encode(each), 2 * cfg.top_k, scorer, cfg)
    within = per.join(wanted, ["query_id", "tree_id"], "left_semi").unionByName(per.join(limited, "query_id", "left_anti"))
    ranked = keep(retrieve.merge(retrieve.fuse(within, cfg.top_k), cfg.top_k).select("query_id", "tree_id", "node_id", "ord", "score", "rank"), "found")

    # answers
    original = unique.select(F.col("asked").alias("query_id"), F.lit(0).alias("variant_no"), "query_text")
    said = context.answers(original, hits.drop("at").unionByName(ranked), nodes, meta, generate, cfg).select(F.col("query_id").alias("asked"), "answer", "sources")
    # Fixed value: the trace of an answer from the cache.
    aged = F.concat(F.lit("[Cache hit — age "), F.col("age").cast("string"), F.lit("s] Query rewritten and variants generated at first call."))
    told = forms.select("asked", scalar.trace(q, F.col("better"), F.col("more")).alias("trace"))
    one = unique.select("asked", "cache_key").join(said, "asked", "left").join(ages, "asked", "left").join(told, "asked", "left")
    out = kept.join(one.drop("asked"), "cache_key", "left")
    mine = lambda c: F.when(F.col("ok"), c)
    answers = out.select(
        "query_id",
        mine(F.col("age").isNotNull()).alias("hit"),
        mine(F.lit(NO_DOCUMENTS) if empty else F.col("answer")).alias("answer"),
        mine(F.coalesce("sources", F.array().cast(said.schema["sources"].dataType))).alias("sources"),
        mine(F.lit("") if empty else F.when(F.col("age").isNotNull(), aged).otherwise(F.col("trace"))).alias("thinking"),
    )
    lists = ranked.groupBy(F.col("query_id").alias("asked")).agg(F.sort_array(F.collect_list(F.struct("rank", "tree_id", "node_id"))).alias("r"))
    pairs = F.transform("r", lambda x: F.struct(x["tree_id"].alias("tree_id"), x["node_id"].alias("node_id"))).cast(PAIRS)
    entries = lists.join(unique, "asked").select("cache_key", F.lit(now).cast("long").alias("at"), "doc_ids", pairs.alias("nodes"))
    return answers, entries


def put(cached: DataFrame, entries: DataFrame, cfg: RetrievalConfig = CONFIG) -> DataFrame:
    """The cache with new entries, the latest of each key, and of these the ``cache_size`` youngest."""
    both = cached.unionByName(entries).groupBy("cache_key").agg(F.max_by(F.struct("at", "doc_ids", "nodes"), "at").alias("e")).select("cache_key", "e.*")
    return both.orderBy(F.col("at").desc(), "cache_key").limit(cfg.cache_size)
