"""Beam search, hybrid scores, reranking and fusion, for many queries and trees at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellis.operators import tree, vector
from trellis.schema import CONFIG, RetrievalConfig
from trellis.sources.scratch import keep

QUERY = ["query_id", "variant_no"]
PLACE = [*QUERY, "tree_id"]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def scoped(nodes: DataFrame, scope: DataFrame | None) -> DataFrame:
    """Nodes of the trees in ``scope``; all if there is none."""
    return nodes if scope is None else nodes.join(scope.select("tree_id").distinct(), "tree_id", "left_semi")


def beam(nodes: DataFrame, queries: DataFrame, cfg: RetrievalConfig = CONFIG) -> DataFrame:
    """Candidates of each query and tree: best children of the root, then of each survivor,
    twice. Trees with few embedded nodes or no child of the root use flat search instead.

    Work follows the beam: only children of survivors are scored. Survivors of a level are
    a few rows for each query and tree; they are written down, so that nothing is found
    twice and the planner knows their size when it joins them with the next level.
    """
    skinny = nodes.select("tree_id", "node_id", "ord", "parent_id", "embedding")
    facts = skinny.groupBy("tree_id").agg(F.count_if(vector.embedded(F.col("embedding"))).alias("n"), F.bool_or(F.col("parent_id").eqNullSafe(tree.ROOT)).alias("top"))
    routes = keep(facts.select("tree_id", ((F.col("n") >= cfg.min_embedded) & F.col("top")).alias("beam")), "routes")
    columns = [*PLACE, "query_text", "node_id", "ord", "sim"]

    def search(block: vector.Block) -> DataFrame:
        level = F.coalesce("sim", F.lit(0.0))
        tops = skinny.where(F.col("parent_id") == tree.ROOT).join(routes.where("beam").select("tree_id"), "tree_id")
        best = vector.top(vector.scored(tops, block, cfg.beam_root).withColumn("level", level), cfg.beam_root, "level", PLACE, ["ord"])
        picked = [keep(best.select(*columns, "_q"), "beam")]
        for last, k in enumerate((cfg.beam_child, cfg.beam_leaf)):
            above = picked[-1].select(*PLACE, "query_text", "_q", F.col("node_id").alias("parent_id"))
            kids = vector.paired(skinny.join(above, ["tree_id", "parent_id"]), block).withColumn("level", level)
            best = vector.top(kids, k, "level", [*PLACE, "parent_id"], ["ord"]).select(*columns, "_q")
            picked.append(best if last else keep(best, "beam"))
        flat = vector.flat_top(skinny.join(routes.where("not beam").select("tree_id"), "tree_id"), block, cfg.flat_k)
        return vector.union([x.select(*columns) for x in (*picked, flat)])

    found = vector.each_block(queries, search)
    if found is None:
        return vector.flat_search(nodes, queries).select(*columns)
    return keep(found, "candidates")


def term_counts(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates, a row for each term of the query that the node's summary and title have
    (term, times in the query, tf; one row with nulls if there is none), with dl, the tokens
    of the node, and n, avgdl and df over the candidates of the query and tree. All steps keep
    these together, so they share one shuffle."""
    text = nodes.select("tree_id", "node_id", F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.coalesce("title", F.lit(""))).alias("_text"))
    docs = candidates.join(text, ["tree_id", "node_id"], "left").withColumn("_toks", tokens(F.coalesce("_text", F.lit("")))).withColumn("dl", F.size("_toks").cast("double"))
    w = Window.partitionBy(*PLACE)
    docs = docs.withColumn("n", F.count("*").over(w)).withColumn("avgdl", F.avg("dl").over(w)).withColumn("_asked", tokens(F.col("query_text")))
    times = lambda toks, t: F.size(F.filter(toks, lambda x: x == t))
    met = F.transform(F.array_intersect("_asked", "_toks"), lambda t: F.struct(t.alias("term"), times("_asked", t).alias("times"), times("_toks", t).alias("tf")))
    each = docs.withColumn("_m", F.explode_outer(met)).select(*candidates.columns, "dl", "n", "avgdl", "_m.*")
    return each.withColumn("df", F.count("*").over(Window.partitionBy(*PLACE, "term")))


def bm25(candidates: DataFrame, nodes: DataFrame, cfg: RetrievalConfig = CONFIG) -> DataFrame:
    """Candidates with ``bm25``, from statistics over the candidates of the query and tree."""
    each = term_counts(candidates, nodes)
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.col("tf")
    part = F.col("times") * idf * tf * (cfg.k1 + 1) / (tf + cfg.k1 * (1 - cfg.b + cfg.b * F.col("dl") / F.col("avgdl")))
    key = [*PLACE, "node_id"]
    rest = [c for c in candidates.columns if c not in key]
    out = each.groupBy(*key).agg(*[F.first(c).alias(c) for c in rest], F.coalesce(F.sum(part), F.lit(0.0)).alias("bm25"))
    return out.select(*candidates.columns, "bm25")


def metadata_match(wanted: DataFrame, meta: DataFrame, fields: list[str]) -> DataFrame:
    """(query_id, tree_id, meta): which share of what a query wants of a document (wanted: query_id,
    field, value) its metadata (meta: doc_id and ``fields``) has, whatever the case; a row only
    where it is more than nothing. Fields that are not known are never met, nulls neither."""
    asked = wanted.where("field is not null and value is not null").select("query_id", "field", F.lower("value").alias("value")).distinct()
    each = asked.withColumn("of", F.count("*").over(Window.partitionBy("query_id")))
    own = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.col(f).cast("string")).alias("value")) for f in fields]))
    held = meta.select(F.col("doc_id").alias("tree_id"), own.alias("x")).where("x.value is not null").select("tree_id", "x.*")
    return each.join(held, ["field", "value"]).groupBy("query_id", "tree_id").agg((F.count("*") / F.first("of")).alias("meta"))


def hybrid(candidates: DataFrame, nodes: DataFrame, cfg: RetrievalConfig = CONFIG, meta: DataFrame | None = None) -> DataFrame:
    """Weighted sum of semantic, lexical and metadata scores; the last is zero unless ``meta``
    (query_id, tree_id, meta) is given."""
    top = F.max("bm25").over(Window.partitionBy(*PLACE))
    scored = bm25(candidates, nodes, cfg).withColumn("sem", (F.coalesce("sim", F.lit(0.0)) + 1) / 2).withColumn("lex", F.when(top > 0, F.col("bm25") / top).otherwise(0.0))
    if meta is None:
        scored = scored.withColumn("meta", F.lit(0.0))
    else:
        scored = scored.join(meta.select("query_id", "tree_id", "meta"), ["query_id", "tree_id"], "left").withColumn("meta", F.coalesce("meta", F.lit(0.0)))
    return scored.withColumn("score", cfg.w_semantic * F.col("sem") + cfg.w_bm25 * F.col("lex") + cfg.w_meta * F.col("meta"))


def rerank(scored: DataFrame, nodes: DataFrame, scorer: Callable[[Column, Column], Column] | None, k: int, cfg: RetrievalConfig = CONFIG) -> DataFrame:
    """The k best of each query and tree. With a scorer, its value replaces the score of the
    best ``rerank_pool``; it sees (query text, start of the content)."""
    if scorer is None:
        return vector.top(scored, k, "score", PLACE, ["ord"])
    pool = vector.top(scored, cfg.rerank_pool, "score", PLACE, ["ord"]).drop("rank")
    texts = nodes.select("tree_id", "node_id", F.left(F.coalesce("content", F.lit("")), F.lit(cfg.rerank_chars)).alias("_text"))
    rated = pool.join(texts, ["tree_id", "node_id"]).withColumn("score", scorer(F.col("query_text"), F.col("_text"))).drop("_text")
    return vector.top(rated, k, "score", PLACE, ["ord"])


def overlap_scorer(query: Column, text: Column) -> Column:
    """A deterministic scorer: share of the query's distinct tokens that the text has."""
    q = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(q, tokens(text))).cast("double") / F.greatest(F.size(q), F.lit(1))


def single(nodes: DataFrame, queries: DataFrame, k: int, scorer=None, cfg: RetrievalConfig = CONFIG, meta: DataFrame | None = None) -> DataFrame:
    return rerank(hybrid(beam(nodes, queries, cfg), nodes, cfg, meta), nodes, scorer, k, cfg)


def max_over_variants(results: DataFrame) -> DataFrame:
    return results.groupBy("query_id", "tree_id", "node_id", "ord").agg(F.max("score").alias("score"))


def fuse(results: DataFrame, k: int) -> DataFrame:
    """Max over a query's variants; k best of each query and tree."""
    return vector.top(max_over_variants(results), k, "score", ["query_id", "tree_id"], ["ord"])


def merge(fused: DataFrame, k: int, bare_ids: bool = False) -> DataFrame:
    """k best of each query over all trees. ``bare_ids``: trees' equal node ids shadow each
    other and the best stays, as a key without the tree would have it."""
    if bare_ids:
        w = Window.partitionBy("query_id", "node_id").orderBy(F.round("score", 9).desc(), "tree_id")
        fused = fused.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return vector.top(fused, k, "score", ["query_id"], ["tree_id", "ord"])


def retrieve(nodes: DataFrame, queries: DataFrame, scope: DataFrame | None = None, scorer=None, cfg: RetrievalConfig = CONFIG, meta: DataFrame | None = None, only_matching: bool = False) -> DataFrame:
    """(query_id, tree_id, node_id, ord, score, rank): the whole chain. ``meta``: scores of
    :func:`metadata_match`; with ``only_matching`` a query sees only documents that have all it
    wants of them, and no other document is read."""
    if only_matching:
        full = keep(meta.where("meta >= 1").select("query_id", "tree_id"), "matching")
        per = single(scoped(scoped(nodes, scope), full), queries, 2 * cfg.top_k, scorer, cfg, meta).join(full, ["query_id", "tree_id"], "left_semi")
    else:
        per = single(scoped(nodes, scope), queries, 2 * cfg.top_k, scorer, cfg, meta)
    return merge(fuse(per, cfg.top_k), cfg.top_k)
