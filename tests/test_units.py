"""Literal cases of the operators, with results worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from trellis import seams
from trellis.functions import images
from trellis.functions import scalar as sc
from trellis.operators import access, cache, context, retrieve, tasks, tree, vector
from trellis.sources import ingest

NODE = "tree_id string, node_id string, ord int, parent_id string, title string, content string, summary string, embedding array<float>"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_parents_and_depths_with_level_skips(spark):
    levels = [2, 1, 3, 2, 3, 3, 1]
    df = spark.createDataFrame([("t", i + 1, v) for i, v in enumerate(levels)], "tree_id string, ord int, header_level int")
    got = tree.with_depth(tree.with_parents(df)).orderBy("ord").collect()
    assert [r["parent_id"] for r in got] == ["0000", "0000", "0002", "0002", "0004", "0004", "0000"]
    assert [r["depth"] for r in got] == [1, 1, 2, 2, 3, 3, 1]


def test_sections(spark):
    texts = [("a", "pre\n\n# One\nx\n```\n# no\n```\n### Three\ny"), ("b", ""), ("c", "### T\nz")]
    got = tree.split_sections(spark.createDataFrame(texts, "tree_id string, text string")).orderBy("tree_id", "ord").collect()
    assert [(r["tree_id"], r["ord"], r["header_level"], r["title"]) for r in got] == [("a", 0, 0, "Document"), ("a", 1, 1, "One"), ("a", 2, 3, "Three"), ("b", 0, 0, "Document"), ("c", 1, 3, "T")]
    assert got[1]["content"] == "# One\nx\n```\n# no\n```"


def test_node_ids_widen(spark):
    assert one(spark, tree.node_id(F.lit(10000))) == "10000"


def test_null_similarity_beats_negative(spark):
    nodes = spark.createDataFrame([("t", f"000{i}", i, "0000", "", "", "", e) for i, e in ((1, [-0.2]), (2, None), (3, [0.1]), (4, [0.5]), (5, [0.4]))], NODE)
    q = spark.createDataFrame([(0, 0, "q", [1.0])], "query_id long, variant_no int, query_text string, query_vec array<float>")
    got = {r["node_id"] for r in retrieve.beam(nodes.where("ord < 4").unionByName(nodes.where("ord = 1").withColumn("node_id", F.lit("0009")).withColumn("ord", F.lit(9))), q).collect()}
    assert got == {"0003", "0002", "0001"}


def test_few_embedded_nodes_use_flat_search(spark):
    nodes = spark.createDataFrame([("t", "0001", 1, "0000", "", "", "", [0.1]), ("t", "0002", 2, "0001", "", "", "", [0.9]), ("t", "0003", 3, "0000", "", "", "", None)], NODE)
    q = spark.createDataFrame([(0, 0, "q", [1.0])], "query_id long, variant_no int, query_text string, query_vec array<float>")
    assert sorted(r["node_id"] for r in retrieve.beam(nodes, q).collect()) == ["0001", "0002"]
    assert retrieve.beam(nodes.withColumn("embedding", F.lit(None).cast("array<float>")), q).count() == 0


def test_bm25_counts_repeated_terms_and_no_match_is_zero(spark):
    c = "query_id long, variant_no int, query_text string, tree_id string, node_id string, ord int, sim double"
    nodes = spark.createDataFrame([("t", "0001", 1, "0000", "a", "", "b", None), ("t", "0002", 2, "0000", "c", "", "d", None)], NODE)
    score = lambda q: {r["node_id"]: r["bm25"] for r in retrieve.bm25(spark.createDataFrame([(0, 0, q, "t", "0001", 1, 0.0), (0, 0, q, "t", "0002", 2, 0.0)], c), nodes).collect()}
    assert score("a a")["0001"] == pytest.approx(2 * score("a")["0001"]) and score("a")["0001"] > 0
    assert score("zz") == {"0001": 0.0, "0002": 0.0}


def ranked(spark, vectors, parents=None):
    ids = [f"000{i + 1}" for i in range(len(vectors))]
    nodes = spark.createDataFrame([("t", n, i + 1, (parents or {}).get(n, "0000"), n, "x", "", v) for i, (n, v) in enumerate(zip(ids, vectors, strict=True))], NODE)
    rows = spark.createDataFrame([(0, "t", n, i + 1, 1.0 - i / 10, i + 1) for i, n in enumerate(ids)], "query_id long, tree_id string, node_id string, ord int, score double, rank int")
    return nodes, rows


def test_near_duplicates_are_greedy(spark):
    nodes, rows = ranked(spark, [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    assert sorted(r["node_id"] for r in context.near_duplicates(rows, nodes).collect()) == ["0001", "0003"]
    chain = [[1.0, 0.0], [0.94, 0.342], [0.766, 0.643]]  # 1~2, 2~3, but not 1~3
    nodes, rows = ranked(spark, chain)
    assert sorted(r["node_id"] for r in context.near_duplicates(rows, nodes).collect()) == ["0001", "0003"]


def test_parent_goes_but_is_cited_and_context_is_cut(spark):
    nodes, rows = ranked(spark, [[1.0, 0.0], [0.0, 1.0]], {"0002": "0001"})
    nodes = nodes.withColumn("content", F.repeat(F.lit("y"), 9000))
    kept = context.prune_parents(context.near_duplicates(rows, nodes))
    assert [r["node_id"] for r in kept.collect()] == ["0002"]
    assert len(context.contexts(kept, nodes).first()["context"]) == 8000
    meta = spark.createDataFrame([], "doc_id string, filename string")
    assert [s["filename"] for s in context.citations(rows, nodes, meta).first()["sources"]] == ["t", "t"]


def test_merge_keys(spark):
    f = spark.createDataFrame([(0, "a", "0001", 1, 0.9, 1), (0, "b", "0001", 1, 0.8, 1)], "query_id long, tree_id string, node_id string, ord int, score double, rank int")
    assert retrieve.merge(f, 5).count() == 2
    assert [r["tree_id"] for r in retrieve.merge(f, 5, bare_ids=True).collect()] == ["a"]


@pytest.mark.parametrize(("n", "taken"), [(4, False), (5, True), (2000, True), (2001, False)])
def test_rewrite_lengths(spark, n, taken):
    assert (one(spark, sc.guarded_rewrite(F.lit("orig"), F.lit("r" * n))) != "orig") == taken


@pytest.mark.parametrize(("s", "want"), [(45.0, "45s"), (90.0, "1m 30s"), (3700.0, "1h 1m"), (59.6, "60s"), (120.0, "2m")])
def test_durations(spark, s, want):
    assert one(spark, sc.format_duration(F.col("s")), s=s) == want


def test_cache_ttl_edges(spark):
    log = lambda *at: spark.createDataFrame([("k", t, i) for i, t in enumerate(at)], "cache_key string, at long, seq long")
    hits = lambda df: [r["hit"] for r in df.orderBy("seq").collect()]
    assert hits(cache.replay_ttl(log(0, 5, 10), ttl=10)) == [False, True, False]
    assert hits(cache.replay_lru(log(0, 5, 10), ttl=10)) == [False, True, False]
    keys = spark.createDataFrame([(k, i, i) for i, k in enumerate("abacb")], "cache_key string, at long, seq long")
    assert hits(cache.replay_lru(keys, size=2)) == [False, False, True, False, False]


def test_vision_answers(spark):
    parse = lambda raw: one(spark, F.struct(*[c.alias(n) for c, n in zip(tree.parse_vision(F.lit(raw)), "ab", strict=True)]))
    assert tuple(parse(" skip ")) == ("", "image")
    assert parse("x\nTYPE: chart\nTYPE: map")["b"] == "chart" and parse("TYPE: painting")["b"] == "image"
    assert tuple(parse(" TYPE: map\n")) == (" TYPE: map\n", "image")


def test_prompts_are_filled_once(spark):
    fill = lambda t, **v: one(spark, sc.rendered(F.lit(t), {k: F.lit(x) for k, x in v.items()}))
    assert fill("A {title} {content}", title="{content}", content="Z") == "A {content} Z"
    assert fill("{{x}} {title}{title}", title="$1 {{t}}") == "{x} $1 {{t}}$1 {{t}}"
    assert fill("{title} {other}", title="t") is None and fill("plain", title="t") == "plain" and fill("{title}", title="") == ""


def test_image_sizes(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452000000030000012C")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc4\x00\x03a\xff\xc0\x00\x0b\x08\x00\x10\x00\x20\x01"
    bmp = b"BM" + bytes(16) + (7).to_bytes(4, "little") + (-9).to_bytes(4, "little", signed=True)
    got = [images.size(b) for b in (png, b"GIF89a\x05\x00\x06\x00", jpeg, bmp, png[:20], b"\xff\xd8\xff", b"", None)]
    assert got == [(3, 300), (5, 6), (32, 16), (7, 9), (0, 0), (0, 0), (0, 0), (0, 0)]
    assert tuple(spark.createDataFrame([(png,)], "c binary").select(images.size_of(F.col("c")).alias("s")).first()["s"]) == (3, 300)


def test_conversion_by_suffix(spark):
    files = spark.createDataFrame([("a.md", b"x"), ("b.PDF", b"%PDF y")], "filename string, content binary")
    assert [r["text"] for r in ingest.convert(files, {".pdf": lambda c: c.decode()[5:]}).orderBy("filename").collect()] == ["x", "y"]
    with pytest.raises(Exception, match="no converter"):
        ingest.convert(files).collect()


def test_filled_embeddings_have_length_one(spark):
    rows = [("t", "1", "ab", None), ("t", "2", "", None), ("t", "3", "abc", [3.0, 0.0]), ("t", "4", "abcd", [])]
    nodes = spark.createDataFrame(rows, "tree_id string, node_id string, summary string, embedding array<float>")
    got = {r["node_id"]: r["embedding"] for r in seams.embed(nodes, encode=lambda ts: [[3.0, 4.0] for _ in ts]).collect()}
    assert got["1"] == got["4"] == pytest.approx([0.6, 0.8]) and got["2"] is None and got["3"] == [3.0, 0.0]
    table = spark.createDataFrame([("t", "1", [6.0, 8.0]), ("t", "2", [1.0, 1.0])], "tree_id string, node_id string, vector array<float>")
    got = {r["node_id"]: r["embedding"] for r in seams.embed(nodes, table).collect()}
    assert got["1"] == pytest.approx([0.6, 0.8]) and not got["2"]


def test_models_see_batches(spark):
    upper = seams.batched(lambda: lambda texts: [t.upper() for t in texts])
    assert one(spark, upper(F.concat(F.lit("a"), F.lit("b")))) == "AB"


def test_blocks_of_queries_find_the_same(spark):
    r = random.Random(3)
    vec = lambda: [r.uniform(-1, 1) for _ in range(5)]
    nodes = spark.createDataFrame([(f"t{i % 3}", f"{i:04d}", i, "0000" if i % 4 == 0 else f"{i - i % 4:04d}", "", "", "", None if i % 7 == 3 else vec()) for i in range(60)], NODE)
    q = spark.createDataFrame([(i, 0, "q", vec()) for i in range(23)] + [(99, 0, "q", None)], "query_id long, variant_no int, query_text string, query_vec array<float>")
    parts = list(vector.blocks(q, 5))
    assert len(parts) == 5 and sum(len(b.query_id) for b in parts) == 23
    best = lambda bs: sorted(tuple(x) for b in bs for x in vector.flat_top(nodes, b, 4).select("query_id", "tree_id", "node_id", "rank").collect())
    want = {}
    vs = {x["node_id"]: x for x in nodes.collect() if x["embedding"]}
    for x in q.where("query_vec is not null").collect():
        for t in ("t0", "t1", "t2"):
            own = sorted((-round(sum(a * b for a, b in zip(n["embedding"], x["query_vec"])), 9), n["ord"], k) for k, n in vs.items() if n["tree_id"] == t)
            want |= {(x["query_id"], t, k, i + 1): 0 for i, (_, _, k) in enumerate(own[:4])}
    assert best(parts) == best(list(vector.blocks(q))) == sorted(want)
    assert retrieve.beam(nodes, q.limit(0)).count() == 0 and vector.similarities(nodes, q.limit(0)).count() == 0


def test_the_plan_after_the_beam_is_short(spark):
    from trellis.plans import retrieval

    plan = retrieval.QUERIES["C03"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") < 12 and plan.count("NestedLoop") == plan.count("Cartesian") == 0


def test_summaries_bottom_up(spark):
    rows = [("t", "0000", 0, None, 0, "D", ""), ("t", "0001", 1, "0000", 1, "A", "# A"), ("t", "0002", 2, "0001", 2, "B", "long enough content of a section")]
    df = spark.createDataFrame(rows, "tree_id string, node_id string, ord int, parent_id string, depth int, title string, content string").withColumn("summary", F.lit(None).cast("string"))
    got = {r["node_id"]: r["summary"] for r in ingest.summarise(df).collect()}
    assert got["0002"] == "long enough content of a section"
    assert got["0001"] == "- B: long enough content of a section" and "A: - B" in got["0000"]


def test_state_keeps_old_fields(spark):
    ev = spark.createDataFrame([("t", 1, 1, "running", "x", 5.0, None), ("t", 2, 2, "failed", None, None, "boom")], "task_id string, ts long, seq long, status string, stage string, pct double, error string")
    r = tasks.state(ev).first()
    assert (r["status"], r["stage"], r["pct"], r["error"]) == ("failed", "x", 5.0, "boom")


def test_roles(spark):
    m = {r["role"]: r["permissions"] for r in access.role_matrix(access.role_permissions(spark)).collect()}
    assert [len(m[r]) for r in access.ROLES] == [13, 10, 5, 2]


def test_zero_vector_stays(spark):
    assert one(spark, vector.normalise(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\nx")
    (tmp_path / "b.bin").write_text("no")
    assert [tuple(r) for r in ingest.read_texts(spark, str(tmp_path)).collect()] == [("a", "# A\nx")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/x.json").write_text('{"title": "D", "node_id": "0000", "nodes": [{"title": "A", "node_id": "0001", "content": "c", "embedding": [1.0], "zz": 1}]}')
    got = ingest.read_trees(spark, str(tmp_path / "t")).orderBy("ord").collect()
    assert [(r["node_id"], r["parent_id"], r["content"], r["embedding"]) for r in got] == [("0000", None, "", None), ("0001", "0000", "c", [1.0])]
