"""The index of balls against flat search, and queries in blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.operators import index, vector

NODE = "tree_id string, node_id string, ord int, parent_id string, embedding array<float>"
QUERY = "query_id long, variant_no int, query_text string, query_vec array<float>"


def clustered(r, n, around, dim=6, spread=0.02):
    out = []
    for i in range(n):
        c = around[i % len(around)]
        out.append([float(x + r.gauss(0, spread)) for x in c])
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(1)
    around = [[r.uniform(-1, 1) for _ in range(6)] for _ in range(8)]
    rows = [("hot", f"{i:04d}", i, "0000", v) for i, v in enumerate(clustered(r, 900, around))]
    rows += [(f"t{i % 5}", f"{i:04d}", i, "0000", v) for i, v in enumerate(clustered(r, 60, around))]
    rows += [("hot", "9999", 9999, "0000", None), ("t0", "9998", 9998, "0000", []), ("odd", "0001", 1, "0000", [1.0, 2.0]), ("same", "0001", 1, "0000", [0.0] * 6)]
    rows += [("same", f"1{i:03d}", i + 2, "0000", [0.5] * 6) for i in range(40)]
    queries = [(i, i % 2, f"q{i}", v) for i, v in enumerate(clustered(r, 17, around, spread=0.3))] + [(90, 0, "none", None), (91, 0, "zero", [0.0] * 6)]
    return spark.createDataFrame(rows, NODE).repartition(5), spark.createDataFrame(queries, QUERY)


def rows(df):
    return sorted((r["query_id"], r["variant_no"], r["query_text"], r["tree_id"], r["node_id"], r["ord"], round(r["sim"], 6), r["rank"]) for r in df.collect())


@pytest.mark.parametrize(("ball_rows", "k"), [(4, 3), (16, 20), (64, 1)])
def test_index_finds_what_flat_search_finds(spark, corpus, tmp_path, ball_rows, k):
    nodes, queries = corpus
    index.write(nodes, str(tmp_path), ball_rows)
    own = index.read(spark, str(tmp_path))
    assert own.agg(F.max("n")).first()[0] <= ball_rows
    assert rows(index.search(own, queries, k)) == rows(vector.flat_search(nodes.where("tree_id <> 'odd'"), queries, k))


def test_index_skips_and_holds_all(spark, corpus, tmp_path):
    nodes, queries = corpus
    index.write(nodes, str(tmp_path), 16)
    own = index.read(spark, str(tmp_path))
    assert len(list(tmp_path.glob("*.parquet"))) <= 8  # not one a tree
    back = {(r["tree_id"], r["node_id"]): list(r["embedding"]) for r in index.unpacked(own).collect()}
    assert back == {(r["tree_id"], r["node_id"]): list(r["embedding"]) for r in nodes.where(vector.embedded(F.col("embedding"))).collect()}
    assert index.share_skipped(own.where("tree_id = 'hot'"), queries, 3) > 0.3
    scoped = own.where("tree_id = 't1'")
    assert "PushedFilters: [IsNotNull(tree_id), EqualTo(tree_id,t1)]" in scoped._jdf.queryExecution().toString()


def test_empty_index_and_no_queries(spark, corpus, tmp_path):
    nodes, queries = corpus
    index.write(nodes.limit(0), str(tmp_path / "a"))
    assert index.search(index.read(spark, str(tmp_path / "a")), queries).count() == 0
    index.write(nodes, str(tmp_path / "b"))
    assert index.search(index.read(spark, str(tmp_path / "b")), queries.limit(0)).count() == 0


def test_blocks_come_one_by_one(spark, corpus):
    nodes, queries = corpus
    got = vector.each_block(queries, lambda b: vector.flat_top(nodes.where("tree_id <> 'odd'"), b, 4).drop("_q"), 5)
    assert rows(got) == rows(vector.flat_search(nodes.where("tree_id <> 'odd'"), queries, 4))
    assert [b.only for b in vector.blocks(queries)] == [True]
    it = vector.blocks(queries, 5)
    assert not next(it).only and iter(it) is it  # nothing but the first block has been collected


def test_best_of_each_parent_in_the_batch(spark):
    r = np.random.default_rng(3)
    nodes = spark.createDataFrame([("t", f"{i:04d}", i, f"p{i % 7}", [float(x) for x in r.normal(size=3)]) for i in range(200)], NODE)
    q = spark.createDataFrame([(0, 0, "q", [1.0, 0.0, 0.5])], QUERY)
    cut = vector.similarities(nodes, q, 2, ("tree_id", "parent_id"))
    best = lambda df: sorted(tuple(x) for x in vector.top(df, 2, "sim", ["query_id", "tree_id", "parent_id"], ["ord"]).select("parent_id", "node_id", "rank").collect())
    assert best(cut) == best(vector.similarities(nodes, q)) and cut.count() < 200


def test_a_root_with_a_vector_is_found(spark):
    nodes = spark.createDataFrame([("t", "0000", 0, None, [1.0, 0.0]), ("t", "0001", 1, "0000", [0.0, 1.0])], NODE)
    q = spark.createDataFrame([(0, 0, "q", [1.0, 0.0])], QUERY)
    assert [r["node_id"] for r in vector.flat_search(nodes, q, 1).collect()] == ["0000"]


def test_written_folders_are_released(spark, tmp_path):
    from trellis.plans import retrieval
    from trellis.sources import scratch

    sf = "/root/testdata/sf0.001"
    one = retrieval.corpus(spark, sf)
    assert retrieval.corpus(spark, sf) is one and one.count() == 200
    scratch.keep(spark.range(3), "some")
    assert scratch.release(spark) >= 2 and scratch.release(spark) == 0
    again = retrieval.corpus(spark, sf)  # ingested anew, as its files are gone
    assert again is not one and again.count() == 200


def test_contents_are_only_moved_for_those_who_need_them(spark):
    from trellis.plans import retrieval

    sf = "/root/testdata/sf0.001"
    one, full = retrieval.corpus(spark, sf), retrieval.corpus(spark, sf, content=True)
    assert "content" not in one.columns and one is not full
    assert sorted(map(str, one.collect())) == sorted(map(str, full.select(*one.columns).collect()))
    ranked = full.where("ord % 3 = 0").select("tree_id", "node_id")
    found = retrieval.with_contents(spark, sf, ranked)
    assert sorted(map(tuple, found.select("tree_id", "node_id", "content").collect())) == sorted(map(tuple, full.where("ord % 3 = 0").select("tree_id", "node_id", "content").collect()))


def test_small_groups_are_ranked_without_a_shuffle_of_pairs(spark):
    r = random.Random(4)
    rows = [("t", f"{i:04d}", i, f"p{i % 3 if i < 90 else i // 3}", [r.choice([0.0, 0.5, 1.0]), 1.0] if i % 5 else None) for i in range(200)]
    q = [(0, 0, "q", [1.0, 0.1]), (1, 0, "r", [-1.0, 0.3])]
    got = {(x["query_id"], x["parent_id"], x["rank"]): x["ord"] for x in vector.top_of_groups(spark.createDataFrame(rows, NODE), spark.createDataFrame(q, QUERY), 2, ["tree_id", "parent_id"]).collect()}
    want = {}
    for k, _, _, v in q:
        for p in {x[3] for x in rows}:
            own = sorted((-round(sum(a * b for a, b in zip(x[4], v, strict=True)), 9) if x[4] else 0.0, x[2]) for x in rows if x[3] == p)
            want |= {(k, p, n + 1): o for n, (_, o) in enumerate(own[:2])}
    assert got == want
