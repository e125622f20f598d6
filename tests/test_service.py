"""Questions through the service, unlike results, metadata, and windows of late rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trellis.operators import context, retrieve, service
from trellis.schema import NO_DOCUMENTS, NOT_FOUND
from trellis.streaming import progress, windows

NODE = "tree_id string, node_id string, ord int, parent_id string, title string, content string, summary string, embedding array<float>"
QUESTION = "query_id long, query_text string, doc_ids array<string>"


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(4)
    rows = [(t, "0000", 0, None, "root", "", "", None) for t in ("a", "b")]
    rows += [(t, f"{i:04d}", i, "0000", f"{t}{i}", f"content {t}{i}", f"summary {t} {i}", [r.uniform(-1, 1) for _ in range(4)]) for t in ("a", "b") for i in range(1, 8)]
    return spark.createDataFrame(rows, NODE)


@pytest.fixture(scope="module")
def meta(spark):
    return spark.createDataFrame([("a", "a.pdf", 8), ("b", None, 8)], "doc_id string, filename string, nodes int")


def encode(df):
    return df.withColumn("query_vec", F.array(*[F.lit(float(x)) for x in (1, 0, 0.5, 0)]))


def run(spark, corpus, meta, questions, cached=None, now=1000, **how):
    none = spark.createDataFrame([], service.ENTRY)
    answers, entries = service.ask(spark.createDataFrame(questions, QUESTION), corpus, meta, none if cached is None else cached, now, encode, **how)
    return {r["query_id"]: r for r in answers.collect()}, entries


def test_a_question_is_answered_then_comes_from_the_cache(spark, corpus, meta):
    asked = [(1, "What is it?", None), (2, "  what IS it ", None), (3, "what is it", ["b"]), (4, " ", None), (5, "x" * 2001, None), (6, None, None)]
    got, entries = run(spark, corpus, meta, asked)
    assert {k: r["hit"] for k, r in got.items()} == {1: False, 2: False, 3: False, 4: None, 5: None, 6: None}
    assert got[1]["answer"] == got[2]["answer"] != got[3]["answer"] and got[1]["thinking"].startswith("Original: What is it?")
    assert {s["doc_id"] for s in got[3]["sources"]} == {"b"} and {s["filename"] for s in got[3]["sources"]} == {"b"}
    kept = {r["cache_key"]: r for r in entries.collect()}
    assert set(kept) == {"what is it", "what is it||b"} and [n["node_id"] for n in kept["what is it"]["nodes"]] == [s["node_id"] for s in got[1]["sources"]]
    cached = service.put(entries.limit(0), entries)
    again, new = run(spark, corpus, meta, asked[:3] + [(7, "what is it", ["a"])], cached, 1060)
    assert {k: r["hit"] for k, r in again.items()} == {1: True, 2: True, 3: True, 7: False}
    assert all(again[k]["answer"] == got[k]["answer"] and again[k]["sources"] == got[k]["sources"] for k in (1, 2, 3))
    assert "age 60s" in again[1]["thinking"] and [r["cache_key"] for r in new.collect()] == ["what is it||a"]
    old, _ = run(spark, corpus, meta, asked[:1], cached, 1000 + 7 * 24 * 3600)
    assert old[1]["hit"] is False  # exactly as old as entries may not be


def test_cached_nodes_are_looked_up_anew(spark, corpus, meta):
    got, entries = run(spark, corpus, meta, [(1, "what", None)])
    first = got[1]["sources"][0]
    changed = corpus.withColumn("content", F.lit("new")).where(~((F.col("tree_id") == first["doc_id"]) & (F.col("node_id") == first["node_id"])))
    again, _ = run(spark, changed, meta, [(1, "what", None)], entries, 1001)
    assert again[1]["hit"] and "new" in again[1]["answer"] and again[1]["sources"] == got[1]["sources"][1:]
    gone, _ = run(spark, corpus.where("tree_id = 'zz'"), meta, [(1, "what", None)], entries, 1001)
    assert gone[1]["answer"] == NO_DOCUMENTS and gone[1]["sources"] == []


def test_rewrites_variants_and_unknown_documents(spark, corpus, meta):
    got, entries = run(spark, corpus, meta, [(1, "what", ["zz"]), (2, "what", None)], rewrite=lambda q: F.concat(q, F.lit(" exactly")), vary=lambda q: F.array(q, F.lit("summary a 3")), generate=lambda q, c: F.concat(q, F.lit("!")))
    assert got[1]["answer"] == NOT_FOUND and got[1]["sources"] == [] and got[2]["answer"] == "what!"
    assert got[2]["thinking"] == "Original: what\nRewritten: what exactly\nVariants (1): summary a 3"
    assert entries.count() == 1
    none, new = run(spark, corpus, meta, [])
    assert none == {} and new.count() == 0


def test_the_cache_keeps_the_youngest(spark):
    rows = [(f"k{i}", i, None, [("t", "1")]) for i in range(5)]
    from trellis.schema import RetrievalConfig

    kept = service.put(spark.createDataFrame(rows, service.ENTRY), spark.createDataFrame([("k0", 9, None, [("t", "2")])], service.ENTRY), RetrievalConfig(cache_size=3)).collect()
    assert [(r["cache_key"], r["at"]) for r in kept] == [("k0", 9), ("k4", 4), ("k3", 3)] and kept[0]["nodes"][0]["node_id"] == "2"


def test_diversified_against_a_loop(spark):
    r = random.Random(5)
    vec = {i: None if i % 7 == 0 else [r.uniform(-1, 1) for _ in range(3)] for i in range(1, 15)}
    nodes = spark.createDataFrame([("t", f"{i:04d}", i, "0000", "", "", "", v) for i, v in vec.items()], NODE)
    score = {i: round(r.random(), 3) for i in vec}
    rows = [(q, "t", f"{i:04d}", i, score[i], n + 1) for q, size in ((0, 14), (1, 3)) for n, i in enumerate(sorted(vec, key=lambda i: -score[i])[:size])]
    ranked = spark.createDataFrame(rows, "query_id long, tree_id string, node_id string, ord int, score double, rank int")
    stored = {x["ord"]: x["embedding"] for x in nodes.collect()}
    for q in (0, 1):
        own, picked = [(x[3], x[5]) for x in rows if x[0] == q], []
        while own and len(picked) < 5:
            near = lambda i: max((sum(a * b for a, b in zip(stored[i], stored[p])) if stored[i] and stored[p] else 0.0 for p in picked), default=0.0)  # noqa: E731, B023
            best = min(own, key=lambda x: (-round(0.6 * score[x[0]] - 0.4 * near(x[0]), 9), x[1]))
            own.remove(best)
            picked.append(best[0])
        got = context.diversified(ranked.where(F.col("query_id") == q), nodes, 5, 0.6).orderBy("pick").collect()
        assert [x["ord"] for x in got] == picked and [x["pick"] for x in got] == list(range(1, len(picked) + 1))


def test_metadata_shares_and_the_filter(spark, corpus, meta):
    wanted = spark.createDataFrame([(1, "filename", "A.PDF"), (1, "nodes", "9"), (2, "filename", "a.pdf"), (2, "filename", "a.pdf"), (3, "color", "red"), (4, "filename", None)], "query_id long, field string, value string")
    found = retrieve.metadata_match(wanted, meta, ["filename", "nodes"])
    assert sorted((r["query_id"], r["tree_id"], r["meta"]) for r in found.collect()) == [(1, "a", 0.5), (2, "a", 1.0)]
    q = encode(spark.createDataFrame([(k, 0, "what") for k in (1, 2, 3)], "query_id long, variant_no int, query_text string"))
    plain = {(r["query_id"], r["tree_id"], r["node_id"]): r["score"] for r in retrieve.single(corpus, q, 10).collect()}
    more = {(r["query_id"], r["tree_id"], r["node_id"]): r["score"] for r in retrieve.single(corpus, q, 10, meta=found).collect()}
    assert {k: round(more[k] - v, 6) for k, v in plain.items()} == {k: {(1, "a"): 0.1, (2, "a"): 0.2}.get(k[:2], 0.0) for k in plain}
    only = retrieve.retrieve(corpus, q, meta=found, only_matching=True).collect()
    assert only and {(r["query_id"], r["tree_id"]) for r in only} == {(2, "a")}


def test_late_rows_and_sessions(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    schema = "ts timestamp, user_id string, action string"
    batches = [[(at(5), "u", "a"), (at(50), "u", "a"), (at(200), "v", "b"), (None, "u", "a")], [(at(10), "u", "a"), (at(130), "u", "a"), (at(170), "u", "a"), (at(400), "v", "b")], [(at(1000), "w", "c")]]

    def stream(window, name):
        for b in batches:
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
            progress.start(window(spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")), f"{tmp_path}/c-{name}", f"{tmp_path}/o-{name}", "append").awaitTermination()
        return spark.read.parquet(f"{tmp_path}/o-{name}").drop("batch")

    got = {(r["start"], r["user_id"]): r["n"] for r in stream(lambda e: windows.counts(e, ["user_id"]), "w").collect()}
    assert got == {(at(0), "u"): 2, (at(120), "u"): 2, (at(180), "v"): 1, (at(360), "v"): 1}  # at 10: late; at 130: in time
    spells = {(r["user_id"], r["start"], r["end"], r["n"]) for r in stream(lambda e: windows.sessions(e, "user_id", "45 minutes"), "s").collect()}
    assert spells == {("u", at(5), at(95), 2), ("u", at(130), at(215), 2), ("v", at(200), at(245), 1), ("v", at(400), at(445), 1)}
    whole = spark.createDataFrame(sum(batches, []), schema)
    assert {(r["user_id"], r["n"]) for r in windows.sessions(whole, "user_id", "45 minutes").collect()} >= {("u", 3), ("w", 1)}
