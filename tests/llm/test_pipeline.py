"""The stages one after the other, each judged on its own input."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from trellis.llm import mixing
from trellis.llm.common import materialize, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = first = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF), f"test-{name}")
        if name != "sharding":
            assert out.columns == first.columns
        if name in ("toxicity", "near-dedup", "decontamination"):
            assert 0 < out.count() <= docs.count() and out.exceptAll(docs).count() == 0
        if name == "mixing":
            words = sum(r["n"] for r in out.selectExpr("size(regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)) n").collect())
            assert words == sum(r["taken"] for r in mixing.takes(docs).collect())
        if name == "sharding":
            own = sorted(map(repr, docs.select("doc_id", "text", "lang", "source", "n_chars").collect()))
            assert sorted(map(repr, out.select("doc_id", "text", "lang", "source", "n_chars").collect())) == own
        docs = out


def odd_tables(spark, where):
    """Planted cases among nulls, repeats, empty and long texts and columns with the names that
    the stages use: what has to go, and what may."""
    r = random.Random(31)
    vocab = ["".join(r.choice("abcdefgé") for _ in range(r.randint(2, 7))) for _ in range(900)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    rows = [(i, text(r.randint(20, 90)), "en", f"s{i % 3}", 0) for i in range(240)]
    items = [(i, text(30) + ". " + text(2) + ".") for i in range(6)]
    bad = lambda t: t + " " + " ".join(r.choice(["moron", "scumbag", "lostian", "lostera"]) for _ in range(6))
    toxic, near, leak = range(300, 340), range(400, 420), range(500, 506)
    rows += [(i, bad(text(40)), "en", "s1", 0) for i in toxic]
    for i in near:
        w = rows[i - 400][1].split()
        rows.append((i, " ".join(w + ["extra"]) if i % 2 else re.sub("[a-z]", lambda m: m[0].upper(), rows[i - 400][1]), "en", "s2", 0))
    rows += [(i, f"{text(20)} {items[i - 500][1]} {text(20)}", "en", "s0", 0) for i in leak]
    rows += [(None, text(30), None, None, None), (600, None, "en", "s1", None), (601, "", "en", "s1", 0), (602, "long word " * 9000, "en", "s1", 0), rows[3], rows[3]]
    names = ["_toxicity", "_hits", "hits", "toxicity", "_near_key", "_mix_key", "_mix_words", "size", "shard", "key"]
    df = spark.createDataFrame([(*x, *[f"n{k}" for k in range(len(names))]) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    df.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([*items, (None, None), (7, "")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i >= 300)) for i in [*range(0, 240), *toxic]] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return df, set(toxic), near, set(leak)


def test_odd_tables_through_all_stages(spark, tmp_path):
    df, toxic, near, leak = odd_tables(spark, tmp_path)
    kept = {}
    docs = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), f"odd-{name}")
        kept[name] = [x["doc_id"] for x in docs.select("doc_id").collect()]
        if name != "sharding":
            assert docs.columns == df.columns
            assert docs.where("_toxicity <> 'n0' or _near_key <> 'n4' or size <> 'n7' or shard <> 'n8'").count() == 0
    ids = {x["doc_id"] for x in df.collect()}
    assert set(kept["toxicity"]) == ids - toxic
    pairs = {frozenset((i, i - 400)) for i in near}
    first = set(kept["near-dedup"])
    assert all(len(p & first) == 1 for p in pairs) and kept["near-dedup"].count(3) == 1
    # a null and an empty text are one class
    assert first == ids - toxic - set(near) - {601}
    assert set(kept["decontamination"]) == first - leak
    # what has words is mixed, in passes of at most three
    mixed = kept["mixing"]
    assert set(mixed) <= first - leak - {600} and max(map(mixed.count, set(mixed))) <= 3
    assert sorted(map(str, kept["sharding"])) == sorted(map(str, mixed))
    last = docs.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert all(x["n"] == x["m"] + 1 for x in last) and set(df.columns) - {"size", "shard"} <= set(docs.columns)


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        table(spark, SF, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
