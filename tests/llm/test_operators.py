"""The corpus operators against brute force, and their defined results in odd cases."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trellis.llm import decontam, exact_dedup, line_dedup, lm, mixing, near_dedup, quality, sharding, textvec, token_counts, toxicity
from trellis.llm.common import join_frequent

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def make(n, seed=0, words=400):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 7))) for _ in range(words)]
    return [(i, " ".join(r.choice(vocab) for _ in range(r.randint(3, 120))), "en", f"s{r.randint(0, 3)}", 0) for i in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing columns."""
    rows = make(40)
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, "", "en", None, 0), (None, "no id here at all", "en", "s1", 4), (103, "long " * 30_000, "en", "s1", 5), rows[0], rows[0], (104, rows[1][1], "en", "s2", 3), (105, rows[1][1].upper(), "en", "s2", 3), (106, "\n\n", "fr", "", 1)]
    return spark.createDataFrame([(*x, 7, "x") for x in rows], DOCS + ", size int, keys string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_words_split_as_the_pattern():
    texts = ["Ab  c\td", None, "", "É\x0bx\xa0y", "  "]
    got = [w for w in textvec.words(pa.array(texts))]
    assert sum((list(w.count) for w in got), []) == [len(WORD.findall(t or "")) for t in texts]
    a, b = (next(textvec.words(pa.array([t]))).hashes() for t in ("ABC abc", "abc x"))
    assert a[0] == a[1] == b[0] != b[1]


# Line dedup


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def test_line_dedup_against_all_pairs(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abcé fg ") for _ in range(r.randint(18, 50))) for _ in range(12)]
    rows = []
    for i in range(50):
        ls = []
        for _ in range(3):
            s = list(r.choice(base))
            for _ in range(r.randint(0, 2)):
                k = r.randrange(len(s))
                s[k : k + r.randint(0, 1)] = r.choice(["", "x", "y"])
            ls.append("".join(s))
        rows.append((i, "\n".join(ls)))
    want, seen = {}, []
    for i, t in rows:
        for n, line in enumerate(t.split("\n")):
            if line.strip() and any(line == o or (len(line) >= 20 and len(o) >= 20 and near(line, o)) for o in seen):
                want.setdefault(i, []).append(n)
            seen.append(line)
    found, _ = line_dedup.verdicts(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=20)
    got = defaultdict(list)
    for x in found.where("goes").select("doc.doc_id", "nth").collect():
        got[x["doc_id"]].append(x["nth"])
    assert {k: sorted(v) for k, v in got.items()} == want


def test_short_lines_are_joined_by_the_query(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, "\n".join("".join(r.choice("ab é") for _ in range(r.choice([1, 2, 3, 5, 8, 19, 20]))) for _ in range(3)), "en", "s", 0) for i in range(30)]
    rows += [(30, "nineteen characters", "en", "s", 0), (31, "nineteen character\nx\n\n \nxy", "en", "s", 0)]
    write(spark.createDataFrame(rows, DOCS), str(tmp_path / "documents.parquet"))
    want, seen = {}, []
    for i, t, *_ in rows:
        want[i] = []
        for n, line in enumerate(t.split("\n")):
            if line.strip():
                if any(line == o or near(line, o) for o in seen):
                    want[i].append(n)
                seen.append(line)
    assert want[31][:1] == [0]
    assert {x["doc_id"]: list(x["gone"]) for x in line_dedup.query(spark, str(tmp_path)).collect()} == want


def test_line_dedup_takes_ids_and_columns_of_any_kind(spark):
    rows = [("b", "one line of words\nanother", 1, "x"), ("a", "one line of words\n\nmore", 2, "y"), (None, "one line of wordz", 3, "z"), ("c", None, 4, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, _line_row int, _line_gone string")
    got = {r["_line_row"]: r for r in line_dedup.clean(df, min_chars=0).collect()}
    assert got[2]["text"] == "one line of words\n\nmore" and got[1]["text"] == "another" and got[3]["text"] == "" and got[4]["text"] is None
    assert {k: r["_line_gone"] for k, r in got.items()} == {1: "x", 2: "y", 3: "z", 4: None}


def test_line_dedup_odd(spark, odd, none):
    out = line_dedup.clean(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert line_dedup.clean(none).count() == 0


# Sharding


def test_shards(spark, odd, none):
    df = spark.createDataFrame(make(3000, 5) + [(9000 + i, "copy of one text " * 20, "en", "s", 0) for i in range(1500)], DOCS)
    rows = sharding.shard(df, 8).collect()
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 4500 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(size.values()) < 1.06 * min(size.values())
    some = sharding.shard(odd, 4).collect()
    assert len(some) == odd.count() and {r["size"] for r in some if r["doc_id"] == 100} == {8}
    assert sharding.shard(none, 4).count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_groups_stay_whole_and_shards_are_even(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rows = sharding.shard(docs, 24).collect()
    size, group, where = Counter(), Counter(), defaultdict(set)
    for r in rows:
        assert r["size"] == len((text[r["doc_id"]] or "").encode()) + 8
        size[r["shard"]] += r["size"]
        group[text[r["doc_id"]]] += r["size"]
        where[text[r["doc_id"]]].add(r["shard"])
    fair = sum(size.values()) / 24
    assert len(rows) == len(text) and all(len(where[t]) == 1 for t, n in group.items() if n <= fair)
    # whole groups, the largest first: no shard is above the mean by more than a small range
    assert max(size.values()) <= max(1.02 * fair, max(group.values())) and min(size.values()) >= 0.97 * fair


def test_large_groups_go_to_as_few_shards_as_hold_them(spark):
    rows = make(900, 6) + [(i, "one text " * 30, "en", "s", 0) for i in range(5000, 5600)] + [(7, "same row " * 30, "en", "s", 0)] * 300 + [(None, "no id " * 30, "en", "s", 0)] * 300
    got = sharding.shard(spark.createDataFrame(rows, DOCS), 8).join(spark.createDataFrame(rows, DOCS).select("text", F.crc32("text").alias("text_crc32")).distinct(), "text_crc32").collect()
    size, group, where = Counter(), Counter(), defaultdict(set)
    for r in got:
        size[r["shard"]] += r["size"]
        group[r["text"]] += r["size"]
        where[r["text"]].add(r["shard"])
    fair = sum(size.values()) / 8
    assert len(got) == len(rows) and max(size.values()) < 1.03 * min(size.values())
    assert all(len(where[t]) <= math.ceil(n / fair) for t, n in group.items()) and max(map(len, where.values())) > 1


def test_shards_take_ids_of_any_type(spark, odd):
    named = odd.withColumn("doc_id", F.concat(F.lit("id-"), F.col("doc_id").cast("string")))
    rows = sharding.shard(named, 4).collect()
    assert len(rows) == odd.count() and {r["doc_id"] for r in rows} == {r["doc_id"] for r in named.collect()}


def test_shards_carry_columns(spark, odd):
    out = sharding.shard(odd, 4, carry=True)
    assert out.columns == ["doc_id", "size", "text_crc32", "shard", "slot", "text", "lang", "source", "n_chars", "keys"]
    same = lambda df: sorted(map(repr, df.select("doc_id", "text", "lang", "source", "n_chars", "keys").collect()))
    assert same(out) == same(odd) and out.where("size <> octet_length(coalesce(text, '')) + 8").count() == 0


def test_shards_rerun(spark, odd):
    key = lambda: sorted((r["doc_id"] or -1, r["shard"], r["slot"]) for r in sharding.shard(odd, 4).collect())
    assert key() == key()


# Near dedup


def test_dart_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**62, 400).astype(np.uint64)
    w1, w2 = r.integers(1, 5, 400).astype(float), r.integers(1, 5, 400).astype(float)
    sig = near_dedup.dart_minhash(np.concatenate([a, a]), np.repeat([0, 1], 400), np.concatenate([w1, w2]), 2, 600)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()) < 0.06
    few = near_dedup.dart_minhash(a[:1], np.zeros(1, int), None, 1, 64)
    assert (few > 0).all()


@pytest.mark.parametrize("top", [1.0, 2.0, 3.5, 900.0])
def test_dart_signatures_of_any_weights(top):
    r = np.random.default_rng(2)
    s = r.integers(0, 2**62, 80).astype(np.uint64)
    w1 = r.uniform(0.01, top, 80)
    w2 = np.where(r.random(80) < 0.4, r.uniform(0.01, top, 80), w1)
    sig = near_dedup.dart_minhash(np.concatenate([s, s]), np.repeat([0, 1], 80), np.concatenate([w1, w2]), 2, 3000)
    assert (sig > 0).all()
    assert abs((sig[0] == sig[1]).mean() - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()) < 0.03


def test_heavy_elements_cost_no_more_darts(monkeypatch):
    s, sizes, mix = np.arange(1, 101, dtype=np.uint64), [], textvec.mix
    monkeypatch.setattr(textvec, "mix", lambda x, seed=0: sizes.append(len(x)) or mix(x, seed))
    for w in (1.0, 1e4, 1e9):
        near_dedup.dart_minhash(s, np.zeros(100, int), np.full(100, w), 1, 180)
        sizes.append(-1)
    one, two, three = (sum(map(int, part.split())) for part in " ".join(map(str, sizes)).split("-1")[:3])
    assert three < 4 * one and two < 4 * one  # a logarithm of the weight, not the weight


def test_an_empty_coordinate_has_a_value():
    tiny = near_dedup.dart_minhash(np.array([5], np.uint64), np.zeros(1, int), np.array([1e-9]), 1, 180)
    assert (tiny > 0).all()


def test_components_of_chains_stars_and_rings(spark):
    from trellis.llm.graph import components

    r = random.Random(12)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 301), (301, 300), (300, 301)]
    r.shuffle(edges)
    got = {x["v"]: x["comp"] for x in components(spark.createDataFrame([e if r.random() < 0.5 else e[::-1] for e in edges], "a long, b long")).collect()}
    assert got == {v: 0 if v <= 40 else v // 100 * 100 for e in edges for v in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_classes(rows, threshold=0.8, weights="count"):
    sets = {}
    for i, t in rows:
        w = low(t).split()
        own = [tuple(w[j : j + 5]) for j in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]
        sets[i] = Counter(own) if weights == "count" else Counter(set(own))
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and (sets[a] & sets[b]).total() >= threshold * (sets[a] | sets[b]).total():
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("wide", "weights"), [(12, "count"), (1, "count"), (12, "set")])
def test_near_dedup_against_all_pairs(spark, wide, weights):
    r = random.Random(8)
    rows = [(i, t) for i, t, *_ in make(60, 2)]
    rows += [(60 + i, f"{t} {t} {t}") for i, t in rows[:8]]  # once and three times: equal as sets, not as multisets
    for i in range(100):
        w = r.choice(rows[:68])[1].split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "zz" + str(r.randint(0, 9))
        rows.append((100 + i, " ".join(w)))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), wide=wide, weights=weights).collect()}
    assert got == brute_classes(rows, weights=weights)


@pytest.mark.parametrize("weights", ["count", "set"])
def test_large_classes_and_many_copies(spark, weights):
    r = random.Random(9)
    base = [f"w{r.randrange(500)}" for _ in range(60)]
    rows = [(i, " ".join(base)) for i in range(400)] + [(400 + i, " ".join([*base, f"n{i}"])) for i in range(300)] + [(700 + i, " ".join(f"u{i}x{k}" for k in range(20))) for i in range(500)]
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), weights=weights).collect()
    assert len(got) == 1200 and all((x["class_id"], x["class_size"]) == ((0, 700) if x["doc_id"] < 700 else (x["doc_id"], 1)) for x in got)
    assert [x["doc_id"] for x in got if x["kept"] and x["class_id"] == 0] == [0]


def test_keep_one_is_stable_and_takes_clashing_names(spark):
    rows = [(1, "same text of five words", k, "a", 3) for k in (5, 2, 9)] + [(None, "other text", 1, "b", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int, _near_key string, _near_nth int")
    one, two = (sorted(map(repr, near_dedup.keep_one(x).collect())) for x in (df, df.orderBy(F.col("extra").desc()).repartition(3)))
    assert one == two and len(one) == 2 and near_dedup.keep_one(df).columns == df.columns


def test_joined_finds_every_pair_at_the_threshold(spark):
    r = random.Random(5)
    common = r.sample(range(1 << 40), 60)
    sets = []
    for i in range(250):  # a common passage, and a few elements of their own or of a family
        family = [(1 << 41) + 50 * (i % 9) + k for k in range(r.randint(0, 20))]
        sets.append(sorted({*common[: r.randint(30, 60)], *family, *((1 << 42) + 1000 * i + k for k in range(r.randint(0, 18)))}))
    rows = [(bytearray(i.to_bytes(16, "big")), i % 40, s) for i, s in enumerate(sets)]
    found = near_dedup._joined(spark.createDataFrame(rows, "v binary, c long, items array<long>"), 0.8).collect()
    got = {(int.from_bytes(x["a"], "big"), int.from_bytes(x["b"], "big")) for x in found}
    want = {(a, b) for a in range(250) for b in range(a) if a % 40 != b % 40 and len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})}
    assert want and {(b, a) for a, b in want} <= got


def test_near_dedup_odd(odd, none):
    rows = near_dedup.classes(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r["class_id"]].append(r)
    assert all(sum(r["kept"] for r in v) == 1 for k, v in by.items() if k is not None)
    assert len({r["class_id"] for r in rows if r["doc_id"] in (100, 101, 102, 106)}) == 1
    assert {r["class_id"] for r in rows if r["doc_id"] in (1, 104)} == {1}
    out = near_dedup.keep_one(odd)
    assert out.columns == odd.columns and out.count() == sum(r["kept"] for r in rows)
    assert near_dedup.classes(none).count() == 0


# Token counts


def test_token_counts_against_greedy(spark, odd, none):
    pieces = [bytes([i]) for i in range(256)] + [b" a", b" ab", b"abc", b"bcd", b"cde", b" abcde", b"gf", b"gfe", "é".encode(), "aé".encode(), b"dd", b"ddd"]
    known, most = set(pieces), max(map(len, pieces))

    def greedy(w):
        w, n = b" " + w, 0
        while w:
            k = next(k for k in range(min(len(w), most), 0, -1) if w[:k] in known)
            w, n = w[k:], n + 1
        return n

    got = sorted((r["doc_id"] or -1, r["n_pieces"], r["n_words"]) for r in token_counts.count(odd, pieces).collect())
    want = sorted((r["doc_id"] or -1, sum(greedy(w) for w in (r["text"] or "").encode().split()), len((r["text"] or "").encode().split())) for r in odd.collect())
    assert got == want and token_counts.count(none, pieces).count() == 0


def test_very_long_words_are_walked():
    r = random.Random(3)
    pieces = [b"a", b"b", b"ab", b"aba", b"abab", b"bb", b"ababb", b"c"]
    a = token_counts.build(pieces, b"")
    for odd in (b"", b"x"):
        w = bytes(r.choice(b"abc") for _ in range(300_000)) + odd
        n, i = 0, 0
        while i < len(w) and w[i : i + 1] != b"x":
            i += next(k for k in range(5, 0, -1) if w[i : i + k] in pieces)
            n += 1
        assert token_counts.count_pieces(a, np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)])).tolist() == [1 if odd else n]


def test_unknown_and_long_words():
    a = token_counts.build([b"ab", b"abcd", b"b", b"c"], b"")
    text = np.frombuffer(b"abc" + b"abx" + b"bc" * 1000, np.uint8)
    assert list(token_counts.count_pieces(a, text, np.array([0, 3, 6]), np.array([3, 6, 2006]))) == [2, 1, 2000]


# Mixing


def test_targets_stop_at_the_limit():
    assert mixing.targets([1, 100, 100], [5, 2, 1], 201) == [3, 132, 66]
    assert mixing.targets([0, 10], [5, 2], 10) == [0, 10]


def test_permutation():
    for n in (1, 2, 7, 1000):
        got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 5))
        assert sorted(got) == list(range(n))


def test_mixture(spark, odd, none):
    df = spark.createDataFrame(make(1500, 4), DOCS)
    rows = mixing.takes(df, block=16).collect()
    taken, goal = Counter(), {}
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
        taken[r["source_size"]] += r["taken"]
        goal[r["source_size"]] = r["target"]
    assert all(abs(taken[s] / goal[s] - 1) < 0.03 for s in goal) and sum(goal.values()) == pytest.approx(sum(r["size"] for r in rows))
    some = mixing.takes(odd, block=16)
    first = sorted(map(repr, some.collect()))
    assert len(first) == odd.count() and first == sorted(map(repr, mixing.takes(odd, block=16).collect()))
    out = mixing.mixed(odd, block=16)
    assert out.columns == odd.columns
    words = sum(len(WORD.findall(r["text"])) for r in out.collect())
    assert words == sum(r["taken"] for r in some.collect())
    assert mixing.takes(none).count() == 0


def test_draws_are_the_same_in_any_range_and_end_at_the_total():
    wanted = np.array([1, 0, 700, 20_000, 13])
    every = list(mixing.draws(wanted, 37, 5, 0, 37))
    assert [k for k, *_ in every] == list(range(37)) and (sum(n for *_, n in every) == wanted).all()
    assert all((a[1] + a[2] == b[1]).all() and (a[2] >= 0).all() for a, b in zip(every, every[1:]))
    assert {int(n.sum()) for *_, n in every} <= {wanted.sum() // 37, wanted.sum() // 37 + 1}
    some = list(mixing.draws(wanted, 37, 5, 11, 14))
    assert [k for k, *_ in some] == [11, 12, 13] and all((x[2] == every[x[0]][2]).all() for x in some)
    assert np.std([n[2] for *_, n in every]) > 1  # drawn, not dealt


def test_mixture_against_brute_force(spark, odd):
    docs = odd.unionByName(spark.createDataFrame([(*x, 7, "x") for x in make(300, 17)], DOCS + ", size int, keys string"))
    placed, sources = mixing._placed_documents(docs, "doc_id", "text", "source", (5, 2, 1), 3, 16, 50)
    rows, uses = placed.collect(), mixing.placements(spark, sources, 64, 3, 11).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["sid"]].append(r)
    for sid, own in by.items():  # positions are a gapless line
        at = 0
        for r in sorted(own, key=lambda r: (r["pos"], r["size"])):
            assert r["pos"] == at
            at += r["size"]
        assert at == sources[sid].words
    n = Counter((u["sid"], u["block"]) for u in uses)
    turns = {(u["sid"], u["block"], u["pass"]) for u in uses}
    assert len(turns) == len(uses) and max(n.values()) <= 3
    word = {sid: np.repeat([n[sid, b] for b in range(sources[sid].blocks)], sources[sid].block) for sid in by}
    want = Counter((r["doc_id"], r["size"], int(word[r["sid"]][r["pos"] : r["pos"] + r["size"]].sum())) for r in rows)
    got = Counter((r["doc_id"], r["size"], r["taken"]) for r in mixing.takes(docs, block=16, per_shard=64, max_sources=50).collect())
    assert got == want


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_sources_come_near_their_targets(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    rows = mixing.takes(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r["t"] / r["g"] - 1) < 0.01 for r in rows)


def test_mixing_clashes(spark, odd):
    docs = odd.withColumn("_mix_key", F.lit("k")).withColumn("_mix_words", F.lit(None).cast("int")).withColumn("pos", F.lit(1)).withColumn("block", F.lit("b"))
    out = mixing.mixed(docs, block=16)
    assert out.columns == docs.columns and out.where("_mix_key <> 'k' or _mix_words is not null or block <> 'b'").count() == 0
    plain = Counter((r["doc_id"], r["text"]) for r in mixing.mixed(odd, block=16).collect())
    assert sum(plain.values()) == out.count()


# Language model


def test_language_model_against_formula(spark, odd, none):
    docs = odd.where("doc_id is not null")
    train = [r["text"] for r in docs.where("doc_id % 3 <> 0").collect()]
    toks = lambda t: [*WORD.findall(low(t)), None]
    c = Counter(w for t in train for w in toks(t))
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for t in train for p in zip(["<s>", *toks(t)[:-1]], toks(t), strict=True))
    ahead = Counter(w for _, w in pairs)

    def cuts(counts):
        """Modified Kneser-Ney discounts out of how many counts are 1, 2, 3 and 4."""
        k1, k2, k3, k4 = (sum(x == i for x in counts) for i in (1, 2, 3, 4))
        y = k1 / (k1 + 2 * k2)
        raw = (1 - 2 * y * k2 / k1, 2 - 3 * y * k3 / k2 if k2 else 1.0, 3 - 4 * y * k4 / k3 if k3 else 1.5)
        return (0.0, *(min(max(x, 0.05), i + 0.95) for i, x in enumerate(raw)))

    d1, d2 = cuts([x for w, x in ahead.items() if w is not None]), cuts(pairs.values())
    rest = sum(d1[min(3, x)] for x in ahead.values()) / len(pairs)
    total, left = Counter(), defaultdict(float)
    for (a, _), x in pairs.items():
        total[a] += x
        left[a] += d2[min(3, x)]

    def prob(a, w):
        p1 = max(0, ahead[w] - d1[min(3, ahead[w])]) / len(pairs) + rest / (v + 1)
        x = pairs[(a, w)]
        return (max(0, x - d2[min(3, x)]) + left[a] * p1) / total[a] if total[a] else p1

    model = lm.train(docs.where("doc_id % 3 <> 0"), part_tokens=3000)
    assert (model.tokens, model.words + 1) == (n, v)
    for r, t in zip(lm.score(docs, model).orderBy("doc_id", "score").collect(), docs.orderBy("doc_id").collect(), strict=True):
        x = toks(t["text"])
        assert r["n_tokens"] == len(x) and r["n_known"] == sum(c[w] > 0 for w in x)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x))
        assert r["score"] == pytest.approx(sum(math.log10(prob(a, w)) for a, w in zip(["<s>", *x[:-1]], x, strict=True)))
    empty = lm.train(none)
    assert lm.score(odd, empty).where("n_known > 0").count() == 0 and lm.score(none, model).count() == 0


def test_three_words_against_formula(spark, odd, none):
    """Order 3 from the definition: counts of triples, then how many words stand before a pair,
    then before a word."""
    docs = odd.where("doc_id is not null").unionByName(spark.createDataFrame([(500 + i, f"a b c a b d a b c {'x y z' if i % 3 else 'b c a'} a b", "en", "s", 0, 0, "") for i in range(20)], odd.schema))
    toks = lambda t: [*WORD.findall(low(t)), None]
    train = [toks(r["text"]) for r in docs.where("doc_id % 3 <> 0").collect()]
    c = Counter(w for t in train for w in t)
    v = len(c)
    triples = Counter(x for t in train for x in zip(["<s>", "<s>", *t[:-1]][: len(t)], ["<s>", *t[:-1]], t, strict=True))
    pairs = Counter(x for t in train for x in zip(["<s>", *t[:-1]], t, strict=True))
    ends = Counter((b, w) for a, b, w in triples if b != "<s>") + Counter({x: n for x, n in pairs.items() if x[0] == "<s>"})
    ahead = Counter(w for _, w in pairs)

    def cuts(counts):
        k1, k2, k3, k4 = (sum(x == i for x in counts) for i in (1, 2, 3, 4))
        y = k1 / (k1 + 2 * k2) if k1 else 0.5
        raw = (1 - 2 * y * k2 / k1 if k1 else 0.5, 2 - 3 * y * k3 / k2 if k2 else 1.0, 3 - 4 * y * k4 / k3 if k3 else 1.5)
        return (0.0, *(min(max(x, 0.05), i + 0.95) for i, x in enumerate(raw)))

    d1, d2, d3 = cuts([x for w, x in ahead.items() if w is not None]), cuts(ends.values()), cuts(triples.values())
    rest = sum(d1[min(3, x)] for x in ahead.values()) / len(pairs)
    sums = [defaultdict(float) for _ in range(4)]
    for (b, _), x in ends.items():
        sums[0][b] += x
        sums[1][b] += d2[min(3, x)]
    for (a, b, _), x in triples.items():
        sums[2][a, b] += x
        sums[3][a, b] += d3[min(3, x)]

    def prob(a, b, w):
        p = max(0, ahead[w] - d1[min(3, ahead[w])]) / len(pairs) + rest / (v + 1)
        if sums[0][b]:
            x = ends[b, w]
            p = (max(0, x - d2[min(3, x)]) + sums[1][b] * p) / sums[0][b]
        if sums[2][a, b]:
            x = triples[a, b, w]
            p = (max(0, x - d3[min(3, x)]) + sums[3][a, b] * p) / sums[2][a, b]
        return p

    for part_tokens in (60, 3000):
        model = lm.train(docs.where("doc_id % 3 <> 0"), part_tokens=part_tokens, order=3)
        assert part_tokens > 60 or len(model.hot_two) > 1
        for r, t in zip(lm.score(docs, model).orderBy("doc_id", "score").collect(), docs.orderBy("doc_id").collect(), strict=True):
            x = toks(t["text"])
            assert r["score"] == pytest.approx(sum(math.log10(prob(a, b, w)) for a, b, w in zip(["<s>", "<s>", *x[:-1]][: len(x)], ["<s>", *x[:-1]], x, strict=True)))
    empty = lm.train(none, order=3)
    assert lm.score(odd, empty).where("n_known > 0").count() == 0 and lm.score(none, model).count() == 0
    with pytest.raises(ValueError):
        lm.train(none, order=4)


@pytest.mark.parametrize("part_tokens", [50, 400, 10**6])
def test_scores_do_not_depend_on_the_parts(spark, monkeypatch, part_tokens):
    monkeypatch.setattr(lm, "MAPPED", 3)
    docs = spark.createDataFrame([(i, "the " * (i % 7) + t, *x) for i, t, *x in make(60, 21, 90)], DOCS)
    key = lambda m: {r["doc_id"]: (r["n_known"], round(r["score"], 9)) for r in lm.score(docs, m).collect()}
    some = lm.train(docs.where("doc_id % 4 > 0"), part_tokens=part_tokens)
    assert part_tokens > 50 or len(some.hot) > 1
    assert key(some) == key(lm.train(docs.where("doc_id % 4 > 0"), part_tokens=3000)) and len(lm._open) <= 3


def test_counts_are_summed_in_64_bits():
    big = np.array([3_000_000_000, 3_000_000_000], np.uint32)
    keys, counts = lm._summed(np.array([7, 7], np.uint64), big)
    assert counts.tolist() == [6_000_000_000] and lm._small(counts).dtype == np.uint64 and lm._small(counts // 9).dtype == np.uint32


def test_probabilities_sum_to_one(spark):
    model = lm.train(spark.createDataFrame([("a b a c",), ("b a",), ("a b c c d",)], "text string"))
    for before in ("", "a ", "c ", "zz "):
        total = 0.0
        for w in ("a", "b", "c", "d", "unseen"):
            p, _, n, first = lm.token_scores(next(textvec.words(pa.array([before + w]))), model)
            total += p[int(n[0]) - 2]
        p, _, n, _ = lm.token_scores(next(textvec.words(pa.array([before]))), model)
        assert total + p[int(n[0]) - 1] == pytest.approx(1.0)


# Decontamination


def test_leaks(spark, odd, none):
    r = random.Random(6)
    docs = make(200, 9, 3000)
    items = [(i, " ".join(r.choice(docs[k][1].split()) for k in r.choices(range(200), k=30)) + ".") for i in range(12)] + [(99, None), (98, "")]
    leaked = set()
    for i in range(0, 60, 5):
        w = items[i // 5][1].split()
        if i % 2:
            w[4], w[11] = "changed", "words"
        docs[i] = (i, docs[i][1] + " " + " ".join(w) + " " + docs[i + 1][1], "en", "s", 0)
        leaked.add((i, i // 5))
    df = spark.createDataFrame(docs, DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in decontam.leaks(df, bench).collect()} == leaked
    assert decontam.leaks(odd, bench).count() == 0 and decontam.leaks(none, bench).count() == 0
    assert decontam.leaks(df, bench.where("item_id > 98")).count() == 0
    key = lambda x: sorted((str(r["doc_id"]), str(r["item_id"]).removeprefix("q")) for r in x.collect())
    want = sorted((str(a), str(b)) for a, b in leaked)
    assert key(decontam.leaks(df, bench, max_items=4)) == want  # searched in parts
    named = bench.withColumn("item_id", F.concat(F.lit("q"), F.col("item_id").cast("string")))
    assert key(decontam.leaks(df, named)) == want
    clash = df.withColumn("hits", F.lit("mine")).withColumn("_hits", F.lit(1))
    kept = decontam.clear(clash, bench)
    assert kept.columns == clash.columns and kept.where("hits = 'mine' and _hits = 1").count() == 200 - len({a for a, _ in leaked})
    found = decontam.search(clash, decontam.fit(df, decontam.load(bench)[0]))
    assert found.where(F.size("hits") > 0).count() == len({a for a, _ in leaked})


def test_latent_space_is_fitted_on_all_documents(spark):
    """The products of all tiles, by hand and in both ways of adding them up."""
    r = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in r.zipf(1.3, int(r.integers(0, 90))) % 50) for _ in range(300)] + ["", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(i, " ".join(f"w{(7 * i + k) % 40}" for k in range(12))) for i in range(6)], "item_id long, text string")
    (b,) = decontam.load(items)
    decontam.fit(docs, b)
    place = {w: int(np.searchsorted(b.vocab, h[0])) for w in {f"w{k}" for k in range(40)} for h in decontam._hashed([w])}
    want = np.zeros((len(b.vocab), len(b.vocab)))
    for t in texts:
        words = (t or "").split()
        for lo in range(0, len(words), decontam.TILE):
            i = [place[w] for w in words[lo : lo + decontam.TILE] if w in place]
            row = np.bincount(i, b.idf[i], len(b.vocab)) / max(1e-9, np.sqrt((b.idf[i] ** 2).sum()))
            want += np.outer(row, row)
    coded = decontam._encoded(docs.select("text"), b)
    assert np.allclose(decontam._products(coded, b), want, rtol=1e-4, atol=1e-4)
    assert np.allclose(decontam._gram(coded, b, np.eye(len(b.vocab))), want, rtol=1e-4, atol=1e-4)


def test_products_cost_no_more_with_a_wide_basis(spark, monkeypatch):
    """Words meet a basis as sums only, so 216 columns cost about as much as one; the sums of
    frequent and of rare words are those of the matrix."""
    r = np.random.default_rng(6)
    vocab = np.array([f"w{k}" for k in range(300)])
    docs = spark.createDataFrame([(" ".join(vocab[r.integers(0, 300, 100_000)]),) for _ in range(20)], "text string").coalesce(1)
    (b,) = decontam.load(spark.createDataFrame([(1, " ".join(vocab)), (2, "w1 w2 w3")], "item_id long, text string"))
    coded = decontam._encoded(docs, b)
    df, tiles = decontam._frequencies(coded, b)
    b.idf = np.log((tiles + 1) / (df + 0.5)).clip(0.05)
    wide = r.standard_normal((300, 216))
    took = []
    for basis in (wide[:, :1], wide[:, :1], wide):
        begun = time.monotonic()
        got = decontam._gram(coded, b, basis)
        took.append(time.monotonic() - begun)
    assert took[2] < 4 * took[1]
    want = decontam._products(coded, b) @ wide
    assert np.allclose(got, want, rtol=1e-3, atol=1e-3 * abs(want).max())
    some = decontam._encoded(docs.select(F.substring("text", 1, 9_000).alias("text")), b)
    want = decontam._products(some, b) @ wide
    monkeypatch.setattr(decontam, "LISTED", 700)
    for square in (0, 1, 40, 299):
        monkeypatch.setattr(decontam, "SQUARE", square)
        assert np.allclose(decontam._gram(some, b, wide), want, rtol=1e-4, atol=1e-4 * abs(want).max())


def test_leaks_against_all_windows(spark):
    """Every item against every stretch of a document that is as long, without the latent
    search: what shares ``strong`` of an item's words in order is found."""
    r = random.Random(16)
    docs = make(80, 19, 2500)
    items = [(i, " ".join(r.choice(docs[k][1].split()) for k in r.choices(range(80), k=r.randint(12, 60)))) for i in range(10)]
    for i in range(0, 80, 2):  # paraphrases: words changed, dropped and put in, from none to all
        w = items[i % 10][1].split()
        for _ in range(r.randint(0, len(w))):
            k = r.randrange(len(w))
            w[k : k + r.randint(0, 1)] = r.choice([[], [f"new{r.randint(0, 99)}"]])
        docs[i] = (i, " ".join([docs[i][1], *w, docs[i + 1][1]]), "en", "s", 0)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row, old = [0], row
            for j, y in enumerate(b):
                row.append(old[j] + 1 if x == y else max(row[j], old[j + 1]))
        return row[-1]

    word = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower())
    want, wide = set(), set()
    for i, t, *_ in docs:
        w = word(t)
        for j, u in items:
            x = word(u)
            if max(common(x, w[k : k + len(x)]) for k in range(max(1, len(w) - len(x) + 1))) >= 0.8 * len(x):
                want.add((i, j))
            if common(x, w) >= 0.55 * len(x):
                wide.add((i, j))
    hits = {(x["doc_id"], x["item_id"]) for x in decontam.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 5 and want <= hits <= wide


def test_weak_share_with_a_short_answer(spark):
    r = random.Random(8)
    docs, items, leaked = make(60, 10, 3000), [], set()
    for i in range(12):
        answer = ["Paris", "New York", "Rio de Janeiro"][i % 3]
        w = [f"q{i}x{k}" for k in range(30 - len(answer.split()))]
        items.append((i, " ".join(w) + ". " + answer + "."))
        for k in r.sample(range(len(w)), 12):
            w[k] = f"other{k}"
        told = i % 4 > 0
        docs[i] = (i, docs[i][1] + " " + " ".join(w) + ". " + (answer if told else "None") + ". " + docs[i + 20][1], "en", "s", 0)
        leaked |= {(i, i)} if told else set()
    hits = decontam.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]) for x in hits} == leaked
    assert all(x["answer"] and 0.55 <= x["lcs"] < 0.7 for x in hits)


def test_lcs():
    a, b = np.array([1, 2, 3, 4, 5]), np.array([9, 1, 3, 7, 5, 2])
    assert decontam.lcs_length(a, b) == 3 and decontam.lcs_length(a, b[:0]) == 0


# Quality


def test_quality_and_sites(spark, odd, none, labels):
    good = make(300, 11)
    rows = [(i, t if i % 4 else "!!! ### " * 10, "en", "s1" if i % 4 else f"s{i % 3}", 0) for i, t, *_ in good]
    marks = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    out = quality.score(spark.createDataFrame(rows, DOCS), marks).where("held_out").collect()
    assert out and all((r["score"] >= 0.5) == (r["doc_id"] % 4 > 0) for r in out)
    assert quality.score(odd, labels).count() == odd.count() and quality.score(none, labels).count() == 0
    assert quality.score(odd, labels.where("doc_id < 0")).where("score is null").count() == 0


def test_sites_tell_what_texts_do_not(spark):
    """Texts say little, hosts and folders much: the score loses less than the evidence."""
    r = random.Random(28)
    share = {("good.org", "a"): 0.95, ("good.org", "b"): 0.6, ("bad.com", "a"): 0.05, ("bad.com", "b"): 0.4, **{(f"rare{i}.net", "a"): r.choice([0.1, 0.9]) for i in range(40)}}
    keys, rows, marks = list(share), [], []
    texts = make(1500, 29)
    for i in range(1500):
        host, path = r.choice(keys[:4]) if r.random() < 0.8 else r.choice(keys)
        good = r.random() < share[host, path]
        text = texts[i][1] if r.random() < (0.6 if good else 0.4) else "!!! ### " * 10
        rows.append((i, text, f"https://www.{host}:80/{path}/page{i}.html?x=1"))
        marks.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, url string")
    host, path = quality.sites(F.col("url"))
    out = quality.score(docs.withColumn("host", host).withColumn("folder", path), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), host="host", path="folder").where("held_out").collect()
    loss = lambda c: -sum(math.log(x[c] if marks[x["doc_id"]][1] else 1 - x[c]) for x in out) / len(out)
    assert loss("score") < 0.85 * loss("evidence")
    odd_ones = spark.createDataFrame([("http://A.b/c/d",), ("ftp://u:p@www.x.y",), ("no address",), ("",), (None,), ("http://h/x",)], "u string").select(*quality.sites(F.col("u"))).collect()
    assert [tuple(x) for x in odd_ones] == [("a.b", "c"), ("x.y", ""), (None, None), (None, None), (None, None), ("h", "")]


def test_scores_take_ids_of_any_kind(spark, labels):
    docs = spark.createDataFrame([(f"d{i}", t) for i, t, *_ in make(20, 30)] + [(None, None)], "doc_id string, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit(1))
    own = labels.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "quality", "toxic")
    assert quality.score(docs, own).where("score between 0 and 1").count() == 21
    assert {x["doc_id"] for x in mixing.takes(docs).collect()} == {None, *[f"d{i}" for i in range(20)]}


def test_sites_against_formula(spark):
    """Site shares and scores recomputed from each row's own evidence and the labels."""
    r = random.Random(27)
    rows = [(i, t if r.random() < (0.9 if i % 5 else 0.2) else "!!! ### " * 10, r.choice(["en", "de"]) if i % 7 else None, f"s{i % 5}" if i % 11 else None, 0) for i, t, *_ in make(260, 26)]
    marks = [(i, int("#" not in rows[i][1]), 0) for i in range(0, 260, 2)]
    got = {x["doc_id"]: x for x in quality.score(spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    label = {i: q for i, q, _ in marks if zlib.crc32(str(i).encode()) % 3 != 1}
    own = {i: (1.0, float(label[i])) if i in label else (0.2, 0.2 * got[i]["evidence"]) for i in got}
    total = lambda keep: tuple(sum(x) for x in zip(*[own[i] for i in own if keep(rows[i])])) or (0.0, 0.0)

    def precision(sites):
        sites = [(n, k, m) for n, k, m in sites if n > 0]
        n, n2 = sum(x[0] for x in sites), sum(x[0] ** 2 for x in sites)
        v = sum(x[0] * x[2] * (1 - x[2]) for x in sites) / n
        between = (sum(x[0] * (x[1] / x[0] - x[2]) ** 2 for x in sites) - (len(sites) - 1) * v) / (n - n2 / n)
        return min(1e4, max(1.0, v / between - 1)) if between > 0 and v > 0 else 1e4

    n, k = total(lambda x: True)
    mu = k / n
    hosts = {h: total(lambda x, h=h: x[3] == h) for h in {x[3] for x in rows}}
    paths = {p: total(lambda x, p=p: (x[3], x[2]) == p) for p in {(x[3], x[2]) for x in rows}}
    s_host = precision([(a, b, mu) for a, b in hosts.values()])
    s_path = precision([(a, b, hosts[p[0]][1] / hosts[p[0]][0]) for p, (a, b) in paths.items()])
    logit = lambda p: math.log(p / (1 - p))
    for i, x in got.items():
        (hn, hk), (pn, pk), (wt, good) = hosts[rows[i][3]], paths[rows[i][3], rows[i][2]], own[i]
        mean = (hk - good + s_host * mu) / (hn - wt + s_host)
        site = min(1 - 1e-6, max(1e-6, (pk - good + s_path * mean) / (pn - wt + s_path)))
        assert x["site"] == pytest.approx(site) and x["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert x["score"] == pytest.approx(1 / (1 + math.exp(-(logit(min(1 - 1e-6, max(1e-6, x["evidence"]))) + logit(site) - logit(mu)))))


# Exact dedup


def write(df, path):
    df.write.mode("overwrite").parquet(path)
    return path


def test_exact_dedup(spark, odd, none, tmp_path):
    path = write(odd, str(tmp_path / "d"))
    groups = defaultdict(list)
    for r in odd.collect():
        groups[low(r["text"])].append(r["doc_id"])
    for how in ({}, {"digest": lambda c: F.substring(F.sha2(c, 256), 1, 1)}):  # the second makes different texts clash
        rows = exact_dedup.dedup(spark, path, **how).collect()
        assert len(rows) == odd.count() and sum(r["kept"] for r in rows) == len(groups)
        for r in rows:
            own = next(v for v in groups.values() if r["doc_id"] in v)
            assert r["group_size"] == len(own) and r["keep_id"] == max((x for x in own if x is not None), default=None)
    assert exact_dedup.dedup(spark, write(none, str(tmp_path / "n"))).count() == 0


def test_only_texts_of_hits_are_grouped(spark):
    rows = spark.createDataFrame([(f"{i % 700:064x}", i) for i in range(1000)], "digest string, n int")
    hits = rows.groupBy("digest").count().where("count > 1").select("digest")
    marked = exact_dedup._marked(rows, hits, 25)
    assert marked.columns == rows.columns and sorted(r["n"] for r in marked.collect()) == [i for i in range(1000) if i % 700 < 300]
    assert exact_dedup._marked(rows, hits, 1).count() == 1000 and exact_dedup._marked(rows, hits.limit(0), 25).count() == 0


def test_frequent_keys_are_joined_apart(spark):
    rows = spark.createDataFrame([(("hot" if i % 3 else f"k{i}"), i) for i in range(3000)], "k string, n int")
    facts = rows.groupBy("k").agg(F.count("*").alias("c"), F.min("n").alias("low"))
    got = join_frequent(rows, facts, ["k"], "c", 3000)
    assert sorted(map(tuple, got.select("k", "n", "low").collect())) == sorted(map(tuple, rows.join(facts, "k").select("k", "n", "low").collect()))


def test_exact_dedup_goes_on(spark, tmp_path):
    """A second run reads new files only, and old digests still count."""
    path, check = str(tmp_path / "d"), str(tmp_path / "c")
    spark.createDataFrame([(1, "Aa"), (2, "b")], "doc_id long, text string").write.parquet(path)
    assert exact_dedup.dedup(spark, path, checkpoint=check).where("kept").count() == 2
    spark.createDataFrame([(3, "aA"), (4, "c")], "doc_id long, text string").write.mode("append").parquet(path)
    rows = {r["doc_id"]: r for r in exact_dedup.dedup(spark, path, checkpoint=check).collect()}
    assert [rows[i]["keep_id"] for i in (1, 2, 3, 4)] == [3, 2, 3, 4] and rows[3]["group_size"] == 2


# Toxicity


def test_maximal_segments_against_all():
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(1, 14)
        s = [r.choice([2.0, 1.0, 0.5, 0, 0, 0, 0]) for _ in range(n)]
        at = np.array([i for i, x in enumerate(s) if x > 0])
        full = [x if x > 0 else -0.75 for x in s]
        got = toxicity.maximal_segments(at, np.array([s[i] for i in at]), n, 0.75) if len(at) else []

        def split(a, b):
            best = max(((sum(full[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
            if best is None or best[0] <= 0:
                return []
            return split(a, best[2]) + [(round(best[0], 6))] + split(best[3], b)

        assert sorted(round(x.score, 6) for x in got) == sorted(split(0, n))


def test_weights_against_counting(spark):
    """Log-odds of words from distinct (word, next word) contexts, shrunk level by level."""
    r = random.Random(23)
    texts = []
    for i, t, *_ in make(160, 24, 300):
        w = t.split()
        if i % 4 == 0:
            for _ in range(3):
                w.insert(r.randint(0, len(w)), r.choice(["moronic", "morons", "scumbag", "lostia", "abcdefg"]))
        texts.append((" ".join(w), i % 4 == 0))
    model = toxicity.learn(spark.createDataFrame([(t, int(y)) for t, y in texts] + [(None, 0), ("", 1)], "text string, toxic int"))
    seen = {(y, w, n) for t, y in texts for w, n in zip(t.split(), [*t.split()[1:], None])}
    cut = lambda w, k: (w if k is None else w.encode()[:k].decode("utf-8", "surrogateescape"))
    pos = [Counter(cut(w, k) for y, w, _ in seen if y) for k in toxicity.LEVELS]
    neg = [Counter(cut(w, k) for y, w, _ in seen if not y) for k in toxicity.LEVELS]
    base = sum(pos[-1].values()) / len(seen)
    logit = lambda p: math.log(p / (1 - p))
    want = {}
    for word in {w for _, w, _ in seen}:
        if not any(p[cut(w, k)] >= 4 and p[cut(w, k)] > 2.5 * base * (p[cut(w, k)] + n[cut(w, k)]) for w in {w for _, w, _ in seen} if cut(w, 4) == cut(word, 4) for p, n, k in zip(pos, neg, toxicity.LEVELS)):
            continue  # nothing that starts as it does tells anything
        rho = base
        for p, n, k in zip(pos, neg, toxicity.LEVELS):
            a, b = p[cut(word, k)], n[cut(word, k)]
            rho = (a + 20 * rho) / (a + b + 20)
            gain = logit(rho) - logit(base)
            z = gain / math.sqrt(1 / (a + 20 * base) + 1 / (b + 20 * (1 - base)))
            want[word] = gain if gain > 1 and z >= 3 else 0.0
    words = sorted({w for _, w, _ in seen})
    got = toxicity.token_scores(next(textvec.words(pa.array([" ".join(words)]), True, True)), model)
    assert {w for w, g in zip(words, got) if g > 0} >= {"moronic", "morons", "scumbag", "lostia"}
    assert list(got) == pytest.approx([want.get(w, 0.0) for w in words])


def test_toxic_words_are_found(spark, odd, none, labels):
    r = random.Random(1)
    rows, marks = [], []
    for i, t, *_ in make(600, 12):
        w = t.split()
        if i % 5 == 0:
            for _ in range(3):
                w.insert(r.randint(0, len(w)), r.choice(["moron", "scumbag", "lostian", "lostera"]))
        rows.append((i, " ".join(w), "en", "s", 0))
        marks.append((i, 1, int(i % 5 == 0)))
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.train_model(df, lab)
    out = toxicity.annotate(df, model).select("doc_id", "toxicity.score").collect()
    held = [x for x in out if zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1]
    assert all((x["score"] >= 0.7) == (x["doc_id"] % 5 == 0) for x in held)
    assert toxicity.annotate(odd, model).where("toxicity.score is null").count() == 0
    assert toxicity.annotate(none, model).count() == 0
    clash = toxicity.annotate(df.withColumn("Toxicity", F.lit("mine")).withColumn("n", F.lit(1)), model)
    assert clash.columns == [*df.columns, "n", "toxicity"]
    scores = {x["doc_id"]: x["score"] for x in out}
    assert all(x["score"] == scores[x["doc_id"]] for x in clash.select("doc_id", "toxicity.score").collect())
    plain = toxicity.annotate(odd, toxicity.train_model(odd, labels.where("doc_id < 0")))
    assert plain.where("toxicity.score > 0.01").count() == 0
