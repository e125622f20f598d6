"""Merkle manifest, prefix BPE and periodic runs against brute force, and in odd cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trellis.llm import bpe, merkle, runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "a b c", "en", "s0", 5),
    (None, "no id", "en", "s1", 5),
    (2, None, None, None, None),
    (7, "", "", "s0", 0),
    (8, "é ü 漢字 😀\x0b\x85\xa0x y", "fr", None, 9),
    (1, "a b c", "en", "s0", 5),
    (1, "a b d", "en", "s0", None),
    (9, "long " * 20_000, "en", "s1", 100_000),
    (10, "\n\n \t", None, "s1", 4),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, 7, "x", [1]) for r in ODD] + [(i, f"text {i} {i % 5}", f"l{i % 3}", "s", 6, 0, "y", None) for i in range(20, 75)]
    return spark.createDataFrame(rows, DOCS + ", rank int, own string, path array<int>").repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


# Merkle manifest


def leaf_of(r, more=0):
    own = (r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"])
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in own])


def pairs_up(level, proofs, where):
    """The only node left; ``where`` has the leaves below each node, whose proofs grow."""
    while len(level) > 1:
        nxt, below = [], []
        for i in range(0, len(level), 2):
            two = level[i : i + 2]
            for k in range(len(two)):
                for x in where[i + k]:
                    proofs[x].append((k, two[1 - k] if len(two) == 2 else None))
            nxt.append(sha(*two))
            below.append(sum(where[i : i + 2], []))
        level, where = nxt, below
    return level[0]


def manifest(rows):
    trees = defaultdict(list)
    for i, r in enumerate(rows):
        trees[r["lang"]].append(i)
    proofs, leaves, sub = defaultdict(list), [leaf_of(r) for r in rows], {}
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    for t in order:
        own = sorted(trees[t], key=lambda i: (rows[i]["doc_id"] is not None, rows[i]["doc_id"] or 0, leaves[i]))
        sub[t] = pairs_up([leaves[i] for i in own], proofs, [[i] for i in own])
    root = pairs_up([sub[t] for t in order], proofs, [trees[t] for t in order])
    out = []
    for i, r in enumerate(rows):
        bad = r["doc_id"] is not None and crc(r["doc_id"]) % 7 == 0
        f = leaf_of(r, 1 if bad and r["n_chars"] is not None else 0)
        for k, s in proofs[i]:
            f = sha(f) if s is None else sha(s, f) if k else sha(f, s)
        out.append((r["doc_id"], leaves[i], sub[r["lang"]], root, sha(*[s for _, s in proofs[i] if s]), f, f == root))
    return sorted(out, key=str)


def written(df, tmp_path):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest_against_pairing_up(spark, odd, bits):
    got = merkle.verify(merkle.documents_manifest(odd, bits)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    want = manifest([r.asDict() for r in odd.collect()])
    assert sorted([tuple(r) for r in got.collect()], key=str) == want
    assert {w[-1] for w in want} == {True, False}


def test_manifest_as_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(merkle.SQL)
    got = merkle.query(spark, sf).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_manifest_whole_proofs(spark, odd):
    found = merkle.documents_manifest(odd, 3).collect()
    assert len(found) == odd.count()
    ranks = defaultdict(list)
    for r in found:
        ranks[r["tree"]].append(r["rank"])
        h = r["leaf"]
        for s in r["path"]:
            h = sha(s["left"], h, s["right"])
        assert h == r["root"]
    assert all(sorted(x) == list(range(len(x))) for x in ranks.values())


def test_manifest_of_one_row_of_none_and_of_many_equal_ones(spark, none, tmp_path):
    assert merkle.query(spark, written(none, tmp_path / "a")).collect() == []
    one = spark.createDataFrame([(7, "x", "en", "s", 1)], DOCS)
    (r,) = merkle.query(spark, written(one, tmp_path / "b")).collect()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == sha()
    same = spark.createDataFrame([(3, "x", "en", "s", 1)] * 37, DOCS)
    got = merkle.verify(merkle.documents_manifest(same, 2)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted([tuple(r) for r in got.collect()], key=str) == manifest([r.asDict() for r in same.collect()])


def test_manifest_takes_other_keys(spark):
    rows = spark.createDataFrame([("b", 2, "q"), ("a", 1, "p"), (None, None, "r")], "k string, host int, h string")
    got = merkle.manifest(rows, "host", "k", "h", ["k"], 4).collect()
    assert {(r["tree"], r["k"], r["leaf"], r["rank"]) for r in got} == {("1", "a", "p", 0), ("2", "b", "q", 0), (None, None, "r", 0)}
    assert len({r["root"] for r in got}) == 1
    with pytest.raises(ValueError):
        merkle.manifest(rows, "host", "k", "h", block_bits=0)


# Prefix BPE


@pytest.fixture(scope="module")
def public():
    return pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tik(public):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary(tik):
    return bpe.Vocabulary(tik[0])


def small(r, n):
    """A vocabulary of merges of random pairs, and of some strings that no merge leads to."""
    tokens = [bytes([b]) for b in range(256)]
    for _ in range(n):
        pick = [t for t in tokens if set(t) <= set(b"abc")]
        t = r.choice(pick) + r.choice(pick)
        if t not in tokens:
            tokens.append(t)
    odd = [t for t in (b"abcabcabc", b"ccbbaaccbb") if t not in tokens]
    return {t: i for i, t in enumerate(tokens + odd)}


def test_prefixes_against_merging_by_rank():
    r = random.Random(5)
    for _ in range(60):
        ranks = small(r, r.randint(1, 40))
        v = bpe.Vocabulary(ranks)
        for _ in range(40):
            data = bytes(r.choice(b"abcd") for _ in range(r.randint(0, 30)))
            want = [ranks[p] for p in bpe.merge(data, ranks)] if data else []
            assert bpe.Prefixes(v, data).tokens(whole=False) == want, (data, ranks)
        assert bpe.Prefixes(v, b"abcabcabc").tokens() == [ranks[b"abcabcabc"]]


def test_append_and_edit_are_exact(vocabulary):
    r = random.Random(6)
    v, words = vocabulary, list(vocabulary.ranks)
    text = b"".join(r.choice(words) for _ in range(400))
    p = bpe.Prefixes(v)
    for i in range(0, len(text), 13):
        p.extend(text[i : i + 13])
    assert p.last == bpe.Prefixes(v, text).last
    for _ in range(60):
        a = r.randint(0, len(p.data))
        b = min(len(p.data), a + r.randint(0, 20))
        new = b"".join(r.choice(words) for _ in range(r.randint(0, 3)))
        done = p.replace(a, b, new)
        assert p.last == bpe.Prefixes(v, bytes(p.data)).last
        if len(p.data) - a > 1000:
            assert done < 400  # far from the end, as it is over soon
    with pytest.raises(ValueError):
        p.replace(5, 2, b"")


def test_encoding_as_the_public_library(tik, vocabulary, public):
    ranks, enc = tik
    e = bpe.Encoder(vocabulary, public.PATTERN)
    r = random.Random(7)
    texts = ["", " ", "\n\n  x", "it's 12,345 <|endoftext|>", "ab" * 40_000, "word " * 20_000, "\x85  \xa0"]
    texts += ["".join(r.choice("abcdeé ñ\n\t漢字١٢3.,'s tI😀") for _ in range(r.randint(0, 60))) for _ in range(400)]
    for t in texts:
        got = [i for run in e.runs(t) for ids in run for i in ids]
        assert got == enc.encode_ordinary(t)


def test_bpe_query_and_round_trip(spark, odd, none, tik, public, tmp_path):
    ranks, enc = tik
    got = bpe.query(spark, written(odd.repartition(2), tmp_path / "a")).collect()
    want = []
    for r in odd.collect():
        ids = enc.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(r["text"] or "")))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.query(spark, written(none, tmp_path / "b")).collect() == []
    ids = bpe.encode(odd.withColumn("doc_id", F.col("doc_id").cast("string")), ranks, public.PATTERN)
    back = bpe.decode(ids, ranks).collect()
    assert sorted((r["doc_id"] or "", bytes(r["data"]).decode()) for r in back) == sorted((str(r["doc_id"] or ""), r["text"] or "") for r in odd.collect())


def test_vocabulary_is_checked(tmp_path):
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0})
    f = tmp_path / "ranks"
    f.write_bytes(b"YQ== 0\nYg== 1\n")
    assert bpe.read_ranks(str(f)) == {b"a": 0, b"b": 1}
    with pytest.raises(ValueError):
        bpe.read_ranks(str(f), max_tokens=1)


# Periodic runs


def all_runs(w, least=1):
    """Every period's maximal stretches, those of a smaller period left out."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(least, 2 * q) and not any(all(w[i + x] == w[i + x + k] for x in range(n - k)) for k in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_repetitions_against_all_periods():
    r = random.Random(8)
    for k in range(1500):
        s = [r.randrange(r.choice([1, 2, 3, 6])) for _ in range(r.randint(0, 36))]
        if k % 3 == 0:
            s = s[: r.randint(1, 12)] * r.randint(1, 4) + s[:5]
        assert sorted(runs.repetitions(s), key=lambda x: (x[0], x[2])) == all_runs(s)


def test_common_extensions():
    r = random.Random(9)
    s = [r.randrange(2) for _ in range(60)]
    t = runs.SuffixTree(s)
    rank = t.rank()
    assert [i for _, i in sorted((x, i) for i, x in enumerate(rank))] == sorted(range(61), key=lambda i: s[i:])
    down = t.rank(descending=True)
    assert [i for _, i in sorted((x, i) for i, x in enumerate(down))] == sorted(range(61), key=lambda i: [-x for x in s[i:]])
    import numpy as np

    i, j = np.array([(a, b) for a in range(61) for b in range(61) if a != b]).T
    for a, b, n in zip(i, j, t.common(i, j), strict=True):
        k = 0
        while max(a, b) + k < 60 and s[a + k] == s[b + k]:
            k += 1
        assert n == k


def words_of(r, k):
    vocab = [f"w{x}".encode() for x in range(r.choice([2, 4, 30]))]
    w = [r.choice(vocab) for _ in range(r.randint(0, 25))]
    for _ in range(r.randint(0, 3)):
        a = r.randint(0, len(w))
        w = w[:a] + w[max(0, a - r.randint(1, 12)) : a] * r.randint(1, 5) + w[a:]
    return w


def test_word_runs_and_collapse():
    r = random.Random(10)
    some = 0
    for k in range(600):
        w = words_of(r, k)
        want = all_runs(w, 12)
        some += len(want)
        assert runs.word_runs(w) == want
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert runs.collapse(w, want) == [x for i, x in enumerate(w) if i not in gone]
    assert some > 200


def test_runs_query(spark, odd, none, tmp_path):
    r = random.Random(11)
    more = [(i, b" \n".join(words_of(r, i)).decode() + " end\x0b", "en", "s", 0, 0, "", None) for i in range(1000, 1120)]
    table = odd.unionByName(spark.createDataFrame(more, odd.schema)).where("length(text) < 50000 or text is null")
    got = {tuple(x) for x in runs.query(spark, written(table, tmp_path / "a")).collect()}
    want = set()
    for d in table.collect():
        w = (d["text"] or "").encode().split()
        n, h = len(w), crc(d["doc_id"]) if d["doc_id"] is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + int((n - a) / (3 + g % 8))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = all_runs(w, 12)
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
        gone = {i for s, k, q in found for i in range(s + q, s + k)}
        text = b" ".join(x for i, x in enumerate(w) if i not in gone)
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in found)
        want.add((d["doc_id"], len(found), *best, best[1] and 1000 * best[1] // best[2], sha(lines), hashlib.sha256(text).hexdigest()))
    assert got == want
    assert runs.query(spark, written(none, tmp_path / "b")).collect() == []


def test_runs_of_a_long_text_and_texts_returned(spark):
    rows = [("a", "x " * 60_000), ("b", " ".join(str(i % 7000) for i in range(30_000))), (None, None)]
    got = {r["doc_id"]: r for r in runs.find(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert [tuple(x) for x in got["a"]["runs"]] == [(0, 60_000, 1)] and got["a"]["collapsed"] == "x"
    assert [tuple(x) for x in got["b"]["runs"]] == [(0, 30_000, 7000)] and got["b"]["collapsed"].endswith(" 6999")
    assert got[None]["n_words"] == 0 and got[None]["runs"] == [] and got[None]["collapsed"] == ""
    with pytest.raises(ValueError):
        runs.find(spark.createDataFrame(rows, "doc_id string, text string"), min_words=5)
