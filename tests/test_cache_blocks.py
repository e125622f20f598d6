"""Replay of the cache in blocks, against a plain pass, and its spread over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from trellis.operators import cache, tasks

LOG = "cache string, cache_key string, at long, seq long"


def plain(rows, size, ttl):
    """(cache, key, seq) -> hit, by one ordered pass; a request without a time is a miss."""
    caches, out = {}, {}
    for c, k, at, seq in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[3])):
        own = caches.setdefault(c, {})
        t = own.pop(k, None)
        hit = t is not None and at is not None and at - t < ttl
        own[k] = t if hit else at
        if len(own) > size:
            own.pop(next(iter(own)))
        out[c, seq] = hit
    return out


def log(seed, n=700, keys=12, span=400):
    r = random.Random(seed)
    rows = [(r.choice("ab"), "hot" if r.random() < 0.4 else f"k{r.randrange(keys)}", r.randrange(span), i) for i in range(n)]
    return rows + [("a", "hot", None, n), ("b", None, 3, n + 1), ("b", None, 5, n + 2), (None, "hot", 5, n + 3), (None, "hot", 6, n + 4)]


@pytest.mark.parametrize(("seed", "size", "ttl"), [(1, 4, 50), (2, 6, 7), (3, 100, 120), (4, 1, 1000), (5, 5, 0)])
def test_lru_is_the_plain_pass(spark, seed, size, ttl):
    rows = log(seed)
    got = cache.replay_lru(spark.createDataFrame(rows, LOG), size=size, ttl=ttl).collect()
    assert {(r["cache"], r["seq"]): r["hit"] for r in got} == plain(rows, size, ttl) and len(got) == len(rows)


@pytest.mark.parametrize(("seed", "ttl"), [(1, 50), (2, 7), (3, 1000), (4, 0)])
def test_ttl_is_the_plain_pass(spark, seed, ttl):
    rows = [("a", *r[1:]) for r in log(seed)]
    got = cache.replay_ttl(spark.createDataFrame(rows, LOG), ttl=ttl).collect()
    assert {("a", r["seq"]): r["hit"] for r in got} == plain(rows, 1000, ttl) and len(got) == len(rows)


def test_no_log(spark):
    none = spark.createDataFrame([], LOG)
    assert cache.replay_ttl(none).count() == cache.replay_lru(none).count() == 0


def test_a_hot_key_is_cut_into_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cache, "folder", lambda s, label: f"file://{tmp_path}/{label}")
    rows = [("all", "hot", i, i) for i in range(4000)]
    assert cache.replay_lru(spark.createDataFrame(rows, LOG), ttl=100).where("not hit").count() == 40
    for label in ("cache-lru", "cache-ttl"):
        sizes = [r["count"] for r in spark.read.parquet(f"{tmp_path}/{label}").groupBy("block").count().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 2000


def test_the_times_of_a_long_task_are_cut_into_blocks(spark, monkeypatch):
    r = random.Random(6)
    rows = [("long" if i % 3 else f"t{i % 7}", i, r.random() * 9) for i in range(3000)]
    want = {}
    for task, _, x in rows:
        n, s = want.get(task, (0, x))
        want[task] = (n + 1, 0.3 * x + 0.7 * s)
    sizes, collect = [], F.collect_list
    monkeypatch.setattr(F, "collect_list", lambda c: sizes.append(1) or collect(c))
    known = spark.createDataFrame([(k, 5000) for k in want], "task_id string, total long")
    got = tasks.eta(spark.createDataFrame(rows, "task_id string, seq long, seconds double"), known, alpha=0.3, block_rows=400).collect()
    assert {t["task_id"]: t["done"] for t in got} == {k: n for k, (n, _) in want.items()}
    assert all(t["ema"] == pytest.approx(want[t["task_id"]][1]) and t["eta_seconds"] == pytest.approx((5000 - t["done"]) * t["ema"]) for t in got)
    assert len(sizes) == 2  # the times of a block, and the blocks of a task
