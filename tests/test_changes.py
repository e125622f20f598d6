"""Feeds of changes, logs in blocks, stages taken up again, and progress as a stream."""

import random
import time

import pytest
from pyspark.sql import functions as F

from trellis import seams
from trellis.functions import scalar as sc
from trellis.operators import access, changes, tasks, timeline
from trellis.sources import ingest, stages
from trellis.streaming import progress


def folded_one_by_one(base, feed):
    """The rules of :mod:`changes`, change by change."""
    rows = {k: dict(v) for k, v in base.items()}
    for _, key, op, own in sorted(feed, key=lambda c: c[0]):
        if key is None:
            continue
        if op == "delete":
            rows.pop(key, None)
        elif key not in rows and op in ("create", "upsert"):
            rows[key] = dict(own)
        elif key in rows and op in ("update", "upsert"):
            rows[key] |= {f: v for f, v in own.items() if v is not None and f != "born"}
    return rows


def test_a_feed_is_applied_as_change_by_change(spark):
    r = random.Random(1)
    for _ in range(3):
        base = {k: {"name": f"n{k}", "role": None, "born": k} for k in range(0, 40, 2)}
        ops = ["create", "update", "update", "delete", "upsert"]
        feed = [(i, r.choice([*range(40), 7, 7, 7, None]), r.choice(ops), {"name": r.choice([None, f"x{i}"]), "role": r.choice([None, "a", "b"]), "born": i}) for i in range(400)]
        table = spark.createDataFrame([(k, *v.values()) for k, v in base.items()], "id long, name string, role string, born long")
        rows = spark.createDataFrame([(k, op, i, *own.values()) for i, k, op, own in feed], "id long, op string, seq long, name string, role string, born long").repartition(7)
        got = {x["id"]: {f: x[f] for f in ("name", "role", "born")} for x in changes.applied(table, rows, "id", ["seq"], ["name", "role", "born"], ("born",)).collect()}
        assert got == folded_one_by_one(base, feed)


def test_users_changed_several_times_are_one_row(spark):
    users = spark.createDataFrame([(1, "a", "viewer", True, 10), (2, "b", "viewer", True, 20)], "user_id long, username string, role string, is_active boolean, created_at long")
    feed = spark.createDataFrame([(1, "update", 1, "admin", None, 99), (1, "update", 2, "analyst", None, 99), (3, "create", 3, "viewer", "c", 5), (3, "update", 4, "admin", None, 6), (3, "delete", 5, None, None, None), (3, "create", 6, "manager", "c2", 7), (9, "update", 7, "admin", None, 1), (2, "delete", 8, None, None, None)], "user_id long, op string, seq long, role string, username string, created_at long")
    got = sorted(tuple(r) for r in access.merge_users(users, feed, ["seq"]).collect())
    assert got == [(1, "a", "analyst", True, 10), (3, "c2", "manager", None, 7)]
    assert access.merge_users(users, feed.limit(0), ["seq"]).count() == 2


def test_client_tasks_new_ones_first(spark):
    known = spark.createDataFrame([("a", 1, "queued", 1.0), ("b", 2, "queued", 1.0)], "task_id string, position long, status string, pct double")
    up = spark.createDataFrame([("b", 1, "update", "running", None), ("b", 2, "update", "running", 7.0), ("x", 3, "update", "running", 1.0), ("c", 4, "upsert", "queued", 0.0), ("d", 5, "upsert", "queued", None), ("c", 6, "update", "running", None), ("a", 7, "cancel", "zz", 5.0)], "task_id string, seq long, op string, status string, pct double")
    out = tasks.merged(known, up, ["status", "pct"]).orderBy(F.col("new_at").desc_nulls_last(), "position").collect()
    assert [(r["task_id"], r["status"], r["pct"]) for r in out] == [("d", "queued", None), ("c", "running", None), ("a", "cancelled", 1.0), ("b", "running", 7.0)]


@pytest.mark.parametrize("block_rows", [1, 7, None])
def test_asof_with_a_hot_key(spark, block_rows):
    r = random.Random(2)
    keys = ["hot"] * 20 + ["a", "b", None]
    events = [(r.choice(keys), r.randrange(60), i) for i in range(200)]
    facts = [(r.choice(keys), r.randrange(60), r.choice(["p", "q", None])) for _ in range(60)]
    got = timeline.asof(spark.createDataFrame(events, "k string, t long, n long"), spark.createDataFrame(facts, "k string, t long, v string"), "k", "t", "v", "was", block_rows)
    for x in got.collect():
        before = [(t, v is not None, v or "", v) for k, t, v in facts if k == x["k"] and k is not None and t <= x["t"]]
        assert x["was"] == (max(before)[3] if before else None)
    assert got.count() == 200


def test_cancelled_work(spark):
    work = spark.createDataFrame([("t", 1, 0), ("t", 2, 1), ("t", 3, 2), ("t", 4, 3), ("u", 9, 4)], "task_id string, ts long, seq long")
    told = spark.createDataFrame([("t", 2, "cancel"), ("t", 4, "submit"), ("t", 4, "cancel"), ("v", 1, "cancel")], "task_id string, ts long, action string")
    got = {r["seq"]: r["dropped"] for r in tasks.cancelled(work, told).collect()}
    assert got == {0: False, 1: True, 2: True, 3: False, 4: False}
    assert tasks.cancelled(work, told.limit(0)).where("dropped").count() == 0


def states_one_by_one(events, restarts):
    out, state, epoch = [], {}, {}
    for task, ts, seq, action in sorted(events, key=lambda e: (e[1], e[2])):
        n = sum(x <= ts for x in restarts)
        s = state.get(task, "")
        if n > epoch.get(task, 0) and s == "running":
            s = "interrupted"
        to = tasks.TRANSITIONS.get((s, action))
        out.append((task, seq, action, s, to or s, to is not None))
        state[task], epoch[task] = to or s, n
    return sorted(out), {t: "interrupted" if s == "running" and len(restarts) > epoch[t] else s for t, s in state.items()}


@pytest.mark.parametrize("block_rows", [3, 40, None])
def test_lifecycle_does_not_depend_on_blocks(spark, block_rows):
    import datetime as dt

    r = random.Random(3)
    at = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)
    actions = ["create", "start", "finish", "fail", "cancel", "requeue", "nonsense"]
    events = [(r.choice(["hot"] * 6 + ["a", "b", "c"]), at(r.randrange(200)), i, r.choice(actions)) for i in range(300)]
    downs = [at(k) for k in (50, 51, 51, 120, 400)]
    ev = spark.createDataFrame(events, "task_id string, ts timestamp_ntz, seq long, action string")
    rs = spark.createDataFrame([(d,) for d in downs], "at timestamp_ntz")
    moves = tasks.lifecycle(ev, rs, block_rows)
    want, end = states_one_by_one(events, downs)
    assert sorted((x["task_id"], x["seq"], x["action"], x["before"], x["after"], x["legal"]) for x in moves.collect()) == want
    assert {x["task_id"]: x["status"] for x in tasks.now(moves, rs).collect()} == end
    assert tasks.lifecycle(ev.limit(0), rs).count() == 0
    assert {x["before"] for x in tasks.lifecycle(ev, rs.limit(0)).collect()}.isdisjoint({"interrupted"})


def test_time_estimate_without_a_sample(spark):
    times = spark.createDataFrame([("a", i, float(i)) for i in range(1, 30)], "task_id string, seq long, seconds double")
    known = spark.createDataFrame([("a", 40), ("b", 4), ("c", 0)], "task_id string, total long")
    ema = 1.0
    for i in range(2, 30):
        ema = 0.3 * i + 0.7 * ema
    for rows in (4, None):
        got = {r["task_id"]: r for r in tasks.eta(times, known, block_rows=rows).collect()}
        assert got["a"]["ema"] == pytest.approx(ema) and got["a"]["eta_seconds"] == pytest.approx(11 * ema)
        assert (got["b"]["done"], got["b"]["eta_seconds"], got["c"]["eta_seconds"]) == (0, 60.0, 0.0)


# Trees


def test_trees_of_any_depth_survive(spark, tmp_path):
    rows = [("a b/c+d%", i, (i - 1) % 120 + 1 if i else 0, f"{i:04d}", f'T "{i}"', "x}\n]" if i % 2 else "", [0.5] if i % 3 == 0 else None) for i in range(500)]
    rows += [("only", 0, 0, "0000", "D", "", None)]
    n = spark.createDataFrame(rows, "tree_id string, ord int, depth int, node_id string, title string, content string, embedding array<float>").withColumn("summary", F.lit(None).cast("string"))
    ingest.write_trees(n, str(tmp_path / "t"), embedding=True)
    (tmp_path / "t" / "broken.json").write_text('{"title": "x", "nodes": [{]}')
    (tmp_path / "t" / "100%.json").write_text('[{"title": "no object"}]')
    got = sorted((r["tree_id"], r["ord"], r["depth"], r["node_id"], r["title"], r["content"], r["embedding"]) for r in ingest.read_trees(spark, str(tmp_path / "t")).collect())
    assert got == sorted(rows)
    parents = {(r["tree_id"], r["node_id"]): r["parent_id"] for r in ingest.walk(ingest.nested_json(n)).collect()}
    assert parents["a b/c+d%", "0120"] == "0119" and parents["a b/c+d%", "0121"] == "0000" and parents["only", "0000"] is None


# Stages


NODES = "tree_id string, node_id string, ord int, parent_id string, depth int, title string, content string"


def tree(texts):
    return [("t", "0000", 0, None, 0, "D", ""), ("t", "0001", 1, "0000", 1, "A", texts[0]), ("t", "0002", 2, "0001", 2, "B", texts[1]), ("t", "0003", 3, "0000", 1, "C", texts[2])]


def test_a_stage_redoes_only_what_changed(spark, tmp_path):
    run = lambda rows, f=seams.extractive_summary: {r["node_id"]: (r["summary"], r["redone"]) for r in stages.summaries(spark, str(tmp_path), spark.createDataFrame(rows, NODES), f).collect()}
    long = "a text that is long enough to be summarised"
    first = run(tree([long, long + " b", long + " c"]))
    assert all(x[1] for x in first.values())
    again = run(tree([long, long + " b", long + " c"]))
    assert {k: v[0] for k, v in again.items()} == {k: v[0] for k, v in first.items()} and not any(x[1] for x in again.values())
    changed = run(tree([long, long + " b", long + " d"]))
    assert {k for k, v in changed.items() if v[1]} == {"0000", "0003"}
    assert run(tree([long, long + " b", long + " c"]))["0003"][1] is True


def test_a_killed_run_is_taken_up(spark, tmp_path):
    long = "a text that is long enough to be summarised"
    rows = spark.createDataFrame(tree([long, long + " b", long + " c"]), NODES)
    calls = []

    def dies(title, text):
        calls.append(1)
        return F.when(title == "A", F.raise_error(F.lit("killed"))).otherwise(seams.extractive_summary(title, text))

    with pytest.raises(Exception, match="killed"):
        stages.summaries(spark, str(tmp_path), rows, dies)
    got = {r["node_id"]: r["redone"] for r in stages.summaries(spark, str(tmp_path), rows, seams.extractive_summary).collect()}
    assert got == {"0000": True, "0001": True, "0002": False, "0003": True}  # the deepest level was committed


def test_images_are_there_once(spark, tmp_path):
    files = lambda *x: spark.createDataFrame([(d, c) for d, c in x], "doc_id string, content binary")
    extract = lambda f: ingest.extract_images(f, lambda c: [(1, i, bytes([b])) for i, b in enumerate(c)])
    see = lambda f: sorted((r["doc_id"], r["page"], r["idx"], r["redone"]) for r in stages.image_rows(spark, str(tmp_path), f, extract).collect())
    assert see(files(("a", b"xy"), ("b", b""))) == [("a", 1, 0, True), ("a", 1, 1, True)]
    assert see(files(("a", b"xy"), ("b", b"z"), ("c", b"w"))) == [("a", 1, 0, False), ("a", 1, 1, False), ("b", 1, 0, True), ("c", 1, 0, True)]
    assert see(files(("a", b"xy"), ("b", b"z"), ("c", b"w"))) == [("a", 1, 0, False), ("a", 1, 1, False), ("b", 1, 0, False), ("c", 1, 0, False)]


# Audit log and citations


def test_audit_tail_by_place_in_the_log(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    log = spark.range(60).select(F.lit(None).cast("timestamp_ntz").alias("ts"), (F.col("id") % 2).cast("string").alias("user_id"), F.lit("x").alias("action"), F.lit("d").alias("detail"), F.col("id").alias("seq"))
    ingest.append_audit(log.where("seq >= 30"), path)
    (next((tmp_path / "log").glob("batch=*")) / "zz.json").write_text('{"seq": 99\n[1]\n5\n\n')
    ingest.append_audit(log.where("seq < 30"), path)
    assert [r["seq"] for r in ingest.audit_tail(spark, path, 3).collect()] == [29, 28, 27]  # the last append, not the largest number
    assert [r["seq"] for r in ingest.audit_tail(spark, path, 20, "1").collect()] == [*range(29, 0, -2), *range(59, 49, -2)]
    assert ingest.audit_tail(spark, path, 1000).count() == 60 and ingest.audit_tail(spark, path, 5, "zz").count() == 0


def test_citation_files_stay_in_the_folder(spark, tmp_path):
    good, other = "a" * 32, "b" * 31 + "1"
    ids = spark.createDataFrame([(good,), (good,), (other,), ("A" * 32,), ("../x",), ("1" * 32,), (None,)], "id string")
    files = spark.createDataFrame([(f"file:{tmp_path}/{good}.pdf",), (f"file:///{str(tmp_path)[1:]}/{good}.md",), (f"{tmp_path}/deep/{other}.pdf",), (f"/elsewhere/{other}.pdf",), (f"{tmp_path}/{other}",)], "path string")
    assert [tuple(r) for r in ingest.find_documents(ids, files, f"file://{tmp_path}").collect()] == [(good, f"{tmp_path}/{good}.md")]


def test_highlight_by_each_rows_terms(spark):
    rows = [("The cat, the catalogue.", ["the", "cat", "catalogue", None, ""]), ("a.b axb a|b", ["a.b", "A|B"]), ("x", []), ("x", None), (None, ["x"]), ("aa", ["a"]), ("no", ["zz"])]
    got = [r["h"] and [tuple(x) for x in r["h"]] for r in spark.createDataFrame(rows, "t string, terms array<string>").select(sc.highlight(F.col("t"), F.col("terms")).alias("h")).collect()]
    assert got[0] == [("", False), ("The", True), (" ", False), ("cat", True), (", ", False), ("the", True), (" ", False), ("catalogue", True), (".", False)]
    assert got[1] == [("", False), ("a.b", True), (" axb ", False), ("a|b", True), ("", False)]
    assert got[2] == got[3] == [("x", False)] and got[4] is None and got[6] == [("no", False)]
    assert got[5] == [("", False), ("a", True), ("", False), ("a", True), ("", False)]


def test_highlight_whatever_the_alphabet(spark):
    rows = [("Öl. und öl.", ["öl."]), ("ΣΑΣ σας", ["Σας"]), ("STRAẞE straße", ["straße"]), ("Iı iİ", ["i"]), ("ıI", ["ı"])]
    got = [[x["text"] for x in r["h"] if x["highlight"]] for r in spark.createDataFrame(rows, "t string, terms array<string>").select(sc.highlight(F.col("t"), F.col("terms")).alias("h")).collect()]
    assert got == [["Öl.", "öl."], ["ΣΑΣ", "σας"], ["STRAẞE", "straße"], ["I", "i"], ["ı"]]


# Progress


EVENT = "task_id string, ts timestamp, seq long, status string, stage string, pct double, error string"


def test_feed_holds_back_closes_and_restarts(spark, tmp_path):
    import datetime as dt

    at = lambda k: dt.datetime(2024, 1, 1, 0, 0, k)
    put = lambda *rows: spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ask = lambda *ids: spark.createDataFrame([(i,) for i in ids], "task_id string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/asks")
    feed = lambda: progress.feed(spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in"), spark.readStream.schema("task_id string").parquet(f"{tmp_path}/asks"), every_ms=8000)
    go = lambda: progress.start(feed(), f"{tmp_path}/check", f"{tmp_path}/out", "append", processingTime="300 milliseconds")
    seen = lambda: sorted((r["batch"], r["task_id"], r["kind"], r["stage"] or "", r["pct"] or 0.0) for r in spark.read.schema(progress.FEED + ", batch long").option("basePath", f"{tmp_path}/out").parquet(f"{tmp_path}/out").collect())
    put(("a", at(1), 1, "running", "one", 1.0, None), ("b", at(1), 2, "running", "x", None, None), (None, at(1), 3, "done", None, None, None))
    ask("zz")
    q = go()
    began = time.time()
    while not (q.lastProgress and q.lastProgress["batchId"] >= 1):
        time.sleep(0.1)
    put(("a", at(2), 4, None, "two", 2.0, None), ("b", at(5), 5, "done", None, 100.0, None), ("b", at(3), 6, None, "late", None, None))
    put(("a", at(3), 7, None, "three", None, None))
    progress.stop_when_idle(q, 0.5)
    first = seen()
    if time.time() - began < 8:  # unless the machine was too slow: what changed since is held back
        assert [x[1:] for x in first if x[1] == "a"] == [("a", "progress", "one", 1.0)]
    assert [x[1:] for x in first if x[1] == "b"] == [("b", "progress", "x", 0.0), ("b", "closed", "late", 100.0)]
    assert [x[2] for x in first if x[1] == "zz"] == ["error"]
    put(("b", at(4), 8, "running", "before its end", None, None), ("b", at(9), 9, "queued", "anew", None, None))
    ask("a", "b")
    progress.stop_when_idle(go(), 9.0)
    last = seen()
    assert last[: len(first)] == first  # a restart repeats nothing
    assert [x[1:] for x in last if x[1] == "a" and x[2] == "progress"][-1] == ("a", "progress", "three", 2.0)
    assert sum(x[1] == "a" and x[2] == "progress" for x in last) == 2
    assert [x[1:] for x in last if x[2] == "answer"] == [("a", "answer", "three", 2.0), ("b", "answer", "anew", 0.0)]


def test_feed_serves_many_tasks_in_a_call(spark, tmp_path):
    """Asks and events of 300 tasks meet in few rows of state, each task for itself."""
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    rows = [(f"t{i}", at + dt.timedelta(seconds=k), 10 * i + k, s, f"s{k}", float(k) if k < 2 else None, None) for i in range(300) for k, s in enumerate(["queued", "running", "done" if i % 3 == 0 else "running", None][: 3 + (i % 2)])]
    spark.createDataFrame(rows, EVENT).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(f"t{i}",) for i in range(600)], "task_id string").write.parquet(f"{tmp_path}/asks")
    feed = progress.feed(spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in"), spark.readStream.schema("task_id string").parquet(f"{tmp_path}/asks"), buckets=4)
    q = progress.start(feed, f"{tmp_path}/check", f"{tmp_path}/out", "append", processingTime="300 milliseconds")
    progress.stop_when_idle(q)
    assert 0 < q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
    got = spark.read.schema(progress.FEED).parquet(f"{tmp_path}/out").collect()
    assert sorted(r["task_id"] for r in got if r["kind"] == "closed") == sorted(f"t{i}" for i in range(0, 300, 3))
    assert {r["task_id"]: (r["error"], r["status"], r["stage"], r["pct"], r["seq"]) for r in got if r["kind"] in ("answer", "error")} == {
        f"t{i}": (progress.UNKNOWN, None, None, None, None) if i >= 300 else (None, None, "s3", None, 10 * i + 3) if i % 6 == 3 else (None, "done" if i % 3 == 0 else "running", f"s{2 + i % 2}", 1.0, 10 * i + 2 + i % 2) for i in range(600)
    }


def test_plain_fold_as_a_stream(spark, tmp_path):
    import datetime as dt

    rows = [("a", dt.datetime(2024, 1, 1), i, "running", f"s{i}", float(i), None) for i in range(5)]
    spark.createDataFrame(rows, EVENT).write.parquet(f"{tmp_path}/in")
    out = progress.latest(spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in"))
    progress.start(out, f"{tmp_path}/check", f"{tmp_path}/out").awaitTermination()
    (r,) = progress.current(spark.read.parquet(f"{tmp_path}/out")).collect()
    assert (r["task_id"], r["stage"], r["pct"]) == ("a", "s4", 4.0)
