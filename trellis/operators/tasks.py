"""Ingestion tasks: state from events, life cycle, resumption and time estimates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellis.operators import changes, timeline
from trellis.schema import CONFIG
from trellis.sources.scratch import keep

#: States in which a task is over.
TERMINAL = ("done", "failed", "cancelled")


def state(events: DataFrame, fields: tuple[str, ...] = ("status", "stage", "pct", "error")) -> DataFrame:
    """Latest value of each field of each task; an event without a field leaves the old one.
    Order is that of (ts, seq). A maximum is combined before the shuffle, so a task with a
    third of all events is one row from each map task."""
    latest = [F.max(F.when(F.col(f).isNotNull(), F.struct("ts", "seq", f)))[f].alias(f) for f in fields]
    return events.groupBy("task_id").agg(*latest, F.max("ts").alias("updated_at"))


def monotone_pct(events: DataFrame) -> DataFrame:
    """Highest percentage so far of each task: progress never goes back."""
    return events.groupBy("task_id").agg(F.max("pct").alias("pct"))


def active(tasks: DataFrame) -> DataFrame:
    return tasks.where(~F.col("status").isin(*TERMINAL))


#: What an action makes of a state ("" before the first); any other is illegal.
TRANSITIONS = {
    ("", "create"): "queued",
    ("queued", "start"): "running",
    ("running", "finish"): "done",
    ("running", "fail"): "failed",
    ("queued", "cancel"): "cancelled",
    ("running", "cancel"): "cancelled",
    ("interrupted", "cancel"): "cancelled",
    ("running", "restart"): "interrupted",
    ("interrupted", "requeue"): "queued",
    ("failed", "requeue"): "queued",
}
STATES = ("", "queued", "running", "interrupted", "done", "failed", "cancelled")
#: States from which a task can go on.
RESUMABLE = ("queued", "interrupted", "failed")


def with_epoch(events: DataFrame, restarts: DataFrame) -> DataFrame:
    """``epoch``: the number of restarts (at) at or before each event's ts. Restarts are counted
    day by day in a calendar, which is broadcast: a row a day."""
    days = restarts.where("at is not null").groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("at")).alias("own"))
    start, end, total = days.agg(F.min("day"), F.max("day"), F.sum("n")).first()
    if not total:
        return events.withColumn("epoch", F.lit(0).cast("long"))
    every = events.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))).alias("day"))
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    calendar = every.join(days, "day", "left").select("day", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), "own")
    both = events.withColumn("day", F.to_date("ts")).join(F.broadcast(calendar), "day", "left")
    here = F.when(F.col("own").isNotNull(), F.size(F.filter("own", lambda x: x <= F.col("ts")))).otherwise(0)
    epoch = F.when(F.col("before").isNotNull(), F.col("before") + here).when(F.col("day") > F.lit(end), F.lit(total)).otherwise(0)
    return both.withColumn("epoch", epoch.cast("long")).drop("day", "before", "own")


def _move(state: str, epoch: int, now: int, action: str | None) -> tuple[str, bool]:
    """The state after the restarts up to ``now`` and an action, and whether it is legal."""
    if now > epoch:
        state = TRANSITIONS.get((state, "restart"), state)
    to = TRANSITIONS.get((state, action))
    return (state, False) if to is None else (to, True)


def lifecycle(events: DataFrame, restarts: DataFrame, block_rows: int | None = None) -> DataFrame:
    """(task_id, ts, seq, action, before, after, legal): each task's states in the order of
    (ts, seq). An action that the state does not allow leaves it as it is and is reported. At a
    restart (a row of ``restarts``: at), which comes before what happens at the same time, running
    tasks are interrupted. A block of the log makes of each state some state; these maps are
    chained for the tasks that cross a border, and then all blocks are replayed side by side,
    so the rows do not depend on how the log is cut. Events without a task or time are ignored."""
    own = with_epoch(events.where("task_id is not null and ts is not null").select("task_id", "ts", "seq", "action"), restarts)
    rows = timeline.blocked(own, "task_id", ["ts", "seq", "action"], block_rows)
    order = ["task_id", "ts", "seq", "action"]

    def summary(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(order, kind="stable")
        out = []
        edge = {b["task_id"].iloc[0], b["task_id"].iloc[-1]}  # all others begin and end in the block
        for task, part in b[b["task_id"].isin(edge)].groupby("task_id"):
            states, epoch = list(STATES), int(part["epoch"].iloc[0])
            for now, action in zip(part["epoch"], part["action"], strict=True):
                states = [_move(s, epoch, now, action)[0] for s in states]
                epoch = now
            out.append((task, int(b["block"].iloc[0]), int(part["epoch"].iloc[0]), int(epoch), states))
        return pd.DataFrame(out, columns=["task_id", "block", "first", "last", "states"])

    def chain(t: pd.DataFrame) -> pd.DataFrame:
        state, epoch, out = "", 0, []
        for task, block, first, last, states in t.sort_values("block")[["task_id", "block", "first", "last", "states"]].itertuples(index=False):
            out.append((task, block, state, epoch))
            state = states[STATES.index(_move(state, epoch, first, None)[0])]
            epoch = last
        return pd.DataFrame(out, columns=["task_id", "block", "state", "epoch"])

    def replay(_: tuple, b: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(order, kind="stable")
        known = {t: (s, e) for t, s, e in zip(entry["task_id"], entry["state"], entry["epoch"], strict=True)}
        before, after, legal, task, state, epoch = [], [], [], None, "", 0
        for t, now, action in zip(b["task_id"], b["epoch"], b["action"], strict=True):
            if t != task:
                task, (state, epoch) = t, known.get(t, ("", 0))
            before.append(_move(state, epoch, now, None)[0])
            state, ok = _move(state, epoch, now, action)
            epoch = now
            after.append(state)
            legal.append(ok)
        return b.assign(before=before, after=after, legal=legal)[[*order, "before", "after", "legal", "epoch"]]

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    head = ", ".join(f"{c} {kind[c]}" for c in order)
    ends = rows.groupBy("block").applyInPandas(summary, f"task_id {kind['task_id']}, block int, first long, last long, states array<string>")
    entries = keep(ends.groupBy("task_id").applyInPandas(chain, f"task_id {kind['task_id']}, block int, state string, epoch long"), "timeline-entries")
    return rows.groupBy("block").cogroup(entries.groupBy("block")).applyInPandas(replay, f"{head}, before string, after string, legal boolean, epoch long")


def now(moves: DataFrame, restarts: DataFrame) -> DataFrame:
    """(task_id, status, resumable) after all events and restarts of a :func:`lifecycle`."""
    last = moves.groupBy("task_id").agg(F.max_by(F.struct("after", "epoch"), F.struct("ts", "seq", "action")).alias("x"))
    total = restarts.agg(F.count("at")).first()[0]
    status = F.when((F.col("x.after") == "running") & (F.lit(total) > F.col("x.epoch")), "interrupted").otherwise(F.col("x.after"))
    return last.select("task_id", status.alias("status")).withColumn("resumable", F.col("status").isin(*RESUMABLE))


def cancelled(work: DataFrame, controls: DataFrame, block_rows: int | None = None) -> DataFrame:
    """``work`` (task_id, ts, ...) with ``dropped``: whether the task's last control (task_id, ts,
    action: submit or cancel) at or before it is a cancel. What was done before stays; what a
    cancelled task does until it is submitted again is dropped. Of both at one time the
    submit counts."""
    told = controls.where(F.col("action").isin("submit", "cancel"))
    return timeline.asof(work, told, "task_id", "ts", "action", "_told", block_rows).withColumn("dropped", F.coalesce(F.col("_told") == "cancel", F.lit(False))).drop("_told")


def after_restart(tasks: DataFrame) -> DataFrame:
    """Tasks as a restart finds them: running ones were interrupted and can be resumed."""
    status = F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status"))
    return tasks.withColumn("status", status).withColumn("resumable", F.col("status").isin(*RESUMABLE))


def unfinished(nodes: DataFrame, done: DataFrame) -> DataFrame:
    """Nodes of a stage that still have to be worked on."""
    return nodes.join(done.select("tree_id", "node_id"), ["tree_id", "node_id"], "left_anti")


def eta(times: DataFrame, known: DataFrame, alpha: float = CONFIG.eta_alpha, prior_s: float = CONFIG.eta_prior_s, block_rows: int | None = None) -> DataFrame:
    """(task_id, done, ema, eta_seconds) of the tasks ``known`` (task_id, total), from their
    (task_id, seq, seconds): an exponential moving average that starts with the first time, or
    ``prior_s`` where there is none, times what remains. A run of times maps an average s to
    a s + b, and such maps follow on each other, so the times are cut into blocks of about as many
    rows each, whatever the tasks, and a task is folded over its blocks."""
    rows = timeline.blocked(times.select("task_id", "seq", "seconds").where("task_id is not null and seconds is not null"), "task_id", ["seq", "seconds"], block_rows)
    lists = rows.groupBy("task_id", "block").agg(F.sort_array(F.collect_list(F.struct("seq", "seconds"))).alias("t"))
    b = F.aggregate("t", F.lit(0.0), lambda s, x: alpha * x["seconds"] + (1 - alpha) * s)
    maps = lists.select("task_id", F.struct("block", F.size("t").alias("n"), F.col("t")[0]["seconds"].alias("first"), F.pow(F.lit(1.0 - alpha), F.size("t")).alias("a"), b.alias("b")).alias("m"))
    folded = maps.groupBy("task_id").agg(F.sort_array(F.collect_list("m")).alias("m"), F.sum("m.n").cast("int").alias("done"))
    ema = F.aggregate("m", F.col("m")[0]["first"], lambda s, x: x["a"] * s + x["b"])
    all_ = known.select("task_id", "total").join(folded.select("task_id", "done", ema.alias("ema")), "task_id", "left")
    done, ema = F.coalesce("done", F.lit(0)), F.coalesce("ema", F.lit(prior_s))
    return all_.select("task_id", done.alias("done"), ema.alias("ema"), (F.greatest(F.col("total") - done, F.lit(0)) * ema).alias("eta_seconds"))


def merged(known: DataFrame, updates: DataFrame, fields: list[str]) -> DataFrame:
    """A client's tasks (task_id, position, fields) after ``updates`` (task_id, seq, op, fields):
    an ``upsert`` brings a whole task, known or not; an ``update`` is one of a stream and counts
    for known tasks only; both write all fields, null too; a ``cancel`` sets the status; a ``delete``
    removes the task. Tasks that came anew have ``new_at`` and go before all others, the latest
    first: order by new_at desc nulls last, position."""
    whole = F.col("op") != "cancel"
    set_ = [F.when(whole, F.struct(F.col(f).alias("v"))).when(F.lit(f == "status"), F.struct(F.lit("cancelled").alias("v"))).alias(f) for f in fields]
    rows = updates.select("task_id", "seq", F.when(whole, F.col("op")).otherwise("update").alias("op"), *set_)
    wrapped = known.select("task_id", *[F.struct(F.col(f).alias("v")).alias(f) for f in fields])
    out = changes.applied(wrapped, rows, "task_id", ["seq"], fields)
    place = out.join(known.select("task_id", "position"), "task_id", "left")
    return place.select("task_id", *[F.col(f"{f}.v").alias(f) for f in fields], F.col("made.seq").alias("new_at"), F.when(F.col("made").isNull(), F.col("position")).alias("position"))
