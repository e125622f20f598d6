"""Progress of tasks as a stream.

:func:`feed` is what a watcher sees: the state of each task at most once in a while, as long
as it changes, and at once when the task is over; whoever asks for a task is told its state, or
that there is none. :func:`latest` is the plain fold of all events, without a clock.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trellis.operators import tasks

FIELDS = ("status", "stage", "pct", "error")
_TYPES = {"status": "string", "stage": "string", "pct": "double", "error": "string"}
FEED = "task_id string, kind string, status string, stage string, pct double, error string, at timestamp, seq long"
# tasks that share a row of state: of each field its value, and when it was set; then the end of the
# run before this one, and the clock
_TASK = ", ".join(f"{f}: {t}, {f}_at: long, {f}_seq: long" for f, t in _TYPES.items()) + ", over_at: long, over_seq: long, emitted: long, changed: boolean, closed: boolean, due: long"
_STATE = f"tasks array<struct<task_id: string, {_TASK}>>"
#: Fixed value: what a watcher of an unknown task is told.
UNKNOWN = "task not found"


def latest(events: DataFrame) -> DataFrame:
    """The same fold as in batch; ``events`` is a stream or a table."""
    return tasks.state(events)


@dataclass
class _Run:
    """What is kept of a task: field -> (value, ts, seq) of its run, and the clock in milliseconds."""

    fields: dict[str, tuple] = field(default_factory=dict)
    over: tuple[int, int] | None = None
    emitted: int = 0
    changed: bool = False
    closed: bool = False
    due: int | None = None

    @classmethod
    def loaded(cls, s: tuple) -> _Run:
        fields = {f: tuple(s[3 * i + 1 : 3 * i + 4]) for i, f in enumerate(FIELDS) if s[3 * i + 1] is not None}
        over_at, over_seq, *clock = s[3 * len(FIELDS) + 1 :]
        return cls(fields, None if over_at is None else (over_at, over_seq), *clock)

    def stored(self, task: str) -> tuple:
        flat = [x for f in FIELDS for x in self.fields.get(f, (None, None, None))]
        return (task, *flat, *(self.over or (None, None)), self.emitted, self.changed, self.closed, self.due)

    def advance(self, task: str, rows: list[tuple], now: int, every_ms: int) -> list[tuple]:
        """Lines of the events (ts, seq, the fields) that are not from before the end of the last run."""
        rows = [r for r in rows if self.over is None or r[:2] > self.over]
        if not rows:
            return []
        if not self.closed:  # stored fields count as events that had just come
            rows = [(*self.fields[f][1:], *[self.fields[f][0] if f == g else None for g in FIELDS]) for f in FIELDS if f in self.fields] + rows
        rows.sort(key=lambda r: r[:2])
        out, part, more = [], {}, False
        for ts, seq, *values in rows:
            for f, v in zip(FIELDS, values, strict=True):
                if v is not None and v == v:
                    part[f] = (v, ts, seq)
            more = values[0] not in tasks.TERMINAL
            if not more:
                self.fields, self.over, self.emitted, self.changed, self.closed = part, (ts, seq), now, False, True
                out.append(_line(task, "closed", part))
                part = {}
        if more:
            self.fields, self.closed = part, False
            if now - self.emitted >= every_ms:
                self.emitted, self.changed = now, False
                out.append(_line(task, "progress", part))
            else:
                self.changed = True
        return out


def _line(task: str, kind: str, fields: dict, error: str | None = None) -> tuple:
    at, seq = max((x[1:] for x in fields.values()), default=(None, None))
    return (task, kind, *[fields[f][0] if f in fields else None for f in FIELDS[:-1]], fields["error"][0] if "error" in fields else error, at, seq)


def feed(events: DataFrame, asks: DataFrame | None = None, every_ms: int = 1000, remember_ms: int = 3_600_000, buckets: int = 1024) -> DataFrame:
    """A stream of (task_id, kind, status, stage, pct, error, at, seq) from the stream ``events``
    (task_id, ts, seq, status, stage, pct, error) and the stream ``asks`` (task_id):

    * ``progress``: the state of a task that changed, at most once in ``every_ms`` of processing
      time; what changes in between is held back until a timer is due;
    * ``closed``: its last state, as soon as it is over. Then its state goes but for this row,
      which is kept for ``remember_ms``; a later event starts a new run of the task from nothing;
    * ``answer``: the state of a task that was asked for; ``error``: there is none.

    Fields change in the order of (ts, seq), whatever the order they come in: an older event fills
    only what no newer one has set, and one from before the end of the last run is left out. A
    field that an event leaves null stays. Events without a task are ignored. Tasks are dealt over
    ``buckets`` rows of state by a hash, so that a call serves many of them; a micro-batch reads and
    writes the rows of the tasks it has. What is held at once are a row of state and its events in a
    micro-batch, which the source's ``maxFilesPerTrigger`` bounds."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select("task_id", micros.alias("ts"), F.col("seq").cast("long").alias("seq"), *[F.col(f).cast(t).alias(f) for f, t in _TYPES.items()], F.lit(False).alias("ask"))
    if asks is not None:
        nothing = [F.lit(0).cast("long").alias(c) for c in ("ts", "seq")] + [F.lit(None).cast(t).alias(f) for f, t in _TYPES.items()]
        rows = rows.unionByName(asks.select("task_id", *nothing, F.lit(True).alias("ask")))

    def step(_: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = state.getCurrentProcessingTimeMs(), []
        known = {t[0]: _Run.loaded(t) for t in state.get[0]} if state.exists else {}
        new: dict[str, list[tuple]] = {}
        asked: dict[str, None] = {}
        for c in () if state.hasTimedOut else chunks:
            for task, ask, *row in zip(*[c[x].tolist() for x in ("task_id", "ask", "ts", "seq", *FIELDS)], strict=True):
                if ask:
                    asked[task] = None
                else:
                    new.setdefault(task, []).append(tuple(row))
        for task, own in new.items():
            out += known.setdefault(task, _Run()).advance(task, own, now, every_ms)
        for task in asked:
            fields = known[task].fields if task in known else {}
            out.append(_line(task, "answer", fields) if fields else _line(task, "error", {}, UNKNOWN))
        for task, run in list(known.items()):
            if task in new or task in asked:
                run.due = now + remember_ms if run.closed else max(now + 1, run.emitted + every_ms) if run.changed else None
            elif run.due is not None and run.due <= now:
                if run.closed:
                    del known[task]
                else:
                    run.emitted, run.changed, run.due = now, False, None
                    out.append(_line(task, "progress", run.fields))
        if known:
            state.update(([run.stored(task) for task, run in known.items()],))
            due = min((run.due for run in known.values() if run.due is not None), default=None)
            if due is not None:
                state.setTimeoutDuration(max(1, due - now))
        elif state.exists:
            state.remove()
        if out:
            yield _table(out)

    raw = FEED.replace("at timestamp", "at long")
    dealt = rows.where("task_id is not null").withColumn("_bucket", F.pmod(F.hash("task_id"), F.lit(buckets)))
    out = dealt.groupBy("_bucket").applyInPandasWithState(step, raw, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    return out.withColumn("at", F.timestamp_micros("at"))


def _table(rows: list[tuple]) -> pd.DataFrame:
    t = pd.DataFrame(rows, columns=["task_id", "kind", *FIELDS, "at", "seq"], dtype=object)
    return t.assign(pct=t["pct"].astype("float64"), seq=t["seq"].astype("Int64"), at=t["at"].astype("Int64"))


def start(out: DataFrame, checkpoint: str, path: str, mode: str = "update", **trigger: object) -> StreamingQuery:
    """Run a stream into one Parquet folder a micro-batch below ``path``, each written again as
    a whole if its batch is retried, so that a restart from ``checkpoint`` repeats nothing. The
    trigger is all there is now unless another is given; a feed has a clock and goes on until it
    is stopped, so it needs one of processing time."""
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}")).start()


def stop_when_idle(query: StreamingQuery, quiet_s: float = 0.0, timeout_s: float = 600.0) -> None:
    """Stop a feed once nothing has come in for ``quiet_s``, so that what its timers hold back
    for no longer is out. Time counts from the start of one micro-batch without input to that of
    another, both after this call, so no batch under way is cut off, however long it takes; and a
    batch that a restart repeats is not taken for a sign that nothing new has come."""
    began = time.time()
    last = idle_since = None
    while query.isActive:
        p = query.lastProgress
        if p and p["timestamp"] != last:
            last = p["timestamp"]
            at = datetime.fromisoformat(last).timestamp()
            if p["numInputRows"] or at < began:
                idle_since = None
            elif idle_since is None:
                idle_since = at
            elif at - idle_since >= quiet_s:
                query.stop()
                return
        if time.time() > began + timeout_s:
            query.stop()
            raise TimeoutError("the stream did not come to rest")
        time.sleep(0.05)
    if query.exception():
        raise query.exception()


def current(changes: DataFrame) -> DataFrame:
    """The latest of the written changes of each task."""
    fields = [c for c in changes.columns if c not in ("task_id", "batch")]
    return changes.groupBy("task_id").agg(F.max(F.struct("batch", *fields)).alias("s")).select("task_id", *[F.col(f"s.{c}").alias(c) for c in fields])
