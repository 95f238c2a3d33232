"""The state of every job as a stream of its events: queued, running, succeeded, failed.

A job's row is written as the runner writes it: queueing sets the status and the time of
creation, starting sets running, the start and no error, finishing sets succeeded
or failed by the exit code, the end, the code and its error. Each field holds what the
latest event says that sets it, by the event's own time and then its number, so
states merge: events may come late, twice, or in any micro-batches, and the row is
the same. A job that has run longer than ``limit`` when the watermark passes is
shown as failed for want of a result; a timer tells it. The event that ends it may
still come, and wins.

State is kept by slots, a hash of the job: a call of Python costs as much as thousands
of merged events, and there may be a job an event. A slot holds its jobs as one Arrow
batch, read and written when one of them has news. ``slots`` should grow with the jobs,
a few thousand to a slot, and stays what it is as long as the checkpoint lives.

``rows`` appends a row with the next version whenever a job has news; ``latest`` keeps
each job's last. ``fold`` says the same of a table of events at once.

Defined results: events of unknown kinds, and those without a job, a time or a number,
are left out; an event later than the watermark's delay is dropped by Spark, so the
delay must cover what is to count; a job whose start never came has no start; an exit
code of null is a failure with code -1.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KINDS = ("queue", "start", "finish")
EVENT = "job_id string, event_id long, ts timestamp, kind string, code int"
FIELDS = ("created", "last_ts", "last_id", "last_kind", "last_code", "started", "started_id", "finished", "finished_id", "code")
#: The watermark that a slot has seen, in microseconds, and its jobs.
STATE = "seen long, jobs binary"
HELD = pa.schema([("job_id", pa.string()), *((f, pa.int64()) for f in ("version", *FIELDS))])
ROW = "job_id string, version long, status string, created_at timestamp, started_at timestamp, finished_at timestamp, returncode int, error string"

COLUMNS = [c.split()[0] for c in ROW.split(", ")]

#: What an error says of a job that ended with a code (fixed value), and of one that did not end.
ENDED, OVERDUE = "Pipeline exited with code ", "No result in time"


def proper(events: DataFrame) -> DataFrame:
    """Events as the machine takes them: their time in microseconds, the exit code a number."""
    known = events.where(F.col("kind").isin(*KINDS) & F.col("job_id").isNotNull() & F.col("ts").isNotNull() & F.col("event_id").isNotNull())
    return known.select("job_id", "event_id", "ts", "kind", F.coalesce("code", F.lit(-1)).alias("code"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def merged(state: dict[str, Any], ts: int, event_id: int, kind: int, code: int) -> None:
    """Let one event set what it is the latest to set; taking it twice changes nothing."""
    later = lambda at, number: state[at] is None or (ts, event_id) > (state[at], state[number])
    if kind == 0 and (state["created"] is None or ts < state["created"]):
        state["created"] = ts
    if later("last_ts", "last_id"):
        state.update(last_ts=ts, last_id=event_id, last_kind=kind, last_code=code)
    if kind == 1 and later("started", "started_id"):
        state.update(started=ts, started_id=event_id)
    if kind == 2 and later("finished", "finished_id"):
        state.update(finished=ts, finished_id=event_id, code=code)


def _shown(job_id: str, state: dict[str, Any], now: int, limit: int) -> tuple:
    overdue = state["last_kind"] == 1 and now >= state["started"] + limit
    failed = state["last_kind"] == 2 and state["last_code"] != 0
    status = "failed" if overdue or failed else ("queued", "running", "succeeded")[state["last_kind"]]
    error = OVERDUE if overdue else f"{ENDED}{state['last_code']}" if failed else None
    return job_id, state["version"], status, state["created"], state["started"], state["finished"], state["code"], error


def _frame(shown: list[tuple]) -> pd.DataFrame:
    columns = dict(zip(COLUMNS, zip(*shown, strict=True), strict=True))
    moment = lambda c: pa.array(c, pa.timestamp("us", "UTC")).to_pandas()
    return pd.DataFrame({n: moment(c) if n.endswith("_at") else pd.Series(c, dtype=object) for n, c in columns.items()})


def _packed(held: dict[str, tuple]) -> bytes:
    columns = [list(held), *zip(*held.values(), strict=True)]
    batch = pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, HELD, strict=True)], schema=HELD)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, HELD) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> dict[str, tuple]:
    ids, *columns = (c.to_pylist() for c in pa.ipc.open_stream(packed).read_all().columns)
    return dict(zip(ids, zip(*columns, strict=True), strict=True))


def rows(events: DataFrame, limit_s: int, delay_s: int, slots: int = 1_024) -> DataFrame:
    """A stream of ``ROW`` from a stream of ``EVENT``."""
    limit = limit_s * 1_000_000
    names = ("version", *FIELDS)
    kind_at, start_at = names.index("last_kind"), names.index("started")
    fresh = (0, *[None] * len(FIELDS))

    def step(key: tuple, parts: Iterator[pd.DataFrame], slot: GroupState) -> Iterator[pd.DataFrame]:
        seen, packed = slot.get if slot.exists else (0, None)
        held = _unpacked(packed) if packed else {}
        news: dict[str, dict[str, Any]] = {}
        for part in parts:
            for job_id, *event in zip(*(part[c].tolist() for c in ("job_id", "us", "event_id", "kind", "code")), strict=True):
                if job_id not in news:
                    news[job_id] = dict(zip(names, held.get(job_id, fresh), strict=True))
                merged(news[job_id], *event)
        now = slot.getCurrentWatermarkMs() * 1000
        for job_id, state in held.items():  # that became overdue since the slot was last met
            if state[kind_at] == 1 and seen < state[start_at] + limit <= now and job_id not in news:
                news[job_id] = dict(zip(names, state, strict=True))
        for job_id, state in news.items():
            state["version"] += 1
            held[job_id] = tuple(state.values())
        slot.update((now, _packed(held)))
        due = min((state[start_at] + limit for state in held.values() if state[kind_at] == 1 and state[start_at] + limit > now), default=None)
        if due is not None:  # a timer goes off when the watermark is beyond it
            slot.setTimeoutTimestamp(max(-(-due // 1000) - 1, 1))
        if news:
            yield _frame([_shown(job_id, state, now, limit) for job_id, state in news.items()])

    timed = proper(events).withWatermark("ts", f"{delay_s} seconds")
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    dealt = timed.withColumn("kind", number).withColumn("slot", F.pmod(F.xxhash64("job_id"), F.lit(slots)))
    return dealt.groupBy("slot").applyInPandasWithState(step, ROW, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def latest(shown: DataFrame) -> DataFrame:
    """Of the appended rows each job's last."""
    return shown.groupBy("job_id").agg(F.max_by(F.struct(*[c for c in shown.columns if c != "job_id"]), "version").alias("row")).select("job_id", "row.*")


def fold(events: DataFrame, limit_s: int, now: Column) -> DataFrame:
    """The same rows (without version) of a table of events, seen at ``now``."""
    stamp = F.struct("ts", "event_id", "kind", "code")
    of = lambda kind: F.max(F.when(F.col("kind") == kind, stamp))
    folded = proper(events).groupBy("job_id").agg(
        F.min(F.when(F.col("kind") == "queue", F.col("ts"))).alias("created_at"), F.max(stamp).alias("last"), of("start").alias("start"), of("finish").alias("finish")
    )
    running, ended = F.col("last.kind") == "start", F.col("last.kind") == "finish"
    overdue = running & (now >= F.col("start.ts") + F.make_interval(secs=F.lit(limit_s)))
    failed = ended & (F.col("last.code") != 0)
    status = F.when(overdue | failed, "failed").when(ended, "succeeded").when(running, "running").otherwise("queued")
    error = F.when(overdue, OVERDUE).when(failed, F.concat(F.lit(ENDED), F.col("last.code")))
    return folded.select(
        "job_id", status.alias("status"), "created_at", F.col("start.ts").alias("started_at"), F.col("finish.ts").alias("finished_at"), F.col("finish.code").alias("returncode"), error.alias("error")
    )
