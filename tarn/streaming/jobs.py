"""A leased job queue and incremental upserts as Structured Streaming.

Parity is the queue: jobs are enqueued once, reserved by priority under a lease, retried with growing delays and failed in the end. The
windowed counts at the end are an extension: the queue has no event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Delays before a retry, in seconds, and the number of attempts.
BACKOFF = (60, 300, 1500)
MOST_ATTEMPTS = 3
STATE = "state string, attempts int, available_at double, lease_until double, worker string"
OUTPUT = "job_id string, event_id long, at double, action string, accepted boolean, state string, attempts int, available_at double, worker string"


def reservable(jobs: DataFrame, now, per: list[str] = (), lapsed=None) -> DataFrame:
    """The job to reserve: waiting and due, or with a lapsed lease (ended before `lapsed`, else before now); highest priority, then oldest, then
    by id; one for each `per`, found by an aggregate, so a long queue is no hot group."""
    due = ((F.col("state") == "pending") & (F.col("available_at") <= now)) | ((F.col("state") == "running") & (F.col("lease_until") < (now if lapsed is None else lapsed)))
    if not per:
        return jobs.where(due).orderBy(F.desc("priority"), F.asc("created_at"), F.asc("job_id")).limit(1)
    rest = [c for c in jobs.columns if c not in per]
    one = jobs.where(due).groupBy(*per).agg(F.min_by(F.struct(*rest), F.struct(-F.col("priority"), "created_at", "job_id")).alias("__j"))
    return one.select(*per, "__j.*").select(*jobs.columns)


def after_failure(attempts) -> tuple:
    """(state, wait): what a failed attempt leads to, attempts counted with it."""
    delays = F.array(*map(F.lit, BACKOFF))
    over = attempts >= MOST_ATTEMPTS
    return F.when(over, "failed").otherwise("pending").alias("state"), F.when(~over, F.element_at(delays, F.greatest(attempts, F.lit(1)))).alias("wait")


def holds(worker, holder, at, lease_until):
    """Whether a worker may act on a job: it holds it and the lease is live."""
    return (worker == holder) & (at < lease_until)


def rearm(jobs: DataFrame, ended: tuple[str, ...] = ("done", "failed")) -> DataFrame:
    """Jobs that have ended wait again with no attempts; others stay as they are."""
    over = F.col("state").isin(*ended)
    return jobs.withColumns({"attempts": F.when(over, 0).otherwise(F.col("attempts")), "state": F.when(over, "pending").otherwise(F.col("state"))})


def step(state: dict, action: str, worker: str, at: float, lease: float) -> tuple[dict, bool]:
    """One transition of a job; an action that isn't allowed changes nothing."""
    s = dict(state)
    held = s["state"] == "running" and s["worker"] == worker and at <= s["lease_until"]
    if action == "enqueue" and s["state"] in ("none", "done", "failed"):
        return {"state": "pending", "attempts": 0, "available_at": at, "lease_until": 0.0, "worker": ""}, True
    if action == "reserve" and (s["state"] == "pending" and s["available_at"] <= at or s["state"] == "running" and s["lease_until"] < at):
        return s | {"state": "running", "attempts": s["attempts"] + 1, "lease_until": at + lease, "worker": worker}, True
    if action == "extend" and held:
        return s | {"lease_until": at + lease}, True
    if action == "complete" and held:
        return s | {"state": "done", "worker": ""}, True
    if action == "fail" and held:
        if s["attempts"] >= MOST_ATTEMPTS:
            return s | {"state": "failed", "worker": ""}, True
        return s | {"state": "pending", "available_at": at + BACKOFF[min(s["attempts"], len(BACKOFF)) - 1], "worker": ""}, True
    return s, False


NEW = {"state": "none", "attempts": 0, "available_at": 0.0, "lease_until": 0.0, "worker": ""}


def replay(rows: pd.DataFrame, state: dict, lease: float) -> tuple[pd.DataFrame, dict]:
    out = []
    for r in rows.sort_values(["at", "event_id"], kind="stable").itertuples():
        state, ok = step(state, r.action, r.worker, float(r.at), lease)
        out.append((r.job_id, int(r.event_id), float(r.at), r.action, ok, state["state"], state["attempts"], state["available_at"], state["worker"]))
    return pd.DataFrame(out, columns=["job_id", "event_id", "at", "action", "accepted", "state", "attempts", "available_at", "worker"]), state


def run_queue(events: DataFrame, lease: float = 600.0) -> DataFrame:
    """The state of each job after each event (job_id, event_id, at, action, worker), for a stream or a table; state is kept by job."""

    def advance(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = dict(zip(NEW, state.get)) if state.exists else dict(NEW)
        rows, now = replay(pd.concat(list(frames)), now, lease)
        state.update(tuple(now.values()))
        yield rows

    if events.isStreaming:
        return events.groupBy("job_id").applyInPandasWithState(advance, OUTPUT, STATE, "append", "NoTimeout")
    return events.groupBy("job_id").applyInPandas(lambda g: replay(g, dict(NEW), lease)[0], OUTPUT)


def upsert_each_batch(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the next version is the merge of the last with the batch; a repeated batch changes nothing if the merge is idempotent."""

    def each(batch: DataFrame, batch_id: int) -> None:
        write(merge(read(), batch))

    return each


def windowed_counts(events: DataFrame, at: str, key: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: counts by tumbling window under a watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), key).agg(F.count("*").alias("n"))


def once_within(events: DataFrame, at: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Extension: the first of events that repeat a key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
