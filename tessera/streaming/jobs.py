"""Remote jobs as event logs: state folds, stale results, retries, stages, worker liveness."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What each kind of event says about the job: its phase and the state of its stage.
PHASES = {
    "dispatch_requested": ("dispatching", "Active"),
    "dispatched": ("dispatched", "Active"),
    "dispatch_failed": ("failed", "Failed"),
    "accepted": ("running", "Active"),
    "queued": ("queued", "Active"),
    "started": ("running", "Active"),
    "status": ("running", "Active"),
    "error": ("error", "Active"),
    "result": ("done", "Done"),
}


def phase(kind: Column, success: Column) -> Column:
    out = F.lit("idle")
    for k, (name, _) in PHASES.items():
        out = F.when(kind == k, name).otherwise(out)
    return F.when((kind == "result") & ~F.coalesce(success, F.lit(True)), "failed").otherwise(out)


def stage_state(kind: Column, success: Column) -> Column:
    out = F.lit("Pending")
    for k, (_, name) in PHASES.items():
        out = F.when(kind == k, name).otherwise(out)
    return F.when((kind == "result") & ~F.coalesce(success, F.lit(True)), "Failed").otherwise(out)


def job_state(events: DataFrame, key: str = "archive_id", order: tuple[str, ...] = ("epoch_ms", "event_id")) -> DataFrame:
    """The last event of each job and what it means: (key, kind, epoch_ms, n_events, phase, stage_state)."""
    last = events.groupBy(key).agg(F.max_by(F.struct("kind", "success", "epoch_ms"), F.struct(*order)).alias("l"), F.count("*").alias("n_events"))
    return last.select(key, F.col("l.kind").alias("kind"), F.col("l.epoch_ms").alias("epoch_ms"), "n_events", phase(F.col("l.kind"), F.col("l.success")).alias("phase"), stage_state(F.col("l.kind"), F.col("l.success")).alias("stage_state"))


JOB = "archive_id long, kind string, epoch_ms long, n_events long"


def job_state_stream(events: DataFrame) -> DataFrame:
    """Streaming form: one row per job and micro-batch that changed it, in update mode."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kind, at, event, n = state.get if state.exists else (None, -1, -1, 0)
        for batch in batches:
            n += len(batch)
            for k, t, e in zip(batch["kind"], batch["epoch_ms"].tolist(), batch["event_id"].tolist(), strict=True):
                if (t, e) > (at, event):
                    kind, at, event = k, t, e
        state.update((kind, at, event, n))
        yield pd.DataFrame([(key[0], kind, at, n)], columns=["archive_id", "kind", "epoch_ms", "n_events"])

    return events.select("archive_id", "kind", "epoch_ms", "event_id").groupBy("archive_id").applyInPandasWithState(step, JOB, "kind string, at long, event long, n long", "update", GroupStateTimeout.NoTimeout)


def fresh_results(results: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """Results of tracked jobs that are not older than the job's start: a durable topic replays old ones."""
    return results.join(starts, keys).where(F.col("completed_at_epoch_ms") >= F.col("started_at_epoch_ms"))


def for_tracked(events: DataFrame, tracked: DataFrame, keys: list[str]) -> DataFrame:
    """Events of jobs that someone watches."""
    return events.join(tracked.select(*keys).distinct(), keys, "left_semi")


def dispatch_retries(requests: DataFrame, responses: DataFrame, key: str = "archive_id", retry_s: float = 2.0, most: int = 3) -> DataFrame:
    """(key, attempts, outcome): sends every retry_s until the first response, `most` at most, then failure.

    requests(key, at_s), responses(key, at_s). A response that comes when the last wait is over comes too late.
    """
    asked = requests.groupBy(key).agg(F.min("at_s").alias("asked"))
    heard = responses.join(asked, key).where(F.col("at_s") >= F.col("asked")).groupBy(key).agg(F.min("at_s").alias("heard"))
    wait = F.col("heard") - F.col("asked")
    answered = F.coalesce(wait < retry_s * most, F.lit(False))
    # A resend and a response at the same moment: the resend is sent first.
    sent = F.least(F.floor(wait / retry_s) + 1, F.lit(most))
    return asked.join(heard, key, "left").select(key, F.when(answered, sent).otherwise(most).cast("int").alias("attempts"), F.when(answered, "answered").otherwise("failed").alias("outcome"))


def dispatch_retry_stream(events: DataFrame, retry_s: float = 2.0, most: int = 3) -> DataFrame:
    """Streaming form of dispatch_retries() on events(archive_id, kind, event_time) with a watermark set: rows appear when
    a response arrives or the watermark passes the last wait."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        asked, heard = state.get if state.exists else (None, None)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], most, "failed")], columns=["archive_id", "attempts", "outcome"])
            return
        for batch in batches:
            for kind, at in zip(batch["kind"], (batch["event_time"].astype("datetime64[ns]").astype("int64") / 1e9).tolist(), strict=True):
                if kind == "dispatch_requested":
                    asked = at if asked is None else min(asked, at)
                elif kind in ("dispatched", "dispatch_failed"):
                    heard = at if heard is None else min(heard, at)
        if asked is not None and heard is not None and heard >= asked:
            state.remove()
            late = heard - asked >= retry_s * most
            attempts = most if late else min(most, int((heard - asked) // retry_s) + 1)
            yield pd.DataFrame([(key[0], attempts, "failed" if late else "answered")], columns=["archive_id", "attempts", "outcome"])
            return
        state.update((asked, heard))
        if asked is not None:
            state.setTimeoutTimestamp(max(int((asked + retry_s * most) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([], columns=["archive_id", "attempts", "outcome"])

    return events.groupBy("archive_id").applyInPandasWithState(step, "archive_id long, attempts int, outcome string", "asked double, heard double", "append", GroupStateTimeout.EventTimeTimeout)


def worker_liveness(heartbeats: DataFrame, now_ms: Column | DataFrame, alive_ms: int = 15_000) -> DataFrame:
    """(worker_id, last_ms, online, full) by each worker's last heartbeat. The time is a column, or a DataFrame of one row
    with a column now."""
    last = heartbeats.groupBy("worker_id").agg(F.max("updated_at_epoch_ms").alias("last_ms"), F.max_by(F.struct("max_concurrent", "running_count"), "updated_at_epoch_ms").alias("h"))
    if isinstance(now_ms, DataFrame):
        last, now_ms = last.join(F.broadcast(now_ms)), F.col("now")
    return last.select("worker_id", "last_ms", (now_ms - F.col("last_ms") <= alive_ms).alias("online"), (F.col("h.running_count") >= F.col("h.max_concurrent")).alias("full"))


def dispatch_outcome(workers: DataFrame) -> DataFrame:
    """One row: NO_WORKER_ONLINE, ALL_WORKERS_FULL or READY."""
    return workers.agg(F.count_if("online").alias("online"), F.count_if(F.col("online") & ~F.col("full")).alias("free")).select("online", "free", F.when(F.col("online") == 0, "NO_WORKER_ONLINE").when(F.col("free") == 0, "ALL_WORKERS_FULL").otherwise("READY").alias("outcome"))


def storage_label(status: Column) -> Column:
    return F.when(status == "RECEIVING", "receiving").otherwise("zipping")
