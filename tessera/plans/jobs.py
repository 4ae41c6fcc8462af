"""Event logs of remote jobs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import capture, states
from ..streaming import jobs as J
from . import inputs as I
from .registry import query

KINDS = {"view": "status", "click": "queued", "error": "error", "purchase": "result", "signup": "accepted"}
KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"


def log(spark, sf_dir):
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.col("event_type"))
    return I.read(spark, sf_dir, "events").select(F.col("user_id").alias("archive_id"), "event_id", kind.alias("kind"), (F.col("value") < 60).alias("success"), F.unix_millis(F.col("ts").cast("timestamp")).alias("epoch_ms"))


@query(
    "job_state_latest",
    f"""WITH l AS (SELECT user_id AS archive_id, arg_max({KIND_SQL}, event_id) AS kind, arg_max(value < 60, event_id) AS ok, max(epoch_us(ts) // 1000) AS epoch_ms, count(*) AS n_events FROM events GROUP BY 1)
    SELECT archive_id, kind, epoch_ms, n_events, CASE kind WHEN 'status' THEN 'running' WHEN 'queued' THEN 'queued' WHEN 'error' THEN 'error' WHEN 'accepted' THEN 'running' ELSE CASE WHEN ok THEN 'done' ELSE 'failed' END END AS phase,
      CASE kind WHEN 'result' THEN CASE WHEN ok THEN 'Done' ELSE 'Failed' END ELSE 'Active' END AS stage_state FROM l""",
)
def job_state_latest(spark, sf_dir):
    return J.job_state(log(spark, sf_dir))


@query(
    "stale_guard",
    "WITH s AS (SELECT user_id, min(epoch_us(ts) // 1000) AS t FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT e.user_id AS archive_id, e.event_id FROM events e JOIN s ON e.user_id = s.user_id WHERE event_type = 'purchase' AND epoch_us(ts) // 1000 >= t",
)
def stale_guard(spark, sf_dir):
    e = log(spark, sf_dir)
    starts = e.where("kind = 'accepted'").groupBy("archive_id").agg(F.min("epoch_ms").alias("started_at_epoch_ms"))
    return J.fresh_results(e.where("kind = 'result'").withColumnRenamed("epoch_ms", "completed_at_epoch_ms"), starts, ["archive_id"]).select("archive_id", "event_id")


@query(
    "dispatch_retry",
    """WITH q AS (SELECT user_id, min(epoch_us(ts) // 1000) / 1e3 AS a FROM events WHERE event_type = 'click' GROUP BY 1), r AS (SELECT e.user_id, min(epoch_us(ts) // 1000) / 1e3 AS h FROM events e JOIN q ON q.user_id = e.user_id WHERE event_type IN ('view', 'error') AND epoch_us(ts) // 1000 / 1e3 >= a GROUP BY 1)
    SELECT q.user_id AS archive_id, CAST(CASE WHEN h - a < 43200 THEN least(floor((h - a) / 14400) + 1, 3) ELSE 3 END AS INTEGER) AS attempts, CASE WHEN h - a < 43200 THEN 'answered' ELSE 'failed' END AS outcome FROM q LEFT JOIN r ON q.user_id = r.user_id""",
)
def dispatch_retry(spark, sf_dir):
    e = log(spark, sf_dir).withColumn("at_s", F.col("epoch_ms") / 1e3)
    return J.dispatch_retries(e.where("kind = 'queued'"), e.where("kind IN ('status', 'error')").select("archive_id", "at_s"), retry_s=14_400.0)


@query(
    "sequence_gaps",
    "WITH g AS (SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events) SELECT CAST(user_id AS VARCHAR) AS stream_id, event_id AS sequence_id, greatest(step - 1, 0) AS lost, step < 1 AS reordered FROM g WHERE step <> 1",
)
def sequence_gaps(spark, sf_dir):
    e = I.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("stream_id"), F.col("event_id").alias("sequence_id"), F.col("ts").alias("at_s"))
    return capture.sequence_gaps(e)


@query(
    "worker_liveness",
    """WITH h AS (SELECT user_id, max(epoch_us(ts) // 1000) AS last_ms, arg_max(value, event_id) AS load FROM events GROUP BY 1), n AS (SELECT max(epoch_us(ts) // 1000) AS now FROM events)
    SELECT CAST(user_id AS VARCHAR) AS worker_id, last_ms, now - last_ms <= 21600000 AS online, load >= 60 AS full FROM h, n""",
)
def worker_liveness(spark, sf_dir):
    e = I.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("worker_id"), F.lit(60.0).alias("max_concurrent"), F.col("value").alias("running_count"), F.unix_millis(F.col("ts").cast("timestamp")).alias("updated_at_epoch_ms"))
    now = e.agg(F.max("updated_at_epoch_ms").alias("now"))
    return J.worker_liveness(e, now, 21_600_000)


@query(
    "sensor_join",
    "SELECT CAST(a.user_id AS VARCHAR) AS stream_id, a.event_id AS frame_id, a.value, b.props FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id = b.event_id AND a.ts = b.ts WHERE a.event_type <> 'error' AND b.event_id % 3 <> 0",
)
def sensor_join(spark, sf_dir):
    e = I.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("stream_id"), F.col("event_id").alias("frame_id"), F.col("ts").alias("event_time"), "event_type", "value", "props")
    return capture.sensor_join(e.where("event_type <> 'error'").drop("props"), e.where("frame_id % 3 <> 0").select("stream_id", "frame_id", "event_time", "props")).select("stream_id", "frame_id", "value", "props")


@query("tracked_events", "SELECT event_id, user_id AS archive_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def tracked_events(spark, sf_dir):
    e = log(spark, sf_dir)
    return J.for_tracked(e, e.where("kind = 'accepted'"), ["archive_id"]).select("event_id", "archive_id")


#: Silence of a worker, wait between sends, and wait of packets, in the sparse time of the events.
SILENT_MS, RESEND_MS, WAIT_MS = 21_600_000, 14_400_000, 2_000_000


@query(
    "worker_changes",
    f"""WITH h AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS worker_id, epoch_us(ts) // 1000 AS at_ms FROM events), n AS (SELECT max(epoch_us(ts) // 1000) AS until FROM events),
    g AS (SELECT *, lag(at_ms) OVER w AS b, lead(at_ms) OVER w AS a FROM h WINDOW w AS (PARTITION BY worker_id ORDER BY at_ms))
    SELECT worker_id, at_ms, true AS online FROM g WHERE b IS NULL OR at_ms - b > {SILENT_MS}
    UNION ALL SELECT worker_id, at_ms + {SILENT_MS}, false FROM g, n WHERE (a IS NULL OR a - at_ms > {SILENT_MS}) AND at_ms + {SILENT_MS} < until""",
)
def worker_changes(spark, sf_dir):
    """When workers come and go; tests hold the stream form against it."""
    beats = I.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("worker_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return states.liveness_changes(beats, beats.agg(F.max("at_ms")).first()[0] or 0, SILENT_MS)


@query(
    "dispatch_sends",
    f"""WITH t AS (SELECT user_id AS archive_id, event_type, epoch_us(ts) // 1000 AS at_ms FROM events), n AS (SELECT max(at_ms) AS until FROM t),
    q AS (SELECT archive_id, min(at_ms) AS asked FROM t WHERE event_type = 'click' GROUP BY 1), r AS (SELECT t.archive_id, min(at_ms) AS heard FROM t JOIN q ON q.archive_id = t.archive_id WHERE event_type = 'view' AND at_ms >= asked GROUP BY 1),
    j AS (SELECT q.archive_id, asked, heard, asked + 3 * {RESEND_MS} AS e, until FROM q LEFT JOIN r ON r.archive_id = q.archive_id, n),
    s AS (SELECT archive_id, CAST(i AS INTEGER) AS attempt, asked + (i - 1) * {RESEND_MS} AS at_ms, 'sent' AS outcome, until, heard FROM j, range(1, 4) x(i)),
    o AS (SELECT archive_id, CAST(CASE WHEN heard < e THEN least((heard - asked) // {RESEND_MS} + 1, 3) ELSE 3 END AS INTEGER) AS attempt, CASE WHEN heard < e THEN heard ELSE e END AS at_ms, CASE WHEN heard < e THEN 'answered' ELSE 'failed' END AS outcome, until FROM j)
    SELECT archive_id, attempt, at_ms, outcome FROM s WHERE at_ms <= least(until, coalesce(heard, until)) UNION ALL SELECT archive_id, attempt, at_ms, outcome FROM o WHERE at_ms <= until""",
)
def dispatch_sends(spark, sf_dir):
    """What is sent when, and how it ends; tests hold the stream form against it."""
    kind = F.when(F.col("kind") == "queued", "dispatch_requested").when(F.col("kind") == "status", "dispatched").otherwise("other")
    e = log(spark, sf_dir).select("archive_id", kind.alias("kind"), F.col("epoch_ms").alias("at_ms"))
    return states.dispatch_sends(e, e.agg(F.max("at_ms")).first()[0] or 0, RESEND_MS, 3)


@query(
    "packets_in_order",
    f"""WITH p AS (SELECT CAST(user_id % 8 AS VARCHAR) AS stream_id, event_id AS sequence_id, epoch_us(ts) // 1000 + (event_id * 7919 % 10) * 400000 AS at_ms FROM events WHERE event_id % 9 <> 0),
    l AS (SELECT *, min(at_ms) OVER (PARTITION BY stream_id ORDER BY sequence_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later, min(at_ms) OVER (PARTITION BY stream_id) AS begin FROM p),
    t AS (SELECT * FROM l WHERE later IS NULL OR at_ms <= later + {WAIT_MS}), f AS (SELECT stream_id, min(sequence_id) AS first FROM t WHERE at_ms <= begin + {WAIT_MS} GROUP BY 1)
    SELECT t.stream_id, sequence_id, at_ms, CAST(coalesce(sequence_id - lag(sequence_id) OVER (PARTITION BY t.stream_id ORDER BY sequence_id) - 1, 0) AS BIGINT) AS lost FROM t JOIN f ON f.stream_id = t.stream_id WHERE sequence_id >= first""",
)
def packets_in_order(spark, sf_dir):
    """Packets that come in time, in order, and what is lost before each; tests hold the stream form against it."""
    k = F.col("event_id")
    e = I.read(spark, sf_dir, "events").where(k % 9 != 0)
    p = e.select((F.col("user_id") % 8).cast("string").alias("stream_id"), k.alias("sequence_id"), (F.unix_millis(F.col("ts").cast("timestamp")) + (k * 7919 % 10) * 400_000).alias("at_ms"))
    return states.reordered(p, WAIT_MS)
