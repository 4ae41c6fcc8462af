"""Sequences, robust statistics, gates and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..durable import materialize
from ..operators import gates, reconcile, robust, sequence
from ..operators.coverage import period_vote as vote
from ..streaming import capture
from . import inputs as I
from .registry import query


def moves(spark, sf_dir):
    """events as positions of streams in order; some are unknown."""
    e = F.col("event_id")
    return I.read(spark, sf_dir, "events").select("user_id", "event_id", F.when(e % 19 != 0, F.col("value")).alias("x"), (e % 7).cast("double").alias("y"))


def fold_sql(source: str, near: str) -> str:
    """Walks the rows (g, i, known, x, y) of each group in order and keeps those that are unknown or not near the last kept."""
    return f"""WITH RECURSIVE src AS ({source}), o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY i) AS rn FROM src
    ), walk AS (
      SELECT g, i, rn, true AS kept, CASE WHEN known THEN x END AS lx, CASE WHEN known THEN y END AS ly FROM o WHERE rn = 1
      UNION ALL
      SELECT o.g, o.i, o.rn, (NOT o.known) OR w.lx IS NULL OR NOT ({near}) AS kept,
        CASE WHEN o.known AND (w.lx IS NULL OR NOT ({near})) THEN o.x ELSE w.lx END, CASE WHEN o.known AND (w.lx IS NULL OR NOT ({near})) THEN o.y ELSE w.ly END
      FROM walk w JOIN o ON o.g = w.g AND o.rn = w.rn + 1
    )"""


@query(
    "spacing_thin",
    fold_sql("SELECT user_id AS g, event_id AS i, event_id % 19 <> 0 AS known, CASE WHEN event_id % 19 <> 0 THEN value END AS x, CAST(event_id % 7 AS DOUBLE) AS y FROM events", "sqrt((o.x - w.lx) ** 2 + (o.y - w.ly) ** 2) < 20.0")
    + " SELECT g AS user_id, i AS event_id FROM walk WHERE kept",
)
def spacing_thin(spark, sf_dir):
    return sequence.keep_spaced(moves(spark, sf_dir), 20.0, "user_id", "event_id", ("x", "y")).select("user_id", "event_id")


def frames(spark, sf_dir):
    e = I.read(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("stream_id"), F.col("event_id").alias("frame_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at_s"))


THROTTLE = fold_sql("SELECT user_id AS g, event_id AS i, true AS known, epoch_us(ts) / 1e6 AS x, 0.0 AS y FROM events", "o.x - w.lx < 14400.0")
NUMBERED = ", kept AS (SELECT CAST(g AS VARCHAR) AS stream_id, i AS frame_id, row_number() OVER (PARTITION BY g ORDER BY i) - 1 AS frame_no FROM walk WHERE kept)"


@query("stream_throttle", THROTTLE + NUMBERED + " SELECT * FROM kept")
def stream_throttle(spark, sf_dir):
    return capture.throttle(frames(spark, sf_dir), 14_400.0).select("stream_id", "frame_id", "frame_no")


@query("frame_batches", THROTTLE + NUMBERED + " SELECT * FROM kept WHERE frame_no > 0 AND (frame_no + 1) % 10 = 0")
def frame_batches(spark, sf_dir):
    return capture.batch_ends(capture.throttle(frames(spark, sf_dir), 14_400.0)).select("stream_id", "frame_id", "frame_no")


@query(
    "largest_gap_cut",
    """WITH c AS (SELECT source || '-' || lang AS image_id, count(*) FILTER (WHERE n_chars > 3000) AS n FROM documents GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY n, image_id) AS i, lag(n) OVER (ORDER BY n, image_id) AS lo, count(*) OVER () AS every FROM c),
    g AS (SELECT i - 1 AS cut, (n + 1) / (lo + 1) AS ratio FROM r WHERE every >= 4 AND i > 1 AND i - 1 <= least(greatest(floor(every * 0.5), 1), every - 1)),
    b AS (SELECT cut, ratio FROM g WHERE ratio > 1 ORDER BY ratio DESC, cut LIMIT 1)
    SELECT image_id, n, round(ratio, 6) AS gap_ratio FROM r, b WHERE ratio >= 1.2 AND i <= cut""",
)
def largest_gap_cut(spark, sf_dir):
    counts = I.read(spark, sf_dir, "documents").groupBy(F.concat_ws("-", "source", "lang").alias("image_id")).agg(F.count_if(F.col("n_chars") > 3000).alias("n"))
    return sequence.gap_cut(counts, least_ratio=1.2).withColumn("gap_ratio", F.round("gap_ratio", 6))


CENTRES = "c AS (SELECT label, avg(CAST(embedding[1] AS DOUBLE)) AS x, avg(CAST(embedding[2] AS DOUBLE)) AS y, avg(CAST(embedding[3] AS DOUBLE)) AS z FROM embeddings GROUP BY label)"


@query(
    "mismatch_outliers",
    f"""WITH {CENTRES}, e AS (SELECT vec_id, 10 * sqrt((embedding[1] - x) ** 2 + (embedding[2] - y) ** 2 + (embedding[3] - z) ** 2) AS error_m FROM embeddings JOIN c USING (label)),
    t AS (SELECT greatest(0.1, 1.7 * median(error_m)) AS threshold FROM e)
    SELECT vec_id, round(error_m, 6) AS error_m, round(threshold, 6) AS threshold FROM e, t WHERE error_m > threshold""",
)
def mismatch_outliers(spark, sf_dir):
    at = [F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")]
    rows = I.read(spark, sf_dir, "embeddings").select("vec_id", "label", *at)
    centre = rows.groupBy("label").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    gap = 10 * F.sqrt(sum((F.pow(F.col(c) - F.col(f"m{c}"), 2) for c in "xyz"), F.lit(0.0)))
    errors = rows.join(centre, "label").select("vec_id", gap.alias("error_m"))
    return robust.mismatches(errors, least=0.1, multiple=1.7).withColumns({c: F.round(c, 6) for c in ("error_m", "threshold")})


FENCE = """q AS (SELECT {by} quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem {group})"""


@query(
    "robust_range",
    "WITH " + FENCE.format(by="l_returnflag,", group="GROUP BY l_returnflag")
    + """ SELECT l_returnflag, round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3, min(l_extendedprice) FILTER (WHERE l_extendedprice BETWEEN q1 - 0.4 * (q3 - q1) AND q3 + 0.4 * (q3 - q1)) AS lo,
      max(l_extendedprice) FILTER (WHERE l_extendedprice BETWEEN q1 - 0.4 * (q3 - q1) AND q3 + 0.4 * (q3 - q1)) AS hi FROM lineitem JOIN q USING (l_returnflag) GROUP BY l_returnflag""",
)
def robust_range(spark, sf_dir):
    return robust.robust_range(I.read(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag", 0.4).withColumns({c: F.round(c, 6) for c in ("q1", "q3")})


@query(
    "robust_range_whole",
    "WITH " + FENCE.format(by="", group="")
    + """ SELECT round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3, min(l_extendedprice) FILTER (WHERE l_extendedprice BETWEEN q1 - 0.4 * (q3 - q1) AND q3 + 0.4 * (q3 - q1)) AS lo,
      max(l_extendedprice) FILTER (WHERE l_extendedprice BETWEEN q1 - 0.4 * (q3 - q1) AND q3 + 0.4 * (q3 - q1)) AS hi FROM lineitem, q""",
)
def robust_range_whole(spark, sf_dir):
    """The same without groups: quantiles by histograms that narrow down, for a column of any size."""
    return robust.robust_range(I.read(spark, sf_dir, "lineitem"), "l_extendedprice", k=0.4).withColumns({c: F.round(c, 6) for c in ("q1", "q3")})


@query("densest_slab", "SELECT DISTINCT p.p_retailprice AS d, (SELECT count(*) FROM part q WHERE q.p_retailprice >= p.p_retailprice AND q.p_retailprice < p.p_retailprice + 3.0) AS n FROM part p")
def densest_slab(spark, sf_dir):
    return sequence.densest_slab(I.read(spark, sf_dir, "part"), "p_retailprice", 3.0).distinct()


SPLIT = """o AS (SELECT user_id AS g, CAST((event_id * 7919) % 1000 AS DOUBLE) AS x, CASE WHEN ((event_id * 7919) % 1000 < 400 + user_id % 5 * 50) = (event_id % 20 <> 0) THEN 1 ELSE 0 END AS i FROM events),
a AS (SELECT g, x, sum(i) AS i, sum(1 - i) AS o FROM o GROUP BY g, x),
l AS (SELECT g, x, coalesce(sum(i) OVER w, 0) AS il, coalesce(sum(o) OVER w, 0) AS ol, sum(i) OVER (PARTITION BY g) AS ni, sum(o) OVER (PARTITION BY g) AS no FROM a WINDOW w AS (PARTITION BY g ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT g, x, (ol + ni - il) / (ni + no) AS r, (no - ol + il) / (ni + no) AS k FROM l WHERE ni >= 10 AND no >= 10),
b AS (SELECT g, (SELECT x FROM p q WHERE q.g = p.g ORDER BY r DESC, x LIMIT 1) AS xr, max(r) AS pr, (SELECT x FROM p q WHERE q.g = p.g ORDER BY k DESC, x LIMIT 1) AS xk, max(k) AS pk FROM p GROUP BY g),
s AS (SELECT g, CASE WHEN pr >= pk THEN xr ELSE xk END AS threshold, CASE WHEN pr >= pk THEN 'keep_right' ELSE 'keep_left' END AS side, greatest(pr, pk) AS purity FROM b)"""


@query("split_purity", f"WITH {SPLIT} SELECT g AS user_id, threshold, side, round(purity, 6) AS purity FROM s WHERE purity >= 0.9 AND CASE side WHEN 'keep_right' THEN threshold / 1000.0 ELSE 1 - threshold / 1000.0 END BETWEEN 0.1 AND 0.9")
def split_purity(spark, sf_dir):
    x = (F.col("event_id") * 7919) % 1000
    inside = (x < 400 + F.col("user_id") % 5 * 50) == (F.col("event_id") % 20 != 0)
    points = I.read(spark, sf_dir, "events").select("user_id", x.cast("double").alias("x"), inside.alias("inside"))
    return sequence.split_purity(points, "user_id", "x", "inside", F.lit(1000.0), least_points=10).withColumn("purity", F.round("purity", 6))


@query(
    "session_stamps",
    """WITH s AS (SELECT user_id, event_id, epoch(date_trunc('hour', ts)) AS began FROM events),
    r AS (SELECT user_id, event_id, CAST(began AS BIGINT) - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM s)
    SELECT user_id, event_id, max(d) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) + n AS stamp FROM r""",
)
def session_stamps(spark, sf_dir):
    starts = I.read(spark, sf_dir, "events").select("user_id", "event_id", F.date_trunc("hour", F.col("ts")).alias("at"))
    return sequence.session_stamps(starts, "user_id", "at", "event_id").select("user_id", "event_id", "stamp")


GATE_SQL = """m AS (
  SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS matches, CAST(sum(l_quantity) * 0.6 AS BIGINT) AS inliers, 1 - sum(l_discount) * 2 AS ratio, CASE WHEN l_orderkey % 29 <> 0 THEN sum(l_tax) * 20 END AS error,
    CASE WHEN l_orderkey % 11 <> 0 THEN CAST(l_orderkey % 13 - 6 AS DOUBLE) END AS dz, CAST((l_orderkey * 37) % 900 - 450 AS DOUBLE) AS shift, 100.0 + l_orderkey % 80 AS period, (l_orderkey % 10) / 10.0 AS confidence,
    CASE WHEN l_orderkey % 41 = 0 THEN 'MATCH_TIMEOUT' ELSE 'OK' END AS status
  FROM lineitem GROUP BY l_orderkey)"""


def metrics(spark, sf_dir):
    k = F.col("l_orderkey")
    return I.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_discount").alias("d"), F.sum("l_tax").alias("t")).select(
        k, F.col("q").cast("long").alias("matches"), F.round(F.col("q") * 0.6, 0).cast("long").alias("inliers"), (1 - F.col("d") * 2).alias("ratio"), F.when(k % 29 != 0, F.col("t") * 20).alias("error"),
        F.when(k % 11 != 0, (k % 13 - 6).cast("double")).alias("dz"), ((k * 37) % 900 - 450).cast("double").alias("shift"), (100.0 + k % 80).alias("period"), ((k % 10) / 10.0).alias("confidence"),
        F.when(k % 41 == 0, "MATCH_TIMEOUT").otherwise("OK").alias("status"),
    )


POSE_SQL = "coalesce(abs(dz) < 2 OR abs(shift) < 100 OR ((dz > 0) = (shift > 0)), true)"
FLOOR_SQL = "coalesce(confidence < 0.6 OR abs(dz) < 1 OR abs(dz / 2.51 - shift / period) <= 0.75, true)"
STATUS_SQL = f"""CASE WHEN status <> 'OK' THEN status WHEN matches < 40 THEN 'LOW_MATCH' WHEN inliers < 25 OR round(ratio, 6) < 0.35 THEN 'LOW_INLIER' WHEN error IS NULL OR round(error, 6) > 3.0 THEN 'HIGH_REPROJECTION_ERROR'
  WHEN NOT {POSE_SQL} THEN 'POSE_INCONSISTENT' WHEN NOT {FLOOR_SQL} THEN 'FLOOR_COUNT_MISMATCH' ELSE 'OK' END"""


def gated(spark, sf_dir):
    m = metrics(spark, sf_dir)
    pose = gates.pose_consistent(F.col("dz"), F.col("shift"))
    floors = gates.floors_consistent(F.col("dz"), F.col("shift"), F.col("period"), F.col("confidence"))
    return m.withColumn("status", gates.gate_status(F.col("status"), F.col("matches"), F.col("inliers"), F.round("ratio", 6), F.round("error", 6), pose, floors))


@query("gate_cascade", f"WITH {GATE_SQL} SELECT l_orderkey, {STATUS_SQL} AS status FROM m")
def gate_cascade(spark, sf_dir):
    return gated(spark, sf_dir).select("l_orderkey", "status")


@query(
    "match_stats",
    f"""WITH {GATE_SQL}, s AS (SELECT *, {STATUS_SQL} AS gate FROM m)
    SELECT count(*) AS attempted, count(*) FILTER (WHERE gate <> 'MATCH_TIMEOUT') AS matched, count(*) FILTER (WHERE gate = 'MATCH_TIMEOUT') AS timed_out,
      count(*) FILTER (WHERE gate NOT IN ('OK', 'MATCH_TIMEOUT')) AS failed, CAST(sum(matches) AS BIGINT) AS raw_matches FROM s""",
)
def match_stats(spark, sf_dir):
    s = F.col("status")
    return gated(spark, sf_dir).agg(F.count("*").alias("attempted"), F.count_if(s != "MATCH_TIMEOUT").alias("matched"), F.count_if(s == "MATCH_TIMEOUT").alias("timed_out"), F.count_if(~s.isin("OK", "MATCH_TIMEOUT")).alias("failed"), F.sum("matches").alias("raw_matches"))


@query(
    "quality_report",
    """SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag <> 'R') AS n_ok, count(*) FILTER (WHERE l_returnflag = 'R') AS n_failed, round(avg(l_discount) FILTER (WHERE l_returnflag <> 'R'), 6) AS mean_inlier_ratio,
      round(median(l_tax) FILTER (WHERE l_returnflag <> 'R'), 6) AS median_error FROM lineitem GROUP BY l_suppkey""",
)
def quality_report(spark, sf_dir):
    ok = F.col("l_returnflag") != "R"
    rows = I.read(spark, sf_dir, "lineitem")
    counts = rows.groupBy("l_suppkey").agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"), F.round(F.avg(F.when(ok, F.col("l_discount"))), 6).alias("mean_inlier_ratio"))
    medians = robust.group_quantiles(rows.where(ok), "l_suppkey", "l_tax", [0.5]).select("l_suppkey", F.round(F.col("q")[0], 6).alias("median_error"))
    return counts.join(medians, "l_suppkey", "left")


@query(
    "decision_reasons",
    """WITH r AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, round(avg(l_quantity) * 0.4, 6) AS drift_px, round(max(l_quantity) * 0.41, 6) AS max_drift_px, round(1 - avg(l_discount) * 10, 6) AS coverage_ratio, count(*) AS image_count,
      count(*) FILTER (WHERE l_quantity < 2) AS never_matched, count(*) FILTER (WHERE l_tax > 0.07) AS unreachable FROM lineitem GROUP BY 1),
    d AS (SELECT *, list_filter([CASE WHEN drift_px > 10 THEN 'drift' END, CASE WHEN max_drift_px > 20 THEN 'seam_drift' END, CASE WHEN 1 - coverage_ratio > 0.5 THEN 'coverage_gap' END,
      CASE WHEN (unreachable + never_matched) / nullif(image_count + never_matched, 0) > 0.14 THEN 'unreachable' END], lambda x: x IS NOT NULL) AS reasons FROM r)
    SELECT month, array_to_string(reasons, ',') AS reasons, len(reasons) > 0 AS needed FROM d""",
)
def decision_reasons(spark, sf_dir):
    report = I.read(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(
        F.round(F.avg("l_quantity") * 0.4, 6).alias("drift_px"), F.round(F.max("l_quantity") * 0.41, 6).alias("max_drift_px"), F.round(1 - F.avg("l_discount") * 10, 6).alias("coverage_ratio"), F.count("*").alias("image_count"),
        F.count_if(F.col("l_quantity") < 2).alias("never_matched"), F.count_if(F.col("l_tax") > 0.07).alias("unreachable"),
    )
    return gates.decision(report, most_unreachable=0.14).select("month", F.concat_ws(",", "reasons").alias("reasons"), "needed")


@query(
    "period_vote",
    """WITH o AS (SELECT event_type, value AS dy, count(*) AS n FROM events WHERE value BETWEEN 40 AND 200 GROUP BY 1, 2), t AS (SELECT event_type, sum(n) AS total FROM o GROUP BY 1 HAVING sum(n) >= 5),
    c AS (SELECT DISTINCT event_type, round_even(dy / 4.0, 0) * 4.0 AS t FROM o WHERE round_even(dy / 4.0, 0) * 4.0 >= 40),
    m AS (SELECT o.event_type, t, dy, n, least(greatest(round_even(dy / t, 0), 1), 3) * t AS near FROM o JOIN c ON o.event_type = c.event_type),
    s AS (SELECT event_type, t, sum(CASE WHEN abs(dy - near) / near < 0.08 THEN n ELSE 0 END) AS score FROM m GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, t) AS r FROM s)
    SELECT event_type, t AS period_px, round(score / total, 6) AS confidence, CAST(total AS BIGINT) AS n_rows, CAST(score AS BIGINT) AS n_inliers FROM b JOIN t USING (event_type) WHERE r = 1""",
)
def period_vote(spark, sf_dir):
    rows = I.read(spark, sf_dir, "events").select("event_type", "value", F.lit(1.0).alias("w"))
    return vote(rows, "event_type", "value", "w", most=200.0).select("event_type", "period_px", F.round("confidence", 6).alias("confidence"), "n_rows", "n_inliers")


@query(
    "best_attempt",
    """WITH a AS (SELECT l_orderkey AS facade, l_linenumber AS attempt, CAST(l_quantity AS BIGINT) AS registered, 50 AS requested FROM lineitem),
    s AS (SELECT *, min(CASE WHEN registered >= 0.9 * requested THEN attempt END) OVER (PARTITION BY facade) AS stop FROM a), r AS (SELECT * FROM s WHERE stop IS NULL OR attempt <= stop),
    k AS (SELECT *, row_number() OVER (PARTITION BY facade ORDER BY registered DESC, attempt) AS n, count(*) OVER (PARTITION BY facade) AS attempts_run FROM r)
    SELECT facade, attempt, registered, attempts_run FROM k WHERE n = 1""",
)
def best_attempt(spark, sf_dir):
    a = I.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("facade"), F.col("l_linenumber").alias("attempt"), F.col("l_quantity").cast("long").alias("registered"), F.lit(50).alias("requested"))
    # Repeated (facade, attempt) rows count once, with their best figure.
    return reconcile.best_attempt(a, "facade", "attempt", "registered", "requested").select("facade", "attempt", "registered", "attempts_run")


@query("plane_fit")
def plane_fit(spark, sf_dir):
    """The principal axes of the located catalog, per component of a point: tests hold them against numpy."""
    from ..operators.pairs import enu

    points = materialize(enu(I.located(spark, sf_dir)).select("x", "y", "z"), "points")
    mean, axes, variances = robust.principal_axes(points)
    rows = [(i, *(round(float(x), 6) for x in axes[i]), round(float(variances[i]), 6)) for i in range(3)]
    return spark.createDataFrame(rows, "axis int, x double, y double, z double, variance double")
