"""Candidate pairs and geography."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..durable import materialize
from ..functions import geo
from ..operators import pairs as P
from . import inputs as I
from .registry import query


@query(
    "pairs_next_k",
    """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
    SELECT a.source AS flight_id, a.doc_id AS image_a, b.doc_id AS image_b FROM r a JOIN r b ON a.source = b.source AND b.rn BETWEEN a.rn + 1 AND a.rn + 4""",
)
def pairs_next_k(spark, sf_dir):
    docs = I.read(spark, sf_dir, "documents").select("source", "doc_id")
    return P.next_neighbours(docs, 4, "source", "doc_id").select(F.col("source").alias("flight_id"), F.col("a.doc_id").alias("image_a"), F.col("b.doc_id").alias("image_b"))


@query("nearest_distance", f"WITH {I.LOCATED}, {I.MEANS}, {I.ENU}, {I.NEAREST} SELECT image_id, round(nn, 6) AS nn FROM nearest")
def nearest_distance(spark, sf_dir):
    return P.nearest_distance(P.enu(I.located(spark, sf_dir)), 8.0).select("image_id", F.round("nn", 6).alias("nn"))


@query(
    "pairs_radius_calibrated",
    f"""WITH {I.LOCATED}, {I.MEANS}, {I.ENU}, {I.NEAREST}
    SELECT a.image_id AS image_a, b.image_id AS image_b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) AS distance_m, round(r, 6) AS radius_m
    FROM enu a JOIN enu b ON a.image_id < b.image_id, radius WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= r""",
)
def pairs_radius_calibrated(spark, sf_dir):
    points = materialize(P.enu(I.located(spark, sf_dir)), "points")
    radius = P.calibrated_radius(points, 8.0)
    return P.radius_pairs(points, radius).select(F.col("a.image_id").alias("image_a"), F.col("b.image_id").alias("image_b"), F.round("distance", 6).alias("distance_m"), F.round(F.lit(radius), 6).alias("radius_m"))


@query("pairs_selected", f"{I.CHAIN} SELECT image_a, image_b, round(gps_distance_m, 6) AS gps_distance_m, round(view_angle_delta_deg, 6) AS view_angle_delta_deg, reason FROM selected")
def pairs_selected(spark, sf_dir):
    return P.select_pairs(I.located(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("gps_distance_m", "view_angle_delta_deg")})


@query(
    "pairs_union_gated",
    f"""{I.CHAIN} SELECT reason, count(*) AS n_pairs, round(avg(gps_distance_m), 6) AS mean_distance_m, round(max(view_angle_delta_deg), 6) AS max_view_delta_deg,
      count(*) FILTER (WHERE gps_distance_m IS NULL) AS n_unlocated FROM selected GROUP BY reason""",
)
def pairs_union_gated(spark, sf_dir):
    """The flagship: pairs of both kinds, gated, each once, with a report by kind."""
    return (
        P.select_pairs(I.located(spark, sf_dir))
        .groupBy("reason")
        .agg(F.count("*").alias("n_pairs"), F.round(F.avg("gps_distance_m"), 6).alias("mean_distance_m"), F.round(F.max("view_angle_delta_deg"), 6).alias("max_view_delta_deg"), F.count_if(F.col("gps_distance_m").isNull()).alias("n_unlocated"))
    )


CAPPED = f"""{I.CHAIN}, near AS (
  SELECT g.*, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS xyz_m FROM gated g JOIN enu a ON a.image_id = g.image_a JOIN enu b ON b.image_id = g.image_b
  WHERE p = 1 AND (g.image_a, g.image_b) NOT IN (SELECT (image_a, image_b) FROM gated WHERE p = 0)
), ends AS (SELECT image_a, image_b, xyz_m, unnest([image_a, image_b]) AS image FROM near
), firsts AS (SELECT image_a, image_b FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY xyz_m, image_a, image_b) AS n FROM ends) WHERE n <= 3)
SELECT image_a, image_b, round(gps_distance_m, 6) AS gps_distance_m, round(view_angle_delta_deg, 6) AS view_angle_delta_deg, reason FROM gated
WHERE p = 0 UNION ALL SELECT image_a, image_b, round(gps_distance_m, 6), round(view_angle_delta_deg, 6), reason FROM near WHERE (image_a, image_b) IN (SELECT (image_a, image_b) FROM firsts)"""


@query("pairs_degree_capped", CAPPED)
def pairs_degree_capped(spark, sf_dir):
    """Greedy by definition; tests hold it against the greedy walk too."""
    return P.select_pairs(I.located(spark, sf_dir), cap=3).withColumns({c: F.round(c, 6) for c in ("gps_distance_m", "view_angle_delta_deg")})


PLACED = """p AS (SELECT s_suppkey, s_nationkey, CAST(((s_suppkey * 37) % 1400) / 10.0 - 70.0 AS DOUBLE) AS latitude, CAST(((s_suppkey * 91) % 3600) / 10.0 - 180.0 AS DOUBLE) AS longitude,
  CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal / 10.0 END AS altitude_m, CAST((s_suppkey * 47) % 360 - 180.0 AS DOUBLE) AS yaw_deg FROM supplier)"""


def placed(spark, sf_dir):
    k = F.col("s_suppkey")
    return I.read(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_nationkey", (((k * 37) % 1400) / 10.0 - 70.0).alias("latitude"), (((k * 91) % 3600) / 10.0 - 180.0).alias("longitude"),
        F.when(k % 7 != 0, F.col("s_acctbal") / 10.0).alias("altitude_m"), ((k * 47) % 360 - 180.0).alias("yaw_deg"),
    )


@query(
    "geo_pairs",
    f"""WITH {PLACED} SELECT a.s_suppkey AS key_a, b.s_suppkey AS key_b, round({I.hav_sql("a", "b")}, 4) AS haversine_m, round({I.distance_sql("a", "b")}, 4) AS distance_m, round({I.delta_sql("a.yaw_deg", "b.yaw_deg")}, 6) AS view_delta_deg
    FROM p a JOIN p b ON b.s_suppkey = a.s_suppkey + 1""",
)
def geo_pairs(spark, sf_dir):
    p = placed(spark, sf_dir)
    a, b = p.select(F.struct("*").alias("a")), p.select(F.struct("*").alias("b"))
    at = lambda s: [F.col(f"{s}.latitude"), F.col(f"{s}.longitude")]
    full = lambda s: [*at(s), F.col(f"{s}.altitude_m")]
    return a.join(b, F.col("b.s_suppkey") == F.col("a.s_suppkey") + 1).select(
        F.col("a.s_suppkey").alias("key_a"), F.col("b.s_suppkey").alias("key_b"), F.round(geo.haversine_m(*at("a"), *at("b")), 4).alias("haversine_m"),
        F.round(geo.distance_3d_m(*full("a"), *full("b")), 4).alias("distance_m"), F.round(geo.angle_delta_deg(F.col("a.yaw_deg"), F.col("b.yaw_deg")), 6).alias("view_delta_deg"),
    )


@query("enu_xyz", f"WITH {I.LOCATED}, {I.MEANS}, {I.ENU} SELECT image_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM enu")
def enu_xyz(spark, sf_dir):
    return P.enu(I.located(spark, sf_dir)).select("image_id", *(F.round(c, 6).alias(c) for c in "xyz"))


@query(
    "utm_epsg",
    f"""WITH {PLACED}, m AS (SELECT s_nationkey, avg(latitude) AS lat, avg(longitude) AS lon FROM p GROUP BY 1)
    SELECT s_nationkey, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(trunc((lon + 180) / 6) AS INTEGER) + 1 AS INTEGER) AS epsg FROM m""",
)
def utm_epsg(spark, sf_dir):
    m = placed(spark, sf_dir).groupBy("s_nationkey").agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"))
    return m.select("s_nationkey", geo.utm_epsg(F.col("lat"), F.col("lon")).alias("epsg"))


@query("utm_xy")
def utm_xy(spark, sf_dir):
    """Projected positions; tests hold them against an integral of the meridian and known values."""
    p = placed(spark, sf_dir).withColumn("epsg", geo.utm_epsg(F.col("latitude"), F.col("longitude")))
    return p.withColumn("at", geo.utm_xy_m(F.col("latitude"), F.col("longitude"), F.col("epsg"))).select("s_suppkey", "epsg", F.round("at.x", 4).alias("x"), F.round("at.y", 4).alias("y"))


@query(
    "quaternions",
    f"""WITH {PLACED}, q AS (SELECT s_suppkey, radians(yaw_deg) / 2 AS a, radians(latitude) / 2 AS b, radians(longitude) / 2 AS c FROM p)
    SELECT s_suppkey, round(cos(c) * cos(b) * cos(a) + sin(c) * sin(b) * sin(a), 6) AS w, round(sin(c) * cos(b) * cos(a) - cos(c) * sin(b) * sin(a), 6) AS x,
      round(cos(c) * sin(b) * cos(a) + sin(c) * cos(b) * sin(a), 6) AS y, round(cos(c) * cos(b) * sin(a) - sin(c) * sin(b) * cos(a), 6) AS z FROM q""",
)
def quaternions(spark, sf_dir):
    p = placed(spark, sf_dir).withColumn("q", geo.quaternion(F.col("yaw_deg"), F.col("latitude"), F.col("longitude")))
    return p.select("s_suppkey", *(F.round(f"q.{c}", 6).alias(c) for c in "wxyz"))
