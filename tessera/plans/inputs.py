"""The supplied tables in the roles of the data model, as DataFrames and as SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def located(spark, sf_dir: str) -> DataFrame:
    """embeddings as a located catalog: some rows lack position, height or direction."""
    e = lambda i: F.col("embedding")[i].cast("double")
    v = F.col("vec_id")
    return read(spark, sf_dir, "embeddings").select(
        v,
        F.format_string("img%08d", v).alias("image_id"),
        F.col("label").cast("string").alias("flight_id"),
        F.when(v % 23 != 0, F.lit(37.5) + e(0) * 0.0004).alias("latitude"),
        F.when(v % 23 != 0, F.lit(127.0) + e(1) * 0.0004).alias("longitude"),
        F.when(v % 17 != 0, F.lit(50.0) + e(2) * 30.0).alias("altitude_m"),
        F.when(v % 13 != 0, F.pmod(e(3) * 360.0, F.lit(360.0))).alias("yaw_deg"),
    )


LOCATED = """located AS (
  SELECT vec_id, printf('img%08d', vec_id) AS image_id, CAST(label AS VARCHAR) AS flight_id,
    CASE WHEN vec_id % 23 <> 0 THEN 37.5 + CAST(embedding[1] AS DOUBLE) * 0.0004 END AS latitude,
    CASE WHEN vec_id % 23 <> 0 THEN 127.0 + CAST(embedding[2] AS DOUBLE) * 0.0004 END AS longitude,
    CASE WHEN vec_id % 17 <> 0 THEN 50.0 + CAST(embedding[3] AS DOUBLE) * 30.0 END AS altitude_m,
    CASE WHEN vec_id % 13 <> 0 THEN ((CAST(embedding[4] AS DOUBLE) * 360.0) % 360.0 + 360.0) % 360.0 END AS yaw_deg
  FROM embeddings
)"""

MEANS = """means AS (SELECT avg(latitude) AS lat0, avg(longitude) AS lon0 FROM located WHERE latitude IS NOT NULL AND longitude IS NOT NULL)"""

ENU = """enu AS (
  SELECT l.*, radians(longitude - lon0) * cos(radians(lat0)) * 6371000.0 AS x, radians(latitude - lat0) * 6371000.0 AS y, coalesce(altitude_m, 0.0) AS z
  FROM located l, means WHERE latitude IS NOT NULL AND longitude IS NOT NULL
)"""

NEAREST = """nearest AS (
  SELECT a.image_id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS nn FROM enu a JOIN enu b ON a.image_id <> b.image_id GROUP BY 1
), radius AS (SELECT least(coalesce(quantile_cont(nn, 0.9) * 3.0, 8.0), 8.0) AS r FROM nearest)"""


def hav_sql(a: str, b: str) -> str:
    return (
        f"CASE WHEN {a}.latitude + {b}.latitude + {a}.longitude + {b}.longitude IS NOT NULL THEN "
        f"2 * 6371000.0 * asin(least(1.0, sqrt(sin(radians({b}.latitude - {a}.latitude) / 2) ** 2 "
        f"+ cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * sin(radians({b}.longitude - {a}.longitude) / 2) ** 2))) END"
    )


def distance_sql(a: str, b: str) -> str:
    h = hav_sql(a, b)
    return f"CASE WHEN {a}.altitude_m IS NULL OR {b}.altitude_m IS NULL THEN {h} ELSE sqrt(({h}) ** 2 + ({a}.altitude_m - {b}.altitude_m) ** 2) END"


def delta_sql(a: str, b: str) -> str:
    d = f"((({a} - {b}) % 360.0 + 360.0) % 360.0)"
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN least({d}, 360.0 - {d}) END"


def pair_sql(a: str, b: str, reason: str) -> str:
    return f"least({a}.image_id, {b}.image_id) AS image_a, greatest({a}.image_id, {b}.image_id) AS image_b, {distance_sql(a, b)} AS gps_distance_m, {delta_sql(a + '.yaw_deg', b + '.yaw_deg')} AS view_angle_delta_deg, '{reason}' AS reason"


SELECTED = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY coalesce(flight_id, '') ORDER BY image_id) AS rn FROM located
), following AS (
  SELECT {pair_sql("a", "b", "temporal_neighbor")}, 0 AS p FROM ranked a JOIN ranked b ON coalesce(a.flight_id, '') = coalesce(b.flight_id, '') AND b.rn BETWEEN a.rn + 1 AND a.rn + 4
), spatial AS (
  SELECT {pair_sql("a", "b", "gps_proximity")}, 1 AS p FROM enu a JOIN enu b ON a.image_id < b.image_id, radius
  WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= r
), gated AS (
  SELECT * FROM following WHERE coalesce(view_angle_delta_deg <= 20.0, true)
  UNION ALL SELECT s.* FROM spatial s, radius WHERE coalesce(gps_distance_m <= r, true) AND coalesce(view_angle_delta_deg <= 20.0, true)
), selected AS (
  SELECT image_a, image_b, gps_distance_m, view_angle_delta_deg, reason FROM (SELECT *, row_number() OVER (PARTITION BY image_a, image_b ORDER BY p) AS n FROM gated) WHERE n = 1
)"""

CHAIN = f"WITH {LOCATED}, {MEANS}, {ENU}, {NEAREST}, {SELECTED}"
