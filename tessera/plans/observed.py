"""Images, their keypoints and the points they see; transfer logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import observations as O
from ..sources import messages as M
from . import inputs as I
from .registry import query

SEEN = """points AS (SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) * 10 AS x, CAST(embedding[2] AS DOUBLE) * 10 AS y, CAST(embedding[3] AS DOUBLE) * 10 AS z, CASE WHEN vec_id % 3 <> 0 THEN abs(CAST(embedding[4] AS DOUBLE)) END AS error FROM embeddings),
seen AS (SELECT user_id AS image_id, event_id AS idx, CASE WHEN event_id % 8 <> 0 THEN event_id % 600 END AS point_id FROM events)"""


def points(spark, sf_dir):
    e = lambda i: F.col("embedding")[i].cast("double")
    return I.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), *((e(i) * 10).alias(c) for i, c in enumerate("xyz")), F.when(F.col("vec_id") % 3 != 0, F.abs(e(3))).alias("error"))


def seen(spark, sf_dir):
    k = F.col("event_id")
    return I.read(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), k.alias("idx"), F.when(k % 8 != 0, k % 600).alias("point_id"))


@query("on_wall_counts", f"WITH {SEEN}, i AS (SELECT DISTINCT image_id FROM seen) SELECT i.image_id, count(p.point_id) AS n FROM i LEFT JOIN seen s ON i.image_id = s.image_id LEFT JOIN points p ON s.point_id = p.point_id AND abs(p.z - 0.5) < 1.0 GROUP BY 1")
def on_wall_counts(spark, sf_dir):
    s = seen(spark, sf_dir)
    return O.on_wall_counts(s, s, points(spark, sf_dir), [0.0, 0.0, 0.5], [0.0, 0.0, 2.0], 1.0)


@query("observation_join", f"WITH {SEEN} SELECT image_id, idx, round(x, 6) AS x FROM seen JOIN points USING (point_id)")
def observation_join(spark, sf_dir):
    return O.observed_points(seen(spark, sf_dir), points(spark, sf_dir)).select("image_id", "idx", F.round("x", 6).alias("x"))


@query("mean_track_error", f"WITH {SEEN} SELECT round(avg(error), 6) AS mean_error, count(error) AS n_points FROM points")
def mean_track_error(spark, sf_dir):
    return O.mean_track_error(points(spark, sf_dir)).withColumn("mean_error", F.round("mean_error", 6))


@query(
    "remapped_matches",
    """WITH m AS (SELECT l_suppkey AS image_a, CAST(l_linenumber AS BIGINT) AS image_b, l_partkey % 50 AS idx_a, l_orderkey % 50 AS idx_b FROM lineitem)
    SELECT DISTINCT image_a, image_b, idx_a // 3 AS idx_a, idx_b // 3 AS idx_b FROM m WHERE idx_a % 10 <> 0 AND idx_b % 10 <> 0""",
)
def remapped_matches(spark, sf_dir):
    line = I.read(spark, sf_dir, "lineitem")
    m = line.select(F.col("l_suppkey").alias("image_a"), F.col("l_linenumber").cast("long").alias("image_b"), (F.col("l_partkey") % 50).alias("idx_a"), (F.col("l_orderkey") % 50).alias("idx_b"))
    images = m.select(F.col("image_a").alias("image_id")).union(m.select("image_b")).distinct()
    index = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long")))
    mapping = images.select("image_id", index.alias("idx")).withColumn("new_idx", F.when(F.col("idx") % 10 == 0, -1).otherwise(F.floor(F.col("idx") / 3)))
    return O.remapped(m, mapping)


@query("texture_filter", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(quality >= 1, true)")
def texture_filter(spark, sf_dir):
    docs = I.read(spark, sf_dir, "documents").join(I.read(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.where(O.keep_textured(F.col("quality"), 1)).select("doc_id")


@query(
    "transfer_message",
    r"""WITH l AS (SELECT conv_id, unnest(list_filter(regexp_split_to_array(text, '[\r\n]'), lambda x: x <> '')) AS value, turn, generate_subscripts(list_filter(regexp_split_to_array(text, '[\r\n]'), lambda x: x <> ''), 1) AS i FROM conversations),
    n AS (SELECT conv_id, turn * 100000 + i AS line_no, CASE WHEN (turn * 7 + i) % 11 = 0 THEN 'Permission denied: ' || value ELSE value END AS value FROM l),
    k AS (SELECT conv_id, arg_max(value, line_no) AS last, arg_max(value, line_no) FILTER (WHERE value LIKE '%Permission denied%') AS refused FROM n GROUP BY 1)
    SELECT conv_id AS transfer_id, CAST(conv_id % 3 AS INTEGER) AS exit_code, CASE WHEN conv_id % 7 = 0 THEN 'cancelled by user' WHEN conv_id % 3 = 0 THEN '' ELSE coalesce(refused, last) END AS message FROM k""",
)
def transfer_message(spark, sf_dir):
    c = I.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("transfer_id"), "turn", F.posexplode(text.lines(F.col("text"))).alias("i", "value"))
    refused = (F.col("turn") * 7 + F.col("i") + 1) % 11 == 0
    lines = c.select("transfer_id", (F.col("turn") * 100_000 + F.col("i") + 1).alias("line_no"), F.when(refused, F.concat(F.lit("Permission denied: "), "value")).otherwise(F.col("value")).alias("value"))
    exits = lines.select("transfer_id").distinct().select("transfer_id", (F.col("transfer_id") % 7 == 0).alias("cancelled"), (F.col("transfer_id") % 3).cast("int").alias("exit_code"))
    return M.transfer_message(lines, exits)


@query("sensor_optional", "SELECT event_id AS frame_id, CASE WHEN event_type = 'view' THEN value END AS gps FROM events WHERE event_id % 5 <> 0")
def sensor_optional(spark, sf_dir):
    e = I.read(spark, sf_dir, "events").select(F.col("event_id").alias("frame_id"), F.col("value").alias("gps"), (F.col("event_type") == "view").alias("has_gps"), (F.col("event_id") % 5 != 0).alias("valid"))
    return M.optional(M.valid_samples(e), ("gps",)).select("frame_id", "gps")


@query("grid_size", "SELECT p_partkey, CAST(ceil(p_retailprice * 3 / 500.0) AS INTEGER) AS cols FROM part")
def grid_size(spark, sf_dir):
    return I.read(spark, sf_dir, "part").select("p_partkey", text.grid_size(F.col("p_retailprice") * 3).alias("cols"))


@query(
    "canonical_pairs",
    """SELECT l_orderkey, l_linenumber, least(l_partkey, l_suppkey) AS image_a, greatest(l_partkey, l_suppkey) AS image_b,
      CASE WHEN l_partkey > l_suppkey THEN l_tax ELSE l_discount END AS kp_a, CASE WHEN l_partkey > l_suppkey THEN l_discount ELSE l_tax END AS kp_b FROM lineitem""",
)
def canonical_pairs(spark, sf_dir):
    from ..operators.pairs import canonical

    line = I.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("image_a"), F.col("l_suppkey").alias("image_b"), F.col("l_discount").alias("kp_a"), F.col("l_tax").alias("kp_b"))
    return canonical(line, swapped=(("kp_a", "kp_b"),))


@query(
    "match_filter",
    """WITH k AS (SELECT l_orderkey AS pair_id, l_quantity * 2 AS xa, l_linenumber * 10.0 AS ya, l_quantity * 2 + 5 AS xb, l_linenumber * 10.0 - 5 AS yb, 1 - l_discount * 5 AS c FROM lineitem)
    SELECT pair_id, CAST(count(*) FILTER (WHERE round(c, 6) >= 0.7 AND xa < 90 AND ya < 60 AND xb < 90 AND yb < 60 AND yb >= 0) AS INTEGER) AS num_matches FROM k GROUP BY 1""",
)
def match_filter(spark, sf_dir):
    from ..operators.gates import match_filter as keep

    q, n = F.col("l_quantity") * 2, F.col("l_linenumber") * 10.0
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    rows = I.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair_id"), F.struct(point(q, n).alias("a"), point(q + 5, n - 5).alias("b"), F.round(1 - F.col("l_discount") * 5, 6).alias("c")).alias("m"))
    matches = rows.groupBy("pair_id").agg(F.collect_list("m").alias("m")).select("pair_id", F.col("m.a").alias("keypoints_a"), F.col("m.b").alias("keypoints_b"), F.col("m.c").alias("confidence"))
    w, h = F.lit(90), F.lit(60)
    return keep(matches, 0.7, w, h, w, h).select("pair_id", "num_matches")


@query("ts_packets", "SELECT doc_id, CAST(unnest(range(0, strlen(text) // 188)) AS INTEGER) AS packet_no FROM documents WHERE strlen(text) >= 188")
def ts_packets(spark, sf_dir):
    """Texts as bundles of packets; tests hold the bytes of packets against slices."""
    from ..sources.files import ts_packets as split

    bundles = I.read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return split(bundles).where(F.octet_length("packet") == 188).select("doc_id", "packet_no")


@query(
    "filler_order",
    """WITH o AS (SELECT doc_id AS image_id FROM labels WHERE quality = 0), m AS (SELECT doc_id AS image_id FROM labels WHERE toxic = 1), g AS (SELECT doc_id AS image_id FROM documents WHERE doc_id % 3 <> 0),
    u AS (SELECT image_id, 0 AS k FROM o UNION SELECT image_id, 1 FROM m WHERE image_id IN (FROM g) AND image_id NOT IN (FROM o))
    SELECT image_id, CAST(row_number() OVER (ORDER BY k, image_id) AS INTEGER) AS filler_no FROM u""",
)
def filler_order(spark, sf_dir):
    from ..operators.coverage import filler_order as order

    labels, ids = I.read(spark, sf_dir, "labels"), F.col("doc_id").alias("image_id")
    return order(labels.where("quality = 0").select(ids), labels.where("toxic = 1").select(ids), I.read(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(ids))
