"""Photo folders and files, cameras, matches and fits, over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..durable import shared_dir
from ..functions import geo, linalg
from ..operators import consensus, graph, homography, kernels, observations, robust
from ..sources import files, messages
from ..streaming import capture
from . import inputs as I
from .registry import query


def fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


@query("stitch_graph", "SELECT l_orderkey, l_linenumber, least(l_partkey, l_suppkey) AS image_a, greatest(l_partkey, l_suppkey) AS image_b, round(1.0 / greatest(l_discount * 10, 1e-6), 6) AS weight FROM lineitem WHERE l_returnflag = 'N'")
def stitch_graph(spark, sf_dir):
    line = I.read(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "N", "OK").otherwise("LOW_MATCH")
    results = line.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("image_a"), F.col("l_suppkey").alias("image_b"), status.alias("status"), (F.col("l_discount") * 10).alias("inlier_ratio"))
    return graph.stitch_graph(results).select("l_orderkey", "l_linenumber", "image_a", "image_b", F.round("weight", 6).alias("weight"))


@query("flat_listing", "SELECT '/photos/p' || CAST(page_id AS VARCHAR) || ['.jpg', '.JPEG', '.png'][CAST(page_id % 3 AS INTEGER) + 1] AS path FROM pages WHERE page_id % 3 < 2 AND page_id % 5 <> 0")
def flat_listing(spark, sf_dir):
    k = F.col("page_id")
    ending = F.element_at(F.array(*map(F.lit, (".jpg", ".JPEG", ".png"))), (k % 3 + 1).cast("int"))
    folder = F.when(k % 5 == 0, "/photos/sub/p").otherwise("/photos/p")
    paths = I.read(spark, sf_dir, "pages").select(F.concat(folder, k.cast("string"), ending).alias("path"))
    return files.flat_listing(paths.unionByName(paths), "/photos/")


@query("direction_folders", "SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]+)/', 1) AS direction FROM pages WHERE regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]+)/', 1) <> ''")
def direction_folders(spark, sf_dir):
    return files.direction_folders(I.read(spark, sf_dir, "pages"), F.nullif(F.regexp_extract("url", r"^[a-z]+://[^/]+/([^/?#]+)/", 1), F.lit("")))


def photos(spark, sf_dir):
    """A photo file per page, with an XMP packet but for every fifth."""
    k = F.col("page_id").cast("string")
    packet = F.concat(
        F.lit('<x:xmpmeta xmlns:x="x" xmlns:d="d"><Description d:Model="M&amp;'), k, F.lit('" d:GpsLatitude="'), (F.col("page_id") / 8 + 30).cast("string"), F.lit('" d:GpsLongtitude="'),
        (-F.col("page_id") / 4).cast("string"), F.lit('" d:GimbalYawDegree="'), F.when(F.col("page_id") % 3 == 0, "north").otherwise("12.5"), F.lit('"/></x:xmpmeta>'),
    )
    content = F.concat(F.unhex(F.lit("FFD8")), F.encode(F.when(F.col("page_id") % 5 == 0, "no packet").otherwise(packet), "UTF-8"))
    path = F.concat(F.lit("/flight"), (F.col("page_id") % 4).cast("string"), F.lit("/img"), k, F.lit(".jpg"))
    return I.read(spark, sf_dir, "pages").select(path.alias("path"), content.alias("content")).withColumn("length", F.octet_length("content").cast("long"))


@query(
    "catalog_read_again",
    """SELECT 'img' || CAST(page_id AS VARCHAR) AS image_id, 'flight' || CAST(page_id % 4 AS VARCHAR) AS flight_id, CASE WHEN page_id % 5 <> 0 THEN 'M&' || CAST(page_id AS VARCHAR) END AS camera_model,
      CASE WHEN page_id % 5 <> 0 THEN page_id / 8 + 30 END AS latitude, CASE WHEN page_id % 5 <> 0 THEN -page_id / 4 END AS longitude, CASE WHEN page_id % 5 <> 0 AND page_id % 3 <> 0 THEN 12.5 END AS yaw_deg FROM pages""",
)
def catalog_read_again(spark, sf_dir):
    """Photo metadata, written as a flat catalog for half of the files, then for all, which reads the other half alone."""
    images, path = photos(spark, sf_dir), fresh(spark, "catalog")
    files.cached_catalog(images.where(F.col("path").startswith("/flight0") | F.col("path").startswith("/flight1")), path)
    flat = files.flatten(files.cached_catalog(images, path))
    of = lambda c: F.col(f"`{c}`")
    return flat.select("image_id", of("mission.flight_id").alias("flight_id"), "camera_model", of("gps.latitude").alias("latitude"), of("gps.longitude").alias("longitude"), of("gimbal_pose.yaw_deg").alias("yaw_deg"))


@query(
    "exif_fill",
    """SELECT 'img' || CAST(page_id AS VARCHAR) AS image_id, CASE WHEN page_id % 5 <> 0 THEN page_id / 8 + 30 ELSE round(-(10 + (page_id % 60) / 60.0 + 30.0 / 3600.0), 6) END AS latitude,
      CASE WHEN page_id % 5 <> 0 THEN 'M&' || CAST(page_id AS VARCHAR) ELSE 'Camera' END AS camera_model, '2026-01-02T03:04:' || printf('%02d', page_id % 60) AS timestamp_utc, CAST(page_id % 50 AS DOUBLE) AS focal_length_mm FROM pages""",
)
def exif_fill(spark, sf_dir):
    """EXIF fills what XMP leaves open."""
    catalog = files.metadata(photos(spark, sf_dir))
    k = F.regexp_extract("file_path", r"img(\d+)", 1).cast("long")
    second, minute = F.format_string("%02d", k % 60), (k % 60).cast("string")
    tags = {"GPSLatitude": F.concat(F.lit("10.0,"), minute, F.lit(",30.0")), "GPSLatitudeRef": F.lit("S"), "GPSLongitude": F.lit("1.0,0.0,0.0"), "Model": F.lit("Camera"), "DateTime": F.concat(F.lit("2026:01:02 03:04:"), second), "FocalLength": (k % 50).cast("string")}
    exif = catalog.select("file_path", F.create_map(*(x for t, v in tags.items() for x in (F.lit(t), v))).alias("tags"))
    return files.with_exif(catalog, exif).select("image_id", F.round("gps.latitude", 6).alias("latitude"), "camera_model", "timestamp_utc", F.col("camera.focal_length_mm").alias("focal_length_mm"))


@query(
    "flv_replay",
    """WITH t AS (SELECT doc_id, doc_id * 7 % 100000 AS ts, strlen(text) AS n FROM documents), g AS (SELECT doc_id, 0 AS tag_no, 9 AS type, ts, n AS size, ts AS wait FROM t UNION ALL SELECT doc_id, 1, 8, ts + 40, 3, 40 FROM t)
    SELECT CAST(doc_id AS VARCHAR) AS path, tag_no, type, ts AS timestamp_ms, size, 1000 + ts AS due_ms, wait AS wait_ms FROM g""",
)
def flv_replay(spark, sf_dir):
    """Each document as an FLV file of two tags, its tags, and when they are due."""
    data, ts = F.encode("text", "UTF-8"), F.col("doc_id") * 7 % 100_000
    number = lambda n, digits: F.lpad(F.hex(n.cast("long")), digits, "0")
    head = lambda kind, size, at: F.unhex(F.concat(F.lit(kind), number(size, 6), number(at, 6), F.lit("00000000")))
    content = F.concat(F.unhex(F.lit("464C5601050000000900000000")), head("09", F.octet_length("text"), ts), data, F.unhex(F.lit("00000000")), head("08", F.lit(3), ts + 40), F.unhex(F.lit("616263")))
    clips = I.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), content.alias("content"))
    return messages.replay(files.flv_tags(clips), F.lit(1000))


@query(
    "concat_lines",
    """WITH f AS (SELECT doc_id, 'file ''' || source || '/' || CAST(doc_id AS VARCHAR) || '.jpg''' AS v FROM documents)
    SELECT v AS value FROM f UNION ALL SELECT 'duration 0.100000' FROM f UNION ALL SELECT arg_max(v, doc_id) FROM f""",
)
def concat_lines(spark, sf_dir):
    frames = I.read(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"))
    return files.concat_list(frames, "path", "doc_id", 10.0)


@query(
    "assignments",
    """SELECT CASE WHEN n_nationkey % 4 <> 0 THEN n_name END AS topic, n_nationkey % 3 AS version, CASE WHEN n_nationkey % 2 = 0 THEN n_name || '|x' ELSE '' END AS directions FROM nation WHERE n_nationkey % 5 <> 0""",
)
def assignments(spark, sf_dir):
    """Assignment files written from a table, one in five of them broken."""
    k, path = F.col("n_nationkey"), fresh(spark, "assignments")
    whole = F.to_json(F.struct(F.when(k % 4 != 0, F.col("n_name")).otherwise(" ").alias("Topic"), (k % 3).alias("Version"), F.when(k % 2 == 0, F.array("n_name", F.lit("x"))).alias("Directions")))
    texts = I.read(spark, sf_dir, "nation").select(F.when(k % 5 == 0, F.lit('{"Topic": ')).otherwise(whole).alias("value"), "n_nationkey")
    texts.repartition(25, "n_nationkey").write.partitionBy("n_nationkey").text(path)
    return files.assignments(spark, path).select(F.col("Topic").alias("topic"), F.col("Version").alias("version"), F.concat_ws("|", "Directions").alias("directions"))


@query("local_metres", f"WITH {I.LOCATED}, {I.MEANS} SELECT image_id, round(radians(longitude - lon0) * cos(radians(lat0)) * 6378137.0, 6) AS x, round(radians(latitude - lat0) * 6378137.0, 6) AS y FROM located, means WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def local_metres(spark, sf_dir):
    """Local metres on the equator's radius."""
    located = I.located(spark, sf_dir).where("latitude IS NOT NULL AND longitude IS NOT NULL")
    mean = located.agg(F.avg("latitude").alias("lat0"), F.avg("longitude").alias("lon0"))
    at = geo.local_xyz_m(F.col("latitude"), F.col("longitude"), F.col("altitude_m"), F.col("lat0"), F.col("lon0"), 6_378_137.0)
    return located.join(F.broadcast(mean)).withColumn("at", at).select("image_id", F.round("at.x", 6).alias("x"), F.round("at.y", 6).alias("y"))


@query(
    "plane_footprints",
    """WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 10 AS ox, CAST(embedding[2] AS DOUBLE) * 10 AS oy, 5 + abs(CAST(embedding[3] AS DOUBLE)) * 10 AS d FROM embeddings),
    b AS (SELECT vec_id, (0 - 320) * d / 500 - ox AS x0, (0 - 240) * d / 500 - oy AS y0, (640 - 320) * d / 500 - ox AS x1, (480 - 240) * d / 500 - oy AS y1 FROM e),
    r AS (SELECT vec_id, x0, y1, greatest(floor(x0), 0) AS l, greatest(floor(y0), 0) AS t, least(ceil(x1), 6) AS r, least(ceil(y1), 4) AS u FROM b)
    SELECT vec_id, round(x0, 6) AS x0, round(y1, 6) AS y1, CASE WHEN r > l AND u > t THEN CAST(l AS BIGINT) END AS x, CASE WHEN r > l AND u > t THEN CAST(r - l AS BIGINT) END AS w, CASE WHEN r > l AND u > t THEN CAST(u - t AS BIGINT) END AS h FROM r""",
)
def plane_footprints(spark, sf_dir):
    """Images carried to a plane by its homography, their boxes, and those in whole pixels of a canvas."""
    e = lambda i: F.col("embedding")[i].cast("double")
    v = linalg.vector
    unit = F.array(*(F.lit(float(i in (0, 4, 8))) for i in range(9)))
    k = F.array(*(F.lit(float(x)) for x in (500, 0, 320, 0, 500, 240, 0, 0, 1)))
    m = linalg.plane_homography(k, unit, v(F.lit(0.0), F.lit(0.0), 5 + F.abs(e(2)) * 10), v(e(0) * 10, e(1) * 10, F.lit(0.0)), v(F.lit(1.0), F.lit(0.0), F.lit(0.0)), v(F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    box = I.read(spark, sf_dir, "embeddings").select("vec_id", m.alias("m")).select("vec_id", linalg.bounds(F.col("m"), F.lit(640.0), F.lit(480.0)).alias("b"))
    roi = box.withColumn("roi", linalg.clamp_roi(F.col("b"), 6, 4))
    return roi.select("vec_id", F.round("b.x0", 6).alias("x0"), F.round("b.y1", 6).alias("y1"), *(F.col(f"roi.{c}").cast("long").alias(c) for c in "xwh"))


PLACES = "SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 60 AS x, CAST(embedding[2] AS DOUBLE) * 60 AS y, CAST(embedding[3] AS DOUBLE) * 60 AS z FROM embeddings"


def places(spark, sf_dir):
    return I.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), *((F.col("embedding")[i].cast("double") * 60).alias(c) for i, c in enumerate("xyz")))


@query(
    "near_cameras",
    f"""WITH p AS ({PLACES}), g AS (SELECT a.vec_id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS gap FROM p a, p b WHERE b.vec_id % 20 = 0 GROUP BY 1),
    m AS (SELECT quantile_cont(gap, 0.5) AS half FROM g) SELECT vec_id AS point_id, round(gap, 6) AS gap FROM g, m WHERE gap < least(1.5 * half, 150.0)""",
)
def near_cameras(spark, sf_dir):
    p = places(spark, sf_dir)
    return robust.near_cameras(p, p.where("point_id % 20 = 0").select("x", "y", "z"), 1.5).select("point_id", F.round("gap", 6).alias("gap"))


@query("off_plane", f"SELECT vec_id AS point_id FROM ({PLACES}) WHERE abs(z - 2) > 3 AND abs(z - 2) <= 9")
def off_plane(spark, sf_dir):
    return places(spark, sf_dir).where(observations.off_plane(robust.plane_distance([0, 0, 2], [0, 0, 1]), 3.0, 9.0)).select("point_id")


@query(
    "self_repeats",
    """WITH f AS (SELECT vec_id, CAST(label AS VARCHAR) AS image_id, CAST(embedding[1] AS DOUBLE) * 400 + 500 AS x, CAST(embedding[2] AS DOUBLE) * 400 + 500 AS y, 4.0 + vec_id % 5 AS size, CAST(vec_id * 17 % 360 AS DOUBLE) AS angle, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS d FROM embeddings),
    g AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, x) AS i FROM f),
    n AS (SELECT a.image_id, a.i, b.i AS j, list_distance(a.d, b.d) AS gap, row_number() OVER (PARTITION BY a.image_id, a.i ORDER BY list_distance(a.d, b.d), b.i) AS r FROM g a JOIN g b ON a.image_id = b.image_id AND a.i <> b.i),
    m AS (SELECT p.image_id, p.i, p.j FROM n p JOIN n s ON p.image_id = s.image_id AND p.i = s.i AND p.r = 1 AND s.r = 2 AND p.gap <= 0.95 * s.gap AND p.i < p.j),
    w AS (SELECT m.image_id, abs(b.y - a.y) AS dy, abs(b.x - a.x) AS dx, least(a.size, b.size) / greatest(a.size, b.size) AS scale_ratio, abs(((a.angle - b.angle + 180) % 360 + 360) % 360 - 180) AS turn
      FROM m JOIN g a ON a.image_id = m.image_id AND a.i = m.i JOIN g b ON b.image_id = m.image_id AND b.i = m.j),
    o AS (SELECT *, scale_ratio * greatest(0.0, cos(radians(turn))) AS weight FROM w)
    SELECT image_id, round(dy, 6) AS dy, round(weight, 6) AS weight, round(scale_ratio, 6) AS scale_ratio FROM o WHERE sqrt(dx * dx + dy * dy) >= 10 AND dx <= 0.5 * 1000 AND weight >= 0.1""",
)
def self_repeats(spark, sf_dir):
    e, k = F.col("embedding"), F.col("vec_id")
    features = I.read(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("image_id"), F.lit(1000).alias("width"), (e[0].cast("double") * 400 + 500).alias("x"), (e[1].cast("double") * 400 + 500).alias("y"),
        (k % 5 + 4.0).alias("size"), (k * 17 % 360).cast("double").alias("angle"), e.cast("array<double>").alias("descriptor"),
    )
    return observations.self_repeats(features, 0.5, 0.95, 10.0, 0.1).select("image_id", *(F.round(c, 6).alias(c) for c in ("dy", "weight", "scale_ratio")))


TILTED = "r AS (SELECT radians(vec_id % 60) AS b FROM embeddings)"


@query(
    "camera_directions",
    f"""WITH {TILTED}, u AS (SELECT sum(-cos(b)) AS y, sum(sin(b)) AS z FROM r), n AS (SELECT y / sqrt(y * y + z * z) AS uy, z / sqrt(y * y + z * z) AS uz FROM u),
    v AS (SELECT avg(-sin(b)) AS y, avg(-cos(b)) AS z FROM r, n WHERE sin(b) * uy + cos(b) * uz > -cos(radians(45.0))), w AS (SELECT uy, uz, y - (y * uy + z * uz) * uy AS y, z - (y * uy + z * uz) * uz AS z FROM v, n)
    SELECT round(uy, 6) AS up_y, round(uz, 6) AS up_z, round(y / sqrt(y * y + z * z), 6) AS normal_y, round(z / sqrt(y * y + z * z), 6) AS normal_z FROM w""",
)
def camera_directions(spark, sf_dir):
    """The mean up direction of tilted cameras, and the level direction from the wall to them."""
    b, zero = F.radians((F.col("vec_id") % 60).cast("double")), F.lit(0.0)
    cameras = I.read(spark, sf_dir, "embeddings").select(F.array(F.lit(1.0), zero, zero, zero, F.cos(b), -F.sin(b), zero, F.sin(b), F.cos(b)).alias("rotation"))
    up = robust.mean_up(cameras)
    normal = robust.wall_normal(cameras, up)
    row = [round(float(x), 6) + 0.0 for x in (up[1], up[2], normal[1], normal[2])]
    return spark.createDataFrame([row], "up_y double, up_z double, normal_y double, normal_z double")


OUTLIERS = "SELECT s_suppkey AS k, s_suppkey % 6 = 0 AS few, s_suppkey % 4 AS wrong FROM supplier"


@query(
    "pair_geometry",
    f"""WITH s AS ({OUTLIERS}) SELECT k AS image_a, k + 1 AS image_b, CASE WHEN few THEN 'LOW_MATCH' ELSE 'OK' END AS status, CASE WHEN few THEN 3 ELSE 16 + wrong END AS num_matches, CASE WHEN few THEN 0 ELSE 16 END AS num_inliers,
      CASE WHEN NOT few THEN round(16.0 / (16 + wrong), 6) ELSE 0.0 END AS inlier_ratio, CASE WHEN NOT few THEN CAST(k % 40 AS DOUBLE) END AS dx, CASE WHEN NOT few THEN CAST(-(k % 30) AS DOUBLE) END AS dy, CASE WHEN NOT few THEN 0.0 END AS error_px FROM s""",
)
def pair_geometry(spark, sf_dir):
    """Homographies of pairs whose keypoints are moved by a shift, all but the last few, which are moved elsewhere."""
    k = F.col("s_suppkey")

    def at(dx, dy, off):
        one = lambda i: F.struct((i * 37 % 100 + dx + F.when(i > 16, off * (i - 15)).otherwise(0)).cast("double").alias("x"), (i * i * 11 % 90 + dy - F.when(i > 16, off).otherwise(0)).cast("double").alias("y"))
        return F.transform(F.sequence(F.lit(1), F.when(k % 6 == 0, F.lit(3).cast("long")).otherwise(16 + k % 4)), one)

    matches = I.read(spark, sf_dir, "supplier").select(k.cast("string").alias("image_a"), (k + 1).cast("string").alias("image_b"), F.lit("OK").alias("status"), at(0, 0, 0).alias("keypoints_a"), at(k % 40, -(k % 30), 150).alias("keypoints_b"))
    g = homography.estimate(matches)
    return g.select(F.col("image_a").cast("long").alias("image_a"), F.col("image_b").cast("long").alias("image_b"), "status", "num_matches", "num_inliers", F.round("inlier_ratio", 6).alias("inlier_ratio"), (F.round(F.col("homography")[2], 3) + 0.0).alias("dx"), (F.round(F.col("homography")[5], 3) + 0.0).alias("dy"), (F.round("median_reprojection_error_px", 3) + 0.0).alias("error_px"))


def by_length():
    """A matcher that finds as many matches as the ids have letters, modulo 7. On some ids it fails, on others it hangs."""
    import time

    def match(a, b):
        if a.endswith("99"):
            raise ValueError(f"no photo {a[-4:]}")
        if a.endswith("500"):
            time.sleep(60)
        return [(float(i), 0.0, float(i) + 1, 0.0, 0.5) for i in range((len(a) + len(b)) % 7)]

    return match


@query(
    "matcher",
    """WITH p AS (SELECT p_partkey, p_name || p_partkey AS a, p_brand AS b FROM part), s AS (SELECT *, CASE WHEN a LIKE '%99' THEN 'MATCH_FAILED' WHEN a LIKE '%500' THEN 'MATCH_TIMEOUT' ELSE 'OK' END AS status FROM p)
    SELECT p_partkey, status, CASE WHEN status = 'OK' THEN CAST((length(a) + length(b)) % 7 AS INTEGER) ELSE 0 END AS num_matches, CASE WHEN status = 'MATCH_FAILED' THEN 'ValueError: no photo ' || a[-4:] END AS error FROM s""",
)
def matcher(spark, sf_dir):
    """A matcher passed in as a function, on every pair, with a time limit for each."""
    pairs = I.read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.col("p_partkey").cast("string")).alias("image_a"), F.col("p_brand").alias("image_b"))
    found = kernels.match_pairs(pairs, by_length, timeout_s=1.0).select("image_a", "image_b", "status", "num_matches", "error")
    return pairs.join(found, ["image_a", "image_b"]).select("p_partkey", "status", "num_matches", "error")


@query("similarity_fit", "SELECT count(*) FILTER (vec_id % 10 >= 3) AS n_near, 2.0 AS scale, -1.0 AS r01, 1.0 AS r10, 1.0 AS r22, 1.0 AS tx, 2.0 AS ty, 3.0 AS tz FROM embeddings")
def similarity_fit(spark, sf_dir):
    """The similarity that takes points to themselves turned, doubled and moved, but for three in ten that go elsewhere."""
    wrong = F.when(F.col("point_id") % 10 < 3, 3.0 + F.col("point_id") % 7).otherwise(0.0)
    p = places(spark, sf_dir)
    moved = p.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"), (-2 * F.col("y") + 1 + wrong).alias("bx"), (2 * F.col("x") + 2 - 2 * wrong).alias("by"), (2 * F.col("z") + 3 + wrong).alias("bz"))
    s = consensus.similarity(moved, 0.05)
    row = [s["n_near"], *(round(float(x), 6) + 0.0 for x in (s["scale"], s["rotation"][0][1], s["rotation"][1][0], s["rotation"][2][2], *s["translation"]))]
    return spark.createDataFrame([row], "n_near long, scale double, r01 double, r10 double, r22 double, tx double, ty double, tz double")


@query("frames_once", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS stream_id, event_id AS frame_id FROM events")
def frames_once(spark, sf_dir):
    """Frames written in three overlapping increments are there once each."""
    e = I.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("stream_id"), F.col("event_id").alias("frame_id"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at_s"))
    path = fresh(spark, "frames")
    for part in (e.where("frame_id % 3 < 2"), e.where("frame_id % 3 > 0"), e):
        capture.extract_increment(part, path)
    return spark.read.parquet(path).select("stream_id", "frame_id")


@query(
    "refined_homographies",
    "SELECT CAST(a.vec_id // 12 AS VARCHAR) AS facade, CAST(a.vec_id AS VARCHAR) AS node, round(100 * (CAST(a.embedding[1] AS DOUBLE) - CAST(r.embedding[1] AS DOUBLE)), 1) + 0.0 AS tx, round(100 * (CAST(a.embedding[2] AS DOUBLE) - CAST(r.embedding[2] AS DOUBLE)), 1) + 0.0 AS ty FROM embeddings a JOIN embeddings r ON r.vec_id = a.vec_id - a.vec_id % 12 AND a.vec_id // 12 < (SELECT max(vec_id) // 12 FROM embeddings)",
)
def refined_homographies(spark, sf_dir):
    """Facades of twelve images, each joined with the next three; one edge of each is far off, the start is off everywhere.
    The last facade may be cut short, and one wrong edge of few can't be told, so it is left out."""
    v = I.read(spark, sf_dir, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 100).alias("x"), (F.col("embedding")[1].cast("double") * 100).alias("y"), F.floor(F.col("vec_id") / 12).alias("f"))
    v = v.join(F.broadcast(v.agg(F.max("f").alias("last")))).where("f < last").drop("last")
    shift = lambda dx, dy: F.array(F.lit(1.0), F.lit(0.0), dx, F.lit(0.0), F.lit(1.0), dy, F.lit(0.0), F.lit(0.0), F.lit(1.0))
    ahead = v.select(F.col("f").alias("g"), F.col("vec_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    near = v.withColumn("b", F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 3))).join(ahead, "b").where("f = g")
    off = F.when((F.col("vec_id") % 12 == 5) & (F.col("b") == F.col("vec_id") + 2), 5000.0).otherwise(0.0)
    text = lambda c: F.col(c).cast("string")
    edges = near.select(text("f").alias("facade"), text("vec_id").alias("image_a"), text("b").alias("image_b"), shift(F.col("x") - F.col("bx") + off, F.col("y") - F.col("by")).alias("homography"))
    root = v.where("vec_id % 12 = 0").select("f", F.col("x").alias("rx"), F.col("y").alias("ry"))
    wobble = F.when(F.col("vec_id") % 12 == 0, 0.0).otherwise(F.col("vec_id") % 5 - 2.0)
    start = v.join(root, "f").select(text("f").alias("facade"), text("vec_id").alias("node"), shift(F.col("x") - F.col("rx") + wobble, F.col("y") - F.col("ry") - wobble).alias("to_reference"), F.lit(640.0).alias("width"), F.lit(480.0).alias("height"), (F.col("vec_id") % 12 == 0).alias("root"))
    h = F.col("to_reference")
    return graph.refine(edges, start).select("facade", "node", (F.round(h[2] / h[8], 1) + 0.0).alias("tx"), (F.round(h[5] / h[8], 1) + 0.0).alias("ty"))
