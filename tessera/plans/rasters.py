"""Coverage of a canvas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..durable import materialize
from ..functions import text
from ..operators import coverage as C
from ..operators import tiles
from . import inputs as I
from .registry import query

WIDTH, HEIGHT = 120, 90
FOOT = f"f AS (SELECT p_partkey AS image_id, CAST((p_partkey * 37) % {WIDTH + 20} - 10 AS INTEGER) AS x, CAST((p_partkey * 53) % {HEIGHT + 20} - 10 AS INTEGER) AS y, p_size % 9 AS w, (p_size * 3) % 8 AS h, p_brand FROM part)"
CELLS = f"{FOOT}, k AS (SELECT image_id, p_brand, cx, cy FROM f, range({WIDTH}) a(cx), range({HEIGHT}) b(cy) WHERE cx >= x AND cx < x + w AND cy >= y AND cy < y + h)"


def footprints(spark, sf_dir):
    k = F.col("p_partkey")
    return I.read(spark, sf_dir, "part").select(k.alias("image_id"), ((k * 37) % (WIDTH + 20) - 10).cast("int").alias("x"), ((k * 53) % (HEIGHT + 20) - 10).cast("int").alias("y"), (F.col("p_size") % 9).alias("w"), ((F.col("p_size") * 3) % 8).alias("h"), "p_brand")


def tiled(spark, sf_dir):
    return tiles.tiled(footprints(spark, sf_dir), WIDTH, HEIGHT, ("image_id", "p_brand"))


MAIN = "p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')"


@query("coverage_ratio", f"WITH {CELLS} SELECT p_brand, count(DISTINCT (cx, cy)) AS covered_cells, round(count(DISTINCT (cx, cy)) / {WIDTH * HEIGHT}.0, 6) AS coverage_ratio FROM k GROUP BY p_brand")
def coverage_ratio(spark, sf_dir):
    united = tiles.union(tiled(spark, sf_dir), ("p_brand",))
    return tiles.coverage(united, WIDTH, HEIGHT, ("p_brand",)).withColumn("coverage_ratio", F.round("coverage_ratio", 6))


@query("coverage_union", f"WITH {CELLS} SELECT cx, cy, max(image_id) AS value FROM k GROUP BY cx, cy")
def coverage_union(spark, sf_dir):
    """The greatest value of each cell: of layers in falling order of value, each one's own cells."""
    layers = tiled(spark, sf_dir).select(F.col("image_id").alias("value"), *tiles.TILE)
    return tiles.cells_of(tiles.claims(layers, "value", WIDTH, HEIGHT, last=True), WIDTH, HEIGHT)


@query(
    "gap_fill",
    f"WITH {CELLS}, free AS (SELECT * FROM k WHERE NOT ({MAIN}) AND (cx, cy) NOT IN (SELECT (cx, cy) FROM k WHERE {MAIN})) SELECT cx, cy, min(image_id) AS filler_no FROM free GROUP BY cx, cy",
)
def gap_fill(spark, sf_dir):
    layers = tiled(spark, sf_dir)
    fillers = layers.where(f"NOT ({MAIN})").select(F.col("image_id").alias("filler_no"), *tiles.TILE)
    return tiles.cells_of(tiles.claims(fillers, "filler_no", WIDTH, HEIGHT, taken=tiles.union(layers.where(MAIN))), WIDTH, HEIGHT)


@query("cell_owners", f"WITH {CELLS} SELECT cx, cy, max(image_id) AS owner FROM k GROUP BY cx, cy")
def cell_owners(spark, sf_dir):
    layers = tiled(spark, sf_dir).select(F.col("image_id").alias("owner"), *tiles.TILE)
    return tiles.cells_of(tiles.claims(layers, "owner", WIDTH, HEIGHT, last=True), WIDTH, HEIGHT)


@query(
    "seam_owners",
    f"""WITH {FOOT}, c AS (SELECT image_id, greatest(x, 0) AS x0, greatest(y, 0) AS y0, least(x + w, {WIDTH}) AS x1, least(y + h, {HEIGHT}) AS y1 FROM f),
    k AS (SELECT image_id, cx, cy, least(cx - x0 + 1, x1 - cx, cy - y0 + 1, y1 - cy) AS inside FROM c, range({WIDTH}) a(cx), range({HEIGHT}) b(cy) WHERE cx >= x0 AND cx < x1 AND cy >= y0 AND cy < y1)
    SELECT cx, cy, arg_max(image_id, inside * 1000000 - image_id) AS image_id FROM k GROUP BY cx, cy""",
)
def seam_owners(spark, sf_dir):
    """Each covered cell to the image whose border is farthest from it. Numbers beyond a million count as steps, as in the SQL."""
    feet = materialize(tiles.first_of_equal(footprints(spark, sf_dir), WIDTH, HEIGHT), "footprints")
    return tiles.cells_of(tiles.seams(tiles.tiled(feet, WIDTH, HEIGHT), WIDTH, HEIGHT, worth=1_000_000), WIDTH, HEIGHT)


#: A wall of 61 m x 42 m at 100 cells a metre, with footprints whose sides lie on a grid of UNIT cells.
WALL_W, WALL_H, UNIT = 6100, 4200, 50
ON_WALL = f"f AS (SELECT p_partkey AS image_id, p_brand, CAST((p_partkey * 37) % 122 - 3 AS INTEGER) AS x, CAST((p_partkey * 53) % 84 - 3 AS INTEGER) AS y, p_size % 9 + 4 AS w, (p_size * 3) % 8 + 4 AS h FROM part)"
WALL_CELLS = f"{ON_WALL}, k AS (SELECT image_id, p_brand, cx, cy FROM f, range({WALL_W // UNIT}) a(cx), range({WALL_H // UNIT}) b(cy) WHERE cx >= x AND cx < x + w AND cy >= y AND cy < y + h)"


def wall(spark, sf_dir):
    k = F.col("p_partkey")
    place = [((k * 37) % 122 - 3, "x"), ((k * 53) % 84 - 3, "y"), (F.col("p_size") % 9 + 4, "w"), ((F.col("p_size") * 3) % 8 + 4, "h")]
    feet = I.read(spark, sf_dir, "part").select(k.alias("image_id"), "p_brand", *((v * UNIT).cast("int").alias(c) for v, c in place))
    return tiles.tiled(feet, WALL_W, WALL_H, ("image_id", "p_brand"))


@query("wall_coverage", f"WITH {WALL_CELLS} SELECT p_brand, count(DISTINCT (cx, cy)) * {UNIT**2} AS covered_cells, round(count(DISTINCT (cx, cy)) * {UNIT**2} / {WALL_W * WALL_H}.0, 6) AS coverage_ratio FROM k GROUP BY p_brand")
def wall_coverage(spark, sf_dir):
    united = tiles.union(wall(spark, sf_dir), ("p_brand",))
    return tiles.coverage(united, WALL_W, WALL_H, ("p_brand",)).withColumn("coverage_ratio", F.round("coverage_ratio", 6))


@query(
    "wall_gap_fill",
    f"WITH {WALL_CELLS}, free AS (SELECT * FROM k WHERE NOT ({MAIN}) AND (cx, cy) NOT IN (SELECT (cx, cy) FROM k WHERE {MAIN})), got AS (SELECT cx, cy, min(image_id) AS filler_no FROM free GROUP BY cx, cy) SELECT filler_no, count(*) * {UNIT**2} AS cells FROM got GROUP BY filler_no",
)
def wall_gap_fill(spark, sf_dir):
    """How many cells each filler gets."""
    layers = wall(spark, sf_dir)
    fillers = layers.where(f"NOT ({MAIN})").select(F.col("image_id").alias("filler_no"), *tiles.TILE)
    got = tiles.claims(fillers, "filler_no", WALL_W, WALL_H, taken=tiles.union(layers.where(MAIN)))
    return got.groupBy("filler_no").agg(F.sum(F.bitmap_count("bits")).alias("cells"))


@query("wall_owners", f"WITH {WALL_CELLS}, got AS (SELECT cx, cy, max(image_id) AS image_id FROM k GROUP BY cx, cy) SELECT image_id, count(*) * {UNIT**2} AS cells FROM got GROUP BY image_id")
def wall_owners(spark, sf_dir):
    """How many cells each image has that no later one covers."""
    got = tiles.claims(wall(spark, sf_dir).select("image_id", *tiles.TILE), "image_id", WALL_W, WALL_H, last=True)
    return got.groupBy("image_id").agg(F.sum(F.bitmap_count("bits")).alias("cells"))


LETTER = "chr(CAST(65 + {i} % 26 AS INTEGER))"


@query(
    "grid_labels",
    f"WITH {FOOT}, g AS (SELECT image_id, CAST(floor((x + 10) * 4.7) AS BIGINT) AS c, CAST(floor((y + 10) / 5.0) AS BIGINT) AS r FROM f) SELECT image_id, CASE WHEN c >= 26 THEN {LETTER.format(i='(c // 26 - 1)')} ELSE '' END || {LETTER.format(i='c')} || CAST(r + 1 AS VARCHAR) AS cell FROM g",
)
def grid_labels(spark, sf_dir):
    f = footprints(spark, sf_dir)
    return f.select("image_id", text.grid_cell((F.col("x") + 10) * 4.7, (F.col("y") + 10) / 5.0, 1.0).alias("cell"))


@query(
    "point_in_box_topn",
    f"""WITH {FOOT}, q AS (SELECT s_suppkey AS point_id, (s_suppkey * 29) % {WIDTH} AS px, (s_suppkey * 31) % {HEIGHT} AS py FROM supplier),
    h AS (SELECT point_id, image_id, CAST(w AS BIGINT) * h AS area FROM q JOIN f ON px >= x AND px < x + w AND py >= y AND py < y + h), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY point_id ORDER BY area, image_id) AS INTEGER) AS rank FROM h)
    SELECT point_id, rank, image_id, area FROM r WHERE rank <= 5""",
)
def point_in_box_topn(spark, sf_dir):
    k = F.col("s_suppkey")
    points = I.read(spark, sf_dir, "supplier").select(k.alias("point_id"), ((k * 29) % WIDTH).alias("x"), ((k * 31) % HEIGHT).alias("y"))
    return C.images_at(points, footprints(spark, sf_dir), 5, 16).select("point_id", "rank", "image_id", "area")


@query(
    "grid_spread_cap",
    """WITH p AS (SELECT p_brand, p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, length(p_name) AS support FROM part),
    b AS (SELECT *, min(x) OVER w AS lx, greatest(max(x) OVER w - min(x) OVER w, 1e-6) AS sx, min(y) OVER w AS ly, greatest(max(y) OVER w - min(y) OVER w, 1e-6) AS sy, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY p_brand)),
    c AS (SELECT *, least(greatest(trunc((x - lx) / sx * 4), 0), 3) * 4 + least(greatest(trunc((y - ly) / sy * 4), 0), 3) AS cell FROM b),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, cell ORDER BY support DESC, p_partkey) <= 1 AS first FROM c),
    k AS (SELECT *, count(*) FILTER (WHERE first) OVER (PARTITION BY p_brand) AS kept, row_number() OVER (PARTITION BY p_brand, first ORDER BY cell, support DESC, p_partkey) AS rest FROM r)
    SELECT p_brand, p_partkey FROM k WHERE n <= 30 OR first OR rest <= 30 - kept""",
)
def grid_spread_cap(spark, sf_dir):
    p = I.read(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.length("p_name").alias("support"))
    return C.spread_cap(p, 30, "p_brand", "p_partkey", grid=4).select("p_brand", "p_partkey")


@query("point_splat", "SELECT CAST(floor(p_size / 5.0) AS BIGINT) AS cx, CAST(floor(p_retailprice / 10.0) AS BIGINT) AS cy, round(avg(p_retailprice), 6) AS value, count(*) AS n FROM part GROUP BY 1, 2")
def point_splat(spark, sf_dir):
    p = I.read(spark, sf_dir, "part").select((F.col("p_size") / 5.0).alias("u"), (F.col("p_retailprice") / 10.0).alias("v"), F.col("p_retailprice").alias("value"))
    return C.splat(p, 1.0, "value").withColumn("value", F.round("value", 6))
