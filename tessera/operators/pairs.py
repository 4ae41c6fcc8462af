"""Candidate pairs of a catalog: next neighbours in capture order, and neighbours in space within a calibrated radius.

The catalog here is flat: image_id, flight_id, latitude, longitude, altitude_m, yaw_deg; see catalog_columns().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import materialize
from ..functions import geo
from . import robust
from .numbering import numbered

XYZ = ("x", "y", "z")


def catalog_columns(catalog: DataFrame) -> DataFrame:
    """The flat columns of a nested catalog."""
    return catalog.select(
        "image_id", F.col("mission.flight_id").alias("flight_id"), F.col("gps.latitude").alias("latitude"), F.col("gps.longitude").alias("longitude"),
        F.col("gps.altitude_m").alias("altitude_m"), F.col("gimbal_pose.yaw_deg").alias("yaw_deg"),
    )


def next_neighbours(df: DataFrame, k: int, group: str = "flight_id", key: str = "image_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row with the next k of its group in key order: (group, a, b), and a struct of kept columns of either side.

    Rows meet by (group, position): a row is sent to the k positions after it, and no task needs a whole group.
    """
    placed = numbered(df.select(group, key, *keep).withColumn(group, F.coalesce(F.col(group), F.lit(""))), [group], [key])
    row = F.struct(key, *keep)
    ahead = placed.select(group, row.alias("a"), F.explode(F.sequence(F.col("rn") + 1, F.col("rn") + k)).alias("rn"))
    return ahead.join(placed.select(group, row.alias("b"), "rn"), [group, "rn"]).select(group, "a", "b")


def enu(catalog: DataFrame) -> DataFrame:
    """Located rows with local metres x, y, z about the mean position of all of them."""
    located = catalog.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    mean = located.agg(F.avg("latitude").alias("_lat0"), F.avg("longitude").alias("_lon0"))
    at = geo.local_xyz_m(F.col("latitude"), F.col("longitude"), F.col("altitude_m"), F.col("_lat0"), F.col("_lon0"))
    # One row of means is broadcast.
    return located.join(F.broadcast(mean)).withColumn("_at", at).select(*located.columns, "_at.x", "_at.y", "_at.z")


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size).cast("long")


def _distance(a: str, b: str, dims: tuple[str, ...]) -> Column:
    return F.sqrt(sum((F.pow(F.col(f"{a}.{d}") - F.col(f"{b}.{d}"), 2) for d in dims), F.lit(0.0)))


def radius_pairs(points: DataFrame, radius: float, key: str = "image_id", dims: tuple[str, ...] = XYZ, within: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with a < b whose distance is at most radius: (a, b, distance), a and b structs of key, dims, kept columns.

    Space is cut into cells as wide as the radius. A row goes to its own cell and, as the left side, to the half of the
    neighbouring cells that comes first, so each pair of cells meets once; the distance decides. `within` columns have to
    be equal. A crowded cell is a skewed join key, which Spark splits at run time.
    """
    import itertools

    if radius < 0:
        raise ValueError("the radius has to be at least zero")
    base = points.select(F.struct(key, *dims, *keep).alias("row"), *within, *(_cell(d, radius or 1.0).alias(f"_c{i}") for i, d in enumerate(dims)))
    cells = [f"_c{i}" for i in range(len(dims))]
    half = [s for s in itertools.product((-1, 0, 1), repeat=len(dims)) if s >= (0,) * len(dims)]
    steps = F.array(*(F.array(*(F.lit(x) for x in s)) for s in half))
    left = base.select(F.col("row").alias("a"), *within, F.explode(steps).alias("_s"), *cells)
    left = left.select("a", *within, *(F.col(c) + F.col("_s")[i].cast("long") for i, c in enumerate(cells)), (F.forall("_s", lambda x: x == 0)).alias("_own"))
    left = left.toDF("a", *within, *cells, "_own")
    met = left.join(base.withColumnRenamed("row", "b"), [*within, *cells])
    near = met.where((~F.col("_own") | (F.col(f"a.{key}") < F.col(f"b.{key}"))) & (F.col(f"a.{key}") != F.col(f"b.{key}"))).withColumn("distance", _distance("a", "b", dims))
    swap = F.col(f"a.{key}") > F.col(f"b.{key}")
    return near.where(F.col("distance") <= radius).select(*within, F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), "distance")


#: Places in a cell that nearest_distance() begins with, at most.
CELL_PLACES = 32


def nearest_distance(points: DataFrame, start: float, key: str = "image_id", dims: tuple[str, ...] = XYZ) -> DataFrame:
    """(key, nn): the distance of each row's nearest other row; null for a lone row.

    Rows in one place are zero apart. Other places look within one cell around them, beginning with cells of width start, or
    narrower ones that hold few places each; those that find nobody within that width look again in cells twice as wide.
    """
    import itertools

    where = F.struct(*dims)
    rows = points.select(key, *dims)
    grouped = rows.groupBy(*dims).agg(F.count("*").alias("_rows"))
    places = materialize(grouped, "places")
    extent = places.agg(*(F.max(d) - F.min(d) for d in dims), F.count("*")).first()
    same = F.when(F.col("_rows") > 1, F.lit(0.0))
    if extent[-1] < 2:
        return rows.join(places.select(*dims, same.alias("nn")), list(dims), "left").select(key, "nn")
    size = start
    while size > start / 2**20:
        cells = [_cell(d, size).alias(f"_c{i}") for i, d in enumerate(dims)]
        most = places.groupBy(*cells).count().agg(F.max("count")).first()[0]
        if most <= CELL_PLACES:
            break
        size /= max(2.0, (most / CELL_PLACES) ** (1 / len(dims)))
    widest = max(start, *(x or 0.0 for x in extent[:-1])) * len(dims) ** 0.5 + start
    steps = F.array(*(F.array(*(F.lit(x) for x in s)) for s in itertools.product((-1, 0, 1), repeat=len(dims))))
    open_places, done = places.where("_rows = 1"), places.where("_rows > 1").select(*dims, F.lit(0.0).alias("nn"))
    while True:
        cells = [f"_c{i}" for i in range(len(dims))]
        base = places.select(where.alias("b"), *(_cell(d, size).alias(c) for d, c in zip(dims, cells, strict=True)))
        ask = open_places.select(where.alias("a"), F.explode(steps).alias("_s"))
        ask = ask.select("a", *((F.floor(F.col(f"a.{d}") / size).cast("long") + F.col("_s")[i]).alias(c) for i, (d, c) in enumerate(zip(dims, cells, strict=True))))
        met = ask.join(base, cells).where(F.col("a") != F.col("b"))
        found = met.groupBy("a").agg(F.min(_distance("a", "b", dims)).alias("nn")).where(F.col("nn") <= size)
        found = materialize(found.select("a.*", "nn"), "nearest")
        done = done.unionByName(found)
        open_places = materialize(open_places.join(found, list(dims), "left_anti"), "unsettled")
        if size > widest or open_places.isEmpty():
            return rows.join(done, list(dims)).select(key, "nn")
        size *= 2


def calibrated_radius(points: DataFrame, most: float, multiplier: float = 3.0, key: str = "image_id") -> float:
    """multiplier times the 90th percentile of the distances to the nearest neighbour, at most `most`."""
    p90 = robust.quantiles(nearest_distance(points, most, key), "nn", [0.9])
    return most if p90 is None else min(p90[0] * multiplier, most)


def gate(pairs: DataFrame, radius: float, view: float) -> DataFrame:
    """Drops spatial pairs known to be farther apart than radius, and pairs known to look more than view apart."""
    near = (F.col("reason") != "gps_proximity") | F.coalesce(F.col("gps_distance_m") <= radius, F.lit(True))
    return pairs.where(near & F.coalesce(F.col("view_angle_delta_deg") <= view, F.lit(True)))


def first_writer(pairs: DataFrame, priority: Column) -> DataFrame:
    """One row per unordered pair, the one of least priority, ids in order."""
    keyed = canonical(pairs).withColumn("_p", priority)
    best = F.row_number().over(Window.partitionBy("image_a", "image_b").orderBy("_p", "reason"))
    return keyed.withColumn("_n", best).where("_n = 1").drop("_n", "_p")


def canonical(pairs: DataFrame, a: str = "image_a", b: str = "image_b", swapped: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Ids in order; columns in `swapped` change sides with them."""
    turn = F.col(a) > F.col(b)
    columns = {a: F.least(a, b), b: F.greatest(a, b)}
    for x, y in swapped:
        columns |= {x: F.when(turn, F.col(y)).otherwise(F.col(x)), y: F.when(turn, F.col(x)).otherwise(F.col(y))}
    return pairs.withColumns(columns)


def _measured(pairs: DataFrame, reason: str) -> DataFrame:
    side = lambda s, *cs: [F.col(f"{s}.{c}") for c in cs]
    place = ("latitude", "longitude", "altitude_m")
    return pairs.select(
        F.col("a.image_id").alias("image_a"),
        F.col("b.image_id").alias("image_b"),
        geo.distance_3d_m(*side("a", *place), *side("b", *place)).alias("gps_distance_m"),
        geo.angle_delta_deg(F.col("a.yaw_deg"), F.col("b.yaw_deg")).alias("view_angle_delta_deg"),
        F.lit(reason).alias("reason"),
    )


def select_pairs(catalog: DataFrame, k: int = 4, most_m: float = 8.0, view_deg: float = 20.0, multiplier: float = 3.0, cap: int = 0) -> DataFrame:
    """Candidate pairs of a flat catalog: next neighbours first, then neighbours in space, each unordered pair once.

    Next neighbours are gated by view alone. cap limits the spatial pairs of an image, see degree_capped(); 0 is no limit.
    """
    place = ("latitude", "longitude", "altitude_m", "yaw_deg")
    points = materialize(enu(catalog), "points")
    radius = calibrated_radius(points, most_m, multiplier)
    following = _measured(next_neighbours(catalog, k, keep=place), "temporal_neighbor")
    near = radius_pairs(points, radius, keep=place)
    spatial = _measured(near, "gps_proximity")
    first = gate(following, radius, view_deg)
    if cap:
        apart = near.select(F.col("a.image_id").alias("image_a"), F.col("b.image_id").alias("image_b"), F.col("distance").alias("xyz_m"))
        rest = canonical(gate(spatial, radius, view_deg)).join(canonical(first).select("image_a", "image_b"), ["image_a", "image_b"], "left_anti")
        chosen = degree_capped(rest.join(canonical(apart), ["image_a", "image_b"]), cap)
        return canonical(first).unionByName(chosen.select(*first.columns))
    both = first.unionByName(gate(spatial, radius, view_deg))
    return first_writer(both, F.when(F.col("reason") == "temporal_neighbor", 0).otherwise(1))


def degree_capped(pairs: DataFrame, cap: int, group: str | None = None, by: str = "xyz_m") -> DataFrame:
    """Nearest first, a pair stays while one of its images still has fewer than cap; ties by ids.

    An image's first cap pairs all stay, since it has fewer than cap before each of them; from then on it has cap. So a pair
    stays exactly if it is among the first cap pairs of one of its images, and no order over all pairs has to be walked. The
    first ones of an image are sought within each task before they meet, so an image of any number of pairs is no crowd.
    With a group, images of different groups are different. Equal rows count each.
    """
    within = [] if group is None else [group]
    place = [by, "image_a", "image_b"]
    one = F.row_number().over(Window.partitionBy(*within, *place).orderBy(F.lit(0)))
    rows = materialize(pairs.withColumn("_copy", one), "near-pairs")
    ends = rows.select(*within, *place, "_copy", F.explode(F.array("image_a", "image_b")).alias("_image"))
    first = Window.partitionBy(*within, "_image").orderBy(*place, "_copy")
    kept = ends.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= cap).select(*within, *place, "_copy").distinct()
    same = F.col("l._copy") == F.col("r._copy")
    for c in (*within, *place):
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return rows.alias("l").join(kept.alias("r"), same, "left_semi").select(*pairs.columns)
