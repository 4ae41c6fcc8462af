"""Robust statistics: quantile fences, mismatches, plane fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import materialize, release, ship
from ..functions import linalg

#: Values that may be collected once the histograms have narrowed a quantile down.
FEW = 10_000
BINS = 1024


def _interpolated(lo: float, hi: float, share: float) -> float:
    return lo if lo == hi or share == 0 else lo + (hi - lo) * share


#: Logarithms of the least and of the largest double are inside.
LOGS = (-745.2, 709.8)


def _bin(x: Column, a: Column, b: Column, stuck: Column, bins: int) -> Column:
    """The bin of x among those that [a, b], a < b, is cut into; a and b lie in different ones.

    Ranges of one sign and of many magnitudes are cut by magnitude, others evenly; where that was of no use (stuck), ranges
    around zero are cut by sign and magnitude. Bins are evenly wide also where b - a is beyond the largest double; they are at
    least as wide as the least double, and then at most twice as many.
    """
    inf, least = float("inf"), F.lit(5e-324)
    near = F.least(F.floor((x - a) / F.greatest((b - a) / bins, least)), F.lit(2 * bins))
    far = F.least(F.floor((x / 2 - a / 2) / F.greatest((b / 2 - a / 2) / bins, least)), F.lit(bins - 1))
    low, high = F.least(F.abs(a), F.abs(b)), F.greatest(F.abs(a), F.abs(b))
    share = (F.log(F.abs(x)) - F.log(low)) / (F.log(high) - F.log(low))
    step = F.least(F.floor(share * bins), F.lit(bins - 1))
    size = F.floor((F.log(F.abs(x)) - LOGS[0]) / (LOGS[1] - LOGS[0]) * bins) + 1
    return (
        F.when((a > 0) & (high > 4 * low), step)
        .when((b < 0) & (high > 4 * low), -step)
        .when(stuck & (a <= 0) & (b >= 0), F.when(x == 0, 0).otherwise(F.signum(x).cast("long") * size))
        .when(b - a < inf, near)
        .otherwise(far)
    )


def quantiles(df: DataFrame, value: str, probabilities: list[float], few: int = FEW, bins: int = BINS) -> list[float] | None:
    """Exact quantiles of a whole column, linearly interpolated; null and NaN are left out; None for an empty column.

    Each pass counts a histogram per sought rank, with partial counts in every task, and narrows the rank's range to one
    bin, whose least and greatest value are the next range. When a range holds few values, those are sorted. No task ever
    holds the column, whatever its size. Infinite values are counted at the ends, and the ranges are of the others; a
    quantile between an infinite and another value is infinite, and NaN between the two infinities.
    """
    col = F.col(value).cast("double")
    inf = float("inf")
    all_rows = df.where(col.isNotNull() & ~F.isnan(col)).select(col.alias("x"))
    rows = all_rows.where(F.abs("x") < inf)
    inside = F.when(F.abs("x") < inf, F.col("x"))
    low, high, n, minus, plus = all_rows.agg(F.min(inside), F.max(inside), F.count("*"), F.count_if(F.col("x") == -inf), F.count_if(F.col("x") == inf)).first()
    if not n:
        return None
    sought = sorted({r for p in probabilities for r in (int(np.floor(p * (n - 1))), int(np.ceil(p * (n - 1))))})
    found: dict[int, float] = {r: -inf if r < minus else inf for r in sought if r < minus or r >= n - plus}
    # range -> values below it, values inside, ranks inside, whether the last histogram told little
    open_ranges = {(low, high): (minus, n - minus - plus, [r for r in sought if r not in found], False)} if len(found) < len(sought) else {}
    while open_ranges:
        following = {}
        for (a, b), (below, inside, ranks, stuck) in open_ranges.items():
            part = rows.where(F.col("x").between(a, b))
            if a == b:
                found |= dict.fromkeys(ranks, a)
            elif inside <= few:
                values = [r[0] for r in part.sort("x").collect()]
                found |= {r: values[r - below] for r in ranks}
            else:
                bin_of = _bin(F.col("x"), F.lit(a), F.lit(b), F.lit(stuck), bins)
                got = sorted((r["bin"], r["n"], r["lo"], r["hi"]) for r in part.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect())
                if len(got) == 1:  # least and greatest lie in different bins, so this cannot be
                    raise RuntimeError(f"a histogram of {value} does not narrow {a!r} to {b!r}")
                at = below
                for _, count, lo, hi in got:
                    if mine := [r for r in ranks if at <= r < at + count]:
                        following[(lo, hi)] = (at, count, mine, 2 * count > inside)
                    at += count
        open_ranges = following
    out = []
    for p in probabilities:
        rank = p * (n - 1)
        out.append(_interpolated(found[int(np.floor(rank))], found[int(np.ceil(rank))], rank - np.floor(rank)))
    return out


#: Open ranges that are sent to every task; more meet the values by group.
SMALL_RANGES = 20_000


def _small(ranges: DataFrame) -> DataFrame:
    """A written table of ranges, marked for sending to all tasks if its counted size is small: groups are few, then, and a
    join by group would be a crowded one."""
    return F.broadcast(ranges) if ranges.count() <= SMALL_RANGES else ranges


def group_quantiles(df: DataFrame, group: str, value: str, probabilities: list[float], few: int = 1000, bins: int = BINS, most_rounds: int = 80) -> DataFrame:
    """(group, q): exact quantiles per group as an array, linearly interpolated; groups without values are left out.

    Like quantiles(), but ranges are rows of a table, one per group and sought rank: each round counts the values of a
    range by bin, with partial counts in every task, and keeps the bin that holds the rank. A range of few values is
    sorted. So neither a group's values nor its distinct values meet in one task, whatever their number.
    """
    col = F.col(value).cast("double")
    inf = float("inf")
    rows = df.where(col.isNotNull() & ~F.isnan(col)).select(F.col(group).alias("g"), col.alias("x"))
    inside = F.when(F.abs("x") < inf, F.col("x"))
    size = rows.groupBy("g").agg(F.min(inside).alias("a"), F.max(inside).alias("b"), F.count("*").alias("n"), F.count_if(F.col("x") == -inf).alias("minus"), F.count_if(F.col("x") == inf).alias("plus"))
    at = [F.col("n").cast("double") * p - p for p in probabilities]  # p * (n - 1)
    ranks = F.array_distinct(F.array(*(f(r).cast("long") for r in at for f in (F.floor, F.ceil))))
    size = materialize(size, "groups")
    asked = size.withColumn("rank", F.explode(ranks))
    outside = (F.col("rank") < F.col("minus")) | (F.col("rank") >= F.col("n") - F.col("plus"))
    found = asked.where(outside).select("g", "rank", F.when(F.col("rank") < F.col("minus"), -inf).otherwise(inf).alias("x"))
    open_ranges = asked.where(~outside).select("g", "a", "b", F.col("minus").alias("below"), (F.col("n") - F.col("minus") - F.col("plus")).alias("inside"), "rank", F.lit(False).alias("stuck"))
    rows = rows.where(F.abs("x") < inf)
    for _ in range(most_rounds):
        open_ranges = materialize(open_ranges, "quantile-ranges")
        settled = open_ranges.where((F.col("a") == F.col("b")) | (F.col("inside") <= few))
        spans = materialize(settled.select("g", "a", "b", "below").distinct(), "quantile-spans")
        within = F.col("r.g").eqNullSafe(F.col("s.g")) & F.col("r.x").between(F.col("s.a"), F.col("s.b"))
        # Values of a settled range, each once with its number: few, or one value that occurs often.
        values = rows.alias("r").join(_small(spans).alias("s"), within).groupBy("s.g", "s.a", "s.b", "s.below", "r.x").agg(F.count("*").alias("k"))
        upto = F.sum("k").over(Window.partitionBy("g", "a", "b").orderBy("x")) + F.col("below")
        placed = values.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("k"))
        hit = placed.alias("v").join(settled.alias("t"), F.col("v.g").eqNullSafe(F.col("t.g")) & (F.col("v.a") == F.col("t.a")) & (F.col("v.b") == F.col("t.b")) & (F.col("t.rank") >= F.col("v._from")) & (F.col("t.rank") < F.col("v._to")))
        found = found.unionByName(materialize(hit.select("t.g", "t.rank", "v.x"), "quantile-ranks"))
        left = open_ranges.where((F.col("a") != F.col("b")) & (F.col("inside") > few))
        if left.isEmpty():
            break
        wide = materialize(left.select("g", "a", "b", "below", "stuck").distinct(), "quantile-spans")
        bin_of = _bin(F.col("r.x"), F.col("s.a"), F.col("s.b"), F.col("s.stuck"), bins)
        counts = rows.alias("r").join(_small(wide).alias("s"), within).groupBy("s.g", "s.a", "s.b", "s.below", bin_of.alias("bin")).agg(F.count("*").alias("k"), F.min("r.x").alias("lo"), F.max("r.x").alias("hi"))
        to = F.sum("k").over(Window.partitionBy("g", "a", "b").orderBy("bin")) + F.col("below")
        placed = counts.withColumn("_to", to).withColumn("_from", F.col("_to") - F.col("k"))
        on = F.col("v.g").eqNullSafe(F.col("t.g")) & (F.col("v.a") == F.col("t.a")) & (F.col("v.b") == F.col("t.b")) & (F.col("t.rank") >= F.col("v._from")) & (F.col("t.rank") < F.col("v._to"))
        open_ranges = placed.alias("v").join(left.alias("t"), on).select("t.g", F.col("v.lo").alias("a"), F.col("v.hi").alias("b"), F.col("v._from").alias("below"), F.col("v.k").alias("inside"), "t.rank", (2 * F.col("v.k") > F.col("t.inside")).alias("stuck"))
    else:
        raise RuntimeError(f"quantiles did not settle in {most_rounds} rounds")
    known = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("m"))
    joined = size.alias("s").join(known.alias("k"), F.col("s.g").eqNullSafe(F.col("k.g"))).select(F.col("s.g").alias(group), "n", "m")
    lo, hi = ([F.element_at("m", f(r).cast("long")) for r in at] for f in (F.floor, F.ceil))
    between = [F.when((x == y) | (r == F.floor(r)), x).otherwise(x + (y - x) * (r - F.floor(r))) for x, y, r in zip(lo, hi, at, strict=True)]
    return joined.select(group, F.array(*between).alias("q"))


def robust_range(df: DataFrame, value: str, group: str | None = None, k: float = 3.0) -> DataFrame:
    """Least and greatest value within k interquartile ranges of the quartiles: lo, hi, q1, q3, per group if one is named.

    Where the quartiles coincide, or nothing is inside, plain least and greatest.
    """
    col = F.col(value).cast("double")
    if group is None:
        q = quantiles(df, value, [0.25, 0.75]) or [None, None]
        fences = df.sparkSession.range(1).select(F.lit(q[0]).cast("double").alias("q1"), F.lit(q[1]).cast("double").alias("q3"))
        rows = df.select(col.alias("x")).join(F.broadcast(fences))
        by = ["q1", "q3"]
    else:
        fences = group_quantiles(df, group, value, [0.25, 0.75]).select(group, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
        rows = df.select(group, col.alias("x")).join(fences, group)
        by = [group, "q1", "q3"]
    iqr = F.col("q3") - F.col("q1")
    inside = F.col("x").between(F.col("q1") - k * iqr, F.col("q3") + k * iqr) & (iqr > 1e-9)
    got = rows.groupBy(*by).agg(F.min(F.when(inside, F.col("x"))).alias("lo"), F.max(F.when(inside, F.col("x"))).alias("hi"), F.min("x").alias("all_lo"), F.max("x").alias("all_hi"))
    return got.select(*by, F.coalesce("lo", "all_lo").alias("lo"), F.coalesce("hi", "all_hi").alias("hi"))


def mismatches(errors: DataFrame, error: str = "error_m", least: float = 3.0, multiple: float = 10.0) -> DataFrame:
    """Rows whose error exceeds both `least` and `multiple` medians of all errors."""
    median = quantiles(errors, error, [0.5])
    threshold = least if median is None else max(least, multiple * median[0])
    return errors.where(F.col(error) > threshold).withColumn("threshold", F.lit(float(threshold)))


def moments(points: DataFrame, dims: tuple[str, ...] = ("x", "y", "z")):
    """Number, mean and covariance matrix of points, from sums about a point near the mean."""
    c = [F.col(d) for d in dims]
    near = points.agg(*(F.avg(x) for x in c)).first()
    if near[0] is None:
        return 0, None, None
    shifted = [x - F.lit(float(m)) for x, m in zip(c, near, strict=True)]
    sums = points.agg(F.count("*"), *(F.sum(x) for x in shifted), *(F.sum(shifted[i] * shifted[j]) for i in range(len(dims)) for j in range(len(dims)))).first()
    n, k = sums[0], len(dims)
    delta = np.array(sums[1 : 1 + k], float) / n
    return n, np.array(near, float) + delta, np.array(sums[1 + k :], float).reshape(k, k) / n - np.outer(delta, delta)


def principal_axes(points: DataFrame, dims: tuple[str, ...] = ("x", "y", "z")):
    """Mean, axes as rows (largest variance first), variances. Each axis's largest component is made positive."""
    n, mean, covariance = moments(points, dims)
    if not n:
        return None
    values, vectors = np.linalg.eigh(covariance)
    axes = vectors.T[::-1]
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return mean, axes, values[::-1]


def mean_up(cameras: DataFrame, rotation: str = "rotation") -> np.ndarray:
    """The mean up direction of cameras, of length 1; the z axis if they cancel out or there are none."""
    up = linalg.view_up(F.col(rotation))
    total = np.array(cameras.agg(*(F.sum(up[i]) for i in range(3))).first(), dtype=object)
    if total[0] is None or np.linalg.norm(total.astype(float)) < 1e-6:
        return np.array([0.0, 0.0, 1.0])
    return total.astype(float) / np.linalg.norm(total.astype(float))


def wall_normal(cameras: DataFrame, up: np.ndarray, rotation: str = "rotation", least: int = 4) -> np.ndarray | None:
    """The level direction from the wall to the cameras: the mean of the oblique cameras' reversed views, more than 45
    degrees off straight down. None if fewer than `least` look so."""
    view = linalg.view_forward(F.col(rotation))
    oblique = linalg.dot(view, linalg.vector(*up.tolist())) > -float(np.cos(np.radians(45.0)))
    n, *total = cameras.where(oblique).agg(F.count("*"), *(F.avg(-view[i]) for i in range(3))).first()
    if n < least:
        return None
    normal = np.array(total, float)
    normal = normal - (normal @ up) * up
    length = np.linalg.norm(normal)
    return None if length < 1e-6 else normal / length


def plane_distance(origin, normal, dims: tuple[str, ...] = ("x", "y", "z")) -> Column:
    return sum(((F.col(d) - float(o)) * float(n) for d, o, n in zip(dims, origin, normal, strict=True)), F.lit(0.0))


def near_plane(points: DataFrame, origin, normal, k: float = 3.0, rounds: int = 3, spread: float = 5.0, slab: float = 3.0, slab_share: float = 0.25, band: float = 1.5):
    """The points near a wall and their mean: fences on the distance along the normal, round by round; where what is left
    still spreads too far, the densest slab seeds a band around the wall instead."""
    from .sequence import densest_slab

    mean = lambda df: np.array(df.agg(F.avg("x"), F.avg("y"), F.avg("z")).first(), float)
    total = points.count()
    subset, size, centre = points, total, np.array(origin, float)
    for _ in range(rounds):
        at = points.withColumn("d", plane_distance(centre, normal))
        fence = robust_range(at, "d", k=k).first()
        kept = at.where(F.col("d").between(fence["lo"], fence["hi"])).drop("d")
        n = kept.count()
        if n == size or n < 10:
            break
        subset, size, centre = kept, n, mean(kept)
    p10, p90 = quantiles(subset.withColumn("d", plane_distance(centre, normal)), "d", [0.1, 0.9])
    if p90 - p10 <= spread:
        return subset, centre
    at = points.withColumn("d", plane_distance(centre, normal))
    best = densest_slab(at, "d", slab).agg(F.max_by(F.struct("d", "n"), F.struct("n", -F.col("d"))).alias("b")).first()["b"]
    if best["n"] < slab_share * total:
        return subset, centre
    centre = mean(at.where(F.col("d").between(best["d"], best["d"] + slab)))
    for _ in range(rounds):
        inside = points.where(F.abs(plane_distance(centre, normal)) <= band)
        if inside.count() < 10:
            break
        moved = mean(inside)
        if np.allclose(moved, centre):
            break
        centre = moved
    return points.where(F.abs(plane_distance(centre, normal)) <= band), centre


def facade_plane(points: DataFrame, cameras: DataFrame, px_per_m: float = 100.0, padding_m: float = 2.0) -> dict | None:
    """A wall's plane and canvas from points(x, y, z) and cameras(rotation, translation): origin, e_u across, e_v down,
    width and height in metres. e_u points to the right as the cameras see the wall. None without enough to go by."""
    up = mean_up(cameras)
    normal = wall_normal(cameras, up)
    axes = principal_axes(points)
    if axes is None:
        return None
    centre, directions, _ = axes
    if normal is None:
        normal = directions[2]
        centres = cameras.select(linalg.camera_center(F.col("rotation"), F.col("translation")).alias("c"))
        side = np.array(centres.agg(*(F.avg(F.col("c")[i]) for i in range(3))).first(), float) - centre
        normal = normal if side @ normal >= 0 else -normal
    wall, centre = near_plane(points, centre, normal)
    e_v = -(up - (up @ normal) * normal)
    e_v = e_v / np.linalg.norm(e_v)
    e_u = np.cross(e_v, -normal)
    spans = []
    for axis in (e_u, e_v):
        fence = robust_range(wall.withColumn("d", plane_distance(centre, axis)), "d").first()
        spans.append((fence["lo"] - padding_m, fence["hi"] + padding_m))
    origin = centre + spans[0][0] * e_u + spans[1][0] * e_v
    return {"origin": origin.tolist(), "e_u": e_u.tolist(), "e_v": e_v.tolist(), "px_per_m": px_per_m, "width_m": spans[0][1] - spans[0][0], "height_m": spans[1][1] - spans[1][0]}


def similarity(points: DataFrame, source: tuple[str, ...] = ("ax", "ay", "az"), target: tuple[str, ...] = ("bx", "by", "bz"), least: int = 3) -> dict | None:
    """Scale, rotation and translation that take source to target with least squares, from sums; None below `least` rows."""
    rows = points.dropna(subset=[*source, *target])
    n, mean, cov = moments(rows, (*source, *target))
    if n < least:
        return None
    cross, spread = cov[3:, :3], np.trace(cov[:3, :3])
    u, d, vt = np.linalg.svd(cross)
    sign = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    rotation = u @ sign @ vt
    scale = float((d * np.diag(sign)).sum() / spread) if spread > 0 else 1.0
    return {"scale": scale, "rotation": rotation.tolist(), "translation": (mean[3:] - scale * rotation @ mean[:3]).tolist()}


#: Cameras of a leaf of the partition, about, and leaves that are sent to every task; more of them meet the points by leaf.
LEAF_CAMERAS = 64
SENT_LEAVES = 4096


def camera_leaves(cameras: DataFrame, leaf: int = LEAF_CAMERAS, most_depth: int = 40) -> DataFrame:
    """cameras(x, y, z) in the leaves of a k-d partition: (leaf, x, y, z). Every round halves, at about the middle, the
    widest side of each leaf of more than `leaf` places; equal places are one."""
    now = cameras.select(*(F.col(d).cast("double").alias(d) for d in "xyz")).dropna().distinct().withColumn("leaf", F.lit("0"))
    now = materialize(now, "leaves")
    for _ in range(most_depth):
        sides = now.groupBy("leaf").agg(F.count("*").alias("n"), *(F.min(d).alias(f"lo_{d}") for d in "xyz"), *(F.max(d).alias(f"hi_{d}") for d in "xyz"), *(F.percentile_approx(d, 0.5, 1000).alias(f"mid_{d}") for d in "xyz"))
        wide = [F.col(f"hi_{d}") - F.col(f"lo_{d}") for d in "xyz"]
        side = F.when((wide[0] >= wide[1]) & (wide[0] >= wide[2]), "x").when(wide[1] >= wide[2], "y").otherwise("z")
        # Rows at the middle go down, so it has to lie below the greatest; else between the ends.
        pick = lambda what: F.when(F.col("side") == "x", F.col(f"{what}_x")).when(F.col("side") == "y", F.col(f"{what}_y")).otherwise(F.col(f"{what}_z"))
        cut = sides.where(F.col("n") > leaf).withColumn("side", side)
        cut = cut.select("leaf", "side", F.when(pick("mid") < pick("hi"), pick("mid")).otherwise((pick("lo") + pick("hi")) / 2).alias("at")).where(F.col("at").isNotNull())
        cut = materialize(cut, "cuts")
        if cut.isEmpty():
            release(cut)
            break
        at = F.when(F.col("side") == "x", F.col("x")).when(F.col("side") == "y", F.col("y")).otherwise(F.col("z"))
        below = F.when(F.col("at").isNull(), F.col("leaf")).otherwise(F.concat("leaf", F.when(at <= F.col("at"), "0").otherwise("1")))
        before, now = now, materialize(now.join(cut, "leaf", "left").select("x", "y", "z", below.alias("leaf")), "leaves")
        release(before, cut)
    return now


def nearest_camera(points: DataFrame, cameras: DataFrame, cap_m: float, key: str = "point_id", leaf: int = LEAF_CAMERAS) -> DataFrame:
    """(key, x, y, z, gap): the distance of each point to the nearest camera, 2 * cap_m where none is within cap_m.

    Cameras lie in the leaves of a k-d partition. A point asks only the leaves whose boxes may hold the nearest camera: those
    not farther than the least of the distances to the farthest corners of all boxes. Boxes are one row a leaf; up to
    SENT_LEAVES of them are sent to every task, after counting. Beyond that, points meet the boxes that reach their cell of
    cap_m, and only those.
    """
    ship(points.sparkSession)
    leaves = camera_leaves(cameras, leaf)
    boxes = leaves.groupBy("leaf").agg(*(F.min(d).alias(f"lo_{d}") for d in "xyz"), *(F.max(d).alias(f"hi_{d}") for d in "xyz"))
    boxes = materialize(boxes, "leaf-boxes")
    placed = points.select(key, *(F.col(d).cast("double").alias(d) for d in "xyz"))
    near = F.sqrt(sum((F.pow(F.greatest(F.col(f"lo_{d}") - F.col(d), F.col(d) - F.col(f"hi_{d}"), F.lit(0.0)), 2) for d in "xyz"), F.lit(0.0)))
    far = F.sqrt(sum((F.pow(F.greatest(F.abs(F.col(f"lo_{d}") - F.col(d)), F.abs(F.col(d) - F.col(f"hi_{d}"))), 2) for d in "xyz"), F.lit(0.0)))
    n_leaves = boxes.count()
    if n_leaves <= SENT_LEAVES:
        asked = _asked_leaves(placed, boxes, cap_m, key)
    else:
        cells = lambda a, b: F.explode(F.sequence(F.floor(a / cap_m).cast("long"), F.floor(b / cap_m).cast("long")))
        spread = boxes
        for d in "xyz":
            spread = spread.withColumn(f"k{d}", cells(F.col(f"lo_{d}") - cap_m, F.col(f"hi_{d}") + cap_m))
        here = placed.select("*", *(F.floor(F.col(d) / cap_m).cast("long").alias(f"k{d}") for d in "xyz"))
        met = here.join(spread, ["kx", "ky", "kz"]).select(key, "x", "y", "z", "leaf", near.alias("near"), far.alias("far"))
        least = met.groupBy(key, "x", "y", "z").agg(F.min("far").alias("least"))
        asked = met.where(F.col("near") <= cap_m).join(least, [key, "x", "y", "z"]).where(F.col("near") <= F.col("least")).select(key, "x", "y", "z", "leaf")
    rows = leaves.select("leaf", *(F.col(d).alias(f"c{d}") for d in "xyz"))
    # A leaf's cameras in one row: they are few, and a point meets the row, not each of them.
    packs = rows.groupBy("leaf").agg(F.collect_list(F.struct("cx", "cy", "cz")).alias("cs"))
    least = F.array_min(F.transform("cs", lambda c: F.sqrt(F.pow(F.col("x") - c["cx"], 2) + F.pow(F.col("y") - c["cy"], 2) + F.pow(F.col("z") - c["cz"], 2))))
    found = asked.join(packs, "leaf").groupBy(key, "x", "y", "z").agg(F.min(least).alias("gap"))
    same = F.lit(True)
    for c in (key, "x", "y", "z"):
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}"))
    out = placed.alias("p").join(found.alias("f"), same, "left")
    return out.select(*(f"p.{c}" for c in (key, "x", "y", "z")), F.when(F.col("f.gap") <= cap_m, F.col("f.gap")).otherwise(F.lit(2 * cap_m)).alias("gap"))


def _asked_leaves(placed: DataFrame, boxes: DataFrame, cap_m: float, key: str) -> DataFrame:
    """Points with the leaves that may hold their nearest camera, by boxes that every task has: their number is checked."""
    rows = boxes.collect()
    names = [r["leaf"] for r in rows]
    low, high = (np.array([[r[f"{side}_{d}"] for d in "xyz"] for r in rows], float).reshape(-1, 3) for side in ("lo", "hi"))
    schema = placed.withColumn("leaf", F.lit("")).schema

    def run(batches):
        import pandas as pd

        for batch in batches:
            p = batch[["x", "y", "z"]].to_numpy(float)
            out = []
            for at in range(0, len(p) if len(names) else 0, 1024):
                x = p[at : at + 1024, None, :]
                near = np.sqrt((np.maximum(np.maximum(low - x, x - high), 0) ** 2).sum(axis=2))
                far = np.sqrt((np.maximum(np.abs(low - x), np.abs(x - high)) ** 2).sum(axis=2))
                i, j = np.nonzero((near <= far.min(axis=1, keepdims=True)) & (near <= cap_m))
                part = batch.iloc[at + i].copy()
                part["leaf"] = [names[k] for k in j]
                out.append(part)
            yield pd.concat(out) if out else batch.iloc[:0].assign(leaf="")

    return placed.mapInPandas(run, schema)


def near_cameras(points: DataFrame, cameras: DataFrame, multiple: float = 4.0, cap_m: float = 150.0, key: str = "point_id") -> DataFrame:
    """Points whose nearest camera is closer than the lesser of cap_m and `multiple` medians of that distance.

    points(key, x, y, z), cameras(x, y, z). Points farther than cap_m from every camera cannot stay; they still count in
    the median, as far away.
    """
    nearest = materialize(nearest_camera(points, cameras, cap_m, key), "camera-gaps")
    median = quantiles(nearest, "gap", [0.5])
    return nearest.where(F.col("gap") < (min(multiple * median[0], cap_m) if median else cap_m))
