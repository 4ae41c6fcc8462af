"""Hand-computed cases, properties, and batch against stream."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import geo, linalg, text
from tessera.operators import coverage, gates, graph, kernels, pairs, reconcile, robust, sequence
from tessera.sources import files
from tessera.streaming import capture, jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lits(*xs):
    return [F.lit(x).cast("double") for x in xs]


def test_distances(spark):
    assert one(spark, geo.haversine_m(*lits(37.5, 127.0, 37.5, 127.0001))) == pytest.approx(8.821687, abs=1e-5)
    assert one(spark, geo.haversine_m(*lits(37.5, 127.0, 37.5001, 127.0))) == pytest.approx(11.119493, abs=1e-5)
    assert one(spark, geo.haversine_m(*lits(None, 127.0, 37.5001, 127.0))) is None
    assert one(spark, geo.distance_3d_m(*lits(37.5, 127.0, 10, 37.5001, 127.0, 15))) == pytest.approx(12.191928, abs=1e-5)
    assert one(spark, geo.distance_3d_m(*lits(37.5, 127.0, None, 37.5001, 127.0, 15))) == pytest.approx(11.119493, abs=1e-5)
    for a, b, want in ((350, 10, 20), (10, 350, 20), (-170, 170, 20), (0, 180, 180), (None, 5, None)):
        assert one(spark, geo.angle_delta_deg(*lits(a, b))) == want


def test_utm(spark):
    for lat, lon, want in ((37.5, 127.0, 32652), (-33, -70, 32719), (None, None, None)):
        assert one(spark, geo.utm_epsg(*lits(lat, lon))) == want
    # On the central meridian the northing is the scaled length of the meridian arc.
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    phi = np.linspace(0, math.radians(37.5), 200_001)
    radius = a * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5
    arc = float(((radius[1:] + radius[:-1]) / 2 * np.diff(phi)).sum())
    at = one(spark, geo.utm_xy_m(F.lit(37.5), F.lit(129.0), F.lit(32652)))
    assert at["x"] == pytest.approx(500_000, abs=1e-6) and at["y"] == pytest.approx(0.9996 * arc, abs=1e-3)
    south = one(spark, geo.utm_xy_m(F.lit(-37.5), F.lit(129.0), F.lit(32752)))
    assert south["y"] == pytest.approx(10_000_000 - at["y"], abs=1e-6)


def test_formats(spark):
    assert [one(spark, text.grid_column(F.lit(i))) for i in (0, 25, 26, 51, 52, 701, 702)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]
    assert [one(spark, text.elapsed(F.lit(s))) for s in (65, 3661)] == ["01:05", "1:01:01"]
    assert [one(spark, text.discovery_port(F.lit(d))) for d in (30, 0, 233)] == [14910, 7410, None]
    assert [one(spark, text.exif_timestamp(F.lit(x))) for x in ("2026:01:02 03:04:05", "garbage")] == ["2026-01-02T03:04:05", "garbage"]
    assert [one(spark, text.facade_of(F.lit(x))) for x in ("1000_FRONT_20260101_101010", "FRONT")] == ["1000_FRONT", "FRONT"]
    assert [one(spark, text.cygwin_path(F.lit(x))) for x in (r"D:\x\y", r"a\b")] == ["/cygdrive/d/x/y", "a/b"]
    assert one(spark, text.file_name(F.lit(' a<b>:c\t? '))) == "a_b__c__"
    assert one(spark, geo.dms_to_degrees(F.array(F.lit("10"), F.lit("30"), F.lit("x")), F.lit("S"))) is None
    assert one(spark, text.building_number(F.lit(" 101동 "), "동")) == "101"


def test_progress_lines(spark):
    assert [round(one(spark, text.fraction(F.lit(x))), 6) for x in ("~85/216", "5/0", "x/9", None, "218/216")] == [0.393519, 0, 0, 0, 1]
    for stage, want in (("COLMAP_LOFTR_PROGRESS", 22.560185), ("COLMAP_MAPPING_PROGRESS", 62.708333)):
        assert one(spark, text.stage_percent(F.lit(stage), F.lit("~85/216"))) == pytest.approx(want, abs=1e-6)
    line = one(spark, text.transfer_progress(F.lit("     50,331,650  42%   12.34MB/s    0:00:03 (xfr#12, to-chk=88/103)")))
    assert tuple(line) == (50331650, 42, 12.34)
    assert one(spark, text.transfer_progress(F.lit("DJI_0001.JPG"))) is None
    for line, want in (('{"stage":"DONE","progress":"1/2"}', "DONE"), ('{"stage":7}', None), ("Traceback", None), ("[1]", None), (None, None)):
        got = one(spark, text.log_line(F.lit(line)))
        assert (got and got["stage"]) == want
    assert one(spark, text.lines(F.lit("a\r\n\rb\nc"))) == ["a", "b", "c"]
    for directions, counts, want in (("A,,B", "3", []), ("A,B", "3,4", [3, 4]), (None, None, [])):
        assert one(spark, text.requirement_counts(F.lit(directions), F.lit(counts))) == want


def test_xmp(spark):
    from tessera.sources.xmp import attributes_of, xmp_attributes

    names = 'xmlns:x="x" xmlns:r="r" xmlns:a="a"'
    packet = f"x<x:xmpmeta {names}><r:Description a:Lat=\"1\" b='2'/><Description a:Lat=\"3\"></Description></x:xmpmeta>y<x:xmpmeta><Description z='9'/></x:xmpmeta>"
    rows = spark.createDataFrame([(packet,), ("nothing",), (None,)], "p string")
    assert [r[0] for r in rows.select(xmp_attributes(F.col("p"))).collect()] == [{"Lat": "3", "b": "2"}, {}, {}]
    hard = f'<x:xmpmeta {names}><r:Description a:Model="O\'Neil &amp; Söhne" a:V="1>2" a:W="3"/></x:xmpmeta>'
    assert attributes_of(b"\xff\xd8" + hard.encode() + b"\0") == {"Model": "O'Neil & Söhne", "V": "1>2", "W": "3"}
    assert attributes_of(hard.encode("latin-1"))["Model"] == "O'Neil & S\ufffdhne"
    assert attributes_of(b"<x:xmpmeta xmlns:x='x'><Description a='1'></x:xmpmeta>") == attributes_of(b"<x:xmpmeta>") == {}


def test_null_groups_and_ties(spark):
    df = spark.createDataFrame([(None, i, float(i)) for i in range(6)] + [(1, i, float(i)) for i in range(6)], "g int, i int, x double")
    kept = sequence.keep_spaced(df, 3.0, "g", ["i"], ("x",)).collect()
    assert sorted((r["g"] or 0, r["x"]) for r in kept) == [(0, 0.0), (0, 3.0), (1, 0.0), (1, 3.0)]
    near = spark.createDataFrame([(None, a, b, float(k)) for k, (a, b) in enumerate([("a", "b"), ("a", "c"), ("b", "c"), ("a", "d")])], "g int, image_a string, image_b string, xyz_m double")
    assert {(r["image_a"], r["image_b"]) for r in pairs.degree_capped(near, 1, "g").collect()} == {("a", "b"), ("a", "c"), ("a", "d")}
    ties = spark.createDataFrame([("s", f, 0.0) for f in (5, 3, 9)] + [("s", 1, 0.5), ("s", 7, 1.0), ("s", 6, 1.0)], "stream_id string, frame_id long, at_s double")
    for n in (1, 3):
        assert [(r["frame_id"], r["frame_no"]) for r in capture.throttle(ties.repartition(n)).orderBy("frame_no").collect()] == [(3, 0), (6, 1)]


def test_rows_in_one_place(spark):
    df = spark.createDataFrame([(f"i{k}", 1.0, 2.0, 0.0) for k in range(30)] + [("far", 50.0, 2.0, 0.0)], "image_id string, x double, y double, z double")
    near = {r["image_id"]: r["nn"] for r in pairs.nearest_distance(df, 8.0).collect()}
    assert near.pop("far") == 49.0 and set(near.values()) == {0.0} and len(near) == 30
    assert pairs.calibrated_radius(df, 8.0) == 0.0
    assert pairs.radius_pairs(df, 0.0).count() == 30 * 29 // 2
    assert {r["nn"] for r in pairs.nearest_distance(df.where("image_id = 'far'"), 8.0).collect()} == {None}
    with pytest.raises(ValueError):
        pairs.radius_pairs(df, -1.0)


def test_nearest_in_dense_and_sparse_places(spark):
    rng = np.random.default_rng(12)
    at = np.concatenate([rng.normal(0, 0.01, (300, 3)), rng.normal(500, 200, (40, 3))])
    df = spark.createDataFrame([(str(i), *map(float, p)) for i, p in enumerate(at)], "image_id string, x double, y double, z double")
    got = {r["image_id"]: r["nn"] for r in pairs.nearest_distance(df, 8.0).collect()}
    gaps = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))
    np.fill_diagonal(gaps, np.inf)
    assert np.allclose([got[str(i)] for i in range(len(at))], gaps.min(axis=1))


def test_catalog_is_read_again(spark, tmp_path):
    """Files of equal length are taken from the written catalog; new, changed and removed ones follow."""
    from tessera.sources import files

    def photo(model):
        return f'<x:xmpmeta xmlns:x="x" xmlns:d="d"><Description d:Model="{model}" d:GpsLatitude="1.5"/></x:xmpmeta>'.encode()

    def images(**models):
        return spark.createDataFrame([(f"/f/{k}.jpg", len(photo(m)), bytearray(photo(m))) for k, m in models.items()], "path string, length long, content binary")

    def names(df):
        return {r["image_id"]: (r["camera_model"], r["gps"] and r["gps"]["latitude"]) for r in df.collect()}

    path = f"file://{tmp_path}/catalog"
    first = names(files.cached_catalog(images(a="M1", b="M2"), path))
    assert first == {"a": ("M1", 1.5), "b": ("M2", 1.5)}
    second = files.cached_catalog(images(a="X1", c="M3"), path)
    assert names(second) == {"a": ("M1", 1.5), "c": ("M3", 1.5)} and second.first()["drone_pose"] is None
    assert names(files.cached_catalog(images(a="longer"), path)) == {"a": ("longer", 1.5)}
    # A call that dies before it points to its version leaves the one before in force.
    (tmp_path / "catalog" / "000000000004" / "catalog").mkdir(parents=True)
    assert names(files.cached_catalog(images(a="longer", d="M4"), path)) == {"a": ("longer", 1.5), "d": ("M4", 1.5)}
    assert sorted(p.name for p in (tmp_path / "catalog" / "pointers").iterdir() if p.name.startswith("v")) == ["version-000000000003", "version-000000000004"]


def test_linear_algebra(spark):
    rng = np.random.default_rng(1)
    m, v = rng.normal(size=(3, 3)), rng.normal(size=3)
    col = lambda x: F.array(*(F.lit(float(y)) for y in np.ravel(x)))
    assert np.allclose(one(spark, linalg.inverse(col(m))), np.linalg.inv(m).ravel())
    assert np.allclose(one(spark, linalg.matmul(col(m), col(m.T))), (m @ m.T).ravel())
    assert np.allclose(one(spark, linalg.camera_center(col(m), col(v))), -m.T @ v)
    assert one(spark, linalg.inverse(col(np.ones((3, 3))))) is None
    h = np.array([[1, 0, 5], [0, 2, 0], [0, 0, 1.0]])
    assert tuple(one(spark, linalg.bounds(col(h), F.lit(10.0), F.lit(4.0)))) == (5, 0, 15, 8)
    assert tuple(one(spark, linalg.clamp_roi(F.struct(F.lit(-3.5).alias("x0"), F.lit(1.2).alias("y0"), F.lit(9.1).alias("x1"), F.lit(50.0).alias("y1")), 20, 10))) == (0, 1, 10, 9)


def test_settings_merge():
    files_ = {"child": {"extends": "parent", "a": {"x": 1}}, "parent": {"a": {"x": 0, "y": 2}, "b": 3}}
    assert config.load("child", files_.__getitem__) == {"a": {"x": 1, "y": 2}, "b": 3}
    with pytest.raises(ValueError):
        config.load("loop", {"loop": {"extends": "loop"}}.__getitem__)


def test_next_neighbours(spark):
    df = spark.createDataFrame([("f", c) for c in "abcdef"], "flight_id string, image_id string")
    got = {(r["a"]["image_id"], r["b"]["image_id"]) for r in pairs.next_neighbours(df, 4).collect()}
    assert len(got) == 14 and all(a < b for a, b in got)


def test_pair_gate(spark):
    rows = [(None, None, "gps_proximity"), (9.0, None, "gps_proximity"), (9.0, None, "temporal_neighbor"), (1.0, 21.0, "temporal_neighbor")]
    df = spark.createDataFrame(rows, "gps_distance_m double, view_angle_delta_deg double, reason string")
    assert [r[:1] + r[2:] for r in map(tuple, pairs.gate(df, 8.0, 20.0).collect())] == [(None, "gps_proximity"), (9.0, "temporal_neighbor")]
    twice = spark.createDataFrame([("b", "a", "temporal_neighbor"), ("a", "b", "gps_proximity")], "image_a string, image_b string, reason string")
    assert [tuple(r) for r in pairs.first_writer(twice, F.when(F.col("reason") == "temporal_neighbor", 0).otherwise(1)).collect()] == [("a", "b", "temporal_neighbor")]


def test_radius_pairs_and_nearest(spark):
    rng = np.random.default_rng(3)
    at = rng.normal(size=(120, 3)) * 5
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "image_id int, x double, y double, z double")
    gap = np.linalg.norm(at[:, None] - at[None], axis=2)
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if gap[i, j] <= 2.0}
    assert {(r["a"]["image_id"], r["b"]["image_id"]) for r in pairs.radius_pairs(df, 2.0).collect()} == want
    near = {r["image_id"]: r["nn"] for r in pairs.nearest_distance(df, 0.5).collect()}
    assert np.allclose([near[i] for i in range(120)], np.sort(gap, axis=1)[:, 1])
    assert pairs.calibrated_radius(df.limit(1), 8.0) == 8.0


def test_degree_cap(spark):
    rng = np.random.default_rng(5)
    edges = [(f"{a}", f"{b}", float(d)) for a, b, d in {(int(a), int(b)): (int(a), int(b), round(float(d), 6)) for a, b, d in zip(rng.integers(0, 12, 80), rng.integers(12, 24, 80), rng.random(80))}.values()]
    counts, want = {}, set()
    for a, b, _ in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if counts.get(a, 0) < 2 or counts.get(b, 0) < 2:
            want.add((a, b))
            counts[a], counts[b] = counts.get(a, 0) + 1, counts.get(b, 0) + 1
    df = spark.createDataFrame(edges, "image_a string, image_b string, xyz_m double")
    assert {(r["image_a"], r["image_b"]) for r in pairs.degree_capped(df, 2).collect()} == want


def test_spacing(spark):
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate((0.0, 1.0, 1.4, 1.5, None, 2.9, 3.0, 4.6))], "g string, i int, x double")
    assert [r["x"] for r in sequence.keep_spaced(df, 1.5, "g", "i", ("x",)).collect()] == [0.0, 1.5, None, 3.0, 4.6]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=30), st.floats(0.1, 20))
def test_spacing_property(spark, xs, d):
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(xs)], "g string, i int, x double")
    kept = [r["x"] for r in sequence.keep_spaced(df, d, "g", "i", ("x",)).collect()]
    assert kept[0] == xs[0] and all(abs(a - b) >= d for a, b in zip(kept, kept[1:]))


def test_gap_cut(spark):
    cut = lambda xs: [(r["n"], r["gap_ratio"]) for r in sequence.gap_cut(spark.createDataFrame([(f"i{i}", n) for i, n in enumerate(xs)], "image_id string, n long")).collect()]
    assert cut([3, 4, 50, 60, 70, 80, 90, 100]) == [(3, 10.2), (4, 10.2)]
    assert cut([1, 50, 60]) == [] and cut([10, 11, 12, 13]) == []


def test_robust(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5, 100)], "v double")
    assert tuple(robust.robust_range(df, "v").select("q1", "q3", "lo", "hi").first()) == (2.25, 4.75, 1.0, 5.0)
    assert [r["e"] for r in robust.mismatches(spark.createDataFrame([(x,) for x in (0.2, 0.3, 0.25, 0.4, 17.0)], "e double"), "e").collect()] == [17.0]
    values = np.random.default_rng(0).exponential(size=3000).round(3)
    big = spark.createDataFrame([(float(x),) for x in values], "v double")
    assert np.allclose(robust.quantiles(big, "v", [0.0, 0.1, 0.5, 0.999, 1.0], few=20, bins=16), np.quantile(values, [0, 0.1, 0.5, 0.999, 1]))
    assert robust.quantiles(big.limit(0), "v", [0.5]) is None


def test_group_quantiles(spark):
    rng = np.random.default_rng(7)
    groups = {"a": rng.exponential(size=900).round(2), "b": np.r_[np.zeros(500), rng.normal(size=40)], None: np.array([3.0]), "c": np.array([1.0, 2.0])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("d", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["q"] for r in robust.group_quantiles(df, "g", "v", [0.0, 0.3, 0.5, 0.99], few=20, bins=8).collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        assert np.allclose(got[g], np.quantile(xs, [0, 0.3, 0.5, 0.99]))


def test_planes(spark):
    rng = np.random.default_rng(2)
    wall = np.c_[rng.uniform(0, 40, 600), rng.normal(0, 0.1, 600), rng.uniform(0, 20, 600)]
    far = rng.uniform(100, 200, (60, 3))
    points = spark.createDataFrame([tuple(map(float, p)) for p in np.r_[wall, far]], "x double, y double, z double")
    kept, centre = robust.near_plane(points, np.r_[wall, far].mean(axis=0), [0.0, 1.0, 0.0])
    assert kept.count() >= 595 and abs(centre[1]) < 0.5
    mean, axes, variances = robust.principal_axes(points.where("x < 50"))
    assert abs(abs(axes[2][1]) - 1) < 1e-2 and variances[0] > variances[1] > variances[2]
    # Level cameras in front of the wall, looking along +y.
    rotation = [1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 1.0, 0.0]
    cameras = spark.createDataFrame([(rotation, [-float(x), 5.0, 20.0]) for x in range(0, 40, 5)], "rotation array<double>, translation array<double>")
    assert np.allclose(robust.mean_up(cameras), [0, 0, 1]) and np.allclose(robust.wall_normal(cameras, np.array([0, 0, 1.0])), [0, -1, 0])
    plane = robust.facade_plane(points.where("x < 50"), cameras)
    assert np.allclose(plane["e_u"], [1, 0, 0], atol=1e-6) and np.allclose(plane["e_v"], [0, 0, -1], atol=1e-6)
    assert plane["width_m"] == pytest.approx(44, abs=0.5) and plane["height_m"] == pytest.approx(24, abs=0.5)


def test_similarity(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(20, 3))
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    b = 2.5 * a @ turn.T + [1, 2, 3]
    df = spark.createDataFrame([(*map(float, x), *map(float, y)) for x, y in zip(a, b)], "ax double, ay double, az double, bx double, by double, bz double")
    got = robust.similarity(df)
    assert got["scale"] == pytest.approx(2.5) and np.allclose(got["rotation"], turn) and np.allclose(got["translation"], [1, 2, 3])
    assert robust.similarity(df.limit(2)) is None


def test_gates(spark):
    def status(matches, inliers, ratio, error, pre="OK"):
        return one(spark, gates.gate_status(F.lit(pre), F.lit(matches), F.lit(inliers), F.lit(ratio), F.lit(error).cast("double"), F.lit(True), F.lit(True)))

    assert [status(39, 30, 0.9, 1.0), status(40, 24, 0.9, 1.0), status(40, 25, 0.34, 1.0), status(40, 25, 0.9, 3.01), status(40, 25, 0.9, None), status(40, 25, 0.35, 3.0), status(0, 0, 0.0, None, "MATCH_TIMEOUT")] == ["LOW_MATCH", "LOW_INLIER", "LOW_INLIER", "HIGH_REPROJECTION_ERROR", "HIGH_REPROJECTION_ERROR", "OK", "MATCH_TIMEOUT"]
    assert [one(spark, gates.pose_consistent(*lits(dz, s))) for dz, s in ((3, 150), (3, -150), (1.9, -150), (None, -150))] == [True, False, True, True]
    assert [one(spark, gates.floors_consistent(*lits(dz, 300, 150, c))) for dz, c in ((5.02, 0.8), (2.51, 0.8), (2.51, 0.59))] == [True, False, True]
    assert [one(spark, gates.size_or(F.lit(w).cast("int"), 5280)) for w in (0, None, 10)] == [5280, 5280, 10]
    report = spark.createDataFrame([(11.0, 1.0, 0.9, 100, 0, 0), (1.0, 21.0, 0.9, 100, 0, 0), (1.0, 1.0, 0.4, 100, 0, 0), (1.0, 1.0, 0.9, 96, 4, 0), (None, None, None, 0, 0, 0)], "drift_px double, max_drift_px double, coverage_ratio double, image_count int, never_matched int, unreachable int")
    assert [r["reasons"] for r in gates.decision(report).collect()] == [["drift"], ["seam_drift"], ["coverage_gap"], ["unreachable"], []]
    assert not any(r["needed"] for r in gates.decision(report, enabled=False).collect())


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "a string, b string")
    assert sorted(map(tuple, graph.components(edges).collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")]
    ref = graph.reference(edges).first()
    assert (ref["node"], ref["size"]) == ("b", 3)
    triangle = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y")], "a string, b string")
    tree = graph.levels(triangle, spark.createDataFrame([("a",)], "node string"))
    assert sorted(map(tuple, tree.select("node", "level").collect())) == [("a", 0), ("b", 1), ("c", 1)]
    assert sorted(map(tuple, graph.cycle_edges(triangle, tree).collect())) == [("b", "c"), ("x", "y")]
    assert {r["node"] for r in graph.unreachable(triangle, tree).collect()} == {"x", "y"}


def test_long_chain_components(spark):
    chain = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graph.components(chain).agg(F.max("root"), F.count("*")).first()[:] == (0, 401)


def test_composition_and_refinement(spark):
    rng = np.random.default_rng(6)
    true = {n: np.array([[1, 0, 10.0 * i], [0, 1, 3.0 * i], [0, 0, 1]]) for i, n in enumerate("abcd")}
    names = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("a", "c")]
    edges = [(u, v, [float(x) for x in (np.linalg.inv(true[v]) @ true[u]).ravel()]) for u, v in names]
    df = spark.createDataFrame(edges, "image_a string, image_b string, homography array<double>")
    simple = df.select(F.col("image_a").alias("a"), F.col("image_b").alias("b"))
    tree = graph.levels(simple, spark.createDataFrame([("a",)], "node string"))
    placed = graph.composed(df, tree)
    for r in placed.collect():
        assert np.allclose(np.array(r["to_reference"]).reshape(3, 3), true[r["node"]])
    sizes = placed.select("node", F.lit(100).alias("width"), F.lit(80).alias("height"))
    d = graph.drift(df, graph.cycle_edges(simple, tree), placed, sizes).first()
    assert d["cycle_edges"] == 2 and d["max_drift_px"] < 1e-9
    start = {n: m + np.array([[0, 0, rng.normal()], [0, 0, rng.normal()], [0, 0, 0]]) * (n != "a") for n, m in true.items()}
    fitted = graph.fit_homographies(edges, {n: m.ravel() for n, m in start.items()}, dict.fromkeys("abcd", (100, 80)), {"a"})
    for n in "abcd":
        assert np.allclose(np.array(fitted[n]).reshape(3, 3), true[n], atol=1e-4)


WIDE, HIGH = 640, 480


def connected(edges, n=10):
    seen = {0}
    while more := {x for e in edges if seen & set(e) for x in e} - seen:
        seen |= more
    return len(seen) == n


def noisy_graph(seed, wrong):
    """Ten images about a root, 15 edges with 3 px of noise at the corners, `wrong` of them off by 300 px; the right ones
    connect all images, also without any one of them. Gives (edges, start along the tree, truth)."""
    draw = np.random.default_rng(seed)
    corners = np.array([[0, 0], [WIDE, 0], [WIDE, HIGH], [0, HIGH]], float)

    def fit(a, b):
        rows = [r for (x, y), (u, v) in zip(a, b) for r in ([x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y])]
        return np.append(np.linalg.solve(np.array(rows), b.reshape(-1)), 1).reshape(3, 3)

    true = {i: np.eye(3) if i == 2 else fit(corners, corners + [i % 5 * 150 - 300, i // 5 * 150] + draw.normal(0, 10, (4, 2))) for i in range(10)}
    near = [(i, j) for i in range(10) for j in range(i + 1, 10) if abs(i % 5 - j % 5) <= 1]
    while True:
        used = [near[k] for k in draw.permutation(len(near))[:15]]
        bad = set(used[:wrong])  # they come first
        right = [e for e in used if e not in bad]
        if all(connected(right[:k] + right[k + 1 :]) for k in range(len(right))):
            break
    edges = []
    for a, b in used:
        q = np.c_[corners, np.ones(4)] @ (np.linalg.inv(true[b]) @ true[a]).T
        at = q[:, :2] / q[:, 2:] + draw.normal(0, 3, (4, 2)) + (300 if (a, b) in bad else 0) * np.array([1, -1])
        edges.append((a, b, fit(corners, at).reshape(-1)))
    start, front = {2: np.eye(3)}, [2]
    for x in front:
        for a, b, h in edges:
            for s, t, m in ((a, b, np.linalg.inv(h.reshape(3, 3))), (b, a, h.reshape(3, 3))):
                if s == x and t not in start:
                    start[t] = start[x] @ m
                    front.append(t)
    return edges, {n: (m / m[2, 2]).reshape(-1) for n, m in start.items()}, true


def mean_error(found, true):
    corners = np.array([[0, 0, 1], [WIDE, 0, 1], [WIDE, HIGH, 1], [0, HIGH, 1]], float)
    carry = lambda m: (lambda q: q[:, :2] / q[:, 2:])(corners @ np.asarray(m).reshape(3, 3).T)
    return np.mean([np.linalg.norm(carry(found[n]) - carry(true[n]), axis=1).mean() for n in true])


def test_refinement_with_wrong_edges(spark):
    """Two of 15 edges grossly wrong: all facades end near the truth, through Spark as in the numeric part."""
    edges, places, truths, starts = [], [], {}, []
    for seed in range(8):
        e, start, truths[str(seed)] = noisy_graph(seed, 2 if seed < 6 else 0)
        starts.append(mean_error(start, truths[str(seed)]))
        edges += [(str(seed), str(a), str(b), [float(x) for x in h]) for a, b, h in e]
        places += [(str(seed), str(n), [float(x) for x in h], float(WIDE), float(HIGH), n == 2) for n, h in start.items()]
    done = graph.refine(spark.createDataFrame(edges, graph.EDGE), spark.createDataFrame(places, graph.PLACE)).collect()
    found = {}
    for r in done:
        found.setdefault(r["facade"], {})[int(r["node"])] = r["to_reference"]
    errors = [mean_error(found[f], truths[f]) for f in sorted(truths)]
    # As good as with the right edges alone, to which noise at the corners sets the limit.
    alone = []
    for seed in range(8):
        e, start, true = noisy_graph(seed, 2 if seed < 6 else 0)
        right = e[2:] if seed < 6 else e
        alone.append(mean_error(graph.fit_homographies(right, {n: true[n].reshape(-1) for n in true}, dict.fromkeys(true, (WIDE, HIGH)), {2}), true))
    assert max(errors) <= 6 and np.mean(errors) <= 1.1 * np.mean(alone) and np.mean(starts[:6]) > 10


def test_refinement_leaves_what_it_cannot_fit():
    unit = np.eye(3).reshape(-1)
    assert set(graph.fit_homographies([], {"a": unit, "b": None}, {}, {"a"})) == {"a"}
    lone = graph.fit_homographies([("a", "b", unit)], {"a": unit, "b": unit, "c": 2 * unit}, {"a": (10, 10)}, {"a"})
    assert np.allclose(lone["c"], unit) and np.allclose(lone["b"], unit)


def test_coverage(spark):
    feet = spark.createDataFrame([("a", -1, 0, 3, 2), ("b", 9, 9, 5, 5), ("c", 20, 0, 5, 5)], "image_id string, x int, y int, w int, h int")
    cells = coverage.cells(feet, 10, 10)
    assert sorted(map(tuple, cells.collect())) == [("a", 0, 0), ("a", 0, 1), ("a", 1, 0), ("a", 1, 1), ("b", 9, 9)]
    assert coverage.coverage(cells, 10, 10).first()["coverage_ratio"] == 0.05
    covered = spark.createDataFrame([(1, 0), (2, 0)], "cx int, cy int")
    fillers = spark.createDataFrame([(1, 2, 0), (1, 3, 0), (2, 3, 0), (2, 4, 0)], "filler_no int, cx int, cy int")
    assert sorted(map(tuple, coverage.gap_fill(covered, fillers).select("cx", "filler_no").collect())) == [(3, 1), (4, 2)]
    order = coverage.filler_order(*(spark.createDataFrame([(x,) for x in xs], "image_id string") for xs in ("ba", "dca", "dba")))
    assert [tuple(r) for r in order.orderBy("filler_no").collect()] == [("a", 1), ("b", 2), ("d", 3)]


def test_reconcile(spark):
    local = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("q", "a", 1), ("q", "b", 2), ("r", "a", 1)], "g string, name string, size long")
    remote = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("p", "c", 9), ("q", "a", 1), ("s", "a", 1)], "g string, name string, size long")
    assert {r["g"]: r["matches"] for r in reconcile.sizes_match(local, remote, "g").collect()} == {"p": True, "q": False, "r": True, "s": True}
    assert [one(spark, reconcile.progress_percent(F.lit(a), F.lit(b))) for a, b in ((63, 169), (0, 0))] == [37, 0]
    assert [one(spark, reconcile.canonical_direction(F.lit(x))) for x in ("앞면", "top", "x", None)] == ["FRONT", "ROOF", None, None]


def test_sources(spark, tmp_path):
    for name in ("a/1.jpg", "a/2.JPEG", "a/3.png", "output/4.jpg", "b/output/5.jpg", "excluded/6.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"\xff<x:xmpmeta xmlns:x='x' xmlns:rdf='r' xmlns:d='d'><rdf:Description d:GpsLatitude='37.5' d:GpsLongtitude='127' d:AbsoluteAltitude='bad' d:GimbalYawDegree='9'/></x:xmpmeta>")
    scanned = files.scan_images(spark, str(tmp_path))
    assert sorted(r["path"].removeprefix(f"file:{tmp_path}/") for r in scanned.collect()) == ["a/1.jpg", "a/2.JPEG", "b/output/5.jpg"]
    row = files.metadata(scanned).where("image_id = '1'").first()
    assert tuple(row["gps"]) == (37.5, 127.0, None) and row["mission"]["flight_id"] == "a" and row["gimbal_pose"]["yaw_deg"] == 9.0
    assert "gps.latitude" in files.flatten(files.metadata(scanned)).columns
    ini = spark.createDataFrame([(1, "a = 1"), (2, "; a = 2"), (3, "[a=3]"), (4, "a=4=5"), (5, ""), (6, "b")], "line_no int, value string")
    assert [tuple(r) for r in files.settings(ini).collect()] == [("a", "4=5")]
    (tmp_path / "x.json").write_text('{"Topic": " ", "Key": "k", "Directions": ["FRONT"]}')
    (tmp_path / "y.json").write_text("{broken")
    (got,) = files.assignments(spark, str(tmp_path / "*.json")).collect()
    assert (got["Topic"], got["Key"], got["Buildings"], got["Directions"]) == (None, "k", [], ["FRONT"])
    assert files.sites(spark.createDataFrame([("nonsense",), ('{"companies":[{"name":" ","buildings":[]},{"name":"c","buildings":["1","1"]}]}',)], "value string")).collect()[0][:] == ("c", ["1"])


def test_packets(spark):
    bundle = spark.createDataFrame([("s", 1, 0.5, bytearray(range(188)) + bytearray(b"y" * 200)), ("s", 2, 1.0, bytearray(10))], "stream_id string, chunk_id long, timestamp_sec double, data binary")
    got = files.ts_packets(bundle).orderBy("packet_no").collect()
    assert [(r["chunk_id"], r["packet_no"], len(r["packet"])) for r in got] == [(1, 0, 188), (1, 1, 188)] and bytes(got[0]["packet"]) == bytes(range(188))
    tag = lambda kind, at, body: bytes([kind]) + len(body).to_bytes(3, "big") + (at & 0xFFFFFF).to_bytes(3, "big") + bytes([at >> 24]) + bytes(3) + body + (11 + len(body)).to_bytes(4, "big")
    flv = b"FLV\x01\x05" + (9).to_bytes(4, "big") + bytes(4) + tag(9, 40, b"v") + tag(7, 50, b"?") + tag(8, 0x1000001, b"aa") + tag(9, 90, b"cut")[:-8]
    tags = files.flv_tags(spark.createDataFrame([("f", bytearray(flv))], "path string, content binary"))
    assert [tuple(r)[2:] for r in tags.collect()] == [(9, 40, 1), (8, 0x1000001, 2)]
    lines = files.concat_list(spark.createDataFrame([(1, "a'b"), (2, "c")], "n int, p string"), "p", "n", 2.0)
    assert [r[0] for r in lines.collect()] == ["file 'a'\\''b'", "duration 0.500000", "file 'c'", "duration 0.500000", "file 'c'"]


def test_kernels(spark):
    import time

    pairs_ = spark.createDataFrame([("a", "b"), ("a", "slow")], "image_a string, image_b string")

    def make():
        def match(a, b):
            if b == "slow":
                time.sleep(30)
            return [(1.0, 2.0, 3.0, 4.0, 0.9)]

        return match

    got = {r["image_b"]: (r["status"], r["num_matches"]) for r in kernels.match_pairs(pairs_.coalesce(1), make, timeout_s=2).collect()}
    assert got == {"b": ("OK", 1), "slow": ("MATCH_TIMEOUT", 0)}


def test_kernels_that_fail(spark):
    """An exception fails its pair, with or without a time limit; so does a process that ends, at once."""
    import os
    import time

    def make():
        def match(a, b):
            if b == "bad":
                raise KeyError(a)
            if b == "gone":
                os._exit(3)
            return None if b == "none" else [(1.0, 2.0, 3.0, 4.0, 0.9)]

        return match

    rows = lambda *bs: spark.createDataFrame([("a", b) for b in bs], "image_a string, image_b string").coalesce(1)
    told = lambda df: {r["image_b"]: (r["status"], r["num_matches"], r["error"]) for r in df.collect()}
    want = {"bad": ("MATCH_FAILED", 0, "KeyError: 'a'"), "none": ("MATCH_TIMEOUT", 0, None), "b": ("OK", 1, None)}
    assert told(kernels.match_pairs(rows("bad", "none", "b"), make)) == want
    began = time.monotonic()
    got = told(kernels.match_pairs(rows("bad", "gone", "none", "b"), make, timeout_s=60))
    assert got == want | {"gone": ("MATCH_FAILED", 0, "the process ended with 3")} and time.monotonic() - began < 40
    nulls = spark.createDataFrame([("a", "b", "OK", None, None)], "image_a string, image_b string, status string, keypoints_a array<struct<x:double,y:double>>, keypoints_b array<struct<x:double,y:double>>")
    from tessera.operators import homography

    assert [r["status"] for r in homography.estimate(nulls).collect()] == ["LOW_MATCH"]


def frames_of(spark, rows):
    return spark.createDataFrame(rows, "stream_id string, frame_id long, at_s double")


def test_throttle_batch_is_stream(spark, tmp_path):
    arrivals = [("s", i, t) for i, t in enumerate((0.0, 0.5, 1.0, 1.9, 2.0))]
    assert [r["at_s"] for r in capture.throttle(frames_of(spark, arrivals)).orderBy("at_s").collect()] == [0.0, 1.0, 2.0]
    rng = np.random.default_rng(8)
    rows = [(f"s{i % 3}", i, float(t)) for i, t in enumerate(np.cumsum(rng.random(90) * 0.5))]
    source = tmp_path / "in"
    for k in range(3):
        frames_of(spark, rows[k * 30 : k * 30 + 30]).coalesce(1).write.mode("append").parquet(str(source / f"k={k}"))
    stream = spark.readStream.schema("stream_id string, frame_id long, at_s double, k int").option("maxFilesPerTrigger", 1).parquet(str(source))
    query = capture.throttle_stream(stream).writeStream.format("memory").queryName("throttled").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    want = sorted(map(tuple, capture.throttle(frames_of(spark, rows)).collect()))
    assert sorted(map(tuple, spark.table("throttled").select("stream_id", "frame_id", "at_s", "frame_no").collect())) == want
    ends = capture.batch_ends(spark.range(21).select(F.col("id").alias("frame_no")))
    assert [r[0] for r in ends.collect()] == [9, 19]


def test_increment_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, 5.0), ("s", 2, 90_000.0), ("s", 2, 90_000.0), ("s", 3, None)], "stream_id string, frame_id long, at_s double")
    path = str(tmp_path / "t")
    assert [capture.extract_increment(df, path) for _ in range(2)] == [3, 0]
    more = spark.createDataFrame([("s", 2, 90_000.0), ("s", 4, 90_001.0)], df.schema)
    assert [capture.extract_increment(more, path) for _ in range(2)] == [1, 0]
    days = spark.read.parquet(path).groupBy("day").count().collect()
    assert {r["day"]: r["count"] for r in days} == {0: 1, 1: 2, None: 1}


def test_job_state_batch_is_stream(spark, tmp_path):
    rows = [(i % 4, ["queued", "started", "status", "result"][i // 4 % 4], 1000 + i, i) for i in range(40)]
    schema = "archive_id long, kind string, epoch_ms long, event_id long"
    events = spark.createDataFrame(rows, schema)
    for k in range(2):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.parquet(str(tmp_path / f"in/k={k}"))
    stream = spark.readStream.schema(schema + ", k int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.job_state_stream(stream).writeStream.format("memory").queryName("jobs").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    last = reconcile.latest(spark.table("jobs"), ["archive_id"], ["n_events"])
    state = jobs.job_state(events.withColumn("success", F.lit(True)))
    assert sorted(map(tuple, last.select("archive_id", "kind", "epoch_ms", "n_events").collect())) == sorted(map(tuple, state.select("archive_id", "kind", "epoch_ms", "n_events").collect()))


def test_dispatch_and_stale(spark):
    asked = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 0.0)], "archive_id long, at_s double")
    heard = spark.createDataFrame([(2, 3.0), (3, 6.0)], "archive_id long, at_s double")
    assert {r["archive_id"]: (r["attempts"], r["outcome"]) for r in jobs.dispatch_retries(asked, heard).collect()} == {1: (3, "failed"), 2: (2, "answered"), 3: (3, "failed")}
    results = spark.createDataFrame([("j", 99), ("j", 100)], "job string, completed_at_epoch_ms long")
    starts = spark.createDataFrame([("j", 100)], "job string, started_at_epoch_ms long")
    assert [r["completed_at_epoch_ms"] for r in jobs.fresh_results(results, starts, ["job"]).collect()] == [100]


def test_dispatch_stream(spark, tmp_path):
    rows = [[(1, "dispatch_requested", 0.0), (2, "dispatch_requested", 0.0)], [(2, "dispatched", 3.0), (9, "dispatch_requested", 60.0)], [(9, "dispatched", 60.5), (8, "dispatch_requested", 200.0)]]
    for k, part in enumerate(rows):
        df = spark.createDataFrame(part, "archive_id long, kind string, at double").select("archive_id", "kind", F.timestamp_seconds(F.col("at") + 1000).alias("event_time"))
        df.coalesce(1).write.parquet(str(tmp_path / f"in/k={k}"))
    stream = spark.readStream.schema("archive_id long, kind string, event_time timestamp, k int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("event_time", "1 second")
    query = jobs.dispatch_retry_stream(stream.drop("k")).writeStream.format("memory").queryName("retries").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("retries").collect()} >= {(1, 3, "failed"), (2, 2, "answered"), (9, 1, "answered")}


def test_workers(spark):
    beats = spark.createDataFrame([("a", 2, 2, 90_000), ("b", 2, 0, 1_000), ("b", 2, 1, 70_000)], "worker_id string, max_concurrent long, running_count long, updated_at_epoch_ms long")
    workers = jobs.worker_liveness(beats, F.lit(100_000))
    assert {r["worker_id"]: (r["online"], r["full"]) for r in workers.collect()} == {"a": (True, True), "b": (False, False)}
    assert jobs.dispatch_outcome(workers).first()["outcome"] == "ALL_WORKERS_FULL"
