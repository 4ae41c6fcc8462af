"""Lookups by partition against all comparisons."""

import numpy as np
import pytest

from tessera.operators import coverage, robust


@pytest.mark.parametrize("sent", [4096, 0])
def test_nearest_camera(spark, monkeypatch, sent):
    """A wall that every camera sees, crowds of cameras in one place, points beyond reach: with boxes sent and met by cell."""
    monkeypatch.setattr(robust, "SENT_LEAVES", sent)
    draw = np.random.default_rng(1)
    cameras = np.r_[draw.uniform(0, 60, (300, 3)) * [1, 0.1, 0.5], np.tile([[5.0, 1.0, 2.0]], (50, 1)), draw.normal(0, 0.01, (80, 3)) + [30, 2, 9], [[400.0, 0.0, 0.0]]]
    points = np.r_[draw.uniform(-5, 65, (250, 3)) * [1, 0.1, 0.5], draw.uniform(-400, 800, (60, 3))]
    at = [(i, *map(float, p)) for i, p in enumerate(points)] + [(900, None, 1.0, 1.0)]
    p = spark.createDataFrame(at, "point_id long, x double, y double, z double")
    c = spark.createDataFrame([tuple(map(float, r)) for r in cameras] + [(None, 1.0, 1.0)], "x double, y double, z double")
    gap = np.sqrt(((points[:, None] - cameras[None]) ** 2).sum(axis=2)).min(axis=1)
    got = {r["point_id"]: r["gap"] for r in robust.nearest_camera(p, c, 150.0, leaf=16).collect()}
    assert len(got) == len(at) and got.pop(900) == 300.0
    assert all(abs(got[i] - (g if g <= 150 else 300.0)) < 1e-9 for i, g in enumerate(gap))
    leaves = robust.camera_leaves(c, 16).groupBy("leaf").count().collect()
    assert sum(r["count"] for r in leaves) == 382 and max(r["count"] for r in leaves) <= 16
    if sent:  # few of all cameras meet a point
        boxes = robust.camera_leaves(c, 16).groupBy("leaf").agg(*(f(d).alias(f"{n}_{d}") for d in "xyz" for n, f in (("lo", robust.F.min), ("hi", robust.F.max))))
        assert robust._asked_leaves(p.where("point_id < 250"), boxes, 150.0, "point_id").count() < 250 * 0.3 * len(leaves)
    assert {r["gap"] for r in robust.nearest_camera(p, c.where("false"), 150.0).collect()} == {300.0}


def test_boxes_of_all_sizes(spark):
    """Boxes from one pixel to 100,000: four copies at most, and the rows of all comparisons."""
    draw = np.random.default_rng(2)
    boxes = [(f"b{i:03d}", int(draw.integers(-50_000, 50_000)), int(draw.integers(-50_000, 50_000)), int(2 ** draw.uniform(0, 16.6)), int(2 ** draw.uniform(0, 16.6))) for i in range(150)] + [("edge", -64, 64, 64, 64), ("point", 5, 5, 1, 1), ("none", 1, 1, 0, 5), ("half", 0, 0, 65, 65)]
    points = [(i, int(draw.integers(-60_000, 60_000)), int(draw.integers(-60_000, 60_000))) for i in range(300)] + [(900, 5, 5), (901, -64, 127), (902, 64, 64)]
    feet = spark.createDataFrame(boxes, "image_id string, x int, y int, w int, h int")
    got = sorted((r["point_id"], r["rank"], r["image_id"]) for r in coverage.images_at(spark.createDataFrame(points, "point_id long, x int, y int"), feet, 5).collect())
    want = []
    for k, px, py in points:
        over = sorted((w * h, n) for n, x, y, w, h in boxes if x <= px < x + w and y <= py < y + h)[:5]
        want += [(k, i + 1, n) for i, (_, n) in enumerate(over)]
    assert got == sorted(want)
    plan = coverage.images_at(spark.createDataFrame(points, "point_id long, x int, y int"), feet.where("image_id = 'half'"), 5)
    assert plan.count() >= 2
    empty = coverage.images_at(spark.createDataFrame(points, "point_id long, x int, y int"), feet.where("false"), 5)
    assert empty.count() == 0
