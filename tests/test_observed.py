"""Keypoint operators, EXIF, message helpers."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import observations
from tessera.sources import exif, files, messages


def test_self_repeats(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 8)) * 5
    rows = []
    for k, y in enumerate((0.0, 100.0)):
        for i, d in enumerate(base):
            rows.append(("a", 1000, float(20 * i), y + i, 4.0 + k, 10.0, [float(v) for v in d + rng.normal(size=8) * 0.01]))
    df = spark.createDataFrame(rows, "image_id string, width int, x double, y double, size double, angle double, descriptor array<double>")
    for at_once in (512, 5):
        got = observations.self_repeats(df, at_once=at_once).collect()
        assert len(got) == 12 and all(r["dy"] == 100.0 and abs(r["weight"] - 0.8) < 1e-9 for r in got)


def test_corner_planes(spark):
    rng = np.random.default_rng(2)
    rows = [(c, f"i{k % n}", k, float(a), float(b), 3.0 * c) for c, n in ((1, 4), (2, 2)) for k, (a, b) in enumerate(rng.random((40, 2)))]
    df = spark.createDataFrame(rows, "corner_id int, image_id string, point_id int, x double, y double, z double")
    (got,) = observations.corner_planes(df).collect()
    assert got["corner_id"] == 1 and got["n_points"] == 40 and np.allclose([got["nx"], got["ny"], got["nz"]], [0, 0, 1]) and got["z"] == pytest.approx(3.0)


def entry(tag, kind, count, value):
    return struct.pack("<HHI", tag, kind, count) + value.ljust(4, b"\0")


def jpeg():
    """A JPEG with Make, DateTimeOriginal and a GPS position, built by hand."""
    data, at = b"", 300

    def far(raw):
        nonlocal data
        where = at + len(data)
        data += raw
        return struct.pack("<I", where)

    ratio = lambda *xs: b"".join(struct.pack("<II", int(x * 100), 100) for x in xs)
    base = struct.pack("<H", 3) + entry(0x010F, 2, 4, b"DJI\0") + entry(0x8769, 4, 1, struct.pack("<I", 100)) + entry(0x8825, 4, 1, struct.pack("<I", 180))
    sub = struct.pack("<H", 1) + entry(0x9003, 2, 20, far(b"2026:01:02 03:04:05\0"))
    gps = struct.pack("<H", 5) + entry(1, 2, 2, b"S\0") + entry(2, 5, 3, far(ratio(37, 30, 0))) + entry(3, 2, 2, b"E\0") + entry(4, 5, 3, far(ratio(127, 0, 36))) + entry(6, 5, 1, far(ratio(12.5)))
    tiff = bytearray(at)
    tiff[:8] = b"II*\0" + struct.pack("<I", 8)
    for where, part in ((8, base), (100, sub), (180, gps)):
        tiff[where : where + len(part)] = part
    body = b"Exif\0\0" + bytes(tiff) + data
    frame = b"\x08" + struct.pack(">HH", 3956, 5280) + b"\x03"
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xc0" + struct.pack(">H", len(frame) + 2) + frame + b"\xff\xda\x00\x02"


def test_exif(spark):
    tags = exif.tags_of(jpeg())
    assert tags["Make"] == "DJI" and tags["GPSLatitude"] == "37.0,30.0,0.0" and (tags["ImageWidth"], tags["ImageHeight"]) == ("5280", "3956")
    for cut in range(0, len(jpeg()), 7):
        exif.tags_of(jpeg()[:cut])
    images = spark.createDataFrame([("/f/DJI_1.jpg", bytearray(jpeg())), ("/f/x.jpg", bytearray(b"no"))], "path string, content binary")
    rows = {r["image_id"]: r for r in exif.catalog(images).collect()}
    r = rows["DJI_1"]
    assert tuple(r["gps"]) == (pytest.approx(-37.5), pytest.approx(127.01), 12.5) and r["timestamp_utc"] == "2026-01-02T03:04:05" and r["drone_model"] == "DJI"
    assert (r["width"], r["height"]) == (5280, 3956) and rows["x"]["width"] is None


def test_messages(spark):
    tags = spark.createDataFrame([("f", 0, 0), ("f", 1, 40), ("f", 2, 30)], "path string, tag_no int, timestamp_ms long")
    assert [(r["due_ms"], r["wait_ms"]) for r in messages.replay(tags, F.lit(1000)).orderBy("tag_no").collect()] == [(1000, 0), (1040, 40), (1030, 0)]
    twice = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 1.0)], "sequence_id long, at_s double")
    assert messages.once(twice, ["sequence_id"], "at_s").count() == 2
    assert files.flat_listing(spark.createDataFrame([("/a/1.jpg",), ("/a/1.jpg",), ("/a/b/2.jpg",), ("/a/3.JPEG",)], "path string"), "/a").count() == 2


def test_plane_homography(spark):
    """Image points of a plane's points go back to their places on the plane."""
    from tessera.functions import linalg

    rng = np.random.default_rng(5)
    k = np.array([[800.0, 0, 320], [0, 800, 240], [0, 0, 1]])
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    origin, e_u, e_v = rng.normal(size=3), turn[0], turn[1]
    rotation, translation = np.linalg.qr(rng.normal(size=(3, 3)))[0], np.array([0.1, -0.2, 9.0])
    u, v = 1.5, -0.7
    seen = k @ (rotation @ (origin + u * e_u + v * e_v) + translation)
    col = lambda x: F.array(*(F.lit(float(y)) for y in np.ravel(x)))
    h = linalg.plane_homography(*(col(x) for x in (k, rotation, translation, origin, e_u, e_v)))
    at = spark.range(1).select(linalg.apply_homography(h, F.lit(float(seen[0] / seen[2])), F.lit(float(seen[1] / seen[2]))).alias("p")).first()["p"]
    assert (at["x"], at["y"]) == (pytest.approx(u), pytest.approx(v))


def test_unknown_never_rejects(spark):
    from tessera.operators import gates

    none = F.lit(None).cast("double")
    for dz, shift in ((none, F.lit(500.0)), (F.lit(9.0), none), (none, none)):
        r = spark.range(1).select(gates.pose_consistent(dz, shift), gates.floors_consistent(dz, shift, none, none)).first()
        assert tuple(r) == (True, True)
