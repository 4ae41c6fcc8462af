"""Work that grew with the square of a group."""

import random
import time

import pyarrow as pa
import pyarrow.parquet as pq

from tessera.operators import coverage, graph, kernels, tiles
from tessera.plans import queries, rasters
from tessera.streaming import states


def plainly(packets, wait):
    """Packets (number, time) of one stream: those in time, in order, and what is lost before each."""
    once = {}
    for s, t in packets:
        once[s] = min(t, once.get(s, t))
    order, later, kept = sorted(once), None, []
    for s in reversed(order):
        if later is None or once[s] <= later + wait:
            kept.append(s)
        later = once[s] if later is None else min(later, once[s])
    kept.reverse()
    first = min(s for s in kept if once[s] <= min(once.values()) + wait)
    kept = [s for s in kept if s >= first]
    return [(s, once[s], s - before - 1 if i else 0) for i, (before, s) in enumerate(zip([None, *kept], kept, strict=False))]


def test_packets_of_long_streams(spark):
    """A stream is looked at from behind, each row once, in ranges; before, each row looked at all behind it."""
    draw, packets = random.Random(3), []
    for stream, n in (("a", 3000), ("b", 200), ("c", 1)):
        packets += [(stream, s, s * 100 + draw.choice([0, 0, 0, 50, 900, 4000])) for s in range(10, 10 + 2 * n) if draw.random() < 0.8 or n == 1]
    rows = spark.createDataFrame(packets, "stream_id string, sequence_id long, at_ms long").repartition(7)
    got = states.reordered(rows, 2000)
    assert "UNBOUNDED FOLLOWING" not in got._jdf.queryExecution().toString().upper() and "UNBOUNDEDFOLLOWING" not in got._jdf.queryExecution().toString().upper()
    got = got.collect()
    for stream in "abc":
        mine = sorted((r["sequence_id"], r["at_ms"], r["lost"]) for r in got if r["stream_id"] == stream)
        assert mine == plainly([p[1:] for p in packets if p[0] == stream], 2000)


def test_matchers_that_wait_wait_together():
    """While calls only wait, others go on; each pair has its answer, those that a process had before it too."""

    def make():
        def match(a, b):
            if b.startswith("slow"):
                time.sleep(30)
            if b == "late":
                time.sleep(0.5)
            if b == "busy":
                end = time.process_time() + 0.4
                while time.process_time() < end:
                    pass
            return [(float(len(b)), 0.0, 0.0, 0.0, 1.0)]

        return match

    names = [f"slow{i // 10}" if i % 10 == 3 else "late" if i == 17 else "busy" if i == 28 else "x" * (i % 7) for i in range(120)]
    timed, began = kernels.Timed(make, 2.0), time.monotonic()
    got = timed([("a", b) for b in names])
    took = time.monotonic() - began
    timed.close()
    assert [s for s, *_ in got] == ["MATCH_TIMEOUT" if b.startswith("slow") else "OK" for b in names]
    assert all(found == [(float(len(b)), 0.0, 0.0, 0.0, 1.0)] for b, (s, found, _) in zip(names, got, strict=True) if s == "OK")
    assert took < 12  # one after the other, 24


def test_merging_points_makes_no_pairs(spark, monkeypatch):
    """Ids need not differ between groups; a point without a place stays alone."""
    monkeypatch.setattr("tessera.operators.pairs.radius_pairs", None)
    draw = random.Random(5)
    at = [(g, i, float(draw.randrange(60)), draw.randrange(600) / 10) for g in ("a", "b") for i in range(250)]
    rows = [*at, ("a", 900, None, 1.0), ("a", 901, None, 1.0), (None, 5, 1.0, 1.0), (None, 6, 1.0, 1.0)]
    got = graph.merge_points(spark.createDataFrame(rows, "image string, idx long, x double, y double"), 2.0, "image")
    got = sorted((r["image"] or "", r["root"], r["support"], round(r["x"] or 0.0, 6), round(r["y"], 6)) for r in got.collect())
    want = [("a", 900, 1, 0.0, 1.0), ("a", 901, 1, 0.0, 1.0), ("", 5, 1, 1.0, 1.0), ("", 6, 1, 1.0, 1.0)]
    for g in ("a", "b"):
        left = {i: (x, y) for h, i, x, y in at if h == g}
        while left:
            front, whole = [min(left)], {}
            while front:
                i = front.pop()
                if i in left:
                    whole[i] = x, y = left.pop(i)
                    front += [j for j, (u, v) in left.items() if (u - x) ** 2 + (v - y) ** 2 <= 4.0]
            want.append((g, min(whole), len(whole), *(round(sum(p[k] for p in whole.values()) / len(whole), 6) for k in (0, 1))))
    assert got == sorted(want)


def test_equal_boxes_and_places_are_met_once(spark):
    """2,000 boxes of ten shapes over 400 points in four places; ids that are there twice have their places' hits together."""
    boxes = [(i, i % 10, 0, 5 + i % 2, 4) for i in range(2000)]
    points = [(i % 399, 3 * (i % 4), 1) for i in range(400)]
    got = coverage.images_at(spark.createDataFrame(points, "point_id long, x long, y long"), spark.createDataFrame(boxes, "image_id long, x long, y long, w long, h long"), 5, 4)
    want = []
    for p in {p for p, *_ in points}:
        hits = sorted((w * h, i) for q, px, py in points if q == p for i, x, y, w, h in boxes if x <= px < x + w and y <= py < y + h)
        want += [(p, r + 1, i, area) for r, (area, i) in enumerate(hits[:5])]
    assert sorted((r["point_id"], r["rank"], r["image_id"], r["area"]) for r in got.collect()) == sorted(want)
    shapes = tiles.first_of_equal(spark.createDataFrame(boxes, "image_id long, x long, y long, w long, h long"), 12, 9)
    assert sorted(r["image_id"] for r in shapes.collect()) == list(range(10))


def test_owners_of_large_numbers(spark, tmp_path):
    """The SQL's mark takes an image's number off its distance in millionths, which tells beyond a million."""
    import duckdb

    draw = random.Random(9)
    keys = sorted({draw.randrange(40) * 700_001 + draw.randrange(2000) for _ in range(300)})
    pq.write_table(pa.table({"p_partkey": pa.array(keys, pa.int64()), "p_name": ["a"] * len(keys), "p_brand": ["Brand#1"] * len(keys), "p_type": ["b"] * len(keys), "p_size": pa.array([1 + k % 50 for k in keys], pa.int32()), "p_retailprice": [1.0] * len(keys)}), tmp_path / "part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    want = con.execute("SELECT cx, cy, image_id FROM (" + rasters.query.__globals__["SQL"]["seam_owners"] + ")").fetchall()
    got = queries()["seam_owners"](spark, str(tmp_path))
    assert sorted((r["cx"], r["cy"], r["image_id"]) for r in got.collect()) == sorted(want)
