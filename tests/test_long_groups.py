"""Work on one long chain, one crowded component, one long stream: rounds and tasks, and the rows of the plain rule."""

import random

import numpy as np
import pytest

from tessera.operators import graph, pairs, sequence
from tessera.streaming import capture


def test_composition_of_a_long_chain(spark, monkeypatch):
    """5,000 images in a row: rounds are the logarithm of the depth, products those of the chain."""
    n, rounds = 5000, []
    draw = np.random.default_rng(1)
    turns = draw.normal(size=n) * 0.01
    steps = [np.array([[np.cos(t), -np.sin(t), draw.normal()], [np.sin(t), np.cos(t), draw.normal()], [0, 0, 1.0]]) for t in turns]
    edges = spark.createDataFrame([(i + 1, i, steps[i].reshape(-1).tolist()) for i in range(n - 1)], "image_a long, image_b long, homography array<double>")
    tree = spark.createDataFrame([(i, i, i - 1 if i else None) for i in range(n)], "node long, level int, parent long")
    real = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: (rounds.append(name), real(df, name))[1])
    got = {r["node"]: np.array(r["to_reference"]).reshape(3, 3) for r in graph.composed(edges, tree).collect()}
    assert len(got) == n and len(rounds) <= 14
    at = np.eye(3)
    for i in range(n):
        assert np.abs(got[i] - at).max() < 1e-9
        at = at @ steps[i] if i < n - 1 else at


def test_composition_of_branches_and_gaps(spark):
    """A tree with a crowd below one node, a missing homography, and the root alone."""
    shift = lambda x: [1.0, 0.0, x, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    edges = spark.createDataFrame([(0, 1, shift(1.0)), (2, 1, shift(2.0)), *((i, 2, shift(float(i))) for i in range(10, 60))], "image_a long, image_b long, homography array<double>")
    tree = spark.createDataFrame([(0, 0, None), (1, 1, 0), (2, 2, 1), (3, 3, 2), *((i, 3, 2) for i in range(10, 60))], "node long, level int, parent long")
    got = {r["node"]: r["to_reference"] and r["to_reference"][2] for r in graph.composed(edges, tree).collect()}
    assert got == {0: 0.0, 1: -1.0, 2: 1.0, 3: None, **{i: i + 1.0 for i in range(10, 60)}}
    assert graph.composed(edges, tree.where("level = 0")).count() == 1


def greedy(rows, cap):
    counts, out = {}, []
    for d, a, b in sorted(rows):
        if counts.get(a, 0) < cap or counts.get(b, 0) < cap:
            out.append((a, b))
            counts[a], counts[b] = counts.get(a, 0) + 1, counts.get(b, 0) + 1
    return sorted(out)


def test_degree_cap_on_one_component(spark):
    """100,000 pairs of one component, a third of them at one image: the greedy walk's pairs."""
    draw = random.Random(2)
    found = {(a, b) for a, b in ((draw.randrange(9000), draw.randrange(9000)) for _ in range(68_000)) if a < b} | {(0, b) for b in range(1, 34_000)}
    rows = [(round(draw.random(), 4), a, b) for a, b in found]
    df = spark.createDataFrame(rows, "xyz_m double, image_a long, image_b long")
    for cap in (1, 5):
        assert sorted((r["image_a"], r["image_b"]) for r in pairs.degree_capped(df, cap).collect()) == greedy(rows, cap)
    plan = pairs.degree_capped(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2, "an image's first pairs are to be sought before they meet"


def test_degree_cap_of_equal_rows(spark):
    rows = [(1.0, 1, 2)] * 4 + [(2.0, 1, 3), (2.0, 2, 3)]
    df = spark.createDataFrame([(*r, "g") for r in rows], "xyz_m double, image_a long, image_b long, g string")
    for group in (None, "g"):
        assert sorted((r["image_a"], r["image_b"]) for r in pairs.degree_capped(df, 2, group).collect()) == greedy(rows, 2)


def kept(times, d):
    out, last = [], None
    for t in sorted(t for t in times if t is not None):
        if last is None or t - last >= d:
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize("d", [0.3, 1.0, 50.0])
def test_one_long_stream_spreads(spark, d):
    """The last-kept rule on a stream over many ranges, on streams of one range, with ties and unknown times."""
    draw = random.Random(3)
    times = {"long": [draw.choice([draw.uniform(0, 900), float(draw.randrange(900))]) for _ in range(12_000)], None: [float(i) for i in range(40)], **{f"s{i}": [draw.uniform(0, 20) for _ in range(25)] for i in range(60)}}
    rows = [(g, i, t) for g, ts in times.items() for i, t in enumerate(ts)] + [("long", -1, None), ("s1", -1, None), ("s1", -2, float("nan"))]
    df = spark.createDataFrame(rows, "stream_id string, frame_id long, at_s double").repartition(8)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sequence.keep_spaced(df, d, "stream_id", ["at_s", "frame_id"], ("at_s",)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for g, ts in times.items():
        mine = sorted(r["at_s"] for r in got if r["stream_id"] == g and r["at_s"] is not None and r["at_s"] == r["at_s"])
        assert mine == kept(ts, d)
    assert sorted((r["stream_id"], r["frame_id"]) for r in got if r["at_s"] is None or r["at_s"] != r["at_s"]) == [("long", -1), ("s1", -2), ("s1", -1)]


def test_chains():
    """From every entry, a stretch's table gives what the walk gives."""
    draw = random.Random(4)
    for _ in range(60):
        xs, d = sorted(draw.choice([draw.uniform(0, 30), float(draw.randrange(30))]) for _ in range(draw.randrange(1, 80))), draw.choice([0.5, 3.0, 100.0])
        held = sequence.Chains(d)
        for x in xs:
            held.add(x)
        starts, ends = held.table()
        for entry in [xs[0] - draw.uniform(0, 1.5 * d) for _ in range(20)] + [xs[0]]:
            last = entry
            for x in xs:
                last = x if x - last >= d else last
            reached = [e for s, e in zip(starts, ends, strict=True) if s - entry >= d]
            assert (reached[0] if reached else entry) == last


def test_throttle_numbers_kept_frames(spark):
    df = spark.createDataFrame([("a", i, i * 0.4) for i in range(1000)], "stream_id string, frame_id long, at_s double")
    got = capture.throttle(df).orderBy("frame_no").collect()
    assert [r["frame_no"] for r in got] == list(range(len(got))) and [r["at_s"] for r in got] == kept([i * 0.4 for i in range(1000)], 1.0)
