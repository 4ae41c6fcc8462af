"""Quantiles of columns that hold infinite, huge, tiny and widely spread values."""

import math
import random

import pytest

from tessera.operators import robust

INF = float("inf")
DRAW = random.Random(0)
COLUMNS = {
    "one infinite value": [float(i) for i in range(3000)] + [INF],
    "both infinities": [-INF] * 10 + [float(i) for i in range(3000)] + [INF] * 2000,
    "only infinite": [INF] * 5,
    "beyond the largest difference": [DRAW.choice([-1, 1]) * DRAW.random() * 1.7e308 for _ in range(2000)],
    "the least doubles": [DRAW.randrange(2000) * 5e-324 for _ in range(2000)],
    "many magnitudes": [DRAW.choice([-1, 1, 1]) * 10.0 ** DRAW.uniform(-300, 300) for _ in range(2000)],
    "neighbouring doubles": [1 + DRAW.randrange(3) * 2.0**-52 for _ in range(500)],
}


def plain(values, p):
    values, rank = sorted(values), p * (len(values) - 1)
    lo, hi = values[math.floor(rank)], values[math.ceil(rank)]
    return lo if lo == hi or rank == math.floor(rank) else lo + (hi - lo) * (rank - math.floor(rank))


@pytest.mark.parametrize("name", ["one infinite value", "many magnitudes"])
def test_whole_column(spark, name):
    ps = [0.0, 0.1, 0.5, 1.0]
    df = spark.createDataFrame([(x,) for x in COLUMNS[name]], "x double")
    assert robust.quantiles(df, "x", ps, few=50, bins=64) == [plain(COLUMNS[name], p) for p in ps]


def test_groups(spark):
    df = spark.createDataFrame([(k, x) for k, v in COLUMNS.items() for x in [*v, None, float("nan")]], "g string, x double")
    got = {r["g"]: list(r["q"]) for r in robust.group_quantiles(df, "g", "x", [0.25, 0.5], few=50, bins=64).collect()}
    assert got == {k: [plain(v, p) for p in (0.25, 0.5)] for k, v in COLUMNS.items()}


def test_increment_writes_a_key_once(spark, tmp_path):
    """Also when the key comes again on another day, and where a part of it is null."""
    from tessera.streaming import capture

    path = f"file://{tmp_path}/frames"
    rows = lambda *r: spark.createDataFrame(r, "stream_id string, frame_id long, at_s double")
    assert capture.extract_increment(rows(("a", 1, 10.0), ("a", 2, 11.0), (None, 1, 10.0)), path) == 3
    assert capture.extract_increment(rows(("a", 1, 200_000.0), ("a", 3, 200_001.0), (None, 1, 5.0)), path) == 1
    assert capture.extract_increment(rows(("b", 1, None), ("b", 1, 3.0)), path) == 1
    got = sorted((str(r["stream_id"]), r["frame_id"]) for r in spark.read.parquet(path).collect())
    assert got == [("None", 1), ("a", 1), ("a", 2), ("a", 3), ("b", 1)]
