"""Queries that have no SQL against plain versions in Python."""

import math

import numpy as np
import pytest

from tessera.plans import graphs, inputs, queries


def rows(spark, sf_dir, name):
    return [tuple(r) for r in queries()[name](spark, sf_dir).collect()]


def test_degree_capped(spark, sf_dir, duck):
    chain = f"{inputs.CHAIN.replace('WITH', 'WITH', 1)}"
    first = duck.sql(f"{chain} SELECT image_a, image_b FROM selected WHERE reason = 'temporal_neighbor'").fetchall()
    near = duck.sql(
        f"""{chain}, d AS (SELECT a.image_id AS image_a, b.image_id AS image_b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM enu a JOIN enu b ON a.image_id < b.image_id)
        SELECT s.image_a, s.image_b, d FROM selected s JOIN d USING (image_a, image_b) WHERE reason = 'gps_proximity' ORDER BY d, 1, 2"""
    ).fetchall()
    counts, want = {}, set(first)
    for a, b, _ in near:
        if counts.get(a, 0) < 3 or counts.get(b, 0) < 3:
            want.add((a, b))
            counts[a], counts[b] = counts.get(a, 0) + 1, counts.get(b, 0) + 1
    assert {r[:2] for r in rows(spark, sf_dir, "pairs_degree_capped")} == want


def snyder(lat, lon, epsg):
    """Transverse Mercator by the older series in the longitude difference, good to millimetres within a zone."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2, phi, lam = e2 / (1 - e2), math.radians(lat), math.radians(lon - (epsg % 100 * 6 - 183))
    n, t, c, A = a / math.sqrt(1 - e2 * math.sin(phi) ** 2), math.tan(phi) ** 2, ep2 * math.cos(phi) ** 2, math.cos(phi) * lam
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * phi) - 35 * e2**3 / 3072 * math.sin(6 * phi))
    x = k0 * n * (A + (1 - t + c) * A**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep2) * A**5 / 120) + 500_000
    y = k0 * (m + n * math.tan(phi) * (A**2 / 2 + (5 - t + 9 * c + 4 * c**2) * A**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * ep2) * A**6 / 720))
    return x, y + (10_000_000 if epsg >= 32700 else 0)


def test_utm_xy(spark, sf_dir):
    got = rows(spark, sf_dir, "utm_xy")
    assert got
    for key, epsg, x, y in got:
        lat, lon = key * 37 % 1400 / 10 - 70, key * 91 % 3600 / 10 - 180
        assert (x, y) == pytest.approx(snyder(lat, lon, epsg), abs=0.05)


def test_plane_fit(spark, sf_dir, duck):
    at = np.array(duck.sql(f"WITH {inputs.LOCATED}, {inputs.MEANS}, {inputs.ENU} SELECT x, y, z FROM enu").fetchall())
    values, vectors = np.linalg.eigh(np.cov(at.T, bias=True))
    for axis, x, y, z, variance in rows(spark, sf_dir, "plane_fit"):
        v = vectors[:, 2 - axis]
        v = v * np.sign(v[np.abs(v).argmax()])
        assert np.allclose([x, y, z], v, atol=1e-4) and variance == pytest.approx(values[2 - axis], rel=1e-5)


def test_composition_drift(spark, sf_dir, duck):
    edges = duck.sql(graphs.EDGES + " SELECT a, b FROM e").fetchall()
    at = {v: np.array([x, y]) for v, x, y in duck.sql(f"WITH {inputs.LOCATED}, {inputs.MEANS}, {inputs.ENU} SELECT vec_id, x, y FROM enu").fetchall()}
    shift = {(a, b): at[b] - at[a] + [float((a + b) % 3 == 0), 0] for a, b in edges}
    tree = duck.sql(graphs.EDGES + graphs.LEVELS + " SELECT node, level, parent FROM tree ORDER BY level").fetchall()
    place, branches = {}, set()
    for node, level, parent in tree:
        if parent is None:
            place[node] = np.zeros(2)
            continue
        step = shift[node, parent] if (node, parent) in shift else -shift[parent, node]
        place[node] = place[parent] + step
        branches.add((min(node, parent), max(node, parent)))
    cycles = [e for e in edges if e not in branches]
    gaps = [float(np.linalg.norm(place[a] - place[b] - shift[a, b])) for a, b in cycles if a in place and b in place]
    ((mean, most, n),) = rows(spark, sf_dir, "composition_drift")
    assert n == len(cycles)
    if gaps:
        assert mean == pytest.approx(np.mean(gaps), abs=1e-3) and most == pytest.approx(max(gaps), abs=1e-3)
    else:
        assert mean is None and most is None
