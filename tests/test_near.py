"""The graph of near points without a table of its edges, against the graph of its edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, near, pairs
from tessera.plans import graphs


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def cloud(spark, n=500, spread=1.7, decimals=1):
    at = np.round(np.random.default_rng(n).normal(0, spread, (n, 3)), decimals)
    out = [(i * 7 % 1009, *map(float, p)) for i, p in enumerate(at)]
    return spark.createDataFrame([*out, (2000, float("nan"), 0.0, 0.0), (2001, None, 0.0, 0.0), (2002, 0.0, float("inf"), 0.0)], "image_id long, x double, y double, z double")


def edges_of(points, radius):
    return pairs.radius_pairs(points.where("image_id < 2000"), radius).select(F.col("a.image_id").alias("a"), F.col("b.image_id").alias("b")).cache()


@pytest.mark.parametrize("radius", [0.0, 0.4, 1.0])
def test_levels(spark, radius):
    points = cloud(spark)
    edges = edges_of(points, radius)
    start = graph.reference(edges).select("node")
    want = graph.levels(edges, start)
    assert rows(near.levels(points, start, radius, block_rows=64), "node", "level", "parent") == rows(want, "node", "level", "parent")


def test_levels_of_a_chain(spark):
    points = spark.createDataFrame([(i, 0.9 * i, 0.0, 0.0) for i in range(12)] + [(50, 30.0, 0.0, 0.0)], "image_id long, x double, y double, z double")
    got = rows(near.levels(points, spark.createDataFrame([(0,)], "node long"), 1.0, block_rows=3), "level", "node", "parent")
    assert sorted(got) == sorted((i, i, i - 1 if i else None) for i in range(12))


def refused(*_):
    raise AssertionError("a table of all edges")


def small(name, spark, sf_dir, monkeypatch):
    monkeypatch.setattr(graphs, "edges", refused)
    return graphs.query.__globals__["QUERIES"][name](spark, sf_dir)


def test_drift_makes_no_table_of_edges(spark, sf_dir, duck, monkeypatch):
    got = small("composition_drift", spark, sf_dir, monkeypatch).collect()
    mean, most, n = duck.sql(graphs.EDGES + graphs.DRIFT).fetchall()[0]
    assert [(r["cycle_edges"], r["mean_drift_px"], r["max_drift_px"]) for r in got] == [(n, pytest.approx(mean, abs=1e-4), pytest.approx(most, abs=1e-4))]


def test_drift_of_turned_images(spark):
    """Homographies that do more than shift, with one that has no inverse and one that is not known."""
    points = cloud(spark, 60, 1.0)
    edges = edges_of(points, 1.0)
    tree = graph.levels(edges, graph.reference(edges).select("node")).cache()
    some = F.array(*(F.lit(float(i in (0, 4, 8))) + F.sin(F.col("node") * (i + 1)) * (1e-4 if i > 5 else 0.3) for i in range(9)))
    homographies = tree.where("node % 11 <> 3").select("node", F.when(F.col("node") % 13 != 5, some).otherwise(F.array(*[F.lit(1.0)] * 9)).alias("to_reference")).cache()
    unit = F.array(*(F.lit(float(i in (0, 4, 8))) for i in range(9)))
    results = edges.select(F.col("a").alias("image_a"), F.col("b").alias("image_b"), unit.alias("homography"))
    sizes = homographies.select("node", F.lit(640).alias("width"), F.lit(480).alias("height"))
    want = graph.drift(results, graph.cycle_edges(edges, tree), homographies, sizes).first()
    got = near.drift(points, tree, homographies, lambda a, b: [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], (640.0, 480.0), 1.0).first()
    assert got["cycle_edges"] == want["cycle_edges"] > 50
    assert got["mean_drift_px"] == pytest.approx(want["mean_drift_px"]) and got["max_drift_px"] == pytest.approx(want["max_drift_px"])


@pytest.mark.parametrize("radius,size", [(0.0, 64), (0.3, 32), (1.0, 64), (3.0, 500)])
def test_components(spark, radius, size):
    points = cloud(spark)
    want = graph.components(edges_of(points, radius))
    assert rows(near.components(points, radius, block_rows=size).where("size > 1"), "node", "root") == rows(want, "node", "root")


def test_crowded_cells_that_just_meet(spark):
    """Two crowds, of which one point each is near the other's; a third is a little farther."""
    crowd = lambda x, k: [(k + i, x + 0.0001 * (i % 7), 0.01 * (i // 40), 0.0) for i in range(200)]
    points = [*crowd(0.0, 0), *crowd(1.3, 1000), *crowd(3.0, 2000), (500, 0.4, 0.0, 0.0), (1500, 1.1, 0.0, 0.0)]
    points = spark.createDataFrame(points, "image_id long, x double, y double, z double")
    got = {r["node"]: (r["root"], r["size"]) for r in near.components(points, 0.75, block_rows=150).collect()}
    assert got[0] == got[500] == got[1199] == got[1500] == (0, 402) and got[2000] == got[2199] == (2000, 200)


@pytest.mark.parametrize("name", ["components", "component_sizes", "largest_component_reference", "unreachable", "cycle_edges", "bfs_levels"])
def test_queries_make_no_table_of_edges(spark, sf_dir, monkeypatch, name):
    """What they give is held against their SQL in test_oracle."""
    got = small(name, spark, sf_dir, monkeypatch)
    assert got.columns


def test_ids_that_are_there_twice_join_their_places(spark, sf_dir, tmp_path, duck):
    twice = duck.sql("SELECT vec_id % 40 AS vec_id, embedding, label FROM embeddings WHERE vec_id < 50").arrow()
    import pyarrow.parquet as pq

    pq.write_table(twice.read_all() if hasattr(twice, "read_all") else twice, tmp_path / "embeddings.parquet")
    con = __import__("duckdb").connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = sorted(con.execute(graphs.EDGES + " SELECT node, root FROM comp").fetchall())
    assert sorted(map(tuple, graphs.components(spark, str(tmp_path)).collect())) == want
