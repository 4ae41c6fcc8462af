"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative per group.

Equal vectors of a label are one class, so copies meet nobody. Classes of a label start in one cell; a cell of many classes
is split by spherical k-means over a bounded sample of it, level by level. A class has its home in the cell of the nearest
centre, and visits every other cell in which a class within the wanted angle may have its home: for unit vectors y and x
with x nearer to centre a than to c, y * (c - a) is at most |y - x| * |c - a|. So no link is lost at a border. A cell that
k-means does not make cheaper (a crowd of near copies) stays whole. Within a cell, blocks of classes meet block by block,
each pair of blocks in a group of its own: cosines come from one matrix product, every class counts the homes it is linked
with, and a spanning forest of the links, not the links, goes on to the components.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.graph import components
from .common import materialize, read, release, ship

COSINE = 0.98
#: Classes at home in a cell beyond which it is split, classes of the sample that a split is fitted on (about), children of
#: a split at least and at most, rounds of k-means, and the share of the products that a split may leave to be worth it.
CELL_ROWS = 1024
SAMPLE_ROWS = 4096
LEAST_CHILDREN, CHILDREN = 8, 32
ROUNDS = 8
WORTH = 0.8
#: Rows of a cell that a task assigns, and of a block (about): two blocks and their links are what a task holds.
STREAM_ROWS = 65536
BLOCK_ROWS = 2048
TILE_ROWS = 512
#: Rounding of a product of unit vectors stays far below this.
SLACK = 1e-9

STATE = "cell string, home boolean, id long, m long, vec binary"
MODEL = "cell string, k int, centres binary"
MET = "id long, other long, links long"


def packed(classes: DataFrame, width: int, kind: str) -> DataFrame:
    """classes(id, label, embedding, m) as rows of STATE: vectors as they are (kind: f4 or f8), shorter ones ending in zeros."""
    ship(classes.sparkSession)
    schema = T.StructType.fromDDL(STATE)
    arrow = to_arrow_schema(schema)

    def run(batches):
        import numpy as np

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.zeros((batch.num_rows, width), kind)
            for i, x in enumerate(batch.column("embedding").to_pylist()):
                rows[i, : len(x)] = x
            vec = pa.array([x.tobytes() for x in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("cell").cast(pa.string()), pa.array([True] * len(rows)), batch.column("id"), batch.column("m"), vec], schema=arrow)

    return classes.select(F.col("label").cast("string").alias("cell"), "id", "m", F.col("embedding")).mapInArrow(run, schema)


def unit_vectors(column, kind: str):
    """Packed vectors as a matrix of unit vectors in double precision."""
    import numpy as np

    values = column.to_pylist()
    rows = np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spherical_centres(rows, k: int, seed: int, rounds: int = ROUNDS):
    """Centres of spherical k-means, begun far apart (each drawn by its distance to those before); fewer where cells empty."""
    import numpy as np

    draw = np.random.default_rng(seed)
    chosen = [int(draw.integers(len(rows)))]
    far = 1 - rows @ rows[chosen[0]]
    while len(chosen) < min(k, len(rows)):
        share = np.cumsum(np.maximum(far, 0) + 1e-12)
        chosen.append(int(np.searchsorted(share, draw.random() * share[-1])))
        far = np.minimum(far, 1 - rows @ rows[chosen[-1]])
    centres = rows[chosen]
    for _ in range(rounds):
        nearest = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        length = np.sqrt((sums**2).sum(axis=1))
        some = length > 1e-9
        centres = sums[some] / length[some, None]
    return centres


def homes_and_visits(rows, centres, cosine: float):
    """The nearest centre of each row, and a matrix of the cells (its home among them) that a row has to be in."""
    import numpy as np

    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK  # how far apart two linked unit vectors are at most
    near = rows @ centres.T
    apart = np.sqrt(np.maximum(0, ((centres[:, None] - centres[None]) ** 2).sum(axis=2)))
    visits = np.stack([(near - reach * apart[a]).max(axis=1) <= near[:, a] + SLACK for a in range(len(centres))], axis=1)
    return near.argmax(axis=1), visits


def fit_cells(state: DataFrame, cells: DataFrame, kind: str, cosine: float, cell_rows: int, sample_rows: int) -> DataFrame:
    """A row of MODEL for each of cells(cell, homes, rows) that is worth splitting, fitted on about sample_rows of its homes,
    which are chosen by a hash of their ids."""
    arrow = to_arrow_schema(T.StructType.fromDDL(MODEL))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        import zlib

        import numpy as np

        cell = key[0].as_py()
        table = table.sort_by("id")
        rows = unit_vectors(table.column("vec"), kind)
        k = min(CHILDREN, max(LEAST_CHILDREN, math.ceil(2 * table.column("homes")[0].as_py() / cell_rows)))
        centres = spherical_centres(rows, k, zlib.crc32(cell.encode()))
        home, visits = homes_and_visits(rows, centres, cosine)
        work = (np.bincount(home, minlength=len(centres)) * visits.sum(axis=0)).sum()
        keep = len(centres) > 1 and work <= WORTH * len(rows) ** 2
        out = {"cell": [cell], "k": [len(centres)], "centres": [centres.tobytes()]} if keep else {"cell": [], "k": [], "centres": []}
        return pa.Table.from_pydict(out, schema=arrow)

    chosen = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 40)) / float(1 << 40) * F.col("homes") < sample_rows
    sample = state.where("home").join(cells, "cell").where(chosen).select("cell", "id", "homes", "vec")
    return sample.groupBy("cell").applyInArrow(run, MODEL)


def split_cells(state: DataFrame, models: DataFrame, cells: DataFrame, kind: str, cosine: float) -> DataFrame:
    """The rows of the cells that have a model, in the cells below. The model comes first and the rows stream by; a crowded
    cell has several streams, each with a copy of its model, of bounded size."""
    schema = T.StructType.fromDDL(STATE)
    arrow = to_arrow_schema(schema)
    streams = cells.join(models.select("cell"), "cell").select("cell", F.ceil(F.col("rows") / STREAM_ROWS).cast("int").alias("streams"))
    dealt = state.join(streams, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("streams")).cast("int").alias("stream"), F.lit(1).alias("part"), "home", "id", "m", "vec")
    fitted = models.join(streams, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("streams") - 1)).alias("stream"), F.lit(0).alias("part"), F.lit(None).cast("boolean").alias("home"), F.lit(None).cast("long").alias("id"), F.col("k").cast("long").alias("m"), F.col("centres").alias("vec"))

    def run(batches):
        import numpy as np

        centres = None
        for batch in batches:
            cells, parts = batch.column("cell").to_pylist(), np.asarray(batch.column("part"))
            at = 0
            while at < batch.num_rows:
                if parts[at] == 0:
                    centres = np.frombuffer(batch.column("vec")[at].as_py(), np.float64).reshape(batch.column("m")[at].as_py(), -1)
                    at += 1
                    continue
                end = at + 1
                while end < batch.num_rows and parts[end] and cells[end] == cells[at]:
                    end += 1
                some = batch.slice(at, end - at)
                home, visits = homes_and_visits(unit_vectors(some.column("vec"), kind), centres, cosine)
                row, cell = np.nonzero(visits)
                mine = np.asarray(some.column("home").to_pylist(), bool)[row] & (home[row] == cell)
                took = some.take(pa.array(row))
                names = pa.array([f"{cells[at]}/{c}" for c in cell], pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(mine), took.column("id"), took.column("m"), took.column("vec")], schema=arrow)
                at = end

    return fitted.unionByName(dealt).repartition("cell", "stream").sortWithinPartitions("cell", "stream", "part").mapInArrow(run, schema)


def forest(links):
    """A spanning forest of a two-sided graph given as a matrix of booleans: pairs of row and column."""
    import numpy as np

    rows, columns = np.nonzero(links.any(axis=1))[0], np.nonzero(links.any(axis=0))[0]
    small = links[np.ix_(rows, columns)]
    new_row, new_column = np.ones(len(rows), bool), np.ones(len(columns), bool)
    out = []
    for first in range(len(rows)):
        if not new_row[first]:
            continue
        new_row[first], front = False, [first]
        while front:
            r = front.pop()
            hit = np.nonzero(small[r] & new_column)[0]
            new_column[hit] = False
            out += [(rows[r], columns[c]) for c in hit]
            for c in hit:
                if not new_row.any():
                    break
                more = np.nonzero(small[:, c] & new_row)[0]
                new_row[more] = False
                out += [(rows[x], columns[c]) for x in more]
                front += more.tolist()
    return out


def met_blocks(state: DataFrame, kind: str, cosine: float, block_rows: int) -> DataFrame:
    """Rows of MET: with `links`, the number of rows at home in a cell that a class is linked with there; with `other`, a
    link that holds a group of links together."""
    sizes = state.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = state.join(sizes, "cell").withColumn("block", block).withColumn("met_by", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = placed.select("cell", F.least("block", "met_by").alias("p"), F.greatest("block", "met_by").alias("q"), "block", "home", "id", "m", "vec")
    arrow = to_arrow_schema(T.StructType.fromDDL(MET))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        import numpy as np

        p, q = key[1].as_py(), key[2].as_py()
        blocks = np.asarray(table.column("block").to_pylist())
        sides = [table.filter(pa.array(blocks == b)) for b in (p, q)]
        ids, m, home = ([np.asarray(t.column(c).to_pylist(), kind) for t in sides] for c, kind in (("id", np.int64), ("m", np.float64), ("home", bool)))
        none = pa.Table.from_pydict({"id": [], "other": [], "links": []}, schema=arrow)
        if not len(ids[0]) or not len(ids[1]):
            return none
        left, right = (unit_vectors(t.column("vec"), kind) for t in sides)
        links = np.zeros((len(left), len(right)), bool)
        for at in range(0, len(left), TILE_ROWS):
            links[at : at + TILE_ROWS] = left[at : at + TILE_ROWS] @ right.T >= cosine
        if p == q:
            np.fill_diagonal(links, False)
        # Two visitors meet at home elsewhere.
        links &= home[0][:, None] | home[1][None, :]
        out = {"id": [], "other": [], "links": []}
        for side, hits in ((0, links @ (m[1] * home[1])), (1, links.T @ (m[0] * home[0]))):
            if p == q and side:
                break
            some = np.nonzero(hits)[0]
            out["id"] += ids[side][some].tolist()
            out["links"] += hits[some].astype(np.int64).tolist()
            out["other"] += [None] * len(some)
        for r, c in forest(links):
            out["id"].append(int(ids[0][r]))
            out["other"].append(int(ids[1][c]))
            out["links"].append(None)
        return pa.Table.from_pydict(out, schema=arrow)

    return met.groupBy("cell", "p", "q").applyInArrow(run, MET)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, cell_rows: int = CELL_ROWS, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS, most_levels: int = 40) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding, label).

    Rows of one label link if the cosine of their vectors, in double precision, is at least `cosine`, which has to be over 0.
    Rows without vec_id or label, and vectors that are null, zero, empty or hold null or non-finite components, link with
    nothing; their component is their own vec_id. A shorter vector counts as ending in zeros. Repeated rows are rows of
    their own, linked with each other. All links are found, whatever the cells. An empty table gives no rows.
    """
    x = F.col("embedding")
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select("vec_id", "label", x.cast("array<double>").alias("embedding"))
    takes_part = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fit, F.lit(False))
    some = rows.where(takes_part)
    classes = some.groupBy("label", "embedding").agg(F.count("*").alias("m"), F.min("vec_id").alias("least"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    width = classes.agg(F.max(F.size("embedding"))).first()[0] or 1
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"
    state, settled = materialize(packed(classes, width, kind), "vector-cells"), []
    written = [state]
    for _ in range(most_levels):
        cells = materialize(state.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("rows")), "cell-sizes")
        models = materialize(fit_cells(state, cells.where(F.col("homes") > cell_rows), kind, cosine, cell_rows, sample_rows), "cell-models")
        written += [cells, models]
        if models.isEmpty():
            break
        settled.append(state.join(models.select("cell"), "cell", "left_anti"))
        state = materialize(split_cells(state, models, cells, kind, cosine), "vector-cells")
        written.append(state)
    met = materialize(met_blocks(_all([*settled, state]), kind, cosine, block_rows), "vector-links")
    release(*written)
    counts = met.where("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(met.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = classes.join(groups.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    judged = named.join(least, "root").join(counts, "id", "left").select("label", "embedding", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    judged = materialize(judged, "vector-groups")
    release(met, classes)
    joined = some.join(judged, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~takes_part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def op11_spherical_neardups(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w,
    coalesce(vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS fit FROM embeddings
), u AS (
  SELECT *, sqrt(list_inner_product(w, w)) AS size FROM v WHERE fit
), e AS (
  SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND a.r <> b.r WHERE list_inner_product(a.w, b.w) / (a.size * b.size) >= 0.98
), c AS (
  SELECT r AS node, vec_id AS root FROM v UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node
), g AS (
  SELECT node, min(root) AS component_id FROM c GROUP BY node
), n AS (
  SELECT a, count(*) AS n_links FROM e GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN g ON g.node = v.r LEFT JOIN n ON n.a = v.r
"""
