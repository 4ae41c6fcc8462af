"""Embedding whitening: exact distributed moments, float32 eigenvectors refined in higher precision.

Components are turned into whole numbers, so that sums and products about a whole centre are exact in any order: tasks emit
sums, which Spark adds as decimals. The driver gets one matrix, whose size is that of a vector and not of the table. Its
eigenvectors are first taken in float32 and then corrected by Ogita and Aishima's iterations, which are matrix products, in
extended precision. Where eigenvalues lie closer than an iteration can tell apart, the block of the matrix that belongs to
them is shifted, solved by itself, and the vectors are turned within their space.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialize, read, ship

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: Whole numbers beyond this, either way, count as not finite.
LARGEST = 1 << 40
#: Rows that a task turns into a matrix at a time, and bits of a factor whose products stay exact in double precision.
SLICE_ROWS = 2048
LIMB_BITS = 20
#: Vectors longer than this are refused: the covariance goes to the driver.
WIDEST = 4096
#: An eigenvalue below this share of the trace is taken for zero: nothing varies along it that could be scaled to one.
LEAST_SHARE = 1e-12
#: Steps of the refinement at most (three to six are usual), and roundings within which eigenvalues count as a cluster.
MOST_STEPS = 40
CLOSE = 1e4

WHOLE = "vec_id long, x binary"
MOMENT = "i int, j int, total decimal(38,0)"


def whole_numbers(vectors: DataFrame, width: int) -> DataFrame:
    """vectors(vec_id, embedding) as binary rows of long floor(64 * component) + 1000000; those that take no part are left out."""
    ship(vectors.sparkSession)
    arrow = to_arrow_schema(T.StructType.fromDDL(WHOLE))

    def run(batches):
        import numpy as np

        for batch in batches:
            ids, found = [], []
            for vec, row in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if row is None or None in row:
                    continue
                x = np.zeros(width)
                with np.errstate(over="ignore"):
                    x[: len(row)] = np.floor(SCALE * np.asarray(row, np.float64))
                if (np.abs(x) < LARGEST).all():  # not so for nan
                    ids.append(vec)
                    found.append((x.astype("<i8") + SHIFT).tobytes())
            yield pa.RecordBatch.from_pydict({"vec_id": ids, "x": found}, schema=arrow)

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, T.StructType.fromDDL(WHOLE))


def _slices(batches):
    """Batches of WHOLE as (ids, matrix of longs), few rows at a time."""
    import numpy as np

    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            some = batch.slice(at, SLICE_ROWS)
            rows = some.column("x").to_pylist()
            yield some.column("vec_id"), np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), -1)


def exact_products(x):
    """The transpose of x times x for whole numbers of any size, as Python's integers."""
    import numpy as np

    limbs = []
    while x.any():
        low = x & ((1 << LIMB_BITS) - 1) if abs(x).max() >= 1 << LIMB_BITS else x
        limbs.append(low.astype(np.float64))
        x = (x - low) >> LIMB_BITS
    out = np.zeros((x.shape[1],) * 2, object)
    for a, p in enumerate(limbs):
        for b, q in enumerate(limbs):
            out += (p.T @ q).astype(np.int64).astype(object) << (LIMB_BITS * (a + b))
    return out


def moments(rows: DataFrame, width: int, centre: list[int] | None = None):
    """From WHOLE: the number of rows and, as integers, sums of each component less the centre; with a centre, which makes
    the products small, also the sums of products of two of them. Row -1 of a task's sums holds the sums, entry -1 the count."""
    arrow = to_arrow_schema(T.StructType.fromDDL(MOMENT))

    def run(batches):
        import decimal

        import numpy as np

        n, sums = 0, np.zeros(width, object)
        products = np.zeros((width, width), object) if centre is not None else None
        for _, x in _slices(batches):
            n += len(x)
            y = x - np.asarray(centre, np.int64) if centre is not None else x
            sums += (y >> 20).sum(axis=0).astype(object) * (1 << 20) + (y & ((1 << 20) - 1)).sum(axis=0).astype(object)
            if centre is not None:
                products += exact_products(y)
        if not n:
            return
        with decimal.localcontext(prec=38):
            entries = [(-1, -1, n)] + [(-1, j, int(s)) for j, s in enumerate(sums)]
            if centre is not None:
                entries += [(i, j, int(products[i, j])) for i in range(width) for j in range(i, width)]
            i, j, total = zip(*entries, strict=True)
            yield pa.RecordBatch.from_pydict({"i": i, "j": j, "total": [decimal.Decimal(t) for t in total]}, schema=arrow)

    totals = rows.mapInArrow(run, T.StructType.fromDDL(MOMENT)).groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    got = {(r["i"], r["j"]): int(r["total"]) for r in totals}
    n = got.get((-1, -1), 0)
    sums = [got.get((-1, j), 0) for j in range(width)]
    return n, sums, [[got.get((min(i, j), max(i, j)), 0) for j in range(width)] for i in range(width)] if centre is not None else None


def covariance(n: int, sums: list[int], products: list[list[int]]):
    """The covariance, divisor n, of exact moments, rounded once to extended precision."""
    from fractions import Fraction

    import numpy as np

    def rounded(top: int):
        exact = Fraction(top, n * n)
        return np.longdouble(float(exact)) + np.longdouble(float(exact - Fraction(float(exact))))

    width = len(sums)
    out = np.zeros((width, width), np.longdouble)
    for i in range(width):
        for j in range(i, width):
            out[i, j] = out[j, i] = rounded(n * products[i][j] - sums[i] * sums[j])
    return out


def clusters(values, least):
    """Runs of two or more positions whose neighbouring values, in order, are no farther apart than `least`."""
    import numpy as np

    order = np.argsort(values, kind="stable")
    runs = np.split(order, np.nonzero(np.diff(values[order]) > least)[0] + 1)
    return [run for run in runs if len(run) > 1]


def turned(a, x):
    """Vectors of a cluster turned within their space: the matrix less their mean eigenvalue, small there, is solved alone."""
    import numpy as np

    middle = (x * (a @ x)).sum() / (x * x).sum()
    inner = x.T @ (a @ x - middle * x)
    size = np.abs(inner).max()
    if not size:
        return x
    inner = (inner / size).astype(np.float64)
    return x @ orthonormal(np.linalg.eigh((inner + inner.T) / 2)[1].astype(x.dtype))


def orthonormal(x):
    """Columns that are nearly orthonormal, made so to the last digit."""
    import numpy as np

    for _ in range(2):
        x = x + x @ (np.eye(x.shape[1], dtype=x.dtype) - x.T @ x) / 2
    return x


def eigenvectors(a):
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix in extended precision.

    The largest entry of a vector by size is positive. Vectors of equal eigenvalues are any that span their space.
    """
    import numpy as np

    kind, width = np.longdouble, len(a)
    size = np.abs(a).max() if width else 0
    if not size:
        return np.zeros(width, kind), np.eye(width, dtype=kind)
    a = np.asarray(a, kind) / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(kind)
    enough = 4 * width * np.finfo(kind).eps
    norm = np.sqrt((a * a).sum())
    for _ in range(MOST_STEPS):
        r = np.eye(width, dtype=kind) - x.T @ x
        s = x.T @ (a @ x)
        values = np.diagonal(s) / (1 - np.diagonal(r))
        # Eigenvalues nearer than that are a cluster; so are those that rounding alone could turn into each other.
        least = max(2 * (np.sqrt(((s - np.diag(values)) ** 2).sum()) + norm * np.sqrt((r * r).sum())), CLOSE * enough * norm)
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > least
        change = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ change
        if np.abs(change).max() <= enough:
            break
        for run in clusters(values, least):
            x[:, run] = turned(a, x[:, run])
    x = orthonormal(x)
    values = (x * (a @ x)).sum(axis=0) / (x * x).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(width)] < 0, -1, 1)
    return values[order] * size, x


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each row of vectors(vec_id, embedding) that takes part and each of the first `components` components.

    Gives vec_id, component from 1 by falling eigenvalue, n (rows that take part), deviation (the sum of squares of n times a
    whole component less its sum; null where that exceeds a long), whitened, explained and identity_error (measured on the
    whitened rows). Rows whose vector is null, holds null or non-finite components, or any beyond 2^40 / 64 in size, take no
    part; a null vec_id stays as it is; repeated rows count each. A shorter vector counts as ending in zeros. Components along
    which nothing varies (a share of the variance below 1e-12) are not given: there is nothing to scale to one. So fewer
    rows than dimensions give fewer components; one row, equal rows or an empty table give no rows.
    """
    import numpy as np

    spark = vectors.sparkSession
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(width, 1)
    if width > WIDEST:
        raise ValueError(f"vectors of {width} components; a covariance of more than {WIDEST} is not gathered")
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = materialize(whole_numbers(vectors, width), "whole-vectors")
    n, sums, _ = moments(rows, width)
    if not n:
        return spark.createDataFrame([], out)
    centre = [round(s / n) for s in sums]
    _, shifted, products = moments(rows, width, centre)
    v = covariance(n, shifted, products)
    values, axes = eigenvectors(v)
    trace = np.trace(v)
    used = int((values[:components] > LEAST_SHARE * trace).sum())
    if not used:
        return spark.createDataFrame([], out)
    about = np.asarray(centre, np.int64)
    mean = np.array([s / n for s in shifted])
    scaled = (axes[:, :used] / np.sqrt(values[:used])).astype(np.float64)
    share = (values[:used] / trace).astype(np.float64)

    def projected(x):
        return ((x - about) - mean) @ scaled

    error = _identity_error(rows, projected, n, used)
    schema = T.StructType.fromDDL(out)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for ids, x in _slices(batches):
            y = x - about
            most = n * int(np.abs(y).max()) + max(abs(s) for s in shifted)
            exact = np.int64 if width * most**2 < 1 << 63 else object
            deviation = ((y.astype(exact) * n - np.array(shifted, exact)) ** 2).sum(axis=1)
            deviation = [d if d < 1 << 63 else None for d in deviation.tolist()]
            k = np.repeat(np.arange(len(x)), used)
            columns = [
                ids.take(pa.array(k)), pa.array(np.tile(np.arange(1, used + 1, dtype=np.int32), len(x))), pa.array(np.full(len(k), n, np.int64)),
                pa.array(deviation, pa.int64()).take(pa.array(k)), pa.array(projected(x).reshape(-1)), pa.array(np.tile(share, len(x))), pa.array(np.full(len(k), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.mapInArrow(run, schema)


def _identity_error(rows: DataFrame, projected, n: int, used: int) -> float:
    """How far the covariance of the whitened rows is from the identity, at the worst entry; summed over all rows."""
    import numpy as np

    schema = T.StructType.fromDDL("i int, j int, total double")
    arrow = to_arrow_schema(schema)

    def run(batches):
        total = np.zeros((used + 1, used + 1))
        for _, x in _slices(batches):
            w = np.concatenate([projected(x), np.ones((len(x), 1))], axis=1)
            total += w.T @ w
        i, j = np.nonzero(np.ones_like(total))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.reshape(-1))], schema=arrow)

    total = np.zeros((used + 1, used + 1))
    for i, j, t in rows.mapInArrow(run, schema).groupBy("i", "j").agg(F.sum("total")).collect():
        total[i, j] = t
    mean = total[:used, used] / n
    return float(np.abs(total[:used, :used] / n - np.outer(mean, mean) - np.eye(used)).max())


def op13_refined_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
