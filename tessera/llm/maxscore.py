"""Exact top-k search by MaxScore over dense integer vectors.

Every component is a term. Rows of a shard are ordered by likeness and cut into blocks, each with the least and the greatest
weight of every term in it. For a query with weight q on a term, q times the weight is taken from its least value in the
block, which makes contributions non-negative as MaxScore needs; a term's bound is |q| times the block's range of the term.
A few rows of the shard, scored first for all queries, give each query a threshold. A block whose bounds, all together, do
not lift a row to the threshold of a query is skipped for it. The terms of least bounds that together cannot lift a row past
it are non-essential: the others, the essential ones, are traversed in one product for the queries that compete, and where
few rows still compete after them, these alone are probed in the rest; where many do, a second product is cheaper than
probes. Bounds of rows that differ in all terms are loose, and then nothing is left out: a product of everything is tried
first in each group of queries as soon as probing did not pay.

Shards stay where they are, and blocks of queries, which are far smaller, travel to each of them. A shard gives each query
its k best, and these are merged.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import read, ship

K = 20
SCALE = 64
QUERY_EVERY = 20
#: Rows of a shard and queries of a block: what one task holds.
SHARD_ROWS = 8192
BLOCK_QUERIES = 512
#: Of how many rows one is scored first, in all terms, for a threshold; rows of a block of likes, and rows that it is dealt by.
SEED_EVERY = 4
LIKE_ROWS = 128
PIVOTS = 128
#: Terms are split where the rest still competes with at most this share of the rows; a product costs less than more probes.
WORTH_PROBING = 1 / 16
SLACK = 1e-9

HITS = "query_no long, query_id long, vec_id long, score long"
BLOCK = "block long, ids binary, width int, weights binary"


def exact_type(most_query: int, most_row: int, width: int):
    """A type in which every partial score is exact: floats multiply fastest."""
    import numpy as np

    top = 4 * max(1, most_query) * max(1, most_row) * max(1, width)
    return np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64


def _chain(rows):
    """Rows in an order in which like ones follow each other: each time the one most like the last."""
    import numpy as np

    near, order = rows @ rows.T, [0]
    left = np.ones(len(rows), bool)
    left[0] = False
    while left.any():
        order.append(int(np.where(left, near[order[-1]], -np.inf).argmax()))
        left[order[-1]] = False
    return rows[order]


class Shard:
    """Postings of one shard in blocks of like rows, with the bounds of each block."""

    def __init__(self, ids, rows, kind):
        import numpy as np

        order = np.argsort(ids, kind="stable")
        seeds = order[::SEED_EVERY]
        rest = np.delete(order, np.s_[::SEED_EVERY])
        if len(rest):
            pivots = _chain(rows[seeds[:: max(1, len(seeds) // PIVOTS)][:PIVOTS]].astype(np.float32))
            near = rows[rest].astype(np.float32) @ pivots.T
            rest = rest[np.lexsort((near.max(axis=1), near.argmax(axis=1)))]
        order = np.concatenate([seeds, rest])
        self.ids, self.kind, self.n_seeds = ids[order], kind, len(seeds)
        self.rows = np.ascontiguousarray(rows[order].astype(kind))
        self.spans = [(at, min(at + LIKE_ROWS, len(order))) for at in range(len(seeds), len(order), LIKE_ROWS)]
        self.low, self.high = (np.array([f(self.rows[a:b], axis=0) for a, b in self.spans], kind).reshape(len(self.spans), -1) for f in (np.min, np.max))
        self.middle = (self.low.astype(np.float64) + self.high) / 2
        self.reach = np.array([np.sqrt(((self.rows[a:b] - m) ** 2).sum(axis=1).max()) for (a, b), m in zip(self.spans, self.middle, strict=True)])
        #: Pairs of query and row: in all, skipped by blocks, left out after essential terms, and probed.
        self.pairs = {"all": 0, "skipped": 0, "pruned": 0, "probed": 0}

    def top(self, query_ids, queries, k: int):
        """For each query the rows and scores of its k best, itself left out: a list of (ids, scores)."""
        import numpy as np

        queries = np.ascontiguousarray(queries.astype(self.kind))
        self.pairs["all"] += len(queries) * len(self.ids)
        first = queries @ self.rows[: self.n_seeds].T
        own = query_ids[:, None] == self.ids[None, : self.n_seeds]
        least = np.iinfo(np.int64).min if self.kind is np.int64 else -np.inf
        threshold = np.full(len(queries), least, self.kind)
        if self.n_seeds > k:
            others = np.where(own, self.kind(least), first)
            threshold = np.partition(others, self.n_seeds - k, axis=1)[:, self.n_seeds - k]
        found = [self._reached(first, np.arange(len(queries)), 0, threshold, ~own)]
        # What a block's rows can come to at best, query by query: by the bounds of all terms, and by their distance from a
        # middle row, which says more where rows are alike in many terms at once. Rounding is far below the slack.
        wide = queries.astype(np.float64)
        most = np.maximum(wide, 0) @ self.high.T.astype(np.float64) + np.minimum(wide, 0) @ self.low.T.astype(np.float64)
        around = wide @ self.middle.T + np.sqrt((wide**2).sum(axis=1))[:, None] * self.reach[None, :]
        most = np.minimum(most, around) * (1 + SLACK * np.sign(most)) + SLACK
        split = self.kind is not np.int64 and bool((threshold > least).all())
        for i, (a, b) in enumerate(self.spans):
            asking = np.nonzero(most[:, i] >= threshold)[0]
            self.pairs["skipped"] += (len(queries) - len(asking)) * (b - a)
            if len(asking):
                split, hits = self._block(i, queries, asking, threshold, split)
                found.append(hits)
        q, rows, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        other = self.ids[rows] != query_ids[q]
        q, rows, scores = q[other], rows[other], scores[other]
        order = np.lexsort((self.ids[rows], -scores, q))
        q, rows, scores = q[order], rows[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        q, rows, scores = q[rank < k], rows[rank < k], scores[rank < k].astype(np.int64)
        ends = np.searchsorted(q, np.arange(1, len(queries)))
        return list(zip(np.split(self.ids[rows], ends), np.split(scores, ends), strict=True))

    def _reached(self, scores, asking, start, threshold, also=True):
        import numpy as np

        at = np.flatnonzero((scores >= threshold[asking][:, None]) & also)
        i, j = np.divmod(at, scores.shape[1])
        return asking[i], j + start, scores.reshape(-1)[at]

    def _block(self, i, queries, asking, threshold, split: bool):
        """Whether to split terms in the next block too, and the hits of the block."""
        import numpy as np

        a, b = self.spans[i]
        rows, q = self.rows[a:b], queries[asking]
        if not split:
            return False, self._reached(q @ rows.T, asking, a, threshold)
        bounds = np.abs(q) * (self.high[i] - self.low[i])
        # One order of terms for the queries that compete; what the terms behind a place add at most, query by query.
        order = np.argsort(-bounds.sum(axis=0), kind="stable")
        after = np.cumsum(bounds[:, order[::-1]], axis=1)[:, ::-1]
        edge = np.where(q > 0, self.low[i], self.high[i]) * q
        slack = threshold[asking] - edge.sum(axis=1)
        # Non-essential: together they leave every query short of its threshold.
        n_essential = int((after >= slack[:, None]).any(axis=0).sum())
        if n_essential == len(order):
            n_essential = len(order) // 2  # all are essential; half of them may tell most rows apart
        e, rest = order[:n_essential], order[n_essential:]
        scores = q[:, e] @ rows[:, e].T
        short = threshold[asking] - (edge[:, rest].sum(axis=1) + (after[:, n_essential] if len(rest) else 0))
        competing = scores >= short[:, None]
        share = competing.mean()
        if share > WORTH_PROBING:
            return share < 0.5, self._reached(scores + q[:, rest] @ rows[:, rest].T, asking, a, threshold)
        x, y = np.nonzero(competing)
        self.pairs["pruned"] += competing.size - len(x)
        self.pairs["probed"] += len(x)
        full = scores[x, y] + (q[x][:, rest] * rows[y][:, rest]).sum(axis=1)
        keep = full >= threshold[asking][x]
        return True, (asking[x[keep]], y[keep] + a, full[keep])


def blocks(vectors: DataFrame, parts: int, scale: int = SCALE) -> DataFrame:
    """vectors(vec_id, embedding) dealt to `parts` blocks of a row each, components turned into floor(scale * x).

    Null vectors and those with null or non-finite components are left out; so are rows without vec_id. Shorter vectors
    count as ending in zeros.
    """
    ship(vectors.sparkSession)
    schema = T.StructType.fromDDL(BLOCK)
    arrow = to_arrow_schema(schema)

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        ids, found = [], []
        for batch in batches:
            for vec, row in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if vec is None or row is None or None in row:
                    continue
                x = np.floor(scale * np.asarray(row, np.float64))
                if np.isfinite(x).all():
                    ids.append(vec)
                    found.append(x.astype(np.int64))
        if not ids:
            return
        width = max(map(len, found))
        weights = np.zeros((len(ids), width), np.int64)
        for i, x in enumerate(found):
            weights[i, : len(x)] = x
        # Small whole numbers take a byte each on their way.
        small = weights.astype(np.int8) if width and abs(weights).max() < 128 else weights
        yield pa.RecordBatch.from_pydict({"block": [number], "ids": [np.array(ids, "<i8").tobytes()], "width": [width if small is weights else -width], "weights": [small.tobytes()]}, schema=arrow)

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).repartition(parts).mapInArrow(run, schema)


def unpack(ids: bytes, width: int, weights: bytes):
    import numpy as np

    ids = np.frombuffer(ids, "<i8")
    if not width:
        return ids, np.zeros((len(ids), 0), np.int64)
    return ids, np.frombuffer(weights, np.int8 if width < 0 else np.int64).astype(np.int64).reshape(len(ids), abs(width))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The k highest integer inner products of each query with all rows but those of its own vec_id; ties to the smaller
    vec_id.

    Both sides have (vec_id, embedding). Gives query_id, rank from 1, vec_id, score; fewer than k where fewer take part.
    Repeated rows compete each for itself, and a query that is there twice is answered twice, each time in full. Empty tables
    give no rows. Scores have to fit a long.
    """
    # One count of both sides; nulls are left out by the blocks.
    n = queries.select(F.lit(1).alias("asked")).unionByName(vectors.select(F.lit(0).alias("asked"))).agg(F.count("*").alias("all"), F.sum("asked").alias("asked")).first()
    n_asked = max(1, math.ceil((n["asked"] or 0) / block_queries))
    n_shards = max(1, math.ceil((n["all"] - (n["asked"] or 0)) / shard_rows))
    # A copy of each block of queries goes to every shard. Where a shard's row lies, it comes first and the blocks stream by.
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long")))
    asked = blocks(queries, n_asked, scale).select(every.alias("shard"), F.lit(1).alias("asked"), "block", "ids", "width", "weights")
    shards = blocks(vectors, n_shards, scale).select(F.col("block").alias("shard"), F.lit(0).alias("asked"), "block", "ids", "width", "weights")
    meetings = shards.unionByName(asked).repartitionById(n_shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "asked")
    schema = T.StructType.fromDDL(HITS)
    arrow = to_arrow_schema(schema)

    def run(batches):
        import numpy as np

        shard, weights, held = None, None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if not row["asked"]:
                    shard, held = row["shard"], {}
                    ids, weights = unpack(row["ids"], row["width"], row["weights"])
                    continue
                if row["shard"] != shard:
                    continue  # this shard has no vectors that take part
                q_ids, q_weights = unpack(row["ids"], row["width"], row["weights"])
                width = min(weights.shape[1], q_weights.shape[1])
                top = [int(abs(x).max()) if x.size else 0 for x in (q_weights[:, :width], weights[:, :width])]
                how = width, exact_type(*top, width)
                if how not in held:
                    held = {how: Shard(ids, weights[:, :width], how[1])}
                hits = held[how].top(q_ids, q_weights[:, :width], k)
                q = np.repeat(np.arange(len(q_ids)), [len(h[0]) for h in hits])
                # A block's number and a place in it name a query.
                yield pa.RecordBatch.from_pydict({"query_no": (row["block"] << 32) + q, "query_id": q_ids[q], "vec_id": np.concatenate([h[0] for h in hits]), "score": np.concatenate([h[1] for h in hits])}, schema=arrow)

    hits = meetings.mapInArrow(run, schema)
    order = Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_maxscore_topk(spark, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


OP1_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.no, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY no ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""
