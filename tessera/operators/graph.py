"""The graph of verified pairs: components, reference, breadth-first levels, cycles and drift.

Edges are rows (a, b) of node ids; loops are driven from here, with each round's result written down.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import materialize, release, ship
from ..functions import linalg


def stitch_graph(results: DataFrame, a: str = "image_a", b: str = "image_b") -> DataFrame:
    """Edges of the pairs that passed, ids in order, weighted by the reciprocal of the inlier ratio."""
    weight = 1.0 / F.greatest("inlier_ratio", F.lit(1e-6))
    return results.where("status = 'OK'").withColumns({a: F.least(a, b), b: F.greatest(a, b), "weight": weight})


def both_ways(edges: DataFrame, a: str, b: str) -> DataFrame:
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    return pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node id reachable from each node, by alternating large-star and small-star rounds.

    The rounds shrink a component to a star in about the logarithm of its size. A hub's edges are a skewed join key on the
    side that Spark splits at run time. Nodes are never broadcast: files of sorted numbers are far smaller than their rows.
    """
    loops = edges.where(F.col(a) == F.col(b)).select(F.col(a).alias("node"), F.col(a).alias("root")).distinct()
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "star")
    last = None
    for _ in range(most_rounds):
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == last:
            break
        last = mark
        sym = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "star")
        release(before)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    joined = stars.unionByName(roots)
    return joined.unionByName(loops.join(joined.select("node"), "node", "left_anti"))


def reference(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: the node of highest degree, then highest id, in the largest component (the one of least root on ties)."""
    named = components(edges, a, b)
    largest = named.groupBy("root").agg(F.count("*").alias("size")).agg(F.min_by(F.struct("root", "size"), F.struct(-F.col("size"), F.col("root"))).alias("c")).select("c.*")
    degree = both_ways(edges, a, b).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))
    inside = named.join(F.broadcast(largest), "root").join(degree, "node")
    return inside.agg(F.max_by(F.struct("node", "degree", "root", "size"), F.struct("degree", "node")).alias("r")).select("r.*").where("node is not null")


def levels(edges: DataFrame, start: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 10_000) -> DataFrame:
    """(node, level, parent) of the nodes reachable from start(node), breadth first; the parent is the least node of the
    level before. Each round joins the frontier alone: edges go both ways, so what it meets is in its own level, in the one
    before or new."""
    sym = materialize(both_ways(edges, a, b), "edges")
    frontier = materialize(start.select("node", F.lit(0).alias("level"), F.lit(None).cast(start.schema["node"].dataType).alias("parent")), "levels")
    found, near = [frontier], frontier.select("node")
    for depth in range(1, most_rounds):
        ahead = frontier.select(F.col("node").alias("u")).join(sym, "u").groupBy(F.col("v").alias("node")).agg(F.min("u").alias("parent"))
        frontier = materialize(ahead.join(near, "node", "left_anti").select("node", F.lit(depth).alias("level"), "parent"), "frontier")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, found)
        near = found[-1].select("node").unionByName(frontier.select("node"))
        found.append(frontier)
    raise RuntimeError(f"more than {most_rounds} levels")


def unreachable(edges: DataFrame, reached: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    nodes = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).distinct()
    return nodes.join(reached, "node", "left_anti")


def cycle_edges(edges: DataFrame, tree: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges, ids in order, that are not in the tree of levels()."""
    pairs = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    branches = tree.where("parent is not null").select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"))
    return pairs.join(branches, ["a", "b"], "left_anti")


def composed(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """(node, to_reference): homographies to the root of a tree of levels(), composed by pointer doubling.

    edges(image_a, image_b, homography) map image_a to image_b. Every node knows its homography to an ancestor, first its
    parent, and takes over the ancestor's own; so the way known doubles, and rounds are the logarithm of the depth. Nodes
    that have reached the root wait for those that ask them.
    """
    oriented = edges.select(F.col("image_a").alias("node"), F.col("image_b").alias("parent"), F.col("homography").alias("h")).unionByName(
        edges.select(F.col("image_b").alias("node"), F.col("image_a").alias("parent"), linalg.inverse(F.col("homography")).alias("h"))
    )
    unit = F.array(*(F.lit(float(i in (0, 4, 8))) for i in range(9)))
    steps = tree.join(oriented, ["node", "parent"], "left").groupBy("node", "level", "parent").agg(F.min("h").alias("h"))
    now = materialize(steps.select("node", "level", F.col("parent").alias("up"), F.when(F.col("level") == 0, unit).otherwise(F.col("h")).alias("h")), "composed")
    depth, way = now.agg(F.max("level")).first()[0] or 0, 1
    while way < depth:
        # Ways of length `way` are known, or to the root. A node's ancestor is one node; an ancestor of many is split.
        far = now.where(F.col("level") > way).alias("n").join(now.alias("a"), F.col("n.up") == F.col("a.node"))
        longer = far.select("n.node", "n.level", "a.up", linalg.matmul(F.col("a.h"), F.col("n.h")).alias("h"))
        before, now = now, materialize(now.where(F.col("level") <= way).unionByName(longer), "composed")
        release(before)
        way *= 2
    return now.select("node", F.col("h").alias("to_reference"))


def drift(edges: DataFrame, cycles: DataFrame, homographies: DataFrame, sizes: DataFrame) -> DataFrame:
    """mean_drift_px, max_drift_px and cycle_edges: how far direct and composed homographies of cycle edges part at the
    image corners. sizes(node, width, height)."""
    direct = edges.select(F.least("image_a", "image_b").alias("a"), F.greatest("image_a", "image_b").alias("b"), F.when(F.col("image_a") < F.col("image_b"), F.col("homography")).otherwise(linalg.inverse(F.col("homography"))).alias("direct"))
    on = cycles.join(direct, ["a", "b"], "left")
    on = on.join(homographies.select(F.col("node").alias("a"), F.col("to_reference").alias("ha")), "a", "left").join(homographies.select(F.col("node").alias("b"), F.col("to_reference").alias("hb")), "b", "left")
    on = on.join(sizes.select(F.col("node").alias("a"), F.col("width").cast("double").alias("w"), F.col("height").cast("double").alias("h")), "a", "left")
    predicted = linalg.matmul(linalg.inverse(F.col("hb")), F.col("ha"))
    corner = on.withColumn("predicted", predicted).withColumn("c", F.explode_outer(F.when(F.col("ha").isNotNull() & F.col("hb").isNotNull() & F.col("w").isNotNull(), linalg.corners(F.col("w"), F.col("h")))))
    p, d = (linalg.apply_homography(F.col(m), F.col("c.x"), F.col("c.y")) for m in ("predicted", "direct"))
    gap = F.hypot(p["x"] - d["x"], p["y"] - d["y"])
    return corner.select("a", "b", gap.alias("gap")).agg(F.avg("gap").alias("mean_drift_px"), F.max("gap").alias("max_drift_px"), F.count_distinct(F.struct("a", "b")).alias("cycle_edges"))


def merge_points(points: DataFrame, radius: float, group: str, key: str = "idx", x: str = "x", y: str = "y") -> DataFrame:
    """Points within radius of each other, and those they lead to, become one: (group, root, x, y, support)."""
    from . import near

    placed = points.select(group, F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    placed = materialize(placed.withColumn("_k", F.monotonically_increasing_id()), "points")
    roots = near.components(placed, radius, "_k", ("x", "y"), within=(group,)).select(F.col("node").alias("_k"), F.col("root").alias("_root"))
    named = placed.join(roots.hint("merge"), "_k", "left").withColumn("_root", F.coalesce("_root", "_k"))
    merged = named.groupBy(group, "_root").agg(F.min("id").alias("root"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("support"))
    return merged.drop("_root")


#: Rows that refine() gathers for a facade: its edges, and its images' homographies and sizes.
EDGE = "facade string, image_a string, image_b string, homography array<double>"
PLACE = "facade string, node string, to_reference array<double>, width double, height double, root boolean"
REFINED = "facade string, node string, to_reference array<double>, decided boolean"


#: Disagreement of an edge with another way between its images, of one edge, that noise explains; ways that are tried for each
#: edge, and edges of a way at most; trees that are tried at least and at most, and checks of edges that they may take.
CYCLE_PX, WAYS, LONGEST = 12.0, 8, 7
LEAST_TREES, MOST_TREES, CHECKS = 20, 400, 200_000


def _carried(h, extent):
    """Where homographies carry the corners of images of that extent (width, height): (n, 4, 2)."""
    import numpy as np

    corners = np.ones((len(h), 4, 3))
    corners[:, :, :2] = np.asarray(extent, float)[:, None, :] * np.array([[0, 0], [1, 0], [1, 1], [0, 1]])
    q = corners @ h.transpose(0, 2, 1)
    with np.errstate(all="ignore"):
        return q[..., :2] / q[..., 2:]


def supported(edges, extent, cycle_px: float = CYCLE_PX):
    """For each edge (a, b, matrix) the share of the ways tried between its images that confirm it, without it; a half where
    there is none. Ways are shortest ones in graphs of which some edges are left out at random."""
    import numpy as np

    draw, near = np.random.default_rng(len(edges)), {}
    for i, (a, b, m) in enumerate(edges):
        near.setdefault(a, []).append((b, i, m))
        near.setdefault(b, []).append((a, i, np.linalg.inv(m)))

    def way(a, b, without):
        left_out = draw.random(len(edges)) < 0.2
        left_out[without] = True
        seen, front = {a: (np.eye(3), 0)}, [a]
        while front and b not in seen:
            ahead = []
            for x in front:
                m, n = seen[x]
                for k in draw.permutation(len(near[x])) if n < LONGEST else ():
                    y, i, step = near[x][k]
                    if y not in seen and not left_out[i]:
                        seen[y] = step @ m, n + 1
                        ahead.append(y)
            front = ahead
        return seen.get(b)

    out = []
    for i, (a, b, m) in enumerate(edges):
        found = [w for w in (way(a, b, i) for _ in range(WAYS)) if w is not None]
        if not found:
            out.append(0.5)
            continue
        h = np.stack([m, *(w[0] for w in found)])
        at = _carried(h, [extent[a]] * len(h))
        gaps = np.linalg.norm(at[1:] - at[:1], axis=2).mean(axis=1)
        out.append(float(np.mean(gaps <= cycle_px * np.sqrt([w[1] + 1 for w in found]))))
    return np.array(out)


def agreeing(edges, extent, start, roots, cycle_px: float = CYCLE_PX):
    """Numbers of the edges that disagree with the spanning forest that most edges agree with, homographies along it, and the
    images for which this is open, as another forest that as many edges agree with puts them elsewhere.

    Forests are drawn at random, the more often through an edge the more ways confirm it; images begin at their roots, or
    at one of theirs where there is none. Of forests that as many edges agree with, the one nearest to the start is taken.
    """
    import numpy as np

    draw, support = np.random.default_rng(len(edges) + 1), supported(edges, extent, cycle_px)
    names = sorted({n for a, b, _ in edges for n in (a, b)})
    place = {n: i for i, n in enumerate(names)}
    u, v = (np.array([place[e[k]] for e in edges]) for k in (0, 1))
    direct, sizes = np.stack([e[2] for e in edges]), [extent[e[0]] for e in edges]
    target, begun = _carried(direct, sizes), np.stack([start[n] for n in names])
    back = np.linalg.inv(direct)
    shown = [i for i, n in enumerate(names) if n in extent]
    where = _carried(begun[shown], [extent[names[i]] for i in shown])
    heads = sorted(range(len(names)), key=lambda i: (names[i] not in roots, names[i]))
    best = None
    for trial in range(int(np.clip(CHECKS / len(edges), LEAST_TREES, MOST_TREES))):
        # The first forest takes the best confirmed edges.
        order = np.argsort((1.05 - support) * (1.0 if trial == 0 else draw.random(len(edges))), kind="stable")
        root, near = list(range(len(names))), [[] for _ in names]

        def find(x, root=root):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i in order:
            a, b = find(u[i]), find(v[i])
            if a != b:
                root[a] = b
                near[u[i]].append((v[i], back[i]))
                near[v[i]].append((u[i], direct[i]))
        h, depth = begun.copy(), np.full(len(names), -1)
        for head in heads:
            if depth[head] >= 0:
                continue
            depth[head], front = 0, [head]
            for x in front:
                for y, step in near[x]:
                    if depth[y] < 0:
                        h[y], depth[y] = h[x] @ step, depth[x] + 1
                        front.append(y)
        with np.errstate(all="ignore"):
            gaps = np.linalg.norm(_carried(np.linalg.inv(h[v]) @ h[u], sizes) - target, axis=2).mean(axis=1)
            off = ~(gaps <= cycle_px * np.sqrt(np.minimum(depth[u] + depth[v], LONGEST) + 1.0))
            away = np.linalg.norm(_carried(h[shown], [extent[names[i]] for i in shown]) - where, axis=2).mean()
        mark = (int(off.sum()), float(np.nan_to_num(away, nan=np.inf)))
        if best is None or mark[0] < best[0][0]:
            others = []
        if best is None or mark < best[0]:
            best = mark, off, h
        if mark[0] == best[0][0] and not any((off == o).all() for o, _ in others):
            others.append((off, h))
    _, off, h = best
    # Other forests that as many edges agree with, but of other edges: where they put an image elsewhere, it is open.
    open_, at = set(), _carried(h[shown], [extent[names[i]] for i in shown])
    for _, other in others:
        with np.errstate(all="ignore"):
            gap = np.linalg.norm(_carried(other[shown], [extent[names[i]] for i in shown]) - at, axis=2).mean(axis=1)
        open_ |= {names[shown[i]] for i in np.nonzero(~(gap <= cycle_px * (2 * LONGEST) ** 0.5))[0]}
    return {int(i) for i in np.nonzero(off)[0]}, {n: h[i] / h[i][2, 2] for n, i in place.items()}, open_


def refine(edges: DataFrame, places: DataFrame, huber_px: float = 2.0, rounds: int = 100) -> DataFrame:
    """Each facade's homographies after a robust least-squares fit of all its edges' corner disagreements, its root held fixed.

    edges(facade, image_a, image_b, homography), places(facade, node, to_reference, width, height, root). The edges of a
    facade, a few thousand rows, are gathered in one task; facades run in parallel. Images without edges stay as they are; so
    do those for which the edges leave it open which of them is wrong: decided is false for them.
    """
    import pandas as pd

    def run(key, near: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        start = dict(zip(at["node"], at["to_reference"], strict=True))
        extent = {n: (w, h) for n, w, h in zip(at["node"], at["width"], at["height"], strict=True) if w == w and h == h}
        roots = {n for n, r in zip(at["node"], at["root"], strict=True) if r is not None and r == r and r}
        pairs = list(zip(near["image_a"], near["image_b"], near["homography"], strict=True))
        left_open: set = set()
        done = fit_homographies(pairs, start, extent, roots, huber_px, rounds, left_open=left_open)
        return pd.DataFrame({"facade": key[0], "node": list(done), "to_reference": [v.tolist() for v in done.values()], "decided": [n not in left_open for n in done]})

    ship(edges.sparkSession)
    typed = [df.select(*(F.col(c).cast(t) for c, t in (x.split(" ", 1) for x in ddl.split(", ")))) for df, ddl in ((edges, EDGE), (places, PLACE))]
    return typed[0].groupBy("facade").cogroup(typed[1].groupBy("facade")).applyInPandas(run, REFINED)


def fit_homographies(edges, start, extent, roots, huber_px: float = 2.0, rounds: int = 100, cycle_px: float = CYCLE_PX, left_open: set | None = None):
    """The numeric part of refine(): nine numbers by node.

    Edges that disagree with what most others say are taken out, see agreeing(), and images begin where these lead.

    Huber's loss is minimised first; from there, and from the start, a loss in which edges that are far off count ever less;
    the best end is taken. An edge's residuals are, in the frame of its second image and in pixels, where the two homographies to the root carry the
    corners of its first image against where its own homography does. There an image can't lessen them by shrinking. Weights
    are renewed in each damped Gauss-Newton round. The normal equations are kept as blocks of eight, one
    per node and one per edge, and solved by conjugate gradients.
    """
    import numpy as np

    h = {n: np.array(v, float).reshape(3, 3) / v[8] for n, v in start.items() if v is not None}
    used = [(a, b, np.array(m, float).reshape(3, 3)) for a, b, m in edges if a in h and b in h and a in extent and m is not None]
    wrong, along, open_ = agreeing(used, extent, h, set(roots), cycle_px) if used else (set(), {}, set())
    # Where all edges agree, the start is as good a place to begin, and nearer to what is asked.
    along = h | along if wrong else h
    if left_open is not None:
        left_open |= open_
    # Open images stay where they were, and what they say about others does not count.
    along |= {n: h[n] for n in open_}
    used = [e for i, e in enumerate(used) if i not in wrong and not {e[0], e[1]} & open_]
    free = sorted({n for a, b, _ in used for n in (a, b)} - set(roots))
    if not free:
        return {n: m.reshape(-1) for n, m in h.items()}
    names = free + sorted({n for a, b, _ in used for n in (a, b)} & set(roots))
    place = {n: i for i, n in enumerate(names)}
    u, v = (np.array([place[e[i]] for e in used]) for i in (0, 1))
    size = np.array([extent[a] for a, _, _ in used], float)
    corners = np.ones((len(used), 4, 3))
    corners[:, :, 0], corners[:, :, 1] = size[:, :1] * [0, 1, 1, 0], size[:, 1:] * [0, 0, 1, 1]
    flat = lambda q: q[..., :2] / q[..., 2:]
    direct = flat(corners @ np.stack([m for *_, m in used]).transpose(0, 2, 1))

    def carried(state):
        back = np.linalg.inv(state)[v]
        return back, corners @ (back @ state[u]).transpose(0, 2, 1)

    def residuals(state):
        return flat(carried(state)[1]) - direct

    def slopes(state):
        """By the eight parameters of the first image and of the second: (edge, corner and axis, parameter)."""
        back, p = carried(state)
        at = flat(p)
        # How a change of the carried point, a column of back times one coordinate, moves its two pixel coordinates.
        moved = (back[:, None, :2, :] - at[..., None] * back[:, None, 2:, :]) / p[..., 2, None, None]
        both = [(sign * moved[..., None] * c[:, :, None, None, :]).reshape(len(used), 8, 9)[..., :8] for sign, c in ((1, corners), (-1, p))]
        return both

    def huber(r):
        """Loss and weights, residual by residual."""
        size = np.abs(r)
        return np.where(size <= huber_px, size**2 / 2, huber_px * (size - huber_px / 2)).sum(), huber_px / np.maximum(size, huber_px)

    def redescending(scale):
        """Geman and McClure's loss, edge by edge, and its weights: an edge that is far off hardly counts."""

        def of(r):
            square = (r**2).mean(axis=1, keepdims=True)
            share = scale**2 / (scale**2 + square)
            return 4 * (share * square).sum(), np.broadcast_to(share**2, r.shape)

        return of

    def descend(state, measure):
        now = residuals(state).reshape(len(used), 8)
        (best, weight), damping = measure(now), 1e-3
        for _ in range(rounds):
            ju, jv = slopes(state)
            wu, wv = ju * weight[..., None], jv * weight[..., None]
            diagonal, right = np.zeros((len(names), 8, 8)), np.zeros((len(names), 8))
            for to, j, w in ((u, ju, wu), (v, jv, wv)):
                np.add.at(diagonal, to, j.transpose(0, 2, 1) @ w)
                np.add.at(right, to, -(w * now[..., None]).sum(axis=1))
            step = _solved(diagonal, ju.transpose(0, 2, 1) @ wv, u, v, right, len(free), damping)
            trial = state.copy()
            trial[: len(free)] += np.concatenate([step[: len(free)], np.zeros((len(free), 1))], axis=1).reshape(len(free), 3, 3)
            with np.errstate(all="ignore"):
                after = residuals(trial).reshape(len(used), 8)
                loss, weight_after = measure(after)
            if np.isfinite(after).all() and loss < best:
                gain = best - loss
                state, now, best, weight, damping = trial, after, loss, weight_after, max(damping / 5, 1e-12)
                if gain < 1e-14 * (1 + best):
                    break
            else:
                damping *= 10
                if damping > 1e9:
                    break
        return state, best

    begun, ends = np.stack([along[n] for n in names]), []
    for state, scales in ((begun, (4,)), (begun, (64, 16, 4)), (descend(begun, huber)[0], (64, 16, 4))):
        for scale in scales:
            state, best = descend(state, redescending(scale * huber_px))
        ends.append((best, state))
    # Where edges leave it open which of them is wrong, the start decides.
    least = min(best for best, _ in ends)
    state = next(state for best, state in ends if best <= 1.05 * least + 1e-9)
    return {n: m.reshape(-1) for n, m in along.items()} | {n: state[place[n]].reshape(-1) for n in free}


def _solved(diagonal, across, u, v, right, n_free: int, damping: float):
    """The step of damped block equations by conjugate gradients, preconditioned by the diagonal blocks; fixed nodes rest."""
    import numpy as np

    size = np.sqrt(np.maximum(np.einsum("nii->ni", diagonal), 1e-300))
    scaled = diagonal / size[:, :, None] / size[:, None, :] + damping * np.eye(8)
    off = across / size[u][:, :, None] / size[v][:, None, :]
    inverse = np.linalg.pinv(scaled[:n_free], hermitian=True)
    free = (np.arange(len(right)) < n_free)[:, None]

    def times(x):
        out = np.einsum("nij,nj->ni", scaled, x)
        np.add.at(out, u, np.einsum("eij,ej->ei", off, x[v]))
        np.add.at(out, v, np.einsum("eji,ej->ei", off, x[u]))
        return out * free

    def conditioned(x):
        out = np.zeros_like(x)
        out[:n_free] = np.einsum("nij,nj->ni", inverse, x[:n_free])
        return out

    x, r = np.zeros_like(right), right / size * free
    z = conditioned(r)
    p, rz = z, (r * z).sum()
    first = rz
    for _ in range(16 * n_free + 50):
        if rz <= 1e-20 * first or rz == 0:
            break
        q = times(p)
        alpha = rz / (p * q).sum()
        x, r = x + alpha * p, r - alpha * q
        z = conditioned(r)
        rz, before = (r * z).sum(), rz
        p = z + rz / before * p
    return x / size
