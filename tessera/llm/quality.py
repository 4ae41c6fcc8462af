"""Document quality by Bradley-Terry pairwise ranking.

A preference pair is a document of the better label and one of the worse. The probability that the first is preferred is the
logistic function of the difference of their scores, which are linear in features of the text; the weights minimise the mean
logistic loss over all pairs of all labelled documents. The scores are then set against a quantile of the scores of the
labelled documents: what lies above it is good.

Sums over all pairs take one pass over the documents: a smooth function of the difference of two scores is, within cells of
scores, a polynomial in either one. So documents are spread over the nodes of their cells, and only nodes meet each other.

Features are shares of characters, words and lines of some kinds, and the shares of words and of character trigrams that fall
into each of a number of hash buckets, so that wording counts and not only form.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators import robust
from .common import crc_mod, map_slices, materialize, per_worker, read, release, ship

#: Hash buckets of words and of character trigrams (powers of two).
WORD_BUCKETS, TRIGRAM_BUCKETS = 128, 128
#: A size for trials with learn(fit_rows=...), whose rows are chosen by a hash of their id. Without it all rows count.
FIT_ROWS = 20_000
HASHES = 1 << 40
#: Width of a cell of scores, and nodes in it: the logistic function is regular within pi of the real line, so that a
#: polynomial through so many nodes is off by the order of 3.4 ** -24, 1e-13.
CELL, NODES = 4.0, 24
#: Rows that are standardised at a time.
FIT_SLICE = 1024
#: Steps of Newton's method, halved ones included, at most (some ten are usual).
MOST_STEPS = 100
#: Strength of the penalty on the squares of the weights (of standardised features).
PENALTY = 1e-3
#: The score that lies at the quantile of the labelled rows which has as many rows below as there are of the worse label.
THRESHOLD = 0.7

FEATURES = (
    "upper", "symbols", "digits", "bars", "marks", "repeated", "echo", "word_length", "words", "lines", "odd_words",
    "symbols_any", "repeated_any", "upper_any", "bars_any", "odd_any", "marks_any",
)


class Classes:
    """Classes of characters, as tables by code point."""

    UPPER, LOWER, DIGIT, SPACE, POINT, MARK, BAR, OTHER = range(8)

    def __init__(self):
        import numpy as np

        self.of = np.full(0x110000, self.OTHER, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha() or c.isidentifier():
                self.of[i] = self.UPPER if c.isupper() else self.LOWER
            elif c.isdigit():
                self.of[i] = self.DIGIT
            elif c.isspace():
                self.of[i] = self.SPACE
        self.low = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            if len(x := chr(i).lower()) == 1 and ord(x) != i:
                self.low[i] = ord(x)
        for kind, chars in ((self.POINT, ".,;:'\"()-?"), (self.MARK, "!"), (self.BAR, "|")):
            self.of[[ord(c) for c in chars]] = kind


def mixed(points):
    import numpy as np

    wide = points.astype(np.uint64)
    return wide * np.uint64(0x9E3779B97F4A7C15) ^ wide << np.uint64(17)


def word_hashes(points, first, last):
    """For words from first to last: the sum of their mixed characters times their places in the word."""
    import numpy as np

    each, zero = mixed(points), np.zeros(1, np.uint64)
    plain = np.concatenate([zero, np.cumsum(each)])
    placed = np.concatenate([zero, np.cumsum(each * np.arange(len(points), dtype=np.uint64))])
    return placed[last + 1] - placed[first] - (first.astype(np.uint64) - np.uint64(1)) * (plain[last + 1] - plain[first])


def bucket_shares(value, of, n: int, buckets: int):
    """Roots of the shares of each owner's values that fall into each bucket."""
    import numpy as np

    bucket = (value * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(65 - buckets.bit_length())).astype(np.int64)
    counts = np.bincount(of * buckets + bucket, minlength=n * buckets).reshape(n, buckets)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def features(texts: list[str]):
    """A row of FEATURES, word buckets and trigram buckets for each text; all are shares, their roots or logarithms, so that
    long and short texts compare."""
    import numpy as np

    c = per_worker("quality-classes", Classes)
    n = len(texts)
    whole = "\n".join([*texts, ""])
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    # In lower case, but for the few letters whose lower case is longer.
    low = np.where(c.low[points] > 0, c.low[points], points)
    sizes = np.array([len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(n), sizes)
    kind = c.of[points]
    counts = np.bincount(owner * 8 + kind, minlength=n * 8).reshape(n, 8).astype(np.float64)
    counts[:, c.SPACE] -= 1  # the line end added above
    total = np.maximum(counts.sum(axis=1), 1)
    letters = np.maximum(counts[:, c.UPPER] + counts[:, c.LOWER], 1)
    # Words: runs of anything but white space.
    solid = kind != c.SPACE
    begin = solid & ~np.append(False, solid[:-1])
    end = solid & ~np.append(solid[1:], False)
    first, last = np.nonzero(begin)[0], np.nonzero(end)[0]
    of = owner[first]
    words = np.bincount(of, minlength=n).astype(np.float64)
    some = np.maximum(words, 1)
    length = last - first + 1
    odd = np.isin(kind[last], (c.OTHER, c.MARK, c.BAR))
    caps = (kind[first] == c.UPPER) & (kind[np.minimum(first + 1, len(kind) - 1)] == c.UPPER) & (length > 1)
    word = word_hashes(points, first, last)
    same = np.zeros(len(first), bool)
    same[1:] = (word[1:] == word[:-1]) & (length[1:] == length[:-1]) & (of[1:] == of[:-1])
    share = lambda flag: np.bincount(of[flag], minlength=n) / some
    line = np.bincount(owner[points == 10], minlength=n).astype(np.float64)
    lines = [t.split("\n") for t in texts]
    echo = np.array([1 - len(set(x)) / len(x) for x in lines])
    repeated, odd_share, upper = share(same), share(odd), share(caps)
    symbols, bars, marks = counts[:, c.OTHER] / total, counts[:, c.BAR] / total, counts[:, c.MARK] / total
    some_of = lambda x, least: np.minimum(x / least, 1.0)
    shares = np.stack(
        [
            upper, symbols, counts[:, c.DIGIT] / total, bars, marks, repeated, echo,
            np.log1p(np.bincount(of, length, n) / some), np.log1p(words) / 10, np.log1p(line) / 10, odd_share,
            some_of(symbols, 0.02), some_of(repeated, 0.05), some_of(upper, 0.1), some_of(bars, 0.02), some_of(odd_share, 0.1), some_of(marks, 0.02),
        ],
        axis=1,
    )
    each = mixed(low)
    trigram = (each[:-2] * np.uint64(31) + each[1:-1]) * np.uint64(31) + each[2:]
    inside = owner[:-2] == owner[2:]
    words_of = bucket_shares(word_hashes(low, first, last), of, n, WORD_BUCKETS)
    trigrams_of = bucket_shares(trigram[inside], owner[:-2][inside], n, TRIGRAM_BUCKETS)
    return np.concatenate([shares, words_of, trigrams_of], axis=1).round(9)


def nodes(cells):
    """The scores at the nodes of cells, a row for each."""
    import numpy as np

    return (np.asarray(cells)[:, None] + 0.5 + np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES) / 2) * CELL


def spread(scores):
    """The cell of each score, and the shares by which it belongs to the nodes there: a smooth function's value at the score
    is the sum of its values at the nodes, each times its share."""
    import numpy as np
    from numpy.polynomial.chebyshev import chebvander

    cells = np.floor(scores / CELL).astype(np.int64)
    to_nodes = chebvander(np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES), NODES - 1).T * (2 / NODES)
    to_nodes[0] /= 2
    return cells, chebvander(2 * (scores / CELL - cells) - 1, NODES - 1) @ to_nodes


def logistic(x):
    """The logistic function and its derivative."""
    import numpy as np

    small = np.exp(-np.abs(x))
    return np.where(x < 0, small, 1.0) / (1 + small), small / (1 + small) ** 2


def by_cell(good, cells):
    """The rows of each (label, cell) that occurs."""
    import numpy as np

    for label in (0, 1):
        for cell in np.unique(cells[good == label]).tolist():
            yield label, cell, np.nonzero((good == label) & (cells == cell))[0]


class Meeting:
    """What every row meets in all rows of the other label, from the sums of shares by (label, cell)."""

    def __init__(self, shares: dict):
        import numpy as np

        self.pairs = math.prod(sum(float(v.sum()) for (q, _), v in shares.items() if q == label) for label in (0, 1))
        self.sides = [[c for q, c in sorted(shares) if q == label] for label in (0, 1)]
        at = [nodes(c).ravel() for c in self.sides]
        held = [np.concatenate([shares[label, c] for c in self.sides[label]]) for label in (0, 1)]
        #: The mean of the loss over all pairs.
        self.loss = 0.0
        for cell in self.sides[1]:
            self.loss += float(shares[1, cell] @ (np.logaddexp(0, at[0] - nodes([cell]).T) @ held[0])) / self.pairs
        #: By label and cell: pulls and curves at the nodes; neighbours too, should rounding take a row across a border.
        self.tables = {}
        for label in (0, 1):
            for cell in sorted({c + d for c in self.sides[label] for d in (-1, 0, 1)}):
                apart = nodes([cell]).T - at[1 - label]
                pull, curve = logistic(-apart if label else apart)
                self.tables[label, cell] = np.stack([pull @ held[1 - label], curve @ held[1 - label]], axis=1)

    def crossed(self, sums: dict, width: int):
        """The sum over all pairs of the products of their features, each by its curve; sums: of features by (label, cell, node)."""
        import numpy as np

        keys = [sorted(k for k in sums if k[0] == label) for label in (0, 1)]
        at = [np.array([nodes([c])[0, k] for _, c, k in some]) for some in keys]
        bad = np.array([sums[k] for k in keys[0]])
        out = np.zeros((width, width))
        for i in range(0, len(keys[1]), 256):
            good = np.array([sums[k] for k in keys[1][i : i + 256]])
            out += good.T @ (logistic(at[1][i : i + 256, None] - at[0])[1] @ bad)
        return out


def minimum(total: Callable, penalty: float):
    """Weights of the standardised features, their means and deviations; None unless both labels occur.

    total(work) adds up, by key, the arrays that work(features, good) gives for each slice of the rows.
    """
    import numpy as np

    first = total(lambda x, good: {("rows",): np.bincount(good, minlength=2).astype(np.float64), ("sum",): x.sum(axis=0)})
    if not first or not first["rows",].all():
        return None
    n = first["rows",].sum()
    mean = first["sum",] / n
    deviation = np.sqrt(total(lambda x, good: {("square",): np.einsum("ij,ij->j", x - mean, x - mean)})["square",] / n)
    deviation[deviation < 1e-9] = 1.0
    width = len(mean)

    def shares(weights):
        def work(x, good):
            cells, share = spread((x - mean) / deviation @ weights)
            return {(label, cell): share[rows].sum(axis=0) for label, cell, rows in by_cell(good, cells)}

        return work

    def slopes(weights, tables):
        def work(x, good):
            x = (x - mean) / deviation
            cells, share = spread(x @ weights)
            pull, curve, out = np.zeros(len(x)), np.zeros(len(x)), {}
            for label, cell, rows in by_cell(good, cells):
                pull[rows], curve[rows] = (share[rows] @ tables[label, cell]).T
                for k, of in enumerate(share[rows].T @ x[rows]):
                    out[label, cell, k] = of
            product = (x * curve[:, None]).T @ x
            return out | {("pull",): np.where(good == 1, pull, -pull) @ x} | {("curve", i): product[i, i:] for i in range(width)}

        return work

    weights, step, least = np.zeros(width), np.zeros(width), math.inf
    for _ in range(MOST_STEPS):
        meeting = Meeting(total(shares(weights - step)))
        loss = meeting.loss + penalty / 2 * float(((weights - step) ** 2).sum())
        if loss > least + 1e-12:  # too far
            step = step / 2
            continue
        weights, least = weights - step, loss
        sums = total(slopes(weights, meeting.tables))
        curve = np.zeros((width, width))
        for i in range(width):
            curve[i, i:] = curve[i:, i] = sums["curve", i]
        cross = meeting.crossed({k: v for k, v in sums.items() if len(k) == 3}, width)
        curve = penalty * np.eye(width) + (curve - cross - cross.T) / meeting.pairs
        step = np.linalg.solve(curve, penalty * weights - sums["pull",] / meeting.pairs)
        if np.abs(step).max() < 1e-9:
            return weights - step, mean, deviation
    raise RuntimeError(f"the weights did not settle in {MOST_STEPS} steps")


def add(totals: dict, more: dict) -> None:
    for key, value in more.items():
        totals[key] = totals[key] + value if key in totals else value


def fit(good, bad, penalty: float = PENALTY):
    """Weights of the standardised features, their means and deviations. good, bad: feature rows of either label."""
    import numpy as np

    x = np.concatenate([good, bad])
    labels = np.repeat([1, 0], [len(good), len(bad)])

    def total(work):
        out = {}
        for at in range(0, len(x), FIT_SLICE):
            add(out, work(x[at : at + FIT_SLICE], labels[at : at + FIT_SLICE]))
        return out

    return minimum(total, penalty)


def feature_slices(batches):
    """Batches of (quality, features) as (matrix, labels), few rows at a time."""
    import numpy as np

    for batch in batches:
        for at in range(0, batch.num_rows, FIT_SLICE):
            some = batch.slice(at, FIT_SLICE)
            rows = some.column("features").to_pylist()
            yield np.frombuffer(b"".join(rows)).reshape(len(rows), -1), some.column("quality").to_numpy(zero_copy_only=False)


def summed(rows: DataFrame, work: Callable) -> dict:
    """The arrays that work(features, good) gives for the slices of rows(quality, features), added up by key. Tasks add
    their slices, then keys are dealt to tasks; the driver gets one array for each key, however many rows there are."""
    import json

    import numpy as np

    schema = T.StructType.fromDDL("key string, total binary")
    arrow = to_arrow_schema(schema)

    def packed(totals):
        if totals:
            yield pa.RecordBatch.from_pydict({"key": list(totals), "total": [v.tobytes() for v in totals.values()]}, schema=arrow)

    def run(batches):
        totals = {}
        for x, good in feature_slices(batches):
            add(totals, work(x, good))
        yield from packed({json.dumps(k): v for k, v in totals.items()})

    def join(batches):
        totals = {}
        for batch in batches:
            for key, value in zip(batch.column("key").to_pylist(), batch.column("total").to_pylist(), strict=True):
                add(totals, {key: np.frombuffer(value)})
        yield from packed(totals)

    found = rows.mapInArrow(run, schema).repartition("key").mapInArrow(join, schema).collect()
    return {tuple(json.loads(r["key"])): np.frombuffer(r["total"]) for r in found}


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, text) that labels(doc_id, quality) mark, with quality. Equal rows count once, and the better
    one of a document's labels."""
    marked = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return docs.select("doc_id", "text").join(marked, "doc_id").distinct()


def sampled(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """About fit_rows rows of labelled(), with _hash: those whose ids have the least hashes. The bound on the hash follows
    from the number of rows."""
    keyed = lambda df: df.withColumn("_hash", F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)))
    n = docs.select("doc_id").join(labels.where(F.col("quality").isin(0, 1)).select("doc_id").distinct(), "doc_id").count()
    if n > fit_rows:
        below = int(HASHES * fit_rows / n)
        docs, labels = (keyed(df).where(F.col("_hash") < below).drop("_hash") for df in (docs, labels))
    return keyed(labelled(docs, labels))


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int | None = None) -> dict | None:
    """The model from all rows of docs(doc_id, text) that labels(doc_id, quality) mark; None unless both labels occur.

    fit_rows: for trials, to learn from about so many of them only. The features of all rows are a table; the driver gets
    sums whose size is that of the features and of the range of the scores.
    """
    import numpy as np

    ship(docs.sparkSession)

    def start():
        def work(rows):
            return {"quality": rows["quality"], "features": [x.tobytes() for x in features([t or "" for t in rows["text"]])]}

        return work

    rows = labelled(docs, labels) if fit_rows is None else sampled(docs, labels, fit_rows)
    rows = materialize(map_slices(rows, "quality int, features binary", start), "quality-features")
    found = minimum(lambda work: summed(rows, work), PENALTY)
    if found is None:
        release(rows)
        return None
    weights, mean, deviation = found
    by = weights / deviation
    shift = float(mean @ by)
    schema = T.StructType.fromDDL("bad boolean, raw double")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for x, good in feature_slices(batches):
            # One row by one, so that equal rows are equal here.
            yield pa.RecordBatch.from_pydict({"bad": good == 0, "raw": (x * by).sum(axis=1) - shift}, schema=arrow)

    raw = materialize(rows.mapInArrow(run, schema), "quality-scores")
    bad, n = raw.agg(F.count_if("bad"), F.count("*")).first()
    # Between the rows of rank bad and the next: midway, if the labels are parted there.
    (edge,) = robust.quantiles(raw, "raw", [(bad - 0.5) / (n - 1)])
    release(rows, raw)
    return {"weights": np.asarray(weights).tolist(), "mean": mean.tolist(), "deviation": deviation.tolist(), "edge": edge}


class Judge:
    """Scores texts by a model. Without one every score is 1."""

    def __init__(self, model: dict | None):
        import numpy as np

        if model is not None:
            self.weights = np.array(model["weights"]) / np.array(model["deviation"])
            self.shift = math.log(THRESHOLD / (1 - THRESHOLD)) - model["edge"] - float(self.weights @ np.array(model["mean"]))
        self.model = model

    def __call__(self, texts: list[str | None]):
        import numpy as np

        if self.model is None:
            return np.ones(len(texts))
        # Rows are multiplied one by one, so that a text's score doesn't depend on its neighbours.
        raw = (features([t or "" for t in texts]) * self.weights).sum(axis=1) + self.shift
        return (1 / (1 + np.exp(-np.clip(raw, -30, 30)))).round(6)


def filtered(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows of docs(text, ...) that the model predicts to be good, with the columns of docs. Without a model all stay."""
    if model is None:
        return docs

    def start():
        judge = Judge(model)

        def work(rows):
            keep = [i for i, s in enumerate(judge(rows["text"])) if s >= THRESHOLD]
            return {k: [v[i] for i in keep] for k, v in rows.items()}

        return work

    return map_slices(docs, docs.schema, start)


HELD_OUT, HELD_OUT_REST = 4, 2


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(crc_mod(doc_id, HELD_OUT) == HELD_OUT_REST, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores documents(doc_id, text): learned from labelled rows that are not held out, for every row.

    Null and empty texts have features of nothing; labels with nulls are left out, and one document's labels count once,
    the better one; repeated rows give repeated rows; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("held_out", held_out())
    model = learn(rows.where(~F.col("held_out")), labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")))

    def start():
        score = Judge(model)

        def work(batch):
            scores = score(batch["text"])
            return {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": scores.tolist(), "predicted": (scores >= THRESHOLD).astype(int).tolist()}

        return work

    return map_slices(rows, "doc_id long, held_out boolean, score double, predicted int", start)


def op7_bradley_terry_quality(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
