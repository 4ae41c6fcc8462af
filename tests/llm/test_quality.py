"""The quality model is learned from every labelled row, and over all pairs of a better and a worse one."""

import numpy as np

from tessera.llm import quality


def plain_loss(scores, labels):
    return np.logaddexp(0, scores[labels == 0][None] - scores[labels == 1][:, None]).mean()


def plain_slope(x, labels, weights):
    """The slope of the penalised loss, pair by pair."""
    apart = x[labels == 1][:, None] - x[labels == 0][None]
    p = 1 / (1 + np.exp(apart @ weights))
    return quality.PENALTY * weights - (apart * p[:, :, None]).mean(axis=(0, 1))


def test_all_pairs_count():
    rng = np.random.default_rng(4)
    for n_good, n_bad, scale in ((60, 35, 1.0), (1, 50, 1.0), (50, 1, 30.0), (1500, 40, 0.1)):
        good, bad = rng.normal(0.7, scale, (n_good, 4)), rng.normal(0, scale, (n_bad, 4))
        good[:, 3] = bad[:, 3] = 5.0  # tells nothing
        good[0, 0] = 1000.0
        weights, mean, deviation = quality.fit(good, bad)
        x, labels = np.concatenate([good, bad]), np.repeat([1, 0], [n_good, n_bad])
        assert np.allclose(mean, x.mean(axis=0), atol=1e-9) and np.allclose(deviation[:3], x.std(axis=0)[:3]) and deviation[3] == 1
        assert np.abs(plain_slope((x - mean) / deviation, labels, weights)).max() < 1e-9


def test_what_a_row_meets():
    """Loss, pulls and curves by nodes are those pair by pair, near, far and at borders of cells."""
    rng = np.random.default_rng(5)
    scores = np.concatenate([rng.normal(0, 9, 300), [-4.0, 0.0, 4.0, 8.0, 700.0, -2e4]])
    labels = rng.integers(0, 2, len(scores))
    cells, share = quality.spread(scores)
    meeting = quality.Meeting({(label, cell): share[rows].sum(axis=0) for label, cell, rows in quality.by_cell(labels, cells)})
    assert abs(meeting.loss / plain_loss(scores, labels) - 1) < 1e-10
    for i, (s, label) in enumerate(zip(scores, labels)):
        apart = (s - scores[labels != label]) * (1 if label else -1)
        p = np.exp(-np.logaddexp(0, apart))
        assert np.allclose(share[i] @ meeting.tables[label, cells[i]], [p.sum(), (p * (1 - p)).sum()], atol=1e-9)
        assert (label, cells[i] - 1) in meeting.tables and (label, cells[i] + 1) in meeting.tables


def test_every_labelled_row_is_learned_from(spark):
    """More rows than a trial takes: means, weights and threshold are those of all of them."""
    n = quality.FIT_ROWS + 1500
    words = ["plain", "words", "of", "some", "kind", "BUY", "now!", "x|y", "42"]
    rng = np.random.default_rng(6)
    labels = (rng.random(n) < 0.7).astype(int)
    texts = [" ".join(words[k] for k in rng.integers(0 if y else 3, 7 if y else 9, 6)) for y in labels.tolist()]
    texts[17], labels[17] = "the ONLY one || of its kind !!", 0
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame(list(enumerate(labels.tolist())), "doc_id long, quality int")
    model = quality.learn(docs, marks)
    x = np.concatenate([quality.features(texts[i : i + 1000]) for i in range(0, n, 1000)])
    assert np.allclose(model["mean"], x.mean(axis=0), rtol=0, atol=1e-12)
    assert np.allclose(np.array(model["deviation"])[x.std(axis=0) > 1e-6], x.std(axis=0)[x.std(axis=0) > 1e-6], rtol=1e-9)
    weights, mean, deviation = quality.fit(x[labels == 1], x[labels == 0])
    assert np.allclose(model["weights"], weights, rtol=0, atol=1e-8)
    raw = ((x - mean) / deviation) @ weights
    assert abs(model["edge"] - np.quantile(raw, ((labels == 0).sum() - 0.5) / (n - 1))) < 1e-8
