"""Near copies against all pairs by the Jaccard similarity of five-word shingles."""

import random

import corpus_pipeline
from tessera.llm import nearcopies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(n)]


def edited(rng, base, edits):
    out = list(base)
    for at in rng.sample(range(len(out)), edits):
        out[at] = words(rng, 1)[0]
    return out


def similar(a, b):
    return 9 * len(a & b) >= 4 * (len(a) + len(b))


def plain_kept(rows):
    """The row that stays of each group, by comparing all pairs."""
    sets = [set(nearcopies.shingles(r[1]).tolist()) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (doc, text) in enumerate(rows):
        best.setdefault(find(i), []).append((doc is None, doc or 0, text))
    return best


def stay(spark, rows):
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA)
    return [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]


def test_near_copies_of_ordinary_length_go(spark):
    rng = random.Random(3)
    rows = []
    for doc in range(0, 120, 3):
        base = words(rng, 200)
        rows += [(doc, " ".join(base)), (doc + 1, " ".join(edited(rng, base, 2))), (doc + 2, " ".join(edited(rng, base, 20)))]
    want = sorted(min(g)[1] for g in plain_kept(rows).values())
    got = stay(spark, rows)
    assert sorted(d for d, _ in got) == want and all(d % 3 != 1 for d in want) and len(want) == 80


def test_a_crowd_of_near_copies_leaves_one(spark):
    rng = random.Random(4)
    base = words(rng, 200)
    rows = [(i, " ".join(edited(rng, base, 2))) for i in range(150)] + [(1000 + i, " ".join(words(rng, 200))) for i in range(20)]
    want = sorted(min(g)[1] for g in plain_kept(rows).values())
    assert sorted(d for d, _ in stay(spark, rows)) == want and len(want) == 21


def test_copies_of_copies_and_loners_in_a_crowd(spark):
    """A crowd in which some are alike only by way of others, and some are near but not alike any."""
    rng = random.Random(6)
    base = words(rng, 150)
    rows = [(i, " ".join(edited(rng, base, 1 + i % 8))) for i in range(160)]
    far = edited(rng, base, 6)
    rows += [(500 + i, " ".join(edited(rng, far, 1))) for i in range(3)]
    passage = words(rng, 60)
    rows += [(1000 + i, " ".join(passage + words(rng, 40))) for i in range(120)]
    want = sorted(min(g)[1] for g in plain_kept(rows).values())
    assert sorted(d for d, _ in stay(spark, rows)) == want and 122 < len(want) < 280


def template(rng, base, at, own):
    """A text of a template with a stretch of own words."""
    return base[:at] + words(rng, own) + base[at + own :]


def test_templates_with_words_of_their_own(spark):
    """Sets of one template that are too far from each other, some that are near, and copies that join far ones."""
    rng = random.Random(8)
    base, other = words(rng, 200), words(rng, 200)
    texts = [template(rng, base, 40, 28) for _ in range(60)] + [template(rng, base, 40, 12) for _ in range(20)] + [template(rng, other, 100 + 3 * (i % 9), 30) for i in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(1000 + i, " ".join(edited(rng, texts[i], 1))) for i in (3, 17, 90)]
    rows += [(2000 + i, " ".join(template(rng, base, 40, n)[:190])) for i, n in enumerate((2, 5, 8, 28, 28))]
    want = sorted(min(g)[1] for g in plain_kept(rows).values())
    assert sorted(d for d, _ in stay(spark, rows)) == want and 60 < len(want) < 130


def test_a_template_gives_few_pairs(spark, monkeypatch):
    """Documents of one template, each with a stretch of its own: what is compared does not grow with their square."""
    rng = random.Random(9)
    base, compared = words(rng, 100), []
    real = nearcopies.alike
    monkeypatch.setattr(nearcopies, "alike", lambda pairs, values: (compared.append(pairs.count()), real(pairs, values))[1])
    for n in (150, 300):
        rows = [(i, " ".join(template(rng, base, 30, 14))) for i in range(n)]
        compared.clear()
        assert len(stay(spark, rows)) == n
        # Keys that few share give some pairs each; those that many share give the two that speak for the class.
        assert compared[0] < 60 * n and sum(compared[1:]) <= 4


def test_given_documents_against_all_pairs(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(10**6 + i, " ".join(t.split()[:-1])) for i, (_, t) in enumerate(rows[:40]) if t and len(t.split()) > 60]
    want = sorted(min(g)[1] for g in plain_kept(rows).values())
    assert sorted(d for d, _ in stay(spark, rows)) == want and len(want) < len(rows)


def test_rows_decide_not_ids(spark):
    rng = random.Random(5)
    a, b, c = (" ".join(words(rng, 50)) for _ in range(3))
    got = stay(spark, [(1, a), (7, a), (7, b), (7, c), (None, c), (None, b), (None, b), (7, c)])
    assert sorted(got) == sorted([(1, a), (7, b), (7, c)])
    got = stay(spark, [(None, a), (None, a), (None, a.upper()), (None, b)])
    assert len(got) == 2 and {t.lower() for _, t in got} == {a, b}
