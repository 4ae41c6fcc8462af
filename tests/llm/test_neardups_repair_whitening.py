"""op11, op12 and op13 against plain versions, and their hard inputs."""

import functools
import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import neardups, repair, whitening

VECTORS = "vec_id long, embedding array<float>, label int, id string"


def plain_neardups(rows, cosine=0.98):
    """[(vec_id, n_links, component_id)] of rows (vec_id, vector or None, label or None), pair by pair."""
    width = max((len(x) for _, x, _ in rows if x), default=1)
    units = []
    for _, x, _ in rows:
        x = [] if x is None or any(v is None for v in x) else x
        v = np.array([np.float32(c) for c in x] + [0.0] * (width - len(x)), np.float64)
        units.append(v / np.linalg.norm(v) if np.isfinite(v).all() and v.any() else None)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if None in (rows[i][0], rows[j][0], rows[i][2]) or rows[i][2] != rows[j][2] or units[i] is None or units[j] is None:
                continue
            if units[i] @ units[j] >= cosine:
                links[i], links[j] = links[i] + 1, links[j] + 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (vec_id, _, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), vec_id), vec_id) if vec_id is not None else None
    return sorted(((rows[i][0], links[i], least[find(i)]) for i in range(len(rows))), key=repr)


def neardups_of(spark, rows, **how):
    got = neardups.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], VECTORS), **how).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr)


def test_neardups_hard_inputs(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 0.0, 0.0], 1), (3, [2.0, 0.0, 0.0], 1), (9, [1.0, 0.1, 0.0], 1), (9, [1.0, 0.1, 0.0], 1), (4, [1.0, 0.0], 1),
        (1, [1.0, 0.0, 0.0], 2), (2, [1.0, 0.0, 0.0], None), (None, [1.0, 0.0, 0.0], 1), (6, [0.0, 0.0, 0.0], 1), (7, [nan, 1.0, 0.0], 1),
        (8, [1.0, None, 0.0], 1), (10, None, 1), (11, [], 1), (12, [inf, 0.0, 0.0], 1), (13, [-1.0, 0.0, 0.0], 1), (14, [3e38, 3e36, 0.0], 1),
    ]
    assert neardups_of(spark, rows) == plain_neardups(rows)
    assert neardups_of(spark, []) == []


def test_neardups_cells_lose_no_link(spark):
    draw = np.random.default_rng(3)
    rows = []
    for group in range(60):
        centre = draw.normal(size=12)
        for i in range(1 + group % 7 * 3 + 90 * (group == 0)):
            rows.append((len(rows), (centre + draw.normal(size=12) * 0.1).tolist(), group % 2))
    want = plain_neardups(rows)
    assert max(n for _, n, _ in want) > 20
    assert neardups_of(spark, rows) == want
    assert neardups_of(spark, rows, cell_rows=40, sample_rows=200, block_rows=30) == want


def test_neardups_cells_split(spark):
    """Clusters that lie apart are worth cells of their own, and a class is in few of them."""
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(10, 16))
    rows = [(i, (centres[i % 10] + draw.normal(size=16) * 0.05).tolist(), 0) for i in range(600)]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], VECTORS)
    state = neardups.packed(vectors.selectExpr("label", "vec_id AS id", "embedding", "1L AS m"), 16, "<f4")
    cells = state.groupBy("cell").agg({"*": "count"}).selectExpr("cell", "`count(1)` AS homes", "`count(1)` AS rows")
    models = neardups.fit_cells(state, cells, "<f4", 0.98, 100, 400)
    split = neardups.split_cells(state, models, cells, "<f4", 0.98)
    homes = split.where("home").groupBy("cell").count().collect()
    assert len(homes) > 5 and sum(r["count"] for r in homes) == 600 and split.count() < 1200


WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_repair(rows):
    """Counts, cost, audit and lines of the cheapest edits of (role, text) rows, by trying everything."""
    faults, seen = [], set()
    for role, text in rows:
        bare = text.strip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    follows = {"": ("user", "u"), "s": ("user", "u"), "u": ("assistant", "a"), "a": ("user", "u")}

    @functools.cache
    def best(i, state, inserted):
        role, after = follows[state]
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def add(cost, initial, line, rest):
            if rest:
                found.append((cost + rest[0], initial + rest[1], line + rest[2]))

        if inserted < 4:
            add(2, "I", (role + ":",), best(i, after, inserted + 1))
        if i < len(rows):
            own, text = rows[i]
            more = faults[i] == "truncated"
            add(3, "D", (), best(i + 1, state, 0))
            if faults[i] in (None, "truncated"):
                if own[:1] == role[0]:
                    add(more, "K", (f"{own}:{text}",), best(i + 1, after, 0))
                if state == "" and own[:1] == "s":
                    add(more, "K", (f"{own}:{text}",), best(i + 1, "s", 0))
                add(2 + more, "R", (f"{role}:{text}",), best(i + 1, after, 0))
        return min(found, default=None)

    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (*counts, illegal, *best(0, "", 0))


def plain_report(conversations):
    """Of (conv_id, turn, role, text, copies) rows: REPORT's rows."""
    out = []
    null_first = lambda t: (t is not None, t or 0)
    for conv_id in {r[0] for r in conversations}:
        mine = [(t, r if r is not None else " ", x if x is not None else " ", n) for c, t, r, x, n in conversations if c == conv_id]
        mine.sort(key=lambda r: (null_first(r[0]), r[1], hashlib.md5(r[2].encode()).digest()))
        rows = tuple((r, x) for _, r, x, n in mine for _ in range(n))
        turns = [t for t, _, _, n in mine if n and t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        *counts, cost, audit, lines = plain_repair(rows)
        out.append((conv_id, gaps, *counts, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def report_of(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, copies int, c string")
    return sorted((tuple(r) for r in repair.report(df).collect()), key=repr)


def test_repair_against_every_edit(spark):
    draw = random.Random(5)
    rows = [
        (conv, draw.choice([None, 0, 1, 2, 5, 9]), draw.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), draw.choice(["a.", "b", "", "c! ", "d?\n", " \t", "x ", None]), draw.choice([0, 1, 1, 1, 2]))
        for conv in [None, *range(120)]
        for _ in range(draw.randrange(1, 9))
    ]
    assert report_of(spark, rows) == plain_report(rows)
    assert report_of(spark, []) == []


def test_repair_of_long_conversations(spark):
    """Pieces, blocks that end within them, and runs of copies; another form of the costs is a table of its own."""
    draw = random.Random(6)
    n = 3 * repair.PIECE + 5
    rows = [(1, t, draw.choice(["user", "assistant"]), f"{t}{draw.choice(['.', ''])}", 1) for t in range(n)]
    rows += [(2, 0, "user", "a.", 2 * repair.PIECE), (2, 1, "user", "b.", 1), (2, 2, "user", "a.", 1)]
    got = report_of(spark, rows)
    costs = (0, 4, 2, 0)
    for _, _, role, text, _ in reversed(rows[:n]):
        more, taken = int(text[-1] != "."), []
        for state, (expects, after) in enumerate((("u", 2), ("u", 2), ("a", 3), ("u", 2))):
            taken.append(min(3 + costs[state], (0 if role[0] == expects else 2) + more + costs[after]))
        costs = tuple(min(taken[s], 2 + taken[a], 4 + taken[b]) for s, (a, b) in enumerate(((2, 3), (2, 3), (3, 2), (2, 3))))
    assert got[0][6] == costs[0] and set(got[0][7]) <= set("DIKR")
    audit = got[0][7]
    assert audit.count("D") + audit.count("K") + audit.count("R") == n
    assert got[1][:7] == (2, 0, 0, 2 * repair.PIECE, 0, 2 * repair.PIECE + 1, 6 * repair.PIECE + 2) and got[1][7] == "K" + "D" * (2 * repair.PIECE - 1) + "RD"


def test_repaired_rows(spark):
    df = spark.createDataFrame([(7, 0, "user", "a."), (7, 1, "user", "b."), (7, 2, "user", "")], "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in repair.repaired(df).orderBy("place").collect()]
    assert got == [(7, 0, "K", "user", "a."), (7, 1, "R", "assistant", "b.")]


def test_block_tables():
    """A table's entry is what single steps give; the vectors are few; symbols and blocks do not matter for a function."""
    blocks = repair.Blocks()
    assert len(blocks.vectors) < 40 and blocks.to.shape == (len(repair.SYMBOLS) ** repair.BLOCK, len(blocks.vectors))
    draw = random.Random(7)
    for _ in range(200):
        symbols = "".join(draw.choice(repair.SYMBOLS) for _ in range(draw.randrange(1, 19)))
        to, less = blocks.function(symbols.encode())
        for v, vector in enumerate(blocks.vectors):
            for s in reversed(symbols):
                vector = repair.costs_before(s, vector)
            assert tuple(c + less[v] for c in blocks.vectors[to[v]]) == vector


def test_whitening_against_plain(spark, sf_dir):
    got = whitening.op13_refined_whitening(spark, sf_dir).toPandas()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(64 * np.stack(table["embedding"]).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    assert (got["n"] == n).all() and len(got) == 32 * n
    deviation = got[got["component"] == 1].set_index("vec_id").loc[table["vec_id"], "deviation"]
    assert (deviation.to_numpy() == ((n * x - sums) ** 2).sum(axis=1)).all()
    y = (n * x - sums) / n
    v = y.T @ y / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:32], axes[:, ::-1][:, :32]
    white = got.pivot(index="vec_id", columns="component", values="whitened").loc[table["vec_id"]].to_numpy()
    want = y @ axes / np.sqrt(values)
    want *= np.sign((want * white).sum(axis=0))
    assert np.abs(white - want).max() < 1e-8
    assert np.abs(got.groupby("component")["explained"].first().to_numpy() - values / np.trace(v)).max() < 1e-12
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9


@pytest.mark.parametrize("spread", ["apart", "clustered"])
def test_refined_eigenvectors(spread):
    draw = np.random.default_rng(8)
    q = whitening.orthonormal(whitening.orthonormal(np.linalg.qr(draw.normal(size=(30, 30)))[0].astype(np.longdouble)))
    values = np.linspace(1, 3, 30) if spread == "apart" else np.r_[np.ones(6), 1 + 1e-9 * np.arange(8), 2 + 1e-14 * np.arange(8), np.zeros(4), 1e-7 * np.arange(4)]
    a = (q * values.astype(np.longdouble)) @ q.T
    a = (a + a.T) / 2
    got, x = whitening.eigenvectors(a)
    assert np.abs(np.sort(values)[::-1] - got).max() < 1e-16
    assert np.abs(a @ x - x * got).max() < 1e-16 and np.abs(x.T @ x - np.eye(30)).max() < 1e-17
    if spread == "apart":
        single = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)[:, ::-1]
        assert np.abs(np.abs(single.T @ x) - np.eye(30)).max() > 1e-8  # what the refinement starts from
        assert np.abs(np.abs(q[:, ::-1].T @ x) - np.eye(30)).max() < 1e-15


def test_whitening_hard_inputs(spark):
    nan = float("nan")

    def run(rows):
        df = spark.createDataFrame([(*r, 0, 1.0) for r in rows], "vec_id long, embedding array<double>, component int, n double")
        return sorted((tuple(r) for r in whitening.whiten(df).collect()), key=repr)

    assert run([]) == [] and run([(1, [1.0, 2.0])]) == [] and run([(1, None)]) == [] and run([(1, []), (2, [])]) == []
    assert run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    # Two places: one component. Nulls, NaN and what is too large take no part, repeated rows and null ids do.
    rows = [(1, [1.0]), (1, [1.0]), (None, [3.0, 0.0]), (4, [3.0]), (5, [None]), (6, [nan]), (7, [1e300]), (8, None)]
    got = run(rows)
    assert [(r[0], r[1], r[2], r[3], abs(round(r[4], 12)), r[5]) for r in got] == [(1, 1, 4, 65536, 1.0, 1.0)] * 2 + [(4, 1, 4, 65536, 1.0, 1.0), (None, 1, 4, 65536, 1.0, 1.0)]
    # Sums of squares beyond a long.
    wide = run([(1, [1e9]), (2, [-1e9])])
    assert [r[3] for r in wide] == [None, None] and {abs(round(r[4], 9)) for r in wide} == {1.0}


def test_exact_products():
    draw = np.random.default_rng(9)
    for size in (5, 1 << 21, 1 << 40):
        x = draw.integers(-size, size, (50, 3))
        want = [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True)) for j in range(3)] for i in range(3)]
        assert whitening.exact_products(x).tolist() == want


def test_hash_of_damage(spark):
    """The deal of faults: the checksum of conv_id:turn, nulls as one space."""
    rows = [(c, t, "user", "A b. c!") for c in (None, 1, 2) for t in (None, *range(40))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"], r["copies"]) for r in repair.damaged(df).collect()}
    name = lambda x: " " if x is None else str(x)
    for c, t, _, _ in rows:
        k = zlib.crc32(f"{name(c)}:{name(t)}".encode()) % 20
        assert got[c, t] == ("user", {1: "", 2: "A b c"}.get(k, "A b. c!"), {0: 0, 3: 2}.get(k, 1))
