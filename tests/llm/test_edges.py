"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; and what the methods promise."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bytebpe, langid, maxscore, media, packing, planes, preference, quality, secrets, simhash, wordbpe

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, row string, held_out string, features string, file_no int, digest string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 0.5, 7, "r", "h", "f", 3, "d") for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long = "Wort " * 30_000 + "end"
    rows = [(1, None, "en"), (2, "", "en"), (3, "the cat sat on the mat and the dog", "en"), (3, "the cat sat on the mat and the dog", "en"), (4, "der Hund und die Katze sind im Haus", "de"), (None, "no id here at all", None), (5, long, "de"), (6, " \n\t ", "en"), (7, "x" * 70_000, "en"), (8, "123 !!! 456", None)]
    return documents(spark, rows)


def empty(df):
    return df.limit(0)


def by_doc(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r.asDict())
    return out


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, [None, 1.0]), (7, [-3.0]), (20, [0.0, 0.0]), (None, [1.0, 1.0]), (40, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = [tuple(r) for r in maxscore.top_k(df, df.where("vec_id % 20 = 0"), k=3).collect()]
    q0 = sorted(r for r in got if r[0] == 0)
    assert q0 == [(0, 1, 1, 512), (0, 2, 2, 512), (0, 3, 2, 512)]
    assert sorted(r for r in got if r[0] == 20) == [(20, 1, 0, 0), (20, 2, 1, 0), (20, 3, 2, 0)]
    assert sorted(r for r in got if r[0] == 40) == [(40, 1, 0, 0), (40, 2, 1, 0), (40, 3, 2, 0)]
    assert maxscore.top_k(empty(df), empty(df)).count() == 0


@pytest.mark.parametrize("scale, kind", [(20, np.float32), (5000, np.float64), (2**40, np.int64)])
def test_shard_is_exact(scale, kind):
    rng = np.random.default_rng(scale % 97)
    rows, ids = rng.integers(-scale, scale, (3000, 16)), rng.permutation(3000)
    assert maxscore.exact_type(scale, scale, 16) is kind
    shard = maxscore.Shard(ids, rows, kind)
    small = max(1, min(scale, 2**14))  # scores have to fit a long
    queries = rng.integers(-small, small, (70, 16))
    queries[3] = 0
    for q, own, (got_ids, got) in zip(queries, range(70), shard.top(np.arange(70), queries, 20), strict=True):
        want = sorted(((-int(s), int(i)) for s, i in zip(rows @ q, ids) if i != own))[:20]
        assert [(-int(s), int(i)) for s, i in zip(got, got_ids)] == want


def test_shard_with_a_query_many_times():
    """A query's own id fills the rows that are scored first."""
    rng = np.random.default_rng(5)
    rows = rng.integers(-20, 20, (3000, 8))
    ids = np.where(np.arange(3000) < 2900, 1, np.arange(3000))
    queries = rng.integers(-20, 20, (3, 8))
    shard = maxscore.Shard(ids, rows, np.float32)
    for own, q, (got_ids, got) in zip((1, 2, 2999), queries, shard.top(np.array([1, 2, 2999]), queries, 20), strict=True):
        want = sorted(((-int(s), int(i)) for s, i in zip(rows @ q, ids) if i != own))[:20]
        assert [(-int(s), int(i)) for s, i in zip(got, got_ids)] == want


def test_shards_merge(spark):
    rng = np.random.default_rng(9)
    vectors = (rng.normal(size=(300, 8)) / 3).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    whole = np.floor(64 * vectors.astype("float64")).astype(int)
    want = {(q, r + 1, i, s) for q in range(0, 300, 20) for r, (s, i) in enumerate((-a, b) for a, b in sorted((-int(whole[q] @ whole[i]), i) for i in range(300) if i != q)[:5])}
    got = maxscore.top_k(df, df.where("vec_id % 20 = 0"), k=5, shard_rows=64, block_queries=4)
    assert {tuple(r) for r in got.collect()} == want


def test_topk_of_a_query_that_is_there_twice(spark):
    """Each of its rows is answered in full; neither is a candidate of the other."""
    draw = np.random.default_rng(12)
    rows = [(i, draw.normal(size=4).tolist()) for i in range(60)] + [(20, draw.normal(size=4).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in maxscore.top_k(df, df.where("vec_id % 20 = 0"), k=7, shard_rows=16, block_queries=2).collect())
    want = []
    for q, v in rows:
        if q % 20 == 0:
            scores = sorted((-int(np.floor(64 * np.array(v)) @ np.floor(64 * np.array(w))), i) for i, w in rows if i != q)[:7]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert got == sorted(want)


def test_shard_skips_and_prunes():
    """Blocks of like rows are skipped, terms that hardly count are left out, and the answers stay those of the product."""
    draw = np.random.default_rng(13)
    centres = draw.normal(size=(20, 32))
    likes = centres[draw.integers(0, 20, 4000)] + draw.normal(size=(4000, 32)) * 0.05
    few = draw.normal(size=(4000, 32)) * np.r_[np.ones(4), np.full(28, 0.02)]
    for rows, told in ((likes, "skipped"), (few, "pruned")):
        rows, ids = np.floor(20 * rows).astype(np.int64), draw.permutation(4000)
        shard = maxscore.Shard(ids, rows, np.float32)
        got = shard.top(ids[:50], rows[:50], 10)
        assert shard.pairs[told] > 0 and shard.pairs["skipped"] + shard.pairs["pruned"] > 0.2 * shard.pairs["all"]
        for q, own, (got_ids, scores) in zip(rows, ids, got, strict=False):
            want = sorted(((-int(s), int(i)) for s, i in zip(rows @ q, ids) if i != own))[:10]
            assert [(-int(s), int(i)) for s, i in zip(scores, got_ids)] == want


def test_media_are_fetched_by_size(spark):
    """However many places there are, few payloads are held at a time; large ones are read alone."""
    index = media.store(spark.createDataFrame([("x" * (1000 + i),) for i in range(40)] + [("y" * 300_000,)], "text string"))
    places = index.coalesce(1)
    got = {r["digest"]: r["media"] for r in media.fetched(places, fetch_bytes=2000).collect()}
    assert len(got) == 41 and all(len(got[r["digest"]]) == r["size"] for r in index.collect())


def test_planes_of_many_empty_texts(spark, tmp_path):
    """Documents count in a file's size, also those without text."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "'' AS text")
    manifest = planes.write_planes(docs, f"file://{tmp_path}/planes", file_bytes=planes.DOC_BYTES * 1000)
    sizes = [r["n_docs"] for r in manifest.collect()]
    assert sum(sizes) == 3000 and len(sizes) == 3 and max(sizes) < 2000
    assert planes.read_planes(manifest).agg({"n_tokens": "sum"}).first()[0] == 3000


def test_golay_keys():
    """Words that differ in one bit share a key; words have one or six keys."""
    rng = random.Random(3)
    words = [rng.getrandbits(23) for _ in range(400)]
    keys, count = simhash.golay_keys(words)
    assert set(count.tolist()) <= {1, 6}
    for w, k, n in zip(words, keys, count):
        flipped = [w ^ 1 << b for b in range(23)]
        others, m = simhash.golay_keys(flipped)
        assert all(set(k[:n].tolist()) & set(o[:c].tolist()) for o, c in zip(others, m))


def linked(spark, fps, crowd):
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    named = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, crowd)).collect()}
    return {f: named.get(simhash.signed(f), simhash.signed(f)) for f in fps}


@pytest.mark.parametrize("crowd", [48, 2])
def test_links_lose_nothing(spark, crowd):
    """Random fingerprints, chains and a crowd of neighbours, with and without crowded keys."""
    rng = random.Random(crowd)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        for _ in range(3):
            f ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(f)
    centre = rng.getrandbits(64)
    fps |= {centre ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(120)}
    fps = sorted(fps)
    array = np.array(fps, np.uint64)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, f in enumerate(fps):
        for j in np.nonzero(np.bitwise_count(array ^ array[i]) <= 2)[0]:
            root[find(f)] = find(fps[j])
    got = linked(spark, fps, crowd)
    groups, mine = {}, {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
        mine.setdefault(got[f], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_simhash_edges(spark, odd):
    got = by_doc(simhash.near_duplicates(odd))
    assert sum(map(len, got.values())) == odd.count()
    assert got[1][0]["fingerprint"] == got[2][0]["fingerprint"] == got[6][0]["fingerprint"] == "0" * 16
    assert got[1][0]["component_id"] == got[2][0]["component_id"] == got[6][0]["component_id"] == 1
    assert [r["component_id"] for r in got[3]] == [3, 3] and got[None][0]["component_id"] is None
    assert simhash.near_duplicates(empty(odd)).count() == 0


def test_media_edges(spark, odd):
    got = by_doc(media.document_media(odd))
    assert sum(map(len, got.values())) == odd.count()
    assert got[1][0]["payload_bytes"] == got[2][0]["payload_bytes"] == 64 and got[1][0]["payload_sha256"] == hashlib.sha256(bytes(64)).hexdigest()
    assert got[7][0]["payload_bytes"] == 70_016 and len(got[3]) == 2
    assert media.document_media(empty(odd)).count() == 0


def test_sequences_keep_order(spark):
    html = """<html><head><title>t</title><style>x{}</style></head><body><p>one &amp; <b>two</b></p><script>no</script><figure><img src="media:aa" data-bytes="5" alt="old"><figcaption> the <i>caption</i> </figcaption></figure>
    tail<img src="media:bb" alt="B"><img src="http://x"><p>end</body>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, "plain")], "doc_id long, html string")
    store = spark.createDataFrame([("aa", bytearray(b"A"))], "digest string, media binary")
    got = media.resolve(media.sequences(pages), store).orderBy("doc_id", "position")
    rows = [(r["doc_id"], r["position"], r["kind"], r["text"], r["digest"], r["caption"], r["media"] and bytes(r["media"])) for r in got.collect()]
    assert rows == [(1, 0, "text", "one & two", None, None, None), (1, 1, "media", None, "aa", "the caption", b"A"), (1, 2, "text", "tail", None, None, None), (1, 3, "media", None, "bb", "B", None), (1, 4, "media", None, None, None, None), (1, 5, "text", "end", None, None, None), (3, 0, "text", "plain", None, None, None)]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<head><title>t</title><meta charset=x><p>one", ["one"]),
        ("<html><head><title>t</title>bare text", ["bare text"]),
        ("<figure><figcaption>c</figcaption><img src=media:a></figure>d", [("media:a", "c"), "d"]),
        ("<figure><img src=media:a alt=x><figcaption>c <p>more</figure>d", [("media:a", "c more"), "d"]),
        ("<div><figure><img src=media:a><figcaption>c</div>d", [("media:a", "c"), "d"]),
        ("<figure><img src=a><figure><img src=b><figcaption>in</figcaption></figure><figcaption>out</figcaption></figure>", [("a", "out"), ("b", "in")]),
        ("<figure><figure><img src=a></figure><figure><img src=b><figcaption>own</figure><figcaption>out</figure>", [("a", "out"), ("b", "own")]),
        ("<figcaption>no figure</figcaption>x", ["no figure", "x"]),
        ("a<noscript><img src=b></noscript><img>c", ["a", (None, None), "c"]),
        ("a<script>if (a < b) { '<p>' }</script>b", ["ab"]),
        ("a<style>never closed <p>b", ["a"]),
        ("</div></figure></figcaption>a</p>b<br>c", ["a", "b", "c"]),
        ("<figure><img src=a><figcaption>one<figcaption>two</figure>", [("a", "two")]),
        ("&lt;b&gt; &amp; <b>x</b>", ["<b> & x"]),
    ],
)
def test_pages_that_are_not_well_formed(html, want):
    got = media.parser().items(html)
    assert [(x["src"], x["caption"]) if x["kind"] == "media" else x["text"] for x in got] == want
    assert [x["position"] for x in got] == list(range(len(got)))


def test_given_pages_keep_their_text(spark, sf_dir):
    """Every word of a page's body is in its sequence, in order, by a plain stripping of tags."""
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r["items"] for r in media.sequences(pages, "page_id").collect()}
    for r in pages.collect():
        body = re.sub(r"(?is)<(script|style|noscript|template|title)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", " ", r["html"] or "")
        words = html.unescape(re.sub(r"(?s)<[^>]*>", " ", body)).split()
        items = got.pop(r["page_id"])
        assert "".join(x["text"] for x in items if x["kind"] == "text").replace(" ", "") == "".join(words), r["page_id"]
    assert not got


@pytest.mark.parametrize("data", [b"", b"x", b"a" * 64, bytes(range(256)) * 9000])
def test_png_round_trip(data):
    payload = media.padded(data)
    assert len(payload) % 64 == 0 and payload and media.from_png(media.to_png(payload)) == payload
    broken = bytearray(media.to_png(payload))
    broken[20] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(broken))


def test_language_edges(spark, odd):
    rows = [(i, t, lang) for i in range(100, 160) for t, lang in (("the cat and the dog went with that other thing", "en"), ("der Hund und die Katze gehen mit dem Kind", "de"))]
    got = by_doc(langid.identify(documents(spark, [(i * 2 + (lang == "de"), t, lang) for i, t, lang in rows]).unionByName(odd)))
    assert [got[k][0]["lang_pred"] for k in (1, 2, 6, 8)] == ["und"] * 4 and got[1][0]["score"] == 0
    assert {r["lang_pred"] for r in got[3]} == {"en"} and got[4][0]["lang_pred"] == "de" and 0 <= got[7][0]["score"] <= 1
    assert langid.identify(empty(odd)).count() == 0
    alone = by_doc(langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))))
    assert {r["lang_pred"] for rs in alone.values() for r in rs} == {"und"}


def test_language_of_many_scripts():
    """Letters beyond the Latin ones have profiles too, and counts do not depend on how texts are batched."""
    p = langid.Profiles()
    texts = ["привет мир", "漢字かな", "a", "Ünïcode 𝒳", "", "!!"]
    vectors, sizes = p.encode(texts)
    assert (sizes > 0).tolist() == [True, True, True, True, False, False]
    for t, v in zip(texts, vectors):
        assert np.array_equal(p.encode([t])[0][0], v)


def test_packing_edges(spark, odd):
    got = by_doc(packing.pack_documents(odd))
    assert [got[k][0]["doc_tokens"] for k in (1, 2, 6)] == [1, 1, 1] and got[1][0]["ids_crc32"] == zlib.crc32(b"\1\0\0\0")
    assert len([r for r in got[3] if r["start"] == 0]) == 2
    assert sum(r["length"] for r in got[5]) == got[5][0]["doc_tokens"] > 2048
    assert packing.pack_documents(empty(odd)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_fill_is_closest(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 60): rng.randrange(1, 4) for _ in range(8)}
    room = rng.randrange(1, 150)
    sums = {0}
    for n, k in counts.items():
        sums = {s + n * i for s in sums for i in range(k + 1)}
    chosen = packing.fill(counts, room)
    assert all(0 < chosen[n] <= counts[n] for n in chosen) and sum(n * k for n, k in chosen.items()) == max(s for s in sums if s <= room)
    lengths = [n for n, k in counts.items() for _ in range(k)]
    windows = packing.minimum_bin_slack(lengths, 64)
    assert sorted(i for w in windows for i in w) == list(range(len(lengths))) and all(sum(lengths[i] for i in w) <= 64 for w in windows)


def test_plane_edges(spark, odd, tmp_path):
    got = planes.read_planes(planes.write_planes(odd, f"file://{tmp_path}/a", "bit", file_bytes=50_000)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 3, 4, 5, 6, 7, 8]
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert planes.read_planes(planes.write_planes(empty(odd), f"{tmp_path}/b")).count() == 0


@pytest.mark.parametrize("unit", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 1000])
def test_plane_round_trip(unit, n):
    rng = np.random.default_rng(n)
    sink, want = io.BytesIO(), []
    writer = planes.PlaneWriter(sink, unit, block_ids=64)
    for doc in range(4):
        ids = rng.integers(0, 2 ** (8 * (doc + 1)) - 1, n).astype("<u4")
        writer.add(doc, ids.tobytes())
        want.append(ids)
    assert writer.close() == (4, 4 * n, len(sink.getvalue()))
    read = list(planes.PlaneReader(sink).documents())
    assert [(d, s, c) for d, s, c, _ in read] == [(d, d * n, n) for d in range(4)]
    for (_, _, _, parts), ids in zip(read, want):
        assert np.array_equal(np.concatenate([*parts, np.zeros(0, "<u4")]), ids)
    with pytest.raises(ValueError):
        planes.PlaneReader(io.BytesIO(bytes(40)))


def test_quality_edges(spark, odd, sf_dir):
    labels = spark.createDataFrame([(3, 1), (3, None), (8, 0), (None, 1), (4, 1), (5, 7)], "doc_id long, quality int")
    got = by_doc(quality.judge(odd, labels))
    assert sum(map(len, got.values())) == odd.count() and all(0 <= r["score"] <= 1 for rs in got.values() for r in rs)
    assert got[8][0]["score"] < got[3][0]["score"] == got[3][1]["score"]
    none = by_doc(quality.judge(odd, labels.limit(0)))
    assert {r["predicted"] for rs in none.values() for r in rs} == {1}
    assert quality.judge(empty(odd), labels).count() == 0


def test_quality_at_the_threshold():
    """Equal texts have equal scores whatever stands beside them, and a score at the threshold counts as good."""
    size = quality.features(["a"]).shape[1]
    judge = quality.Judge({"weights": [0.0] * size, "mean": [0.0] * size, "deviation": [1.0] * size, "edge": 0.0})
    scores = judge(["one", None, "", "two three"])
    assert scores.tolist() == [quality.THRESHOLD] * 4
    rng = np.random.default_rng(3)
    judge = quality.Judge({"weights": rng.normal(size=size).tolist(), "mean": [0.0] * size, "deviation": [1.0] * size, "edge": 0.0})
    texts = ["one two", "Three | four!", "", "one two", "x" * 5000]
    assert judge(texts).tolist() == [judge([t])[0] for t in texts]


def test_quality_sample_is_bounded(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(400).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality")
    assert 50 < quality.sampled(docs, labels, 100).count() < 150 and quality.sampled(docs, labels, 400).count() == 400


def test_bradley_terry():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (300, 3)), rng.normal(0, 1, (100, 3))
    weights, mean, deviation = quality.fit(good, bad)
    assert (weights > 0).all()
    score = lambda x: (x - mean) / deviation @ weights
    assert (score(good)[:, None] > score(bad)[None]).mean() > 0.85


def github(body):
    return f"ghp_{body}{secrets.base62(zlib.crc32(body.encode()))}"


def test_secret_spans():
    s = secrets.Scanner()
    body = "abcdefghijklmnopqrstuvwxyz0123"
    cases = {
        "": [],
        'PassWord = "hunter2x"': [("assign", 0, 20)],
        "token: abc": [],
        "token: abc secret=longer1": [("assign", 11, 25)],
        "api_key=secret=abcdef": [("assign", 0, 21)],
        "AKIA" + "A" * 15: [],
        "xAKIA" + "A" * 16 + "b": [("access", 1, 21)],
        "AKIAKIA" + "Z" * 14: [("access", 0, 21)],
        "g" + "0" * 24 + "g" + "1" * 23: [("hex", 1, 25)],
        "ſecret=abcdefg": [],
        "toKen=abcdefg": [],
        "İİ token=abcdefgh": [("assign", 3, 17)],
        github(body): [("github", 0, 40)],
        github(body)[:-1] + "!": [],
        github(body)[:-1] + ("A" if github(body)[-1] != "A" else "B"): [],
        f"secret={'f' * 30}": [("assign", 0, 37), ("hex", 7, 37)],
    }
    for text, want in cases.items():
        assert s.spans(text) == want, text


def test_secret_edges(spark, odd):
    got = by_doc(secrets.scan(odd))
    assert sum(map(len, got.values())) == odd.count() and got[1][0]["base_sha256"] == got[2][0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secrets.scan(empty(odd)).count() == 0
    docs = documents(spark, [(1, "a token=abcdefgh b", "en"), (2, None, "en")])
    assert [(r["text"], r["row"]) for r in secrets.redact(docs).orderBy("doc_id").collect()] == [("a [assign] b", "r"), (None, "r")]


def test_hex_runs_at_every_place():
    s = secrets.Scanner()
    for before in range(30):
        for n in (23, 24, 25, 40):
            text = "g" * before + "a" * n + "z"
            assert s.spans(text) == ([("hex", before, before + n)] if n >= 24 else [])


def test_byte_bpe_edges(spark, odd):
    got = by_doc(bytebpe.encode_documents(odd))
    assert sum(map(len, got.values())) == odd.count()
    assert got[1][0]["n_tokens"] == got[2][0]["n_tokens"] == 0 and got[1][0]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bytebpe.encode_documents(empty(odd)).count() == 0


def digests(c, text):
    """What the library and plain decoding give."""
    ids = c.encoding.encode_ordinary(text)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


SEAMS = ["\n\nWord", "\n\n9", "\t\tx", " \t\n y", "\u00a0\u00a0w", "  'll", "'ll", "x'", "don't", " " * 40 + "z", "\n" * 30, "\x1c\x1cq", "\u3000\u3000漢", "!!\n\n!!", " 12 34", "é\u0301a"]


@pytest.mark.parametrize("seam", SEAMS)
def test_byte_bpe_seams(seam):
    """A seam at every place around the edges of chunks gives the library's ids."""
    c = bytebpe.Codec()
    rng = random.Random(7)
    filler = "".join(rng.choice(["ab ", "cde", "f.", " gh", "7"]) for _ in range(100))
    for fill in (filler, "a" * 300, "日本" * 150, ". " * 150):
        for at in range(20, 140):
            text = fill[:at] + seam + fill[at:230]
            met, _, _ = c.stitches(text, 48, 24)
            assert c.encode(text, met) == c.encoding.encode_ordinary(text), (seam, at)
    assert len(c.stitches(filler[:230], 48, 24)[0]) == 4


def test_byte_bpe_seams_between_shares(spark):
    """The same seams at the edges of shares, which different tasks do."""
    c = bytebpe.Codec()
    rng = random.Random(8)
    filler = "".join(rng.choice(["ab ", "cde", "f.", " gh", "7"]) for _ in range(200))
    texts = [filler[:at] + seam + filler[at:400] for seam in SEAMS for at in range(60, 150, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in bytebpe.encode_documents(docs, chunk=48, overlap=24, share=96).collect()}
    assert got == {i: digests(c, t) for i, t in enumerate(texts)}


def test_byte_bpe_takes_linear_time():
    """Four times the text takes about four times as long."""
    import time

    c = bytebpe.Codec()
    rng = random.Random(9)
    text = "".join(rng.choice(["word ", "other ", "thing.\n", "12 "]) for _ in range(400_000))
    took = []
    for n in (len(text) // 4, len(text)):
        began = time.process_time()
        met, _, _ = c.stitches(text[:n], bytebpe.CHUNK, bytebpe.OVERLAP)
        took.append(time.process_time() - began)
        assert len(met) == -(-n // bytebpe.CHUNK) - 1
    assert took[1] < 10 * took[0] + 0.5


def test_byte_bpe_stitches(spark):
    """Small chunks over awkward texts give what one piece gives: long runs, spaces, marks, many scripts."""
    rng = random.Random(2)
    bits = ["word ", "don't ", "  ", "\n\n", "x" * 90, " " * 80, "né ", "漢字", "😀", "12345", "!!!", "'ll", "\t", " ", " 'd"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 120)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    c = bytebpe.Codec()
    want = {i: (i, *digests(c, text)) for i, text in rows}
    for share in (64, 256, 1_000_000 // 64 * 64):
        got = {r["doc_id"]: tuple(r) for r in bytebpe.encode_documents(docs, chunk=64, overlap=32, share=share).collect()}
        assert got == want, share
    for i, text in rows:
        assert want[i][3] == hashlib.sha256(text.encode()).hexdigest()


def test_word_bpe_is_the_library():
    """Words on the short ways have the ids of the library's whole encode()."""
    enc = wordbpe.WordEncoder()
    texts = ["The Éan, été... don't ΣΑΣ İstanbul naïve café\x0bq a\x1cb x\x85y  z", "é Ångström ﬁ ﷺ ß ẞ ŉ ª 1st 2nd <|endoftext|> a<|startoftext|>b", "ALL CAPS. mixed,Case.. .,. ., ,,, a.b", "漢字 かな 😀 ​ zero", ""]
    rng = random.Random(4)
    for letters in ("etaoinshrdlu'st", "ABCdef.,!?'s'll-_=0123456789", "".join(map(chr, range(33, 127))) + "\0\x01\x1c\x1f", "éèñüßÄŁłœŒİıſµ²½ªº¼·×÷\xad\u0300Ωжשक中a.", "<|endoftext|>"):
        texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 24))) for _ in range(3000)]
    want = [x.ids for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    ids, ends = enc.encode_many(texts)
    for i, text in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == [*want[i], 1], text
    assert enc.encode(texts[0]) == np.asarray(want[0], "<u4").tobytes() and enc.encode_many([])[1].tolist() == [0]
    assert "".join(wordbpe.portions("ab cd\tefgh i", 3)) == "ab cd\tefgh i" and wordbpe.portions("abcdefgh", 3) == ["abcdefgh"]


def test_word_bpe_rules_hold_for_every_token():
    """The table for tiktoken holds each token that the library makes, and both cut the tokens' own strings alike."""
    enc = wordbpe.WordEncoder()
    letter = {c: b for b, c in enumerate(wordbpe.byte_letters())}
    tokens = [t.removesuffix("</w>") for t in enc.tokenizer.get_vocab(with_added_tokens=False)]
    words = [w for t in tokens if (w := bytes(letter[c] for c in t).decode(errors="ignore")) and not any(c.isspace() for c in w)]
    want = [x.ids for x in enc.tokenizer.encode_batch(words, add_special_tokens=False)]
    ids, ends = enc.encode_many(words)
    assert all(ids[ends[i] : ends[i + 1] - 1].tolist() == w for i, w in enumerate(want))


def test_plane_rows_without_distinct_ids(spark, tmp_path):
    """Rows of one id, and rows without one, may lie in several files; the least long is an id like others."""
    docs = documents(spark, [(7, f"some text {i % 5} " * 20, "en") for i in range(60)] + [(None, "x y", "en")] * 20 + [(-(2**63), "low", "en")])
    path = f"file://{tmp_path}/c"
    manifest = planes.write_planes(docs, path, "byte", file_bytes=2000)
    assert manifest.count() > 3
    got = planes.read_planes(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 20 + [-(2**63)] + [7] * 60
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(81)]


def turns(*pairs):
    return [{"role": r, "text": t} for r, t in pairs]


def test_preference_edges(spark):
    schema = "pair_id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt_length int"
    ask, good, bad = ("user", "q"), ("assistant", "good"), ("assistant", "bad")
    rows = [
        (1, turns(ask, good), turns(ask, bad)), (2, turns(ask, good), turns(ask, good)), (3, turns(ask), turns(ask, bad)), (4, None, turns(ask)), (5, turns((None, None), good), turns((None, None), bad)),
        (6, turns(good), turns(bad)), (7, None, None), (8, turns(ask, good, ask, good), turns(ask, bad, ask, good)), (1, turns(ask, good), turns(ask, bad)),
    ]
    df = spark.createDataFrame([(*r, 9) for r in rows], schema)
    got = {}
    for r in preference.format_pairs(df).collect():
        got.setdefault(r["pair_id"], []).append(r)
    assert sorted(got) == [1, 3, 4, 5, 6, 8] and len(got[1]) == 2
    r = got[1][0]
    assert (r["prompt"], r["chosen_text"], r["prompt_turns"]) == ("<|user|>\nq\n<|end|>\n", "<|assistant|>\ngood\n<|end|>\n", 1)
    a, b = map(int, r["chosen_mask"].split(":"))
    assert r["chosen_text"][a:b] == "good\n<|end|>\n"
    assert got[3][0]["chosen_text"] == "" and got[3][0]["chosen_mask"] == "" and got[4][0]["prompt"] == "" and got[5][0]["prompt"].startswith("<|unknown|>")
    assert got[6][0]["prompt_turns"] == 0 and [m.count(":") for m in (got[8][0]["chosen_mask"],)] == [2]
    assert preference.format_pairs(df.limit(0)).count() == 0


def test_parted_pairs_edges(spark):
    rows = [
        (0, 0, "user", "q"), (0, 1, "assistant", "a0"), (0, 1, "assistant", "a0"), (0, 2, "user", "more"),
        (1, 0, "assistant", None), (1, 1, "user", "then"), (1, 2, "assistant", "b"), (1, 3, "assistant", "c"), (2, 0, "user", "no reply"),
        (7, 0, "assistant", "y"), (7, 1, "assistant", "z"), (None, 0, "assistant", "z"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["other_id"], [t["text"] for t in r["chosen"]], [t["text"] for t in r["rejected"]]) for r in preference.parted_pairs(df).collect()}
    # Replies at which they part: of 0 the first of two, of 1 the second of three, of 7 the second of two.
    assert got == {
        0: (1, ["q", "a0", "a0", "more"], ["q", "b", "c"]),
        1: (7, [None, "then", "b", "c"], [None, "then", "z"]),
        7: (0, ["y", "z"], ["y", "a0", "a0", "more"]),
    }
    alone = preference.parted_pairs(df.where("conv_id = 0"))
    assert alone.count() == 1 and preference.format_pairs(alone).count() == 0
    assert preference.parted_pairs(df.limit(0)).count() == 0


def test_masks_of_long_conversations(spark):
    """Conversations longer than a fold's block have the spans that plain counting gives."""
    rng = random.Random(11)
    talks = [[(rng.choice(["assistant", "user", None]), "x" * rng.randrange(5)) for _ in range(n)] for n in (0, 1, 255, 256, 257, 700)]
    df = spark.createDataFrame([(i, turns(*t)) for i, t in enumerate(talks)], "i int, turns array<struct<role:string,text:string>>")
    for i, got in df.select("i", preference.mask(F.col("turns"))).collect():
        at, want = 0, []
        for role, text in talks[i]:
            size = len(f"<|{role or 'unknown'}|>\n{text}\n<|end|>\n")
            if role == "assistant":
                want.append(f"{at + len('<|assistant|>') + 1}:{at + size}")
            at += size
        assert got == ",".join(want)


def test_slices_are_bounded():
    import pyarrow as pa

    from tessera.llm.common import slice_ends

    rng = random.Random(1)
    sizes = [rng.choice([0, 10, 400, 5000]) for _ in range(200)]
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n if n else None for n in sizes], "n": sizes})
    at = 0
    for end in slice_ends(batch, 16, 2000):
        assert at < end <= at + 16 and (sum(sizes[at:end]) <= 2000 or end == at + 1)
        at = end
    assert at == 200 and slice_ends(batch.slice(0, 0), 16) == []
