"""Each query over its whole table against a plain version in Python or SQL."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


def run(spark, sf_dir, name):
    return rows(entry.queries()[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["op1_maxscore_topk", "op10_preference_pairs", "op11_spherical_neardups", "op12_four_russians_repair"])
def test_same_as_sql(spark, sf_dir, duck, name):
    want = duck.sql(entry.oracle_sql()[name])
    got = run(spark, sf_dir, name)
    assert got and sorted(map(repr, (tuple(r[c] for c in want.columns) for r in got))) == sorted(map(repr, want.fetchall()))


def plain_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks):
    """doc_id -> least doc_id reachable over fingerprints within two bits."""
    docs, fps = list(marks), np.array(list(marks.values()), np.uint64)
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, d in enumerate(docs):
        for j in np.nonzero(np.bitwise_count(fps ^ fps[i]) <= 2)[0]:
            a, b = find(d), find(docs[j])
            root[max(a, b)] = min(a, b)
    return {d: find(d) for d in docs}


def test_simhash(spark, sf_dir, texts):
    marks = {d: plain_fingerprint(t) for d, t in texts.items()}
    groups = plain_components(marks)
    got = run(spark, sf_dir, "op2_golay_simhash")
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{marks[d]:016x}", groups[d]) for d in texts}
    assert len(got) == len(texts) and len(set(groups.values())) < len(texts)


def plain_png(payload):
    """A grey image, 64 samples to an unfiltered line, by the PNG specification."""
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    lines = [payload[at : at + 64] for at in range(0, len(payload), 64)]
    data = zlib.compress(b"".join(b"\0" + x for x in lines), 1)
    body = b"".join(chunk(b"IDAT", data[at : at + (1 << 20)]) for at in range(0, len(data), 1 << 20))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (64).to_bytes(4, "big") + len(lines).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])) + body + chunk(b"IEND", b"")


def plain_feature(payload):
    from collections import Counter
    from math import log2, sqrt

    n, counts = len(payload), Counter(payload)
    mean = sum(payload) / n
    deviation = sqrt(sum(k * (v - mean) ** 2 for v, k in counts.items()) / n)
    entropy = abs(-sum(k / n * log2(k / n) for k in counts.values()))
    light = "".join("1" if sum(payload[c::64]) * 64 > sum(payload) else "0" for c in range(64))
    return f"rows={n // 64};mean={mean:.4f};sd={deviation:.4f};entropy={entropy:.4f};columns={int(light, 2):016x}"


def test_media(spark, sf_dir, texts):
    got = run(spark, sf_dir, "op3_interleaved_media")
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    by_text = {}
    for r in got:
        data = texts[r["doc_id"]].encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = plain_png(payload)
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stored), hashlib.sha256(stored).hexdigest(), plain_feature(payload))
        rest = (r["media_bytes"], r["media_sha256"], r["feature"])
        assert by_text.setdefault(texts[r["doc_id"]], rest) == rest


def test_language_held_out(spark, sf_dir, duck):
    lang = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    got = run(spark, sf_dir, "op4_hyperdimensional_langid")
    assert len(got) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_is_the_plain_cosine(spark, sf_dir, duck):
    """Every row's language and score by loops over trigrams, with the letters' vectors alone taken from the operator."""
    from tessera.llm import langid

    letter = np.random.default_rng(langid.SEED).choice(np.array([-1, 1], np.int8), (langid.ALPHABET, langid.DIMENSIONS)).astype(np.int64)
    spare = langid.ALPHABET - 27

    def symbol(c):
        return 0 if not c.isalpha() else ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % spare

    def counted(text):
        of, edges = [0], [symbol(c) for c in text.lower()]
        for x in [*edges, 0]:
            if x or of[-1]:
                of.append(x)
        out = {}
        for t in zip(of, of[1:], of[2:]):
            if t[1]:
                out[t] = out.get(t, 0) + 1
        return out

    kept = {}

    def bundled(counts):
        total = np.zeros(langid.DIMENSIONS)
        for (a, b, c), n in counts.items():
            if (a, b, c) not in kept:
                kept[a, b, c] = np.roll(letter[a], 2) * np.roll(letter[b], 1) * letter[c]
            total += n * kept[a, b, c]
        return total

    docs = duck.sql("SELECT doc_id, text, lang FROM documents").fetchall()
    of_text = {d: counted(t or "") for d, t, _ in docs}
    sums = {}
    for d, t, lang in docs:
        if t is not None and lang is not None and zlib.crc32(str(d).encode()) % 5:
            n = sum(of_text[d].values())
            weight = max(round(langid.UNIT * min(1, langid.FULL_TRIGRAMS / max(n, 1))), 1)
            sums[lang] = sums.get(lang, 0) + weight * bundled(of_text[d])
    names = sorted(sums)
    known = [sums[x] / np.sqrt(sums[x] @ sums[x]) for x in names]
    for r in run(spark, sf_dir, "op4_hyperdimensional_langid"):
        counts = of_text[r["doc_id"]]
        if not counts:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        v = bundled(counts)
        cosines = [v @ k / np.sqrt(v @ v) for k in known]
        assert abs(r["score"] - (1 + max(cosines)) / 2) < 2e-6 and cosines[names.index(r["lang_pred"])] > max(cosines) - 1e-8, r


@pytest.fixture(scope="module")
def ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in texts.items()}


def test_packing(spark, sf_dir, ids):
    got = run(spark, sf_dir, "op5_min_bin_slack")
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
    for doc, want in ids.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0
            at += r["length"]
        assert at == len(want)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    total = sum(map(len, ids.values()))
    assert len(by_sequence) - -(-total // 2048) <= 2


def test_plane_files(spark, sf_dir, ids):
    got = {r["doc_id"]: r for r in run(spark, sf_dir, "op6_bit_planes")}
    at = 0
    for doc in sorted(ids):
        assert (got[doc]["start"], got[doc]["n_tokens"], got[doc]["ids_crc32"]) == (at, len(ids[doc]), zlib.crc32(ids[doc].tobytes()))
        at += len(ids[doc])
    assert len(got) == len(ids)


def auc(scores, labels):
    good, bad = ([s for s, y in zip(scores, labels, strict=True) if y == k] for k in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def test_quality_held_out(spark, sf_dir, duck):
    marked = dict(duck.sql("SELECT doc_id, quality FROM labels").fetchall())
    got = run(spark, sf_dir, "op7_bradley_terry_quality")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in marked]
    assert auc([r["score"] for r in held], [marked[r["doc_id"]] for r in held]) > 0.95
    assert all(r["predicted"] == 1 for r in held if marked[r["doc_id"]] == 1)


def plain_quality_features(text):
    """The features of one text by loops over its characters, words and lines."""
    from math import log1p, sqrt

    from tessera.llm import quality

    def kind(c):
        if c in ".,;:'\"()-?":
            return "point"
        if c in "!|":
            return {"!": "mark", "|": "bar"}[c]
        if c.isalpha() or c.isidentifier():
            return "upper" if c.isupper() else "lower"
        return "digit" if c.isdigit() else "space" if c.isspace() else "other"

    kinds = [kind(c) for c in text]
    words, now = [], []
    for i, k in enumerate([*kinds, "space"]):
        if k == "space":
            if now:
                words.append(now)
            now = []
        else:
            now.append(i)
    n, total = max(len(words), 1), max(len(text), 1)
    share = lambda k: kinds.count(k) / total
    letters = lambda w: [text[i] for i in w]
    caps = sum(len(w) > 1 and kinds[w[0]] == kinds[w[1]] == "upper" for w in words) / n
    same = sum(letters(a) == letters(b) for a, b in zip(words, words[1:])) / n
    odd = sum(kinds[w[-1]] in ("other", "mark", "bar") for w in words) / n
    lines = text.split("\n")
    up = lambda x, least: min(x / least, 1.0)
    out = [caps, share("other"), share("digit"), share("bar"), share("mark"), same, 1 - len(set(lines)) / len(lines)]
    out += [log1p(sum(map(len, words)) / n), log1p(len(words)) / 10, log1p(len(lines)) / 10, odd]
    out += [up(share("other"), 0.02), up(same, 0.05), up(caps, 0.1), up(share("bar"), 0.02), up(odd, 0.1), up(share("mark"), 0.02)]
    low = [c.lower() if len(c.lower()) == 1 else c for c in text] + ["\n"]
    mix = lambda c: (ord(c) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) ^ ord(c) << 17
    of_words = [sum(mix(low[i]) * (k + 1) for k, i in enumerate(w)) for w in words]
    of_trigrams = [(mix(a) * 31 + mix(b)) * 31 + mix(c) for a, b, c in zip(low, low[1:], low[2:])]
    for values, buckets in ((of_words, quality.WORD_BUCKETS), (of_trigrams, quality.TRIGRAM_BUCKETS)):
        counts = [0] * buckets
        for v in values:
            counts[(v * 0xD6E8FEB86659FD93 & (1 << 64) - 1) * buckets >> 64] += 1
        out += [sqrt(c / max(len(values), 1)) for c in counts]
    return [round(x, 9) for x in out]


def test_quality_is_the_plain_score(spark, sf_dir, duck, texts):
    """Every row's score from plain features; the weights fitted on those of the labelled rows that are not held out."""
    from tessera.llm import quality

    marked = dict(duck.sql("SELECT doc_id, max(quality) FROM labels WHERE quality IN (0, 1) GROUP BY doc_id").fetchall())
    assert len(set(marked)) < quality.FIT_ROWS
    plain = {d: plain_quality_features(t or "") for d, t in texts.items()}
    learned = [d for d in texts if d in marked and zlib.crc32(str(d).encode()) % 4 != 2]
    hashes = {r["doc_id"]: r["h"] for r in spark.createDataFrame([(d,) for d in learned], "doc_id long").selectExpr("doc_id", f"pmod(xxhash64(doc_id), {quality.HASHES}) AS h").collect()}
    learned.sort(key=lambda d: (hashes[d], d))
    good, bad = (np.array([plain[d] for d in learned if marked[d] == q]) for q in (1, 0))
    weights, mean, deviation = quality.fit(good, bad)
    raw = lambda x: sum((v - m) / s * w for v, m, s, w in zip(x, mean, deviation, weights, strict=True))
    edge = np.quantile([raw(x) for x in [*good, *bad]], (len(bad) - 0.5) / (len(good) + len(bad) - 1))
    for r in run(spark, sf_dir, "op7_bradley_terry_quality"):
        want = 1 / (1 + np.exp(-(raw(plain[r["doc_id"]]) - edge + np.log(7 / 3))))
        assert abs(r["score"] - want) < 2e-6, r


def plain_secrets(text):
    word = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
    spans = [("assign", *m.span()) for m in re.finditer(word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secrets(spark, sf_dir, texts):
    got = run(spark, sf_dir, "op8_checked_secrets")
    assert len(got) == len(texts)
    for r in got:
        want = plain_secrets(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[0] == k for s in want) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def test_byte_bpe(spark, sf_dir, texts):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = run(spark, sf_dir, "op9_overlapping_bpe")
    assert len(got) == len(texts)
    for r in got:
        want = plain.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
