"""The pipeline, stage by stage, against plain versions of each decision."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import secrets

from .test_against_plain import plain_secrets
from .test_nearcopies import plain_kept


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [("documents", docs.collect(), docs.columns)]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.materialize(stage(spark, docs, sf_dir), name)
        out.append((name, docs.collect(), docs.columns))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "secrets", "packing"]
    assert all(columns == stages[0][2] for _, _, columns in stages[:-1])


def test_language_keeps_texts_with_letters(stages):
    want = {r["doc_id"] for r in stages[0][1] if any(c.isalpha() for c in r["text"] or "")}
    assert {r["doc_id"] for r in stages[1][1]} == want


def test_quality_follows_labels(stages, duck):
    marked = dict(duck.sql("SELECT doc_id, quality FROM labels").fetchall())
    kept = {r["doc_id"] for r in stages[2][1]}
    assert all((d in kept) == (marked[d] == 1) for d in (r["doc_id"] for r in stages[1][1]) if d in marked)


def test_one_of_each_group_stays(stages):
    groups = plain_kept([(r["doc_id"], r["text"]) for r in stages[2][1]])
    assert {r["doc_id"] for r in stages[3][1]} == {min(g)[1] for g in groups.values()}


def test_secrets_are_gone(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3][1]}
    assert sorted(before) == sorted(r["doc_id"] for r in stages[4][1])
    changed = found = 0
    for r in stages[4][1]:
        text = before[r["doc_id"]]
        assert r["n_chars"] == len(r["text"]) and r["text"] == secrets.redacted(text, secrets.Scanner().spans(text))
        changed += r["text"] != text
        found += bool(secrets.Scanner().spans(text))
        if not plain_secrets(text):
            assert r["text"] == text or "ghp_" in text or "npm_" in text
        else:
            assert len(plain_secrets(r["text"])) == 0
    assert changed == found


def test_all_ids_are_packed(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in stages[5][1]:
        pieces.setdefault(r["doc_id"], []).append(r)
    for r in stages[4][1]:
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        got = sorted(pieces.pop(r["doc_id"]), key=lambda p: p["start"])
        assert [p["ids_crc32"] for p in got] == [zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in got] and sum(p["length"] for p in got) == len(ids)
    assert not pieces


def test_repeated_and_null_rows(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, "no id but some words here", "en", "s", 1), (900001, None, "en", "s", 0), (900002, "", None, None, None)], base.schema)
    docs = base.unionByName(base).unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.materialize(stage(spark, docs, sf_dir), name)
        if name == "near_duplicates":
            ids = [r["doc_id"] for r in docs.collect()]
            assert len(ids) == len(set(ids)) and None in ids
    assert docs.count() > 0
    nothing = base.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        nothing = corpus_pipeline.common.materialize(stage(spark, nothing, sf_dir), "empty")
    assert nothing.count() == 0
