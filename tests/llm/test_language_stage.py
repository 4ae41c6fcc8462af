"""The language stage: other languages and gibberish go, documents of the given table stay."""

import base64
import random
import zlib

import corpus_pipeline

GREEK = "η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και τρέχει μακριά ενώ ο ήλιος δύει πίσω από τα βουνά"
RUSSIAN = "быстрая коричневая лиса прыгает через ленивую собаку и убегает далеко пока солнце садится за горы и наступает ночь"
POLISH = "szybki brązowy lis przeskakuje nad leniwym psem i ucieka daleko do lasu kiedy słońce zachodzi za górami w nocy"


def test_other_languages_and_gibberish_go(spark, sf_dir):
    rng = random.Random(2)
    consonants = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(3, 9))) for _ in range(60)) for _ in range(20)]
    han = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(200)) for _ in range(20)]
    coded = [base64.b64encode(rng.randbytes(300)).decode() for _ in range(20)]
    odd = [GREEK, RUSSIAN, POLISH, rng.randbytes(300).hex(), *consonants, *han, *coded]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # crc32 of an id decides who is learned from; these are not, so that nothing of them is learned.
    held = [i for i in range(10**6, 10**6 + 2000) if zlib.crc32(str(i).encode()) % 5 == 0]
    extra = spark.createDataFrame([(held[i], t, None, "s", len(t)) for i, t in enumerate(odd)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.by_language(spark, docs.unionByName(extra), sf_dir).collect()}
    assert not kept & set(held)
    assert kept == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
