"""From documents to packed training sequences: language, quality, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage
is written as Parquet, and the next one reads that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, langid, nearcopies, packing, quality, secrets


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or less like each language that their lang column teaches than its own texts of about
    the size are, go. Null texts go with them."""
    rows = docs.where(F.coalesce(common.crc_mod("doc_id", langid.HELD_OUT) != 0, F.lit(True)))
    learned = langid.prototypes(rows)
    return langid.accepted(docs, learned, langid.least_cosines(rows, learned))


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold go."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").where(~quality.held_out())
    labels = common.read(spark, sf_dir, "labels").select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
    model = quality.learn(rows, labels)
    return quality.filtered(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (SimHash with Golay keys, see nearcopies), texts with 0.8 or more of their shingles of
    five words in common, one row stays: that with the least doc_id, null last. Different texts under one doc_id, or under
    none, are judged on their own."""
    return nearcopies.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become marks; n_chars follows."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", by_language),
    ("quality", by_quality),
    ("near_duplicates", near_duplicates),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Language, quality, fingerprints and token ids aren't expressible in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
