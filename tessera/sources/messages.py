"""Message streams: flattened samples, transfer logs, paced replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def valid_samples(samples: DataFrame, valid: str = "valid") -> DataFrame:
    return samples.where(F.coalesce(F.col(valid), F.lit(False))).drop(valid)


def optional(samples: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Fields that a has_ flag guards: null where it is not set. The flags go."""
    return samples.withColumns({f: F.when(F.col(f"has_{f}"), F.col(f)) for f in fields}).drop(*(f"has_{f}" for f in fields))


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream of message files; bridges from other transports write such files or a Kafka topic."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def once(messages: DataFrame, keys: list[str], event_time: str, late: str = "1 hour") -> DataFrame:
    """Each message once, as transports deliver at least once; on streams within the watermark."""
    return messages.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys) if messages.isStreaming else messages.dropDuplicates(keys)


def replay(tags: DataFrame, start_ms: Column) -> DataFrame:
    """When each tag is due if playback starts at start_ms, and how long after the tag before."""
    order = Window.partitionBy("path").orderBy("tag_no")
    return tags.withColumns({"due_ms": start_ms + F.col("timestamp_ms"), "wait_ms": F.greatest(F.lit(0), F.col("timestamp_ms") - F.coalesce(F.lag("timestamp_ms").over(order), F.lit(0)))})


def transfer_message(lines: DataFrame, exits: DataFrame, key: str = "transfer_id") -> DataFrame:
    """(key, exit_code, message): "cancelled by user", nothing after success, else the last refused permission, else the last
    line. lines(key, line_no, value) without empty ones; exits(key, cancelled, exit_code)."""
    some = lines.where(F.col("value") != "")
    refused = F.when(F.col("value").contains("Permission denied"), F.col("value"))
    last = some.groupBy(key).agg(F.max_by("value", "line_no").alias("last"), F.max_by(refused, F.when(refused.isNotNull(), F.col("line_no"))).alias("refused"))
    message = F.when(F.col("cancelled"), "cancelled by user").when(F.col("exit_code") == 0, "").otherwise(F.coalesce("refused", "last", F.lit("")))
    return exits.join(last, key, "left").select(key, "exit_code", message.alias("message"))
