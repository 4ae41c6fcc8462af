"""Frame streams: throttle, frame numbers, batch triggers, sensor joins, packet loss. Batch and streaming forms agree."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..durable import shared_dir
from ..operators.numbering import numbered
from ..operators.sequence import keep_spaced

FRAMES = "stream_id string, frame_id long, at_s double, frame_no long"


def throttle(frames: DataFrame, interval_s: float = 1.0) -> DataFrame:
    """Batch form: frames(stream_id, frame_id, at_s) at least interval_s after the last kept one, with their number from 0."""
    kept = keep_spaced(frames.select("stream_id", "frame_id", "at_s"), interval_s, "stream_id", ["at_s", "frame_id"], ("at_s",))
    return numbered(kept, ["stream_id"], ["at_s", "frame_id"], "frame_no").withColumn("frame_no", (F.col("frame_no") - 1).cast("long"))


def throttle_stream(frames: DataFrame, interval_s: float = 1.0) -> DataFrame:
    """Streaming form. The state of a stream is when it last kept a frame and how many it kept; rows of a micro-batch are
    taken by time, and a row older than the last kept one is dropped, as it would be too close."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["at_s", "frame_id"])
        out = []
        for frame, at in zip(rows["frame_id"].tolist(), rows["at_s"].tolist(), strict=True):
            if last is None or at - last >= interval_s:
                out.append((key[0], frame, at, n))
                last, n = at, n + 1
        state.update((last, n))
        yield pd.DataFrame(out, columns=["stream_id", "frame_id", "at_s", "frame_no"])

    return frames.select("stream_id", "frame_id", "at_s").groupBy("stream_id").applyInPandasWithState(step, FRAMES, "last double, n long", "append", GroupStateTimeout.NoTimeout)


def batch_ends(kept: DataFrame, every: int = 10) -> DataFrame:
    """The frames that end a batch and set off its extraction: numbers every - 1, 2 * every - 1, ..."""
    return kept.where((F.col("frame_no") > 0) & ((F.col("frame_no") + 1) % every == 0))


#: Seconds of frames that lie in one partition of their table.
DAY_S = 86_400


def extract_increment(kept: DataFrame, path: str, key: tuple[str, ...] = ("stream_id", "frame_id"), at: str = "at_s") -> int:
    """Appends the frames that a table does not have yet, and returns how many: running it again adds nothing.

    As a foreachBatch function this makes an at-least-once stream write each key once, whenever it comes again; of rows with
    one key any one is written. The table is partitioned by day for its readers. To see what is there, only key columns are
    read, and by their statistics only the row groups that may hold keys between the least and the greatest new one.
    """
    spark = kept.sparkSession
    new = kept.dropDuplicates(list(key)).withColumn("day", F.floor(F.col(at) / DAY_S).cast("long"))
    try:
        there = spark.read.parquet(path).select(*key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = None
    if there is not None:
        bounds = kept.agg(*(f(c).alias(f"{n}_{c}") for c in key for n, f in (("lo", F.min), ("hi", F.max)))).first()
        same = F.lit(True)
        for c in key:
            there = there.where(F.col(c).isNull() | F.col(c).between(F.lit(bounds[f"lo_{c}"]), F.lit(bounds[f"hi_{c}"])))
            same = same & F.col(f"new.{c}").eqNullSafe(F.col(f"there.{c}"))
        new = new.alias("new").join(there.alias("there"), same, "left_anti")
    n = new.count()
    if n:
        new.write.mode("append").partitionBy("day").parquet(path)
    return n


def write_frames(stream: DataFrame, path: str, name: str = "frames"):
    """Starts a query that writes a stream of kept frames once each."""
    at = f"{shared_dir(stream.sparkSession)}/stream-{name}"
    return stream.writeStream.option("checkpointLocation", at).foreachBatch(lambda df, _: extract_increment(df, path)).start()


def sequence_gaps(packets: DataFrame, stream: str = "stream_id", sequence: str = "sequence_id", at: str = "at_s") -> DataFrame:
    """Packets in arrival order whose sequence number does not follow the one before: lost is how many are missing,
    reordered whether it went back."""
    order = Window.partitionBy(stream).orderBy(at, sequence)
    step = F.col(sequence) - F.lag(sequence).over(order)
    return packets.withColumn("step", step).where(F.col("step") != 1).select(stream, sequence, F.greatest(F.col("step") - 1, F.lit(0)).alias("lost"), (F.col("step") < 1).alias("reordered"))


def sensor_join(frames: DataFrame, sensors: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Frames with the sensor row of the same stream, frame and time; on streams, watermarks let old state go.

    frames(stream_id, frame_id, event_time, ...), sensors likewise.
    """
    on = ["stream_id", "frame_id", "event_time"]
    if frames.isStreaming:
        frames = frames.withWatermark("event_time", late)
    if sensors.isStreaming:
        sensors = sensors.withWatermark("event_time", late)
    return frames.join(sensors, on)
