"""Streams whose state has timers: job folds, resends, worker liveness, packets back in order.

Each is a stateful processor over a key, on event time with a watermark, with a batch form that gives the same rows from the
whole table. State lies in the RocksDB store (with_rocksdb()), so that it may be larger than memory, and state that nothing
asks for any more is cleared by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..durable import materialize, ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that these streams need, for queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _run(events: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    ship(events.sparkSession)
    with_rocksdb(events.sparkSession)
    return events.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode="EventTime")


def _ms(times: pd.Series) -> list[int]:
    return (times.astype("datetime64[us]").astype("int64") // 1000).tolist()


def _frame(rows: list[tuple], names: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[n.split()[0] for n in names.split(", ")])


def watermarked(events: DataFrame, at_ms: str, late: str = "10 seconds") -> DataFrame:
    """events with event_time from a column of milliseconds, and a watermark."""
    return events.withColumn("event_time", F.timestamp_millis(F.col(at_ms))).withWatermark("event_time", late)


LIVENESS = "worker_id string, at_ms long, online boolean"


class Liveness(StatefulProcessor):
    """A worker's last heartbeat; a timer goes off when it is too old."""

    def __init__(self, alive_ms: int):
        self.alive_ms = alive_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        times = sorted(t for part in rows for t in _ms(part["event_time"]))
        last = self.last.get()[0] if self.last.exists() else None
        for at in times:
            if last is None or at - last > self.alive_ms:
                if last is not None:
                    out.append((key[0], last + self.alive_ms, False))
                out.append((key[0], at, True))
            last = at if last is None else max(last, at)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.last.update((last,))
        self.handle.registerTimer(max(last + self.alive_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield _frame(out, LIVENESS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield _frame([(key[0], last + self.alive_ms, False)], LIVENESS)

    def close(self) -> None:
        pass


def liveness_stream(heartbeats: DataFrame, alive_ms: int = 15_000) -> DataFrame:
    """Changes of workers: (worker_id, at_ms, online), online with the first heartbeat after a silence, offline alive_ms after
    the last one before it. heartbeats(worker_id, event_time) with a watermark. A worker that is offline has no state."""
    return _run(heartbeats.select("worker_id", "event_time"), "worker_id", Liveness(alive_ms), LIVENESS, "append")


def liveness_changes(heartbeats: DataFrame, until_ms: int, alive_ms: int = 15_000) -> DataFrame:
    """Batch form on heartbeats(worker_id, at_ms): the changes up to a time."""
    order = Window.partitionBy("worker_id").orderBy("at_ms")
    near = heartbeats.where("worker_id IS NOT NULL AND at_ms IS NOT NULL").select("worker_id", "at_ms").distinct()
    near = near.withColumn("before", F.lag("at_ms").over(order)).withColumn("after", F.lead("at_ms").over(order))
    back = near.where(F.col("before").isNull() | (F.col("at_ms") - F.col("before") > alive_ms)).select("worker_id", "at_ms", F.lit(True).alias("online"))
    gone = near.where(F.col("after").isNull() | (F.col("after") - F.col("at_ms") > alive_ms)).select("worker_id", (F.col("at_ms") + alive_ms).alias("at_ms"), F.lit(False).alias("online"))
    return back.unionByName(gone.where(F.col("at_ms") < until_ms))


SENDS = "archive_id long, attempt int, at_ms long, outcome string"


class Dispatch(StatefulProcessor):
    """A request is sent, and sent again after each wait without a response; after the last wait it has failed."""

    def __init__(self, retry_ms: int, most: int, keep_ms: int):
        self.retry_ms, self.most, self.keep_ms = retry_ms, most, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("request", "asked long, heard long, sent int, over boolean")

    def _due(self, key, asked, heard, sent, now):
        """Sends and the outcome up to a time; what follows then."""
        out, end = [], asked + self.most * self.retry_ms
        stop = min(now, heard if heard is not None else now)
        while sent < self.most and asked + sent * self.retry_ms <= stop:
            out.append((key[0], sent + 1, asked + sent * self.retry_ms, "sent"))
            sent += 1
        if heard is not None and heard < end and heard <= now:
            return [*out, (key[0], sent, heard, "answered")], sent, True
        if now >= end:
            return [*out, (key[0], self.most, end, "failed")], sent, True
        return out, sent, False

    def _step(self, key, asked, heard, sent, over, now):
        out = []
        if asked is not None and not over:
            out, sent, over = self._due(key, asked, heard, sent, now)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.state.update((asked, heard, sent, over))
        if over:
            self.handle.registerTimer(max(asked + self.most * self.retry_ms + self.keep_ms, now + 1))
        elif asked is not None:
            times = [asked + sent * self.retry_ms, *([heard] if heard is not None else [])]
            self.handle.registerTimer(max(min(times), now + 1))
        return _frame(out, SENDS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked, heard, sent, over = self.state.get() if self.state.exists() else (None, None, 0, False)
        for part in rows:
            for kind, at in sorted(zip(part["kind"], _ms(part["event_time"]), strict=True), key=lambda r: r[1]):
                if over:
                    continue
                if kind == "dispatch_requested":
                    asked = at if asked is None else min(asked, at)
                elif kind in ("dispatched", "dispatch_failed") and asked is not None and at >= asked:
                    heard = at if heard is None else min(heard, at)
        yield self._step(key, asked, heard, sent, over, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        asked, heard, sent, over = self.state.get()
        if over:
            self.state.clear()
            yield _frame([], SENDS)
        else:
            yield self._step(key, asked, heard, sent, over, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def dispatch_sends_stream(events: DataFrame, retry_ms: int = 2000, most: int = 3, keep_ms: int = 60_000) -> DataFrame:
    """What is sent when, and how it ends: (archive_id, attempt, at_ms, outcome of sent, answered, failed), as the watermark
    reaches it. events(archive_id, kind, event_time) with a watermark. A finished job is remembered for keep_ms, so that a
    request that comes again does not start it anew."""
    return _run(events.select("archive_id", "kind", "event_time"), "archive_id", Dispatch(retry_ms, most, keep_ms), SENDS, "append")


def dispatch_sends(events: DataFrame, until_ms: int, retry_ms: int = 2000, most: int = 3) -> DataFrame:
    """Batch form on events(archive_id, kind, at_ms): what is due up to a time."""
    asked = events.where("kind = 'dispatch_requested'").groupBy("archive_id").agg(F.min("at_ms").alias("asked"))
    heard = events.where("kind IN ('dispatched', 'dispatch_failed')").join(asked, "archive_id").where("at_ms >= asked").groupBy("archive_id").agg(F.min("at_ms").alias("heard"))
    job = asked.join(heard, "archive_id", "left").withColumn("end", F.col("asked") + retry_ms * most)
    answered = F.coalesce((F.col("heard") < F.col("end")) & (F.col("heard") <= until_ms), F.lit(False))
    stop = F.least(F.lit(until_ms), F.coalesce("heard", F.lit(until_ms)))
    each = job.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("at_ms", F.col("asked") + (F.col("attempt") - 1) * retry_ms).where(F.col("at_ms") <= stop)
    sent = each.select("archive_id", "attempt", "at_ms", F.lit("sent").alias("outcome"))
    tries = F.least(F.floor((F.col("heard") - F.col("asked")) / retry_ms) + 1, F.lit(most)).cast("int")
    ends = job.select("archive_id", F.when(answered, tries).otherwise(most).alias("attempt"), F.when(answered, F.col("heard")).otherwise(F.col("end")).alias("at_ms"), F.when(answered, "answered").otherwise("failed").alias("outcome"))
    return sent.unionByName(ends.where(F.col("at_ms") <= until_ms))


ORDERED = "stream_id string, sequence_id long, at_ms long, lost long"


class Reorder(StatefulProcessor):
    """Packets wait for those before them, wait_ms at most from the first one that waits."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "sequence_id long")
        self.held = handle.getMapState("held", "sequence_id long", "at long")

    def _release(self, key, now):
        held = {k[0]: v[0] for k, v in self.held.iterator()}
        following = self.next.get()[0] if self.next.exists() else None
        out, due = [], None
        order = sorted(held)
        # The earliest of those that are still held, from each place on.
        first = [min(held[s] for s in order)] if order else []
        if following is None and order:
            due = first[0] + self.wait_ms
            if now < due:
                order = []
            else:
                following, due = min(s for s in order if held[s] <= due), None
                for s in [s for s in order if s < following]:
                    self.held.removeKey((s,))
                order = [s for s in order if s >= following]
        earliest, at = [], None
        for s in reversed(order):
            earliest.append(at)
            at = held[s] if at is None else min(at, held[s])
        begin = following
        for s, later in zip(order, reversed(earliest), strict=True):
            if s != following:
                due = min(held[s], later if later is not None else held[s]) + self.wait_ms
                if now < due:
                    break
                due = None
            if later is not None and held[s] > later + self.wait_ms:
                self.held.removeKey((s,))  # it came when those behind it had waited long enough: lost
                continue
            out.append((key[0], s, held[s], s - following))
            following = s + 1
            self.held.removeKey((s,))
        if following is not None and following != begin or (begin is not None and not self.next.exists()):
            self.next.update((following,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if due is not None:
            self.handle.registerTimer(max(due, now + 1))
        return _frame(out, ORDERED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        following = self.next.get()[0] if self.next.exists() else None
        for part in rows:
            for s, at in zip(part["sequence_id"].tolist(), _ms(part["event_time"]), strict=True):
                if following is not None and s < following:
                    continue  # repeated, or too late
                before = self.held.getValue((s,))[0] if self.held.containsKey((s,)) else None
                self.held.updateValue((s,), (at if before is None else min(before, at),))
        yield self._release(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._release(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def reordered_stream(packets: DataFrame, wait_ms: int = 2000) -> DataFrame:
    """Packets of each stream in sequence order, each once: (stream_id, sequence_id, at_ms, lost), lost being how many numbers
    before it are missing for good. packets(stream_id, sequence_id, event_time) with a watermark.

    A packet is in time if it is at most wait_ms later than every packet behind it; a stream begins with the least number
    that is in time with its first packet. State is what waits, and one number per stream.
    """
    return _run(packets.select("stream_id", "sequence_id", "event_time"), "stream_id", Reorder(wait_ms), ORDERED, "append")


def reordered(packets: DataFrame, wait_ms: int = 2000) -> DataFrame:
    """Batch form on packets(stream_id, sequence_id, at_ms).

    Rows are dealt by ranges of (stream, number), so that a long stream is many tasks'. What a packet has to know of others is
    the earliest time behind it and the last kept number before it: within its range by a window that goes one way, so that
    each row is looked at once, and beyond it from a short table of ranges.
    """
    once = packets.where("stream_id IS NOT NULL AND sequence_id IS NOT NULL AND at_ms IS NOT NULL").groupBy("stream_id", "sequence_id").agg(F.min("at_ms").alias("at_ms"))
    dealt = materialize(once.repartitionByRange("stream_id", "sequence_id").withColumn("_range", F.spark_partition_id()), "packet-ranges")
    back = Window.partitionBy("stream_id", "_range").orderBy(F.desc("sequence_id")).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("stream_id").orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("stream_id", "_range").agg(F.min("at_ms").alias("_least"))
    ranges = ranges.select("stream_id", "_range", F.min("_least").over(behind).alias("_later"), F.min("_least").over(Window.partitionBy("stream_id")).alias("begin"))
    later = F.least(F.min("at_ms").over(back), "_later")
    in_time = dealt.join(ranges, ["stream_id", "_range"]).withColumn("later", later).where(F.col("later").isNull() | (F.col("at_ms") <= F.col("later") + wait_ms))
    in_time = materialize(in_time.select("stream_id", "_range", "sequence_id", "at_ms", "begin"), "packets-in-time")
    first = in_time.where(F.col("at_ms") <= F.col("begin") + wait_ms).groupBy("stream_id").agg(F.min("sequence_id").alias("first"))
    kept = in_time.join(first, "stream_id").where("sequence_id >= first")
    before = Window.partitionBy("stream_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = kept.groupBy("stream_id", "_range").agg(F.max("sequence_id").alias("_end")).select("stream_id", "_range", F.max("_end").over(before).alias("_end"))
    near = F.coalesce(F.lag("sequence_id").over(Window.partitionBy("stream_id", "_range").orderBy("sequence_id")), "_end")
    lost = F.coalesce(F.col("sequence_id") - near - 1, F.lit(0)).cast("long")
    return kept.join(ends, ["stream_id", "_range"]).select("stream_id", "sequence_id", "at_ms", lost.alias("lost"))
