"""Streams with timers give their batch forms' rows, also after a restart from the checkpoint."""

import os
import random

import pytest

from tessera.streaming import states

HEARTBEATS = "worker_id string, at_ms long"
JOBS = "archive_id long, kind string, at_ms long"
PACKETS = "stream_id string, sequence_id long, at_ms long"
END = 10_000_000


def put(spark, path, number, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").json(f"{path}/in-{number}")
    os.makedirs(f"{path}/in", exist_ok=True)
    (part,) = [f for f in os.listdir(f"{path}/in-{number}") if f.startswith("part-")]
    os.rename(f"{path}/in-{number}/{part}", f"{path}/in/{number:03d}.json")


def streamed(spark, path, batches, schema, make):
    """Rows of a stream that reads one file after the other; each time the query is started anew from its checkpoint."""
    out = []
    for number, rows in enumerate(batches):
        put(spark, path, number, rows, schema)
        events = states.watermarked(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{path}/in"), "at_ms", "1 second")
        query = make(events).writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
    return out


@pytest.fixture
def few(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def batches_of(rows, at, size, seed):
    """Rows in the order of time, a little shuffled, in batches, and one far later row that moves the watermark."""
    draw = random.Random(seed)
    order = sorted(rows, key=lambda r: r[at] + draw.uniform(0, 400))
    return [order[i : i + size] for i in range(0, len(order), size)]


def test_liveness(few, tmp_path):
    draw = random.Random(1)
    rows = [(f"w{w}", t) for w in range(4) for t in sorted(draw.sample(range(0, 200_000), 14))]
    rows += [("end", END)]
    got = streamed(few, str(tmp_path), [*batches_of(rows[:-1], 1, 29, 1), rows[-1:]], HEARTBEATS, lambda e: states.liveness_stream(e, 15_000))
    want = states.liveness_changes(few.createDataFrame(rows, HEARTBEATS), END - 1000, 15_000)
    assert sorted(got) == sorted(tuple(r) for r in want.collect()) and any(not r[2] for r in got)
    held = few.read.format("statestore").option("stateVarName", "last").load(f"file://{tmp_path}/state")
    assert {r["key"]["worker_id"] for r in held.collect()} == {"end"}, "workers that are offline are to have no state"


def test_dispatch(few, tmp_path):
    rows = [(1, "dispatch_requested", 1000), (2, "dispatch_requested", 1500), (2, "dispatched", 4700), (3, "dispatch_requested", 2000), (3, "dispatch_failed", 2000), (4, "dispatch_requested", 3000), (4, "dispatched", 9000), (2, "dispatch_requested", 1700), (5, "dispatched", 100), (5, "dispatch_requested", 5000)]
    end = [(9, "other", END)]
    rows.sort(key=lambda r: r[2])
    got = streamed(few, str(tmp_path), [rows[:4], rows[4:8], rows[8:], end], JOBS, states.dispatch_sends_stream)
    want = states.dispatch_sends(few.createDataFrame(rows + end, JOBS), END - 1000)
    assert sorted(got) == sorted(tuple(r) for r in want.collect())
    assert {(r[0], r[3]): r[1] for r in got if r[3] != "sent"} == {(1, "failed"): 3, (2, "answered"): 2, (3, "answered"): 1, (4, "failed"): 3, (5, "failed"): 3}


def test_reordered(few, tmp_path):
    draw = random.Random(2)
    rows = []
    for s in ("a", "b"):
        for n in range(5, 60):
            if draw.random() < 0.85:
                rows.append((s, n, n * 100 + draw.randrange(0, 900)))
                if draw.random() < 0.1:
                    rows.append((s, n, n * 100 + 950))
    rows += [("a", 20, 99_000), ("b", 3, 50_000)]  # too late
    end = [("end", 1, END)]
    got = streamed(few, str(tmp_path), [*batches_of(rows, 2, 40, 3), end], PACKETS, lambda e: states.reordered_stream(e, 1000))
    want = states.reordered(few.createDataFrame(rows + end, PACKETS), 1000).where("stream_id <> 'end'")
    assert sorted(got) == sorted(tuple(r) for r in want.collect()) and any(r[3] for r in got)
    for s in ("a", "b"):
        numbers = [r[1] for r in got if r[0] == s]
        assert numbers == sorted(set(numbers))
