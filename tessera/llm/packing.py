"""Packing of documents into training sequences by minimum bin slack.

A document's ids, with the end id, are cut into windows of the sequence length; the last, shorter piece of each document
is packed with those of other documents. A window opens with the longest piece left, and a subset-sum dynamic program
over bitsets finds the multiset of remaining lengths that comes closest to the window's capacity; the counts of each
length are then read back along the bitsets.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_slices, materialize, ship
from .wordbpe import ENCODE_BYTES, ENCODE_ROWS, encoder

CAPACITY = 2048
#: Pieces that are packed together. Shards are dealt out evenly, so no key decides how large one gets.
SHARD_PIECES = 8192

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECE + ", sequence_id long, offset long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of each document: full windows first, then the rest. A null text is an empty document of one end id."""

    def start():
        enc = encoder(tokenizer)

        def work(rows):
            ids, ends = enc.encode_many(rows["text"])
            view, tokens = memoryview(ids.astype("<u4", copy=False)).cast("B"), np.diff(ends)
            parts = -(-tokens // capacity)
            doc = np.repeat(np.arange(len(tokens)), parts)
            at = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * capacity
            length = np.minimum(capacity, tokens[doc] - at)
            begin = (ends[doc] + at) * 4
            crc = [zlib.crc32(view[a:b]) for a, b in zip(begin.tolist(), (begin + length * 4).tolist(), strict=True)]
            return {"doc_id": [rows["doc_id"][i] for i in doc.tolist()], "start": at, "length": length, "ids_crc32": crc, "doc_tokens": tokens[doc]}

        return work

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), PIECE, start, ENCODE_ROWS, ENCODE_BYTES)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length fill `room` closest to full. counts: pieces left by length."""
    reach, steps, full = 1, [], 1 << room
    for length in sorted((n for n, k in counts.items() if k and n <= room), reverse=True):
        most = min(counts[length], room // length)
        after, left, step = reach, most, 1
        while left:  # binary splitting: shifts by 1, 2, 4, ... pieces reach every count up to `most`
            take = min(step, left)
            after |= after << (take * length)
            left, step = left - take, step * 2
        after &= (full << 1) - 1
        if after != reach:
            steps.append((length, most, reach))
            reach = after
        if reach & full:
            break
    left, chosen = reach.bit_length() - 1, {}
    for length, most, before in reversed(steps):
        used = next(k for k in range(most + 1) if left >= k * length and before >> (left - k * length) & 1)
        if used:
            chosen[length] = used
            left -= used * length
    return chosen


def minimum_bin_slack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows as lists of indices into lengths; each length is between 1 and the capacity."""
    where: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        where.setdefault(lengths[i], []).append(i)
    counts = {n: len(x) for n, x in where.items()}
    out = []
    for longest in sorted(counts, reverse=True):
        while counts[longest]:
            counts[longest] -= 1
            window = [where[longest].pop()]
            if longest < capacity:
                for length, used in fill(counts, capacity - longest).items():
                    counts[length] -= used
                    window += [where[length].pop() for _ in range(used)]
            out.append(window)
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Gives each piece its sequence and its offset there. cut: a materialised result of pieces(), as it is counted first."""
    ship(cut.sparkSession)
    shards = max(1, math.ceil(cut.count() / shard_pieces))
    schema = T.StructType.fromDDL(PACKED)
    arrow = to_arrow_schema(schema)

    def run(batches):
        shard = TaskContext.get().partitionId()
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches).sort_by([("doc_id", "ascending"), ("start", "ascending")])
        windows = minimum_bin_slack(table.column("length").to_pylist(), capacity)
        lengths = table.column("length").to_pylist()
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for k, window in enumerate(windows):
            at = 0
            for i in window:
                sequence[i], offset[i] = (shard << 32) + k, at
                at += lengths[i]
        table = table.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
        yield from table.select(arrow.names).cast(arrow).to_batches(max_chunksize=10_000)

    return cut.repartition(shards).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Sequences of documents(doc_id, text).

    Null and empty texts are one end id; repeated rows are packed as often as they occur; other columns are left out; an
    empty table gives no rows; ties between equal lengths go by doc_id and start within a shard. A window is
    as full as its longest piece and the rest of its shard allow: padding is what lengths force (pieces of 1,025 ids leave half
    of each window), and what the last windows of a shard lack.
    """
    return pack(materialize(pieces(docs, capacity, tokenizer), "pieces"), capacity)


def op5_min_bin_slack(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return pack_documents(read(spark, sf_dir, "documents"))
