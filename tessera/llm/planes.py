"""Token-id files of shuffled byte or bit planes.

A file holds the ids of consecutive documents. Ids are cut into blocks of fixed size; a block is transposed into planes
(the k-th byte, or the k-th bit, of every id), each plane is compressed with zstandard, and planes that are all zero take
no bytes. A chunk index at the end says where each plane lies, and a document index says which ids belong to whom.

    magic | planes ... | document ids | which are null | token counts | chunk index (JSON, zstandard) | length (8 bytes) | magic
"""

from __future__ import annotations

import json
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import filesystem, map_slices, qualified, shared_path, ship, slice_ends
from .wordbpe import ENCODE_BYTES, ENCODE_ROWS, encoder

MAGIC = b"TPLANES1"
BLOCK_IDS = 65_536
#: Bytes of texts that a file is planned for, and what a document counts besides, for its places in a file's lists.
FILE_BYTES = 16 << 20
DOC_BYTES = 64

MANIFEST = "file_no long, path string, n_docs long, n_tokens long, n_bytes long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, unit: str) -> np.ndarray:
    """One row per plane, lowest first. A bit plane is padded to whole bytes."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        return np.ascontiguousarray(raw.T)
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")


def from_planes(planes: np.ndarray, n: int, unit: str) -> np.ndarray:
    if unit == "byte":
        return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)
    bits = np.unpackbits(planes, axis=1, bitorder="little")[:, :n]
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").reshape(-1)


class PlaneWriter:
    """Writes one file to a stream; holds one block at a time."""

    def __init__(self, sink, unit: str = "byte", block_ids: int = BLOCK_IDS, level: int = 1):
        import zstandard

        if unit not in ("byte", "bit"):
            raise ValueError(f"unit is {unit!r}, not byte or bit")
        self.sink, self.unit, self.block_ids = sink, unit, block_ids
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.held, self.held_bytes, self.at = [], 0, 0
        self.chunks, self.docs, self.counts = [], [], []
        self._put(MAGIC)

    def _put(self, data: bytes) -> list[int]:
        self.sink.write(data)
        self.at += len(data)
        return [self.at - len(data), len(data)]

    def _block(self, raw: bytes) -> None:
        planes = to_planes(np.frombuffer(raw, "<u4"), self.unit)
        self.chunks.append([len(raw) // 4, [self._put(self.zstd.compress(p.tobytes())) if p.any() else [0, 0] for p in planes]])

    def _table(self, values: list[int], kind: str) -> list[int]:
        return self._put(self.zstd.compress(np.asarray(values, kind).tobytes()))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.held.append(ids)
        self.held_bytes += len(ids)
        size = self.block_ids * 4
        if self.held_bytes >= size:
            held = b"".join(self.held)
            whole = len(held) // size * size
            for at in range(0, whole, size):
                self._block(held[at : at + size])
            self.held, self.held_bytes = [held[whole:]], len(held) - whole

    def close(self) -> tuple[int, int, int]:
        """Documents, ids and bytes of the file."""
        if self.held_bytes:
            self._block(b"".join(self.held))
        index = {"unit": self.unit, "chunks": self.chunks, "docs": self._table([d or 0 for d in self.docs], "<i8")}
        index |= {"nulls": self._table([d is None for d in self.docs], "u1"), "counts": self._table(self.counts, "<i8")}
        _, n = self._put(self.zstd.compress(json.dumps(index).encode()))
        self._put(n.to_bytes(8, "little") + MAGIC)
        return len(self.docs), sum(self.counts), self.at


class PlaneReader:
    """Reads a file from a seekable stream, block by block."""

    def __init__(self, source):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        end = source.seek(0, 2)
        tail = self._get(end - 16, 16)
        if tail[8:] != MAGIC or self._get(0, 8) != MAGIC:
            raise ValueError("not a file of id planes")
        n = int.from_bytes(tail[:8], "little")
        self.index = json.loads(self.zstd.decompress(self._get(end - 16 - n, n)))

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def table(self, name: str, kind: str = "<i8") -> list[int]:
        return np.frombuffer(self.zstd.decompress(self._get(*self.index[name])), kind).tolist()

    def blocks(self):
        unit = self.index["unit"]
        for n, planes in self.index["chunks"]:
            width = n if unit == "byte" else (n + 7) // 8
            rows = [np.frombuffer(self.zstd.decompress(self._get(at, size)), np.uint8) if size else np.zeros(width, np.uint8) for at, size in planes]
            yield from_planes(np.stack(rows), n, unit)

    def documents(self):
        """doc_id, first id's place in the file, number of ids, and the ids as a list of arrays."""
        blocks, held = self.blocks(), np.zeros(0, "<u4")
        start = 0
        for doc, null, n in zip(self.table("docs"), self.table("nulls", "u1"), self.table("counts"), strict=True):
            parts, need = [], n
            while need:
                if not len(held):
                    held = next(blocks)
                parts.append(held[:need])
                held = held[need:]
                need -= len(parts[-1])
            yield None if null else doc, start, n, parts
            start += n


def in_id_order(docs: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Deals documents to consecutive ranges of doc_id, one per partition, each sorted; a null doc_id comes first.

    Rows with one doc_id are told apart by their texts, and equal rows by their places in the input, so that rows of one id
    can lie in several ranges. Equal rows have equal ids, so it does not matter which of them is where.
    """
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + DOC_BYTES)).first()[0] or 0
    files = max(1, math.ceil(size / file_bytes))
    keyed = docs.withColumn("_text", F.xxhash64("text")).withColumn("_at", F.monotonically_increasing_id())
    return keyed.repartitionByRange(files, "doc_id", "_text", "_at").sortWithinPartitions("doc_id", "_text", "_at").drop("_text", "_at")


def write_planes(docs: DataFrame, path: str, unit: str = "byte", tokenizer: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encodes documents(doc_id, text), writes files under path in ascending doc_id order, and returns the manifest.

    path must be one that every executor reaches. A retried task writes the same bytes under the same name: a file is
    written beside its place and moved there when it is whole.
    """
    ship(docs.sparkSession)
    schema = T.StructType.fromDDL(MANIFEST)
    arrow = to_arrow_schema(schema)
    spark = docs.sparkSession
    path = qualified(spark, path)

    def run(batches):
        context = TaskContext.get()
        number = context.partitionId()
        enc, writer, store = encoder(tokenizer), None, None
        for batch in batches:
            at = 0
            for end in slice_ends(batch, ENCODE_ROWS, ENCODE_BYTES):
                rows = batch.slice(at, end - at).to_pydict()
                at = end
                if writer is None:
                    files, folder = filesystem(path)
                    files.create_dir(folder, recursive=True)
                    name = f"{folder}/ids-{number:07d}.planes"
                    beside = f"{name}.{context.taskAttemptId()}"
                    store = files.open_output_stream(beside, compression=None)
                    writer = PlaneWriter(store, unit)
                ids, ends = enc.encode_many(rows["text"])
                for i, doc in enumerate(rows["doc_id"]):
                    writer.add(doc, ids[ends[i] : ends[i + 1]].astype("<u4", copy=False).tobytes())
        if writer is not None:
            docs_n, tokens, size = writer.close()
            store.close()
            files.move(beside, name)
            yield pa.RecordBatch.from_pydict({"file_no": [number], "path": [f"{path}/ids-{number:07d}.planes"], "n_docs": [docs_n], "n_tokens": [tokens], "n_bytes": [size]}, schema=arrow)

    ordered = in_id_order(docs.select(F.col("doc_id").cast("long"), "text"), file_bytes)
    manifest = ordered.select("doc_id", "text").mapInArrow(run, schema)
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.schema(schema).parquet(f"{path}/manifest")


def read_planes(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: its first id's place among all ids, its number of ids, and their crc32.

    The manifest has a row per file, so the running sum over it stays small.
    """
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    files = max(1, manifest.count())

    def start():
        def work(rows):
            out = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32")}
            for path, base in zip(rows["path"], rows["base"], strict=True):
                store, name = filesystem(path)
                with store.open_input_file(name) as f:
                    for doc, at, n, parts in PlaneReader(f).documents():
                        crc = 0
                        for p in parts:
                            crc = zlib.crc32(np.ascontiguousarray(p, "<u4"), crc)
                        out["doc_id"].append(doc)
                        out["start"].append(base + at)
                        out["n_tokens"].append(n)
                        out["ids_crc32"].append(crc)
            return out

        return work

    return map_slices(placed.select("path", "base").repartition(files), READ, start, slice_rows=1)


def op6_bit_planes(spark, sf_dir: str) -> DataFrame:
    """Null and empty texts are one end id; repeated rows follow each other; an empty table gives no files and no rows."""
    from .common import read

    return read_planes(write_planes(read(spark, sf_dir, "documents"), shared_path(spark, "planes")))
