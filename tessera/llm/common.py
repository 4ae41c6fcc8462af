"""What the operators of this subpackage share: table access, durable intermediate tables, batched Python tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..durable import materialize, release, shared_dir, ship  # noqa: F401  the first two are for the operators

#: Rows, and bytes of texts, that a Python task turns into Python objects at a time. A longer text goes alone.
SLICE_ROWS = 256
SLICE_BYTES = 1 << 20

def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def qualified(spark, path: str) -> str:
    """The path as a URI. One without a scheme is on the session's default file system, as it is for Spark."""
    if "://" in path or path.startswith("file:"):
        return path
    return spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").rstrip("/") + "/" + path.lstrip("/")


def filesystem(path: str):
    """The file system of a URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file:///" + path[5:].lstrip("/") if path.startswith("file:") else path)


def slice_ends(batch: pa.RecordBatch, rows: int, size: int = SLICE_BYTES) -> list[int]:
    """Where slices of a batch end, so that none has more than `rows` rows, or than `size` bytes unless one row has."""
    import numpy as np
    import pyarrow.compute as pc

    bytes_of = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
            bytes_of += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, ends, at = np.cumsum(bytes_of), [], 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        at = min(at + rows, max(at + 1, int(np.searchsorted(total, before + size, "right"))))
        at = min(at, batch.num_rows)
        ends.append(at)
    return ends


def map_slices(df: DataFrame, schema: str | T.StructType, start: Callable, slice_rows: int = SLICE_ROWS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Runs `start()` once per task, which returns a function from a slice (dict of lists) to a dict of lists.

    The function may have an attribute `finish`, called at the end of the task, that returns a last dict of lists.
    Batches are cut into slices, so that a task holds few Python objects whatever the size of the Arrow batches.
    """
    ship(df.sparkSession)
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            at = 0
            for end in slice_ends(batch, slice_rows, slice_bytes):
                out = work(batch.slice(at, end - at).to_pydict())
                at = end
                if out and len(next(iter(out.values()))):
                    yield pa.RecordBatch.from_pydict({k: out[k] for k in arrow.names}, schema=arrow)
        finish = getattr(work, "finish", None)
        if finish:
            out = finish()
            if out and len(next(iter(out.values()))):
                yield pa.RecordBatch.from_pydict({k: out[k] for k in arrow.names}, schema=arrow)

    return df.mapInArrow(run, schema)


def per_worker(key: str, make: Callable):
    """A value that a Python worker makes once and keeps for its later tasks."""
    import sys

    store = sys.modules.setdefault("_tessera_worker_store", type(sys)("_tessera_worker_store")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def crc_mod(doc_id, n: int):
    """crc32 of the id as decimal text, modulo n: the deal of documents to folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n
