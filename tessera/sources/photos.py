"""A data source of photo files that reads heads: as much of a file as its metadata take, 256 KiB at first.

    spark.dataSource.register(PhotoHeads)
    spark.read.format("photo_heads").option("path", folder).load()

The folder is listed once, in planning; filters on path are applied to the listing, so that files they exclude are not
opened. Files are dealt to partitions by number. The path has to be one that pyarrow.fs knows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from ..durable import ship
from .xmp import END, START

#: Bytes that are read at first, and each time that a packet goes on; files of a partition.
HEAD_BYTES = 256 * 1024
FILES = 256
SCHEMA = "path string, length long, content binary, bytes_read long"


def wanted(data: bytes) -> int | None:
    """How many bytes of a file are needed beyond these: None if its metadata are whole. Segments of a JPEG are followed up to
    the image data; an XMP packet that has begun is read to its end."""
    begun = data.find(START)
    if begun >= 0 and data.find(END, begun) < 0:
        return len(data) + HEAD_BYTES
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xDA or marker == 0xD9:
            return None
        if marker == 0xFF or marker == 0x01 or 0xD0 <= marker <= 0xD7:  # fill bytes, markers without a body
            at += 1 if marker == 0xFF else 2
            continue
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return at + 4


def head(source, size: int, head_bytes: int = HEAD_BYTES) -> bytes:
    """The head of an open file of a known size."""
    data = source.read_at(min(size, head_bytes), 0)
    while len(data) < size:
        need = wanted(data)
        if need is None or need <= len(data):
            break
        data += source.read_at(min(size, max(need, len(data) + 4096)) - len(data), len(data))
    return data


def opened(path: str):
    """The file system of a folder, its path there, and what stands before such paths in a table."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/"), "file:"
    files, inside = fs.FileSystem.from_uri(path)
    return files, inside, path[: path.index("://") + 3]


@dataclass
class Files(InputPartition):
    found: tuple  # (path there, length)


class Heads(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.below = tuple(x for x in options.get("below", "output,excluded").split(",") if x)
        self.head_bytes, self.files = int(options.get("head_bytes", HEAD_BYTES)), int(options.get("files", FILES))
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps filters on path for the listing; the others are left to Spark."""
        for f in filters:
            of = getattr(f, "attribute", None)
            if of == ("path",) and isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)):
                self.tests.append(f)
            else:
                yield f

    def _asked(self, path: str) -> bool:
        for f in self.tests:
            if isinstance(f, EqualTo):
                ok = path == f.value
            elif isinstance(f, In):
                ok = path in f.value
            elif isinstance(f, StringStartsWith):
                ok = path.startswith(f.value)
            elif isinstance(f, StringEndsWith):
                ok = path.endswith(f.value)
            else:
                ok = f.value in path
            if not ok:
                return False
        return True

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        files, root, before = opened(self.path)
        found = []
        for f in files.get_file_info(fs.FileSelector(root, recursive=True)):
            inside = f.path.removeprefix(root).lstrip("/")
            parts = inside.split("/")
            hidden = any(p[:1] in "._" for p in parts)
            if f.type == fs.FileType.File and f.extension.lower() in ("jpg", "jpeg") and not hidden and not (len(parts) > 1 and parts[0] in self.below) and self._asked(before + f.path):
                found.append((f.path, f.size))
        found.sort()
        return [Files(tuple(found[i : i + self.files])) for i in range(0, len(found), self.files)] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _, before = opened(self.path)
        for path, size in partition.found:
            with files.open_input_file(path) as source:
                data = head(source, size, self.head_bytes)
            yield pa.RecordBatch.from_pydict({"path": [before + path], "length": [size], "content": [data], "bytes_read": [len(data)]})


class PhotoHeads(DataSource):
    """Options: path; below (folders directly in it that are left out, by comma); head_bytes; files (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "photo_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Heads(self.options)


def scan_heads(spark: SparkSession, folder: str, below: tuple[str, ...] = ("output", "excluded"), head_bytes: int = HEAD_BYTES) -> DataFrame:
    """Like files.scan_images(), with the head of each file as content; bytes_read says how much that is."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PhotoHeads)
    return spark.read.format("photo_heads").option("path", folder).option("below", ",".join(below)).option("head_bytes", head_bytes).load()
