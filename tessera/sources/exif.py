"""EXIF tags and image sizes of JPEG files, without an image library."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..durable import ship

#: Tags that the catalog uses, by number: of the base directory, of the Exif directory, of the GPS directory.
TAGS = {
    0x010F: "Make", 0x0110: "Model", 0x0132: "DateTime", 0x8769: "ExifOffset", 0x8825: "GPSInfo",
    0x9003: "DateTimeOriginal", 0x920A: "FocalLength", 0xA405: "FocalLengthIn35mmFilm",
}
GPS_TAGS = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 6: "GPSAltitude"}

WIDTHS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Markers of a JPEG file and their contents, up to the image data."""
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, (size,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
        if marker == 0xDA:
            return
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size


def directory(tiff: bytes, order: str, at: int, names: dict[int, str]) -> dict[str, str]:
    """Values of a TIFF directory's known tags as text; rational triples are joined by commas; damaged entries drop out."""
    out: dict[str, str] = {}
    try:
        (n,) = struct.unpack_from(order + "H", tiff, at)
    except struct.error:
        return out
    for i in range(n):
        try:
            tag, kind, count, inline = struct.unpack_from(order + "HHI4s", tiff, at + 2 + 12 * i)
            size = WIDTHS.get(kind, 0) * count
            if tag not in names or not size:
                continue
            raw = inline[:size] if size <= 4 else tiff[(start := struct.unpack(order + "I", inline)[0]) : start + size]
            if len(raw) < size:
                continue
            if kind == 2:
                text = raw.split(b"\0")[0].decode("utf-8", "replace").strip()
            elif kind in (5, 10):
                pairs = struct.unpack(order + ("II" if kind == 5 else "ii") * count, raw)
                text = ",".join("" if not d else repr(p / d) for p, d in zip(pairs[::2], pairs[1::2]))
            else:
                text = ",".join(map(str, struct.unpack(order + {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}[kind] * count, raw)))
            out[names[tag]] = text
        except struct.error:
            return out
    return out


def tags_of(data: bytes) -> dict[str, str]:
    """Base tags, then those of the Exif and GPS directories over them; ImageWidth and ImageHeight from the frame header."""
    out: dict[str, str] = {}
    for marker, body in segments(data):
        if marker == 0xE1 and body[:6] == b"Exif\0\0":
            tiff = body[6:]
            order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
            if order is None or len(tiff) < 8:
                continue
            base = directory(tiff, order, struct.unpack_from(order + "I", tiff, 4)[0], TAGS)
            exif, gps = base.pop("ExifOffset", ""), base.pop("GPSInfo", "")
            out |= base
            out |= directory(tiff, order, int(exif), TAGS) if exif.isdecimal() else {}
            out |= directory(tiff, order, int(gps), GPS_TAGS) if gps.isdecimal() else {}
        elif marker in (0xC0, 0xC1, 0xC2) and len(body) >= 5:
            height, width = struct.unpack_from(">HH", body, 1)
            out |= {"ImageWidth": str(width), "ImageHeight": str(height)}
    return out


def exif_tags(images: DataFrame) -> DataFrame:
    """(file_path, tags) of images(path, content); files that are no JPEG have no tags."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"file_path": batch["path"], "tags": [tags_of(bytes(c)) if c is not None else {} for c in batch["content"]]})

    ship(images.sparkSession)
    return images.select("path", "content").mapInPandas(run, "file_path string, tags map<string,string>")


def catalog(images: DataFrame) -> DataFrame:
    """The catalog of scanned images(path, content): XMP first, EXIF where it is silent."""
    from pyspark.sql import functions as F

    from .files import metadata, with_exif

    tags = exif_tags(images)
    filled = with_exif(metadata(images), tags)
    size = lambda k: F.try_element_at("tags", F.lit(k)).try_cast("int")
    return filled.join(tags, "file_path", "left").withColumns({"width": size("ImageWidth"), "height": size("ImageHeight")}).select(*filled.columns)
