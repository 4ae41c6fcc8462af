"""The source that reads heads: rows of the whole-file scan, from a small part of the bytes."""

import struct

from pyspark.sql import functions as F

from tessera.sources import exif, files, photos


def segment(marker, body):
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body


def photo(lat, before=0, image=3_000_000, frame_at_end=False):
    """A JPEG with an XMP packet behind `before` bytes of other segments, a frame header and image data."""
    xmp = f'<x:xmpmeta xmlns:x="x" xmlns:d="d"><Description d:Model="M" d:GpsLatitude="{lat}" d:GpsLongtitude="{lat}"/></x:xmpmeta>'.encode()
    other = b"".join(segment(0xE2, bytes(60_000)) for _ in range(before // 60_000))
    frame = segment(0xC0, struct.pack(">BHHB", 8, 300, 400, 1) + bytes(3))
    return b"\xff\xd8" + other + segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + xmp) + frame + segment(0xDA, bytes(10)) + bytes(image)


def test_heads(spark, tmp_path):
    made = {"a/one.JPG": photo(1.5), "a/b/two.jpeg": photo(2.5, before=900_000), "three.jpg": photo(3.5, image=10), "output/four.jpg": photo(4.5), "a/output/five.jpg": photo(5.5), "six.png": b"x", "seven.jpg": b"", "eight.jpg": b"no photo" * 100_000, "nine.jpg": photo(9.5)[:300]}
    for name, data in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    folder = f"file:{tmp_path}"
    heads = photos.scan_heads(spark, folder)
    whole = files.scan_images(spark, folder)
    rows = lambda df: sorted(map(repr, exif.catalog(df).collect()))
    assert rows(heads.where("length > 0")) == rows(whole.where("length > 0")) and heads.count() == 7
    read = {r["path"].rsplit("/", 1)[1]: r["bytes_read"] for r in heads.collect()}
    assert read["one.JPG"] == read["five.jpg"] == photos.HEAD_BYTES and 900_000 < read["two.jpeg"] < 1_200_000
    assert read["eight.jpg"] == photos.HEAD_BYTES and read["seven.jpg"] == 0
    assert sum(read.values()) < 0.3 * sum(len(d) for d in made.values())


def test_filters_on_path_keep_files_closed(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"p{i}.jpg").write_bytes(photo(float(i)))
    heads = photos.scan_heads(spark, f"file:{tmp_path}")
    some = heads.where(F.col("path").endswith("p3.jpg") & (F.col("length") > 5))
    assert [r["path"] for r in some.select("path").collect()] == [f"file:{tmp_path}/p3.jpg"]
    reader = photos.Heads({"path": f"file:{tmp_path}", "files": "2"})
    assert [len(p.found) for p in reader.partitions()] == [2, 2, 2]
    left = list(reader.pushFilters([photos.StringEndsWith(("path",), "p3.jpg"), photos.EqualTo(("length",), 5)]))
    assert len(left) == 1 and [p[0].rsplit("/", 1)[1] for part in reader.partitions() for p in part.found] == ["p3.jpg"]
    assert photos.scan_heads(spark, f"file:{tmp_path}").where("path = 'none'").count() == 0


def test_a_packet_that_goes_on(spark):
    """Packets are read to their end, however long."""

    class Source:
        def __init__(self, data):
            self.data = data

        def read_at(self, n, at):
            return self.data[at : at + n]

    long = b"<x:xmpmeta>" + b"." * 700_000 + b"</x:xmpmeta>" + bytes(5_000_000)
    got = photos.head(Source(long), len(long))
    assert got.endswith(bytes(10)) and b"</x:xmpmeta>" in got and len(got) < 1_100_000
    cut = b"<x:xmpmeta>" + b"." * 300_000
    assert photos.head(Source(cut), len(cut)) == cut
