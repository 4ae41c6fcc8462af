"""Sources: photo folders, metadata, settings, listings, JSON files, packets; and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..durable import ship
from ..functions import geo, text
from .xmp import xmp_attributes


def scan_images(spark: SparkSession, folder: str, below: tuple[str, ...] = ("output", "excluded")) -> DataFrame:
    """path, length and content of the JPEG files under a folder, but for the named folders directly in it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[jJ][pP]*[gG]").load(folder)
    name = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    inside = F.regexp_extract("path", r"^(?:file:)?/*(.*)$", 1)
    root = "/".join(x for x in folder.removeprefix("file:").split("/") if x)
    pruned = F.lit(False)
    for b in below:
        pruned = pruned | inside.startswith(f"{root}/{b}/")
    return found.where(name.isin("jpg", "jpeg") & ~pruned).select("path", "length", "content")


def flat_listing(paths: DataFrame, folder: str) -> DataFrame:
    """Distinct *.jpg and *.jpeg directly in a folder."""
    name = F.substring_index("path", "/", -1)
    direct = F.col("path") == F.concat(F.lit(folder.rstrip("/") + "/"), name)
    return paths.where(direct & F.lower(name).rlike(r"\.jpe?g$")).select("path").distinct()


def direction_folders(paths: DataFrame, direction: Column) -> DataFrame:
    """Known directions among parent folders that hold at least one file."""
    return paths.select(direction.alias("direction")).where(F.col("direction").isNotNull()).distinct()


def metadata(images: DataFrame) -> DataFrame:
    """Catalog rows of scanned images(path, content), by the XMP packet of each file. Unknown fields are null.

    Files whose XMP has neither coordinate leave the position to exif(), which is joined by path.
    """
    ship(images.sparkSession)
    rows = images.select("path", xmp_attributes(F.col("content")).alias("xmp"))
    number = lambda k: F.try_element_at("xmp", F.lit(k)).try_cast("double")
    word = lambda k: F.try_element_at("xmp", F.lit(k))
    has_position = F.map_contains_key("xmp", "GpsLatitude") | F.map_contains_key("xmp", "GpsLongtitude")
    pose = lambda p: F.struct(*(number(f"{p}{a}Degree").alias(f"{a.lower()}_deg") for a in ("Yaw", "Pitch", "Roll")))
    gps = F.struct(number("GpsLatitude").alias("latitude"), number("GpsLongtitude").alias("longitude"), number("AbsoluteAltitude").alias("altitude_m"))
    none = F.lit(None).cast("double")
    camera = F.struct(
        none.alias("focal_length_mm"), none.alias("equivalent_focal_length_mm"), none.alias("sensor_width_mm"), none.alias("sensor_height_mm"),
        number("CalibratedFocalLength").alias("calibrated_focal_length_px"), number("CalibratedOpticalCenterX").alias("calibrated_optical_center_x_px"),
        number("CalibratedOpticalCenterY").alias("calibrated_optical_center_y_px"), F.lit(False).alias("calibrated"),
    )
    missing = F.lit(None).cast("string")
    mission = F.struct(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("flight_id"), missing.alias("waypoint_id"), missing.alias("facade_hint"))
    return rows.select(
        text.stem(F.col("path")).alias("image_id"), F.col("path").alias("file_path"), missing.alias("timestamp_utc"), word("Make").alias("drone_model"), word("Model").alias("camera_model"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.when(has_position, gps).otherwise(F.lit(None)).alias("gps"),
        pose("Flight").alias("drone_pose"), pose("Gimbal").alias("gimbal_pose"), camera.alias("camera"), mission.alias("mission"),
    )


def with_exif(catalog: DataFrame, exif: DataFrame) -> DataFrame:
    """Fills a catalog from exif(file_path, tags map<string,string>): the position where XMP has none, models, time.

    Rational triples are comma-separated decimals under GPSLatitude and GPSLongitude.
    """
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    position = F.struct(
        geo.dms_to_degrees(F.split(tag("GPSLatitude"), ","), tag("GPSLatitudeRef")).alias("latitude"),
        geo.dms_to_degrees(F.split(tag("GPSLongitude"), ","), tag("GPSLongitudeRef")).alias("longitude"),
        tag("GPSAltitude").try_cast("double").alias("altitude_m"),
    )
    named = F.coalesce(F.nullif(tag("DateTimeOriginal"), F.lit("")), F.nullif(tag("DateTime"), F.lit("")))
    camera = F.col("camera").withField("focal_length_mm", tag("FocalLength").try_cast("double")).withField("equivalent_focal_length_mm", tag("FocalLengthIn35mmFilm").try_cast("double"))
    joined = catalog.join(exif.select("file_path", "tags"), "file_path", "left")
    filled = joined.withColumns({
        "gps": F.coalesce("gps", position), "drone_model": F.coalesce(F.nullif("drone_model", F.lit("")), tag("Make")), "camera_model": F.coalesce(F.nullif("camera_model", F.lit("")), tag("Model")),
        "timestamp_utc": text.exif_timestamp(named), "camera": camera,
    })
    return filled.select(*catalog.columns)


def flatten(catalog: DataFrame) -> DataFrame:
    """Nested fields as dotted names."""
    columns = []
    for f in catalog.schema:
        inner = getattr(f.dataType, "names", None)
        columns += [F.col(f"{f.name}.{n}").alias(f"{f.name}.{n}") for n in inner] if inner else [F.col(f.name)]
    return catalog.select(*columns)


def settings(lines: DataFrame) -> DataFrame:
    """(key, value) of INI lines(line_no, value): the first = parts, blank lines, ; and [ are skipped, later keys win."""
    line = F.trim("value")
    kept = lines.where((line != "") & ~line.startswith(";") & ~line.startswith("[") & line.contains("="))
    parts = F.split(line, "=", 2)
    return kept.select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("v"), "line_no").groupBy("key").agg(F.max_by("v", "line_no").alias("value"))


def settings_lines(values: DataFrame) -> DataFrame:
    return values.select(F.concat_ws("=", "key", F.coalesce("value", F.lit(""))).alias("value"))


def remote_listing(lines: DataFrame) -> DataFrame:
    """(name, size) of `size TAB name` lines; lines without a readable size are dropped."""
    parts = F.split("value", "\t", 2)
    return lines.where(F.size(parts) == 2).select(parts[1].alias("name"), F.trim(parts[0]).try_cast("long").alias("size")).where(F.col("size").isNotNull())


def assignments(spark: SparkSession, path: str) -> DataFrame:
    """Assignment files; malformed ones give no row, an empty topic is null, missing lists are empty."""
    from pyspark.sql import types as T

    schema = T.StructType([*schemas.ASSIGNMENT, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    empty = F.array().cast("array<string>")
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record").withColumns({"Topic": F.nullif(F.trim("Topic"), F.lit("")), "Buildings": F.coalesce("Buildings", empty), "Directions": F.coalesce("Directions", empty)})


def sites(texts: DataFrame, column: str = "value") -> DataFrame:
    """(company, buildings) of site catalogs as JSON text; blank names are dropped, malformed text gives none."""
    parsed = F.from_json(F.col(column), schemas.SITES)
    company = texts.select(F.explode_outer(parsed["companies"]).alias("c"))
    return company.where(F.trim("c.name") != "").select(F.trim("c.name").alias("company"), F.array_distinct(F.coalesce("c.buildings", F.array().cast("array<string>"))).alias("buildings"))


PACKET = 188


def ts_packets(bundles: DataFrame, size: int = PACKET) -> DataFrame:
    """Transport-stream packets of bundles(stream_id, chunk_id, timestamp_sec, data); a part at the end is left out."""
    from pyspark.sql import types as T

    kept = [f for f in bundles.schema if f.name != "data"]
    schema = T.StructType([*kept, T.StructField("packet_no", T.IntegerType()), T.StructField("packet", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            # A bundle at a time, some packets at a time: a bundle is not copied beside each of its packets.
            for row in range(batch.num_rows):
                data = memoryview(batch.column("data")[row].as_buffer() or b"")
                for at in range(0, len(data) // size, 4096):
                    numbers = range(at, min(at + 4096, len(data) // size))
                    same = [pa.repeat(batch.column(f.name)[row], len(numbers)) for f in kept]
                    packets = pa.array([bytes(data[i * size : (i + 1) * size]) for i in numbers], pa.binary())
                    yield pa.RecordBatch.from_arrays([*same, pa.array(numbers, pa.int32()), packets], names=schema.names)

    return bundles.select(*(f.name for f in kept), "data").mapInArrow(run, schema)


def flv_tags(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, tag_no, type, timestamp_ms, size) of FLV files: audio, video and script tags, up to a truncated one."""
    import pandas as pd

    def read(data: bytes):
        at = (int.from_bytes(data[5:9], "big") if data[:3] == b"FLV" else len(data)) + 4
        while at + 11 <= len(data):
            kind, size = data[at] & 0x1F, int.from_bytes(data[at + 1 : at + 4], "big")
            if at + 11 + size > len(data):
                return
            if kind in (8, 9, 18):
                yield kind, data[at + 7] << 24 | int.from_bytes(data[at + 4 : at + 7], "big"), size
            at += 11 + size + 4

    def run(batches):
        for batch in batches:
            out = [(k, i, *tag) for k, data in zip(batch[key], batch[content], strict=True) if data is not None for i, tag in enumerate(read(bytes(data)))]
            yield pd.DataFrame(out, columns=[key, "tag_no", "type", "timestamp_ms", "size"])

    return files.select(F.col(key).cast("string"), content).mapInPandas(run, f"{key} string, tag_no int, type int, timestamp_ms long, size long")


def concat_list(frames: DataFrame, path: str, order: str, fps: float) -> DataFrame:
    """The lines of a concat list: file and duration per frame, the last file once more at the end."""
    quoted = F.concat(F.lit("file '"), F.replace(F.col(path), F.lit("'"), F.lit("'\\''")), F.lit("'"))
    end = frames.agg(F.max(order).alias("_end"))  # one row
    rows = frames.join(F.broadcast(end)).select(order, quoted.alias("f"), (F.col(order) == F.col("_end")).alias("last"))
    line = F.when(F.col("last"), F.array("f", F.lit(f"duration {1 / fps:.6f}"), "f")).otherwise(F.array("f", F.lit(f"duration {1 / fps:.6f}")))
    return rows.select(order, F.posexplode(line).alias("part", "value")).orderBy(order, "part").select("value")


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON line per facade."""
    reports.write.mode("overwrite").json(path)


def write_catalog(catalog: DataFrame, path: str) -> None:
    flatten(catalog).write.mode("overwrite").parquet(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A written catalog with its nested fields."""
    flat = spark.read.parquet(path)
    nested: dict[str, list[str]] = {}
    for name in flat.columns:
        outer, _, inner = name.partition(".")
        nested.setdefault(outer, []).append(inner)
    field = lambda o, i: F.col(f"`{o}.{i}`")
    group = lambda o, names: F.struct(*(field(o, i).alias(i) for i in names))
    # A nested field of which all parts are null was null as a whole, or may be taken for it.
    whole = lambda o, names: F.when(F.coalesce(*(field(o, i).cast("string") for i in names)).isNotNull(), group(o, names))
    return flat.select(*(F.col(o) if names == [""] else whole(o, names).alias(o) for o, names in nested.items()))


def _current(spark: SparkSession, path: str) -> str | None:
    """The version of a cached catalog that is whole: what its newest pointer names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/pointers")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    numbers = [int(n.rsplit("-", 1)[1]) for n in names if n.startswith("version-")]
    return f"{path}/{max(numbers):012d}" if numbers else None


def cached_catalog(images: DataFrame, path: str) -> DataFrame:
    """The catalog of scanned images(path, length, content), written under path; files that a catalog there has, with the
    same length, are not read again, and those that are gone leave it.

    Each call writes a version of its own, and last an empty file that points to it. A call that dies on the way leaves
    the version before in force; the last two versions are kept, as a reader may still be in the one before.
    """
    from .exif import catalog

    spark = images.sparkSession
    listed = images.select("path", "length")
    current = _current(spark, path)
    if current is None:
        whole, number = catalog(images), 1
    else:
        number = int(current.rsplit("/", 1)[1]) + 1
        known, old = spark.read.parquet(f"{current}/files"), read_catalog(spark, f"{current}/catalog")
        same = listed.join(known, ["path", "length"], "left_semi").select(F.col("path").alias("file_path"))
        new = images.join(known, ["path", "length"], "left_anti")
        whole = old.join(same, "file_path", "left_semi").select(*old.columns).unionByName(catalog(new))
    version = f"{path}/{number:012d}"
    write_catalog(whole, f"{version}/catalog")
    listed.write.mode("overwrite").parquet(f"{version}/files")
    _touch(spark, f"{path}/pointers/version-{number:012d}")
    if number > 2:
        _remove(spark, f"{path}/pointers/version-{number - 2:012d}")
        _remove(spark, f"{path}/{number - 2:012d}")
    return read_catalog(spark, f"{version}/catalog")


def _touch(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True).close()


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def json_log(rows: DataFrame, level: str, message: str, fields: list[str]) -> DataFrame:
    """Log lines with level, message and fields, as text."""
    return rows.select(F.to_json(F.struct(F.lit(level).alias("level"), F.lit(message).alias("message"), *fields)).alias("value"))
