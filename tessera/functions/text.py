"""Parsing and formatting of names, logs and progress lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .linalg import let


def exif_timestamp(raw: Column) -> Column:
    """`Y:m:d H:M:S` as `Y-m-dTH:M:S` without a zone; other text as it is; empty is null."""
    shape = r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}:\d{2}:\d{2})$"
    return F.when(raw.rlike(shape), F.regexp_replace(raw, shape, "$1-$2-$3T$4")).otherwise(F.nullif(raw, F.lit("")))


def grid_column(index: Column) -> Column:
    """0 is A, 25 Z, 26 AA, up to three letters."""
    letter = lambda i: F.char(F.lit(65) + F.pmod(i, F.lit(26)))
    up = lambda i: F.floor(i / 26) - 1
    second, third = up(index), up(up(index))
    return F.concat(F.when(third >= 0, letter(third)).otherwise(""), F.when(second >= 0, letter(second)).otherwise(""), letter(index))


def grid_cell(x: Column, y: Column, step: float) -> Column:
    """The name of the cell of a point: letters across, numbers from 1 down."""
    return F.concat(grid_column(F.floor(x / step)), (F.floor(y / step) + 1).cast("string"))


def elapsed(seconds: Column) -> Column:
    """H:MM:SS from an hour on, else MM:SS."""
    s = seconds.cast("long")
    h, m = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    tail = F.format_string("%02d:%02d", m, F.pmod(s, F.lit(60)))
    return F.when(h >= 1, F.concat(h.cast("string"), F.lit(":"), tail)).otherwise(tail)


def discovery_port(domain: Column) -> Column:
    """The default discovery port of a DDS domain; null outside 0 to 232."""
    return F.when(domain.between(0, 232), 7400 + 250 * domain + 10)


def cygwin_path(path: Column) -> Column:
    r"""`D:\x` as `/cygdrive/d/x`; otherwise only the slashes turn."""
    turned = F.translate(path, "\\", "/")
    return F.when(path.rlike(r"^[A-Za-z]:"), F.concat(F.lit("/cygdrive/"), F.lower(F.substring(path, 1, 1)), F.substr(turned, F.lit(3)))).otherwise(turned)


#: Characters that file names may not hold, besides control characters.
INVALID_IN_NAMES = '"<>|:*?\\/'


def file_name(text: Column) -> Column:
    """Each character that a file name may not hold becomes _, then blanks at the ends go."""
    return F.trim(F.regexp_replace(text, r'[\x00-\x1F"<>|:*?\\/]', "_"))


def building_number(text: Column, suffix: str) -> Column:
    """Without one trailing unit and the blanks around it."""
    return F.rtrim(F.regexp_replace(F.trim(text), f"{suffix}$", ""))


def facade_of(folder: Column) -> Column:
    """The name before `_date_time`, else the whole."""
    shape = r"^(.+)_\d{8}_\d{6}$"
    return F.when(folder.rlike(shape), F.regexp_extract(folder, shape, 1)).otherwise(folder)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")


def fraction(progress: Column) -> Column:
    """`~85/216` as 85/216, at most 1; 0 for anything else."""
    parts = F.split(F.regexp_replace(progress, r"^~+", ""), "/")
    done, total = (F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2))
    fits = (F.size(parts) == 2) & done.isNotNull() & (total > 0)
    return F.when(F.coalesce(fits, F.lit(False)), F.least(F.lit(1.0), done / total)).otherwise(0.0)


#: Where stages stand on the way from 0 to 100: the stage's start, and what its progress adds. These values are fixed.
STAGE_PERCENT = {
    "PHOTO_SPACING": (3, 0),
    "COLMAP_EXTRACT": (4, 0),
    "COLMAP_LOFTR_PROGRESS": (8, 37),
    "COLMAP_MAPPING": (45, 0),
    "COLMAP_MAPPING_PROGRESS": (45, 45),
    "COLMAP_ONLY": (90, 0),
    "GPS_MISMATCH_DETECTED": (92, 0),
    "OFF_WALL_DETECTED": (92, 0),
    "GAP_FILL": (97, 0),
    "METADATA_PARSED": (2, 0),
    "PAIR_GRAPH_BUILT": (10, 0),
    "MATCH_GEOMETRY": (10, 55),
    "GEOMETRY_SOLVED": (65, 0),
    "PREVIEW_UPDATED": (65, 20),
    "STITCHED": (85, 0),
    "COLMAP_FALLBACK": (92, 0),
    "RECTIFIED_COLMAP": (98, 0),
    "DONE": (100, 0),
}


def log_line(line: Column) -> Column:
    """stage, progress and message of a JSON log line; null where the line is no JSON object or has no textual stage."""
    kind = F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(line), "$.stage", "variant")), F.lit("VOID"))
    parsed = F.from_json(line, "stage string, progress string, message string")
    return F.when(kind == "STRING", parsed)


def stage_percent(stage: Column, progress: Column) -> Column:
    """Null for stages that stand nowhere."""
    table = F.create_map(*(F.lit(x) for name, (start, more) in STAGE_PERCENT.items() for x in (name, f"{start},{more}")))
    place = F.split(F.try_element_at(table, stage), ",")
    return place[0].cast("double") + fraction(progress) * place[1].cast("double")


def transfer_progress(line: Column) -> Column:
    """bytes, percent and MB/s of a transfer's progress line; null for any other line."""
    # One expression takes all three, once; lines that it does not fit stay as they are, without the mark in front.
    shape = r"^(?=[^0-9]*([0-9][0-9,]*))[^%]*?(\d+)%(?:.*?([0-9.]+[A-Za-z]*)/s)?.*$"
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

    def figures(parts: Column) -> Column:
        token = parts[3]
        value, unit = F.translate(token, letters, "").try_cast("double"), F.translate(token, "0123456789.", "")
        rate = F.when(unit == "kB", value / 1024).when(unit == "MB", value).when(unit == "GB", value * 1024).otherwise(value / (1024 * 1024))
        some = F.struct(F.replace(parts[1], F.lit(","), F.lit("")).try_cast("long").alias("bytes"), parts[2].cast("int").alias("percent"), F.coalesce(rate, F.lit(0.0)).alias("rate_mbps"))
        return F.when(parts[0] == "\u0001", some)

    return F.when(line.contains("%"), let(F.split(F.regexp_replace(line, shape, "\u0001|$1|$2|$3"), r"\|"), figures))


def lines(text: Column) -> Column:
    r"""Split at \r or \n, without empty lines."""
    return F.filter(F.split(text, r"[\r\n]"), lambda x: x != "")


def csv_items(text: Column) -> Column:
    """Without empty items; null is an empty list."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda x: x != "")


def requirement_counts(directions: Column, counts: Column) -> Column:
    """Counts as numbers, only if there are as many as directions."""
    numbers = F.transform(csv_items(counts), lambda x: F.coalesce(F.regexp_extract(x, r"^\s*(\d+)", 1).try_cast("long"), F.lit(0).cast("long")))
    return F.when(F.size(numbers) == F.size(csv_items(directions)), numbers).otherwise(F.array().cast("array<bigint>"))


def grid_size(extent_px: Column, px_per_m: float = 100.0, spacing_m: float = 5.0) -> Column:
    """How many cells of a labelled grid an extent takes."""
    return F.ceil(extent_px / (px_per_m * spacing_m)).cast("int")
