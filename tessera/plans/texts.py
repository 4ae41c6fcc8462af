"""Names, paths, markup, logs and progress lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..durable import ship
from ..functions import geo, text
from ..operators import sequence
from ..sources import files
from ..sources.xmp import xmp_attributes
from . import inputs as I
from .registry import query


@query(
    "path_scan_filter",
    r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages)
    SELECT page_id, 'D:' || replace(path, '/', chr(92)) AS windows, '/cygdrive/d' || path AS cygwin, trim(regexp_replace(path, '[/?]', '_', 'g')) AS safe,
      regexp_extract(path, '([^/]*)$', 1) || '_20260101_101010' AS folder, CASE WHEN path LIKE '%/' THEN '_20260101_101010' ELSE regexp_extract(path, '([^/]*)$', 1) END AS facade FROM p WHERE path LIKE '/en/%' OR path LIKE '/de/%'""",
)
def path_scan_filter(spark, sf_dir):
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1)
    p = I.read(spark, sf_dir, "pages").select("page_id", path.alias("path")).where(F.col("path").startswith("/en/") | F.col("path").startswith("/de/"))
    p = p.withColumn("windows", F.concat(F.lit("D:"), F.translate("path", "/", "\\"))).withColumn("folder", F.concat(F.regexp_extract("path", r"([^/]*)$", 1), F.lit("_20260101_101010")))
    return p.select("page_id", "windows", text.cygwin_path(F.col("windows")).alias("cygwin"), text.file_name(F.col("path")).alias("safe"), "folder", text.facade_of(F.col("folder")).alias("facade"))


@query(
    "attr_extract",
    r"""WITH p AS (SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, length(html) AS n, page_id % 5 <> 4 AS whole FROM pages)
    SELECT page_id, CASE WHEN whole THEN lang END AS "lang", CASE WHEN whole AND page_id % 3 <> 0 THEN 37.0 + n / 1000.0 END AS latitude,
      CASE WHEN whole THEN CASE WHEN page_id % 2 = 0 THEN '2>1' ELSE '1' END END AS v, CASE WHEN whole THEN 'O''Neil & "Söhne" <' || CAST(page_id AS VARCHAR) || '>' END AS model FROM p""",
)
def attr_extract(spark, sf_dir):
    """Attributes of an XMP packet made from each page: quotes, entities and marks in values are text, the last of a name
    wins, what is not a number is null, and a packet that is no XML has none."""
    n, k = F.length("html"), F.col("page_id")
    packet = F.concat(
        F.lit('junk<x:xmpmeta xmlns:x="adobe:ns:meta/" xmlns:d="d/"><rdf:RDF xmlns:rdf="rdf/"><rdf:Description d:Lang="'), F.regexp_extract("html", '<html lang="([^"]*)"', 1), F.lit('" d:GpsLatitude="'),
        F.when(k % 3 != 0, (37.0 + n / 1000.0).cast("string")).otherwise("none"), F.lit('" d:V="1" d:Model="O\'Neil &amp; &quot;Söhne&quot; &lt;'), k.cast("string"), F.lit('>"/>'),
        F.when(k % 2 == 0, "<rdf:Description d:V='2>1'></rdf:Description>").otherwise(""), F.when(k % 5 == 4, "<open>").otherwise(""), F.lit("</rdf:RDF></x:xmpmeta>tail"),
    )
    at = lambda name: F.try_element_at("a", F.lit(name))
    ship(spark)
    pages = I.read(spark, sf_dir, "pages").select("page_id", xmp_attributes(packet).alias("a"))
    return pages.select("page_id", at("Lang").alias("lang"), at("GpsLatitude").try_cast("double").alias("latitude"), at("V").alias("v"), at("Model").alias("model"))


STAGE_SQL = "['COLMAP_LOFTR_PROGRESS', 'COLMAP_MAPPING_PROGRESS', 'MATCH_GEOMETRY', 'DONE', 'UNKNOWN', 'PREVIEW_UPDATED'][CAST(event_id % 6 AS INTEGER) + 1]"
STAGES = ["COLMAP_LOFTR_PROGRESS", "COLMAP_MAPPING_PROGRESS", "MATCH_GEOMETRY", "DONE", "UNKNOWN", "PREVIEW_UPDATED"]
LOG_SQL = f"""g AS (SELECT event_id, user_id, {STAGE_SQL} AS stage, least(1.0, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 80.0) AS f FROM events WHERE event_id % 9 <> 0),
c AS (SELECT event_id, user_id, stage, CASE stage WHEN 'COLMAP_LOFTR_PROGRESS' THEN 8 + f * 37 WHEN 'COLMAP_MAPPING_PROGRESS' THEN 45 + f * 45 WHEN 'MATCH_GEOMETRY' THEN 10 + f * 55 WHEN 'DONE' THEN 100.0 WHEN 'PREVIEW_UPDATED' THEN 65 + f * 20 END AS percent FROM g)"""


def log_lines(spark, sf_dir):
    """events as log lines: JSON with a stage and a progress like ~k/80, and some that are none."""
    e = F.col("event_id")
    stage = F.element_at(F.array(*map(F.lit, STAGES)), (e % 6 + 1).cast("int"))
    line = F.to_json(F.struct(F.lit("INFO").alias("level"), stage.alias("stage"), F.concat(F.lit("~"), F.get_json_object("props", "$.k"), F.lit("/80")).alias("progress")))
    return I.read(spark, sf_dir, "events").select("event_id", "user_id", F.when(e % 9 == 0, "Traceback: no JSON {").otherwise(line).alias("value"))


def parsed_log(spark, sf_dir):
    log = log_lines(spark, sf_dir).withColumn("l", text.log_line(F.col("value"))).where("l.stage IS NOT NULL")
    return log.select("event_id", "user_id", "l.stage", text.stage_percent(F.col("l.stage"), F.col("l.progress")).alias("percent"))


@query("log_progress", f"WITH {LOG_SQL} SELECT event_id, stage, round(percent, 6) AS percent FROM c")
def log_progress(spark, sf_dir):
    return parsed_log(spark, sf_dir).select("event_id", "stage", F.round("percent", 6).alias("percent"))


@query("progress_monotone", f"WITH {LOG_SQL} SELECT user_id, event_id, round(max(percent) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS shown FROM c")
def progress_monotone(spark, sf_dir):
    return sequence.running_max(parsed_log(spark, sf_dir), "user_id", "event_id", "percent", "shown").select("user_id", "event_id", F.round("shown", 6).alias("shown"))


@query("log_ring", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 20")
def log_ring(spark, sf_dir):
    """The reference operator's own ring of last lines, per stream."""
    return sequence.last_rows(I.read(spark, sf_dir, "events").select("user_id", "event_id"), 20, "user_id", "event_id")


@query(
    "transfer_progress_parse",
    """SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS BIGINT) AS bytes, CAST(l_quantity AS INTEGER) AS percent,
      round(CASE l_linenumber % 3 WHEN 0 THEN (l_tax * 100 + 1) / 1024 WHEN 1 THEN l_tax * 100 + 1 ELSE (l_tax * 100 + 1) * 1024 END, 6) AS rate_mbps FROM lineitem WHERE l_linenumber <> 4""",
)
def transfer_progress_parse(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, ("kB", "MB", "GB"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    shown = F.format_string("     %s  %d%%   %.2f%s/s    0:00:03 (xfr#12, to-chk=88/103)", F.format_number(F.bround("l_extendedprice", 0), 0), F.col("l_quantity").cast("int"), F.col("l_tax") * 100 + 1, unit)
    lines = I.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 4, "DJI_0001.JPG").otherwise(shown).alias("line"))
    # As rows of a generator, figures are taken once; a filter on them would be pushed below and take them again.
    parsed = lines.select("l_orderkey", "l_linenumber", F.inline(F.filter(F.array(text.transfer_progress(F.col("line"))), lambda p: p.isNotNull())))
    return parsed.withColumn("rate_mbps", F.round("rate_mbps", 6))


@query(
    "transfer_outcome",
    """WITH l AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(text, '[\r\n]'), lambda x: x <> '')) AS line FROM conversations), n AS (SELECT *, row_number() OVER () AS i FROM l),
    k AS (SELECT conv_id, count(*) AS n_lines FROM l GROUP BY 1) SELECT conv_id, n_lines FROM k""",
)
def transfer_outcome(spark, sf_dir):
    return I.read(spark, sf_dir, "conversations").select("conv_id", F.explode(text.lines(F.col("text"))).alias("line")).groupBy("conv_id").agg(F.count("*").alias("n_lines"))


@query(
    "csv_pairs",
    """WITH c AS (SELECT n_regionkey, string_agg(CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE n_name END, ',' ORDER BY n_nationkey) AS d, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS k FROM nation GROUP BY 1),
    s AS (SELECT n_regionkey, list_filter(string_split(d, ','), lambda x: x <> '') AS ds, list_filter(string_split(k, ','), lambda x: x <> '') AS ks FROM c)
    SELECT n_regionkey, array_to_string(ds, '|') AS directions, CASE WHEN len(ds) = len(ks) THEN array_to_string(ks, '|') ELSE '' END AS counts FROM s""",
)
def csv_pairs(spark, sf_dir):
    n = I.read(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.col("n_name")).alias("name"))
    joined = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "name"))).alias("l")).select("n_regionkey", F.concat_ws(",", "l.name").alias("d"), F.array_join(F.transform("l.n_nationkey", lambda x: x.cast("string")), ",").alias("k"))
    return joined.select("n_regionkey", F.concat_ws("|", text.csv_items(F.col("d"))).alias("directions"), F.concat_ws("|", F.transform(text.requirement_counts(F.col("d"), F.col("k")), lambda x: x.cast("string"))).alias("counts"))


@query(
    "settings_fold",
    """WITH l AS (SELECT event_id AS line_no, event_type || ' = ' || CAST(value AS VARCHAR) AS value FROM events WHERE event_id % 10 <> 0) SELECT trim(split_part(value, '=', 1)) AS key, arg_max(trim(split_part(value, '=', 2)), line_no) AS value FROM l GROUP BY 1""",
)
def settings_fold(spark, sf_dir):
    e = I.read(spark, sf_dir, "events")
    lines = e.select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 20 == 0, "; note = 1").when(F.col("event_id") % 10 == 0, "[section]").otherwise(F.concat("event_type", F.lit(" = "), F.col("value").cast("string"))).alias("value"))
    return files.settings(lines)


@query(
    "remote_listing",
    "SELECT 'f' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS name, CAST(l_quantity AS BIGINT) AS size FROM lineitem WHERE l_linenumber % 5 <> 0",
)
def remote_listing(spark, sf_dir):
    name = F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    size = F.when(F.col("l_linenumber") % 5 == 0, "?").otherwise(F.col("l_quantity").cast("long").cast("string"))
    return files.remote_listing(I.read(spark, sf_dir, "lineitem").select(F.concat(size, F.lit("\t"), name).alias("value")))


@query(
    "format_scalars",
    """SELECT event_id, CASE WHEN CAST(value * 60 AS BIGINT) >= 3600 THEN CAST(CAST(value * 60 AS BIGINT) // 3600 AS VARCHAR) || ':' || printf('%02d:%02d', (CAST(value * 60 AS BIGINT) % 3600) // 60, CAST(value * 60 AS BIGINT) % 60)
        ELSE printf('%02d:%02d', CAST(value * 60 AS BIGINT) // 60, CAST(value * 60 AS BIGINT) % 60) END AS elapsed,
      CASE WHEN user_id <= 232 THEN CAST(7410 + 250 * user_id AS BIGINT) END AS port, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp, CAST(user_id AS VARCHAR) AS building,
      round(CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END * (user_id + (event_id % 60) / 60.0 + 30.5 / 3600.0), 6) AS degrees FROM events""",
)
def format_scalars(spark, sf_dir):
    e = I.read(spark, sf_dir, "events")
    dms = F.array(F.col("user_id").cast("string"), (F.col("event_id") % 60).cast("string"), F.lit("30.5"))
    return e.select(
        "event_id", text.elapsed(F.bround(F.col("value") * 60, 0)).alias("elapsed"), text.discovery_port(F.col("user_id")).cast("long").alias("port"), text.exif_timestamp(F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).alias("stamp"),
        text.building_number(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" 동")), "동").alias("building"), F.round(geo.dms_to_degrees(dms, F.when(F.col("event_id") % 2 == 0, "S").otherwise("N")), 6).alias("degrees"),
    )


@query("json_log", """SELECT doc_id, '{"level":"INFO","message":"METADATA_PARSED","doc_id":' || CAST(doc_id AS VARCHAR) || ',"source":"' || source || '"}' AS value FROM documents""")
def json_log(spark, sf_dir):
    d = I.read(spark, sf_dir, "documents").select("doc_id", "source")
    return d.select("doc_id", F.to_json(F.struct(F.lit("INFO").alias("level"), F.lit("METADATA_PARSED").alias("message"), "doc_id", "source")).alias("value"))
