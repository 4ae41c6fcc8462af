"""Reconciliation, sets and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reconcile as R
from . import inputs as I
from .registry import query


@query("never_matched", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def never_matched(spark, sf_dir):
    return R.without(I.read(spark, sf_dir, "documents"), "doc_id", I.read(spark, sf_dir, "labels"))


@query("registration_failed", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1 EXCEPT SELECT doc_id FROM documents WHERE n_chars < 200")
def registration_failed(spark, sf_dir):
    docs, labels = I.read(spark, sf_dir, "documents"), I.read(spark, sf_dir, "labels")
    return R.without(docs, "doc_id", labels.where("quality = 1"), labels.where("toxic = 1"), docs.where("n_chars < 200"))


@query("excluded_set", "SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT doc_id FROM labels WHERE toxic = 1")
def excluded_set(spark, sf_dir):
    labels = I.read(spark, sf_dir, "labels")
    return R.listings(labels.where("quality = 0").select("doc_id"), labels.where("toxic = 1").select("doc_id"))


@query("matched_catalog", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def matched_catalog(spark, sf_dir):
    return I.read(spark, sf_dir, "documents").join(I.read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", "source")


@query("catalog_limit", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def catalog_limit(spark, sf_dir):
    """The reference operator's own row limit, after an explicit sort."""
    return I.read(spark, sf_dir, "documents").select("doc_id", "source").orderBy("doc_id").limit(100)


@query(
    "size_reconcile",
    """WITH l AS (SELECT o_custkey AS g, o_orderkey AS name, o_orderkey % 97 AS size FROM orders WHERE o_orderkey % 5 <> 0), r AS (SELECT o_custkey AS g, o_orderkey AS name, o_orderkey % 97 + CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END AS size FROM orders WHERE o_orderkey % 7 <> 0),
    m AS (SELECT l.g, count(*) AS n_local, count(*) FILTER (WHERE NOT coalesce(l.size = r.size, false)) AS n_missing FROM l LEFT JOIN r ON l.g = r.g AND l.name = r.name GROUP BY l.g), s AS (SELECT g, count(*) AS n FROM r GROUP BY g)
    SELECT coalesce(m.g, s.g) AS g, coalesce(n_missing, 0) = 0 OR coalesce(n_local, 0) = 0 OR coalesce(n, 0) = 0 AS matches, coalesce(n_local, 0) AS n_local, coalesce(n_missing, 0) AS n_missing FROM m FULL JOIN s ON m.g = s.g""",
)
def size_reconcile(spark, sf_dir):
    k = F.col("o_orderkey")
    o = I.read(spark, sf_dir, "orders")
    local = o.where(k % 5 != 0).select(F.col("o_custkey").alias("g"), k.alias("name"), (k % 97).alias("size"))
    remote = o.where(k % 7 != 0).select(F.col("o_custkey").alias("g"), k.alias("name"), (k % 97 + F.when(k % 31 == 0, 1).otherwise(0)).alias("size"))
    return R.sizes_match(local, remote, "g")


@query(
    "requirement_progress",
    """WITH q AS (SELECT o_orderpriority AS direction, count(*) FILTER (WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity < 10)) AS required, count(*) FILTER (WHERE o_orderstatus = 'F') AS received FROM orders GROUP BY 1)
    SELECT direction, required, received, CAST(CASE WHEN required > 0 THEN trunc(100.0 * received / required) ELSE 0 END AS INTEGER) AS percent FROM q""",
)
def requirement_progress(spark, sf_dir):
    files = I.read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("direction"), F.col("o_orderkey").alias("key"), "o_orderstatus")
    out = I.read(spark, sf_dir, "lineitem").where("l_returnflag = 'A' AND l_quantity < 10").select(F.col("l_orderkey").alias("key"))
    received = files.groupBy("direction").agg(F.count_if(F.col("o_orderstatus") == "F").alias("received"))
    return R.requirement_counts(files, out, "direction", "key").join(received, "direction").withColumn("percent", R.progress_percent(F.col("received"), F.col("required")))


NAMES = ["front", "뒤", "Left", "우측", "top", "기타", "nowhere", "정면"]
ALIAS_SQL = "CASE lower({c}) " + " ".join(f"WHEN '{k.lower()}' THEN '{v}'" for k, v in R.DIRECTION_ALIASES.items()) + " END"
NAME_SQL = "[" + ", ".join(f"'{n}'" for n in NAMES) + "][CAST(c_custkey % 8 AS INTEGER) + 1]"


@query("alias_canonical", f"SELECT {ALIAS_SQL.format(c=NAME_SQL)} AS direction, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2")
def alias_canonical(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("c_custkey") % 8 + 1).cast("int"))
    return I.read(spark, sf_dir, "customer").groupBy(R.canonical_direction(name).alias("direction"), "c_mktsegment").agg(F.count("*").alias("n"))


@query(
    "override_lookup",
    f"""WITH r AS (SELECT c_custkey, c_nationkey, {ALIAS_SQL.format(c=NAME_SQL)} AS direction FROM customer), o AS (SELECT n_nationkey, 'LEFT' AS d, n_name AS face FROM nation WHERE n_nationkey % 3 = 0)
    SELECT c_custkey, coalesce(o.face, s.f, 'none') AS face, CASE WHEN o.face IS NOT NULL THEN 'override' WHEN s.f IS NOT NULL THEN 'standard' ELSE 'none' END AS face_source
    FROM r LEFT JOIN o ON r.c_nationkey = o.n_nationkey AND r.direction = o.d LEFT JOIN (VALUES ('FRONT', '정면'), ('BACK', '후면'), ('LEFT', '좌측면'), ('RIGHT', '우측면')) s(d, f) ON r.direction = s.d""",
)
def override_lookup(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("c_custkey") % 8 + 1).cast("int"))
    rows = I.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("building"), R.canonical_direction(name).alias("direction"))
    overrides = I.read(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").cast("string").alias("building"), F.lit("left").alias("direction"), F.col("n_name").alias("face"))
    return R.override_or_standard(rows, overrides, ["building", "direction"], "face", R.looked_up(F.col("direction"), R.STANDARD_FACES)).select("c_custkey", "face", "face_source")


@query(
    "stem_match",
    """WITH f AS (SELECT regexp_extract(url, '([^/?#]*)[?#]?[^/]*$', 1) AS stem, url FROM pages), m AS (SELECT lower(stem) AS s, min(url) AS url FROM f GROUP BY 1)
    SELECT DISTINCT upper(f.stem) AS wanted, m.url FROM f JOIN m ON lower(f.stem) = m.s""",
)
def stem_match(spark, sf_dir):
    f = I.read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"([^/?#]*)[?#]?[^/]*$", 1).alias("stem"), "url")
    wanted = f.select(F.upper("stem").alias("stem")).distinct()
    return R.stem_match(wanted, f, "stem", "url").select(F.col("stem").alias("wanted"), "url")


@query("listing_union", "SELECT url AS path FROM pages WHERE page_id % 2 = 0 UNION SELECT url FROM pages WHERE page_id % 3 = 0")
def listing_union(spark, sf_dir):
    p = I.read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    return R.listings(p.where("page_id % 2 = 0").select("path"), p.where("page_id % 3 = 0").select("path"))


@query(
    "site_catalog",
    "SELECT r_name AS company, array_to_string(list(DISTINCT n_name ORDER BY n_name), ',') AS buildings FROM region JOIN nation ON n_regionkey = r_regionkey WHERE trim(r_name) <> '' GROUP BY r_name",
)
def site_catalog(spark, sf_dir):
    """Regions and nations written as a site catalog in JSON and read back."""
    from ..sources.files import sites

    nations = I.read(spark, sf_dir, "nation").join(I.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    company = nations.groupBy(F.col("r_name").alias("name")).agg(F.sort_array(F.collect_list("n_name")).alias("buildings"))
    text = company.select(F.to_json(F.struct(F.array(F.struct("name", "buildings")).alias("companies"))).alias("value"))
    return sites(text).select("company", F.concat_ws(",", "buildings").alias("buildings"))
