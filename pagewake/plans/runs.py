"""Queries over whole runs, stored artifacts and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewake.functions import feeds
from pagewake.operators import runs
from pagewake.plans.governance import WALK
from pagewake.plans.registry import register
from pagewake.sources import views
from pagewake.sources.tables import table
from pagewake.sources.views import FILES, SNAPSHOTS

@register(
    f"""{WALK}, {SNAPSHOTS}, h AS (SELECT run_id, canonical_url AS node, arg_max(content_hash, id) AS hash FROM snapshots WHERE canonical_url <> '' GROUP BY ALL),
    p AS (SELECT node, hash FROM h WHERE run_id = 1), c AS (SELECT node, hash FROM h WHERE run_id = 2 AND node IN (SELECT node FROM best)),
    cut AS (SELECT count(*) > 0 AS cut FROM best WHERE depth = 4 AND node IN (SELECT "from" FROM edges))
    SELECT coalesce(p.node, c.node) AS node, CASE WHEN p.node IS NULL THEN 'new' WHEN c.node IS NULL THEN CASE WHEN (SELECT cut FROM cut) THEN 'unknown' ELSE 'missing' END WHEN p.hash <> c.hash THEN 'changed' ELSE 'same' END AS change FROM p FULL JOIN c ON p.node = c.node"""
)
def run_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An incremental run: a walk of four levels from each site's root over run 2, and what changed since run 1."""
    s = views.snapshots(spark, sf_dir).where("canonical_url <> ''").groupBy("run_id", F.col("canonical_url").alias("node")).agg(F.max_by("content_hash", "id").alias("hash"))
    told, _ = runs.incremental(s.where("run_id = 1").drop("run_id"), s.where("run_id = 2").drop("run_id"), views.page_graph(spark, sf_dir), views.page_seeds(spark, sf_dir), 4)
    return told.select("node", "change")


@register("WITH t AS (SELECT event_id AS id, user_id, epoch_us(ts) / 1000000.0 AS t0, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT id, round(max(t0 - n * 900.0) OVER (PARTITION BY user_id ORDER BY t0, id) + n * 900.0, 3) AS not_before FROM t")
def request_pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest start of each request, a quarter of an hour apart for each user."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"))
    return runs.not_before(e, "user_id", "at", 900.0).select("id", F.round("not_before", 3).alias("not_before"))


@register(f"WITH {FILES} SELECT run_id, download_url, sha256, count(*) AS observations FROM files GROUP BY ALL")
def artifact_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.stored(views.file_observations(spark, sf_dir), "sha256", "download_url", "run_id")[1]


@register(f"WITH {FILES} SELECT DISTINCT sha256 FROM files")
def artifact_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.stored(views.file_observations(spark, sf_dir), "sha256", "download_url", "run_id")[0]


@register(
    f"""WITH {SNAPSHOTS}, {FILES}, pg AS (SELECT site, page_id, canonical_url FROM snapshots WHERE run_id = 1), fl AS (SELECT pg.site, pg.canonical_url FROM files f JOIN pg USING (page_id) WHERE f.run_id = 1),
    r AS (SELECT site, canonical_url, row_number() OVER (PARTITION BY site ORDER BY count(*) DESC, canonical_url) AS n FROM fl GROUP BY site, canonical_url)
    SELECT p.site, count(*) AS n_pages, coalesce((SELECT count(*) FROM fl WHERE fl.site = p.site), 0) AS n_files, coalesce((SELECT list(canonical_url ORDER BY n) FROM r WHERE r.site = p.site AND n <= 5), []) AS top_pages FROM pg p GROUP BY p.site"""
)
def site_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.snapshots(spark, sf_dir).where("run_id = 1").select("site", "page_id", "canonical_url")
    files = views.file_observations(spark, sf_dir).where("run_id = 1").select("page_id").join(pages, "page_id")
    return runs.evidence(pages, files, "site", "canonical_url")


@register("SELECT s_suppkey AS site_key, s_name AS name, s_suppkey % 10 <> 3 AS is_active FROM supplier UNION ALL SELECT 1000000, 'added', true")
def site_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with one added, and some no longer active."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site_key"), F.col("s_name").alias("name"), F.lit(True).alias("is_active"))
    added = spark.range(1).select(F.lit(1_000_000).cast("bigint").alias("site_key"), F.lit("added").alias("name"), F.lit(True).alias("is_active"))
    return s.withColumn("is_active", F.when(F.col("site_key") % 10 == 3, False).otherwise(F.col("is_active"))).unionByName(added)


@register(
    f"""SELECT page_id, regexp_replace(regexp_replace(url || '&apikey=x1&b=2', '^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@', '\\1'), '(?i)([?&#][^=&#]*(?:{'|'.join(feeds.SECRET_KEYS)})[^=&#]*=)[^&#]*', '\\1[REDACTED]', 'g') AS redacted FROM (SELECT page_id, replace(url, '://', '://me:pw@') AS url FROM pages)"""
)
def url_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    secret = F.concat(F.replace("url", F.lit("://"), F.lit("://me:pw@")), F.lit("&apikey=x1&b=2"))
    return table(spark, sf_dir, "pages").select("page_id", feeds.redacted_url(secret).alias("redacted"))


@register()
def event_props_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", feeds.redacted_json("props").alias("props"))


@register()
def sitemap_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sitemap of each site's pages, read back as a listing."""
    s = views.snapshots(spark, sf_dir).where("run_id = 1")
    loc = F.concat(F.lit("<url><loc>"), F.replace(F.replace("canonical_url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</loc></url>"))
    xml = s.groupBy("site").agg(F.concat(F.lit("<urlset>"), F.array_join(F.array_sort(F.collect_list(loc)), ""), F.lit("</urlset>")).alias("xml"))
    return xml.select("site", feeds.listed("xml").alias("l")).select("site", "l.*")
