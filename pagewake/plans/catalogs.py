"""Queries over catalogs of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewake.operators import catalogs
from pagewake.plans.registry import register
from pagewake.sources.tables import table


@register(
    """SELECT s_nationkey AS catalog, s_suppkey AS position, CASE WHEN k NOT IN (0, 1) THEN CASE WHEN k = 2 THEN '' ELSE 'site' || s_suppkey % 40 END END AS site_key, CASE WHEN k = 0 THEN 'not_an_object' WHEN k = 1 THEN 'missing:fetch_mode,notes' WHEN k = 2 THEN 'site_key'
      WHEN s_suppkey > first THEN 'duplicate_site_key' WHEN k = 3 THEN 'monitor_url' WHEN k = 4 THEN 'smoke_expectation' WHEN k = 5 THEN 'tree_seed_url' WHEN k = 6 THEN 'tree_file_prefixes' WHEN k = 7 THEN 'tree_max_pages' WHEN k = 8 THEN 'priority' WHEN k = 9 THEN 'expected_min_words' END AS error
    FROM (SELECT *, min(CASE WHEN k NOT IN (0, 1, 2) THEN s_suppkey END) OVER (PARTITION BY s_nationkey, s_suppkey % 40) AS first FROM (SELECT *, s_suppkey % 12 AS k FROM supplier))"""
)
def smoke_catalog_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A smoke catalog of each nation; by its number an entry breaks one rule or none."""
    k, n = F.col("s_suppkey") % 12, F.col("s_suppkey").cast("string")
    url = F.concat(F.lit("https://s"), n, F.lit(".org/"))
    fields = {
        "site_key": F.when(k == 2, "  ").otherwise(F.concat(F.lit(" Site"), (F.col("s_suppkey") % 40).cast("string"))), "abbreviation": F.lit("a"), "full_name": F.col("s_name"), "priority": F.when(k == 8, "maybe").otherwise("Yes"), "homepage_url": url,
        "monitor_url": F.when(k == 3, F.concat(F.lit("http://s"), n)).otherwise(url), "fetch_mode": F.when(k != 1, "HTTP"), "fetch_config_json": F.struct(F.lit(3).alias("retries")), "smoke_required": F.lit(True), "smoke_expectation": F.when(k == 4, "pass").otherwise("pass_http"),
        "expected_min_words": F.when(k == 9, "many").otherwise("30"), "js_heavy_candidate": F.lit(0), "website_status": F.lit(""), "source_name": F.lit(""), "source_row": F.lit(7), "notes": F.when(k != 1, ""),
        "tree_seed_url": F.when(k == 5, "ftp://x").when(k == 10, url), "tree_file_prefixes": F.when(k == 6, "/a"), "tree_max_pages": F.when(k == 7, "ten").when(k == 11, "10"),
    }
    entry = F.when(k == 0, "[1]").otherwise(F.to_json(F.struct(*[v.alias(f) for f, v in fields.items()])))
    entries = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("catalog"), F.col("s_suppkey").alias("position"), entry.alias("entry"))
    return catalogs.smoke_errors(entries, "catalog")


@register(
    """WITH s AS (SELECT s_nationkey AS catalog, s_suppkey AS position, ['soa', 'cas', 'iaa', 'x' || s_suppkey][s_suppkey % 4 + 1] AS site_key, s_suppkey % 5 AS k FROM supplier), f AS (SELECT *, min(position) OVER (PARTITION BY catalog, site_key) AS first FROM s)
    SELECT catalog, position, site_key, CASE WHEN position > first THEN 'duplicate_site_key' WHEN k = 1 THEN 'document_url' WHEN k = 2 THEN 'sample_download_limit' END AS error FROM f
    UNION ALL SELECT c.catalog, NULL, w.site_key, 'required_site_missing' FROM (SELECT DISTINCT catalog FROM s) c, (VALUES ('soa'), ('cas'), ('iaa')) w(site_key) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.catalog = c.catalog AND s.site_key = w.site_key)"""
)
def dev_catalog_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Development targets of each nation; by its number an entry breaks one rule or none, and a nation may lack a site."""
    k, n = F.col("s_suppkey") % 5, F.col("s_suppkey").cast("string")
    key = F.get(F.array(F.lit("SOA"), F.lit("cas "), F.lit("iaa"), F.concat(F.lit("x"), n)), (F.col("s_suppkey") % 4).cast("int"))
    fields = {f: F.lit("https://a.org") for f in catalogs.DEV_URLS} | {f: F.lit(1) for f in catalogs.DEV_NUMBERS} | {"site_key": key, "site_name": F.col("s_name"), "document_url": F.when(k == 1, "/doc").otherwise("https://a.org"), "sample_download_limit": F.when(k == 2, -1).otherwise(0)}
    entries = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("catalog"), F.col("s_suppkey").alias("position"), F.to_json(F.struct(*[v.alias(f) for f, v in fields.items()])).alias("entry"))
    return catalogs.dev_errors(entries, "catalog")
