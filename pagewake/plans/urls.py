"""Queries over URLs, paths and identity keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewake.functions import identity, urls
from pagewake.operators import planning
from pagewake.plans.registry import register
from pagewake.sources import views
from pagewake.sources.tables import table
from pagewake.sources.views import sql_canonical, sql_origin, sql_path, sql_prefix, sql_request, sql_segments

PATH = sql_path("url")


@register(f"SELECT page_id, {sql_request('url')} AS request_url, {sql_canonical('url')} AS canonical_url, {sql_origin('url')} AS origin, {PATH} AS path FROM pages")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.request_url(u).alias("request_url"), urls.canonical_url(u).alias("canonical_url"), urls.origin(u).alias("origin"), urls.path_of(u).alias("path"))


def _sql_in(path: str, prefixes: list[str]) -> str:
    return "(" + " OR ".join(f"{path} = '{p}' OR starts_with({path}, '{p}/')" for p in prefixes) + ")"


@register(
    f"""SELECT page_id, {_sql_in(PATH, ['/en', '/de'])} AS in_page_scope, {_sql_in(PATH, ['/fr'])} AS in_file_scope, true AS under_root, false AS under_none,
    {sql_origin('url')} = 'https://example.org' AND {_sql_in(PATH, ['/en'])} AS in_one_scope FROM pages"""
)
def url_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    some = lambda *p: F.array(*map(F.lit, p)).cast("array<string>")
    path = urls.path_of(u)
    return table(spark, sf_dir, "pages").select(
        "page_id",
        urls.matches_prefixes(path, some("/en", "/de")).alias("in_page_scope"),
        urls.matches_prefixes(path, some("/fr")).alias("in_file_scope"),
        urls.matches_prefixes(path, some("/")).alias("under_root"),
        urls.matches_prefixes(path, some()).alias("under_none"),
        urls.in_scope(u, F.lit("https://example.org"), some("/en")).alias("in_one_scope"),
    )


@register(
    f"""SELECT page_id, len({sql_segments(PATH)}) AS level, {sql_prefix(PATH, 1)} AS level1, {sql_prefix(PATH, 2)} AS level2,
    list_transform(range(1, least(len({sql_segments(PATH)}), 3) + 1), lambda i: '/' || list_aggregate({sql_segments(PATH)}[1:i], 'string_agg', '/')) AS sections FROM pages"""
)
def url_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = urls.path_of(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", urls.path_level(path).cast("bigint").alias("level"), urls.path_prefix(path, 1).alias("level1"), urls.path_prefix(path, 2).alias("level2"), urls.section_prefixes(path, 3).alias("sections"))


@register(
    f"""WITH t AS (SELECT page_id, url, regexp_replace(lower({views.NETLOC.format(u='url')}), '^.*@|:[0-9]+$', '') AS host FROM pages)
    SELECT page_id, host, host = 'example.org' OR ends_with(host, '.example.org') OR host = 'example.com' OR ends_with(host, '.example.com') AS allowed,
    NOT (lower({views.SCHEME.format(u='url')}) = 'http') AS redirect_allowed,
    CASE WHEN regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') = '' THEN 'site' ELSE regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END AS slug,
    substr(regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 1, 80) AS component FROM t"""
)
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        urls.host(u).alias("host"),
        urls.domain_allowed(urls.host(u), ["example.org", "example.com"]).alias("allowed"),
        urls.redirect_allowed(F.lit("https://a.b/"), u).alias("redirect_allowed"),
        urls.slug(u, "site").alias("slug"),
        urls.file_component(u).alias("component"),
    )


@register(
    f"""WITH {views.FILES} SELECT id, '_blobs/' || substr(sha256, 1, 2) || '/' || sha256 || '.pdf' AS blob_path,
    '_tracked/' || site || '.example.org/files/' || regexp_extract(download_url, '([^/]*)\\.pdf$', 1) || '--' || substr(sha256, 1, 8) || '.pdf' AS tracked_path,
    true AS is_document, 'sha256-' || substr(sha256, 1, 16) AS asset_id, 'document-' || id::VARCHAR AS bare_id,
    'item-' || substr(sha256(run_id::VARCHAR || ':' || download_url), 1, 16) AS item_id FROM files"""
)
def url_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.file_observations(spark, sf_dir)
    page = F.concat(F.lit("https://"), "site", F.lit(".example.org/files"))
    return f.select(
        "id",
        urls.blob_path(F.col("sha256"), F.col("download_url")).alias("blob_path"),
        urls.tracked_path(page, F.col("download_url"), F.col("sha256")).alias("tracked_path"),
        urls.is_document(F.col("download_url")).alias("is_document"),
        identity.asset_id(F.col("sha256"), F.col("id")).alias("asset_id"),
        identity.asset_id(F.lit(None).cast("string"), F.col("id")).alias("bare_id"),
        identity.item_id(F.col("run_id"), F.col("download_url")).alias("item_id"),
    )


@register(
    f"""WITH t AS (SELECT page_id, {PATH} || '//' AS raw FROM pages),
    n AS (SELECT page_id, CASE WHEN regexp_replace(raw, '/+$', '') = '' THEN '/' ELSE '/' || regexp_replace(regexp_replace(raw, '^/+', ''), '/+$', '') END AS prefix FROM t)
    SELECT page_id, prefix, prefix = '/en' OR starts_with(prefix, '/en/') AS covered, true AS under_root FROM n"""
)
def url_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(urls.path_of(F.col("url")), F.lit("//"))
    return table(spark, sf_dir, "pages").select("page_id", urls.normal_prefix(raw).alias("prefix"), urls.covers(F.lit("en/"), raw).alias("covered"), urls.covers(F.lit("/"), raw).alias("under_root"))


_SITE_PREFIXES = f"""{views.SNAPSHOTS}, prefixes AS (
  SELECT DISTINCT site, prefix FROM (SELECT site, {sql_prefix('path', 1)} AS prefix FROM snapshots UNION ALL SELECT site, {sql_prefix('path', 2)} FROM snapshots)
)"""


@register(f"WITH {_SITE_PREFIXES} SELECT site, prefix FROM prefixes p WHERE NOT EXISTS (SELECT 1 FROM prefixes q WHERE q.site = p.site AND q.prefix <> p.prefix AND (q.prefix = '/' OR starts_with(p.prefix, q.prefix || '/')))")
def prefixes_minimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.minimal_prefixes(planning.site_prefixes(views.snapshots(spark, sf_dir)), "site", "prefix")


@register(
    f"""WITH {_SITE_PREFIXES}, chosen AS (SELECT * FROM prefixes WHERE length(prefix) % 2 = 1),
    minimal AS (SELECT * FROM chosen p WHERE NOT EXISTS (SELECT 1 FROM chosen q WHERE q.site = p.site AND q.prefix <> p.prefix AND starts_with(p.prefix, q.prefix || '/'))),
    rejected AS (SELECT * FROM prefixes WHERE length(prefix) % 2 = 0)
    SELECT site, prefix, 'allowed' AS role FROM minimal
    UNION ALL SELECT site, prefix, 'focus' FROM chosen c WHERE NOT EXISTS (SELECT 1 FROM minimal m WHERE m.site = c.site AND m.prefix = c.prefix)
    UNION ALL SELECT site, prefix, 'excluded' FROM rejected r WHERE NOT EXISTS (SELECT 1 FROM minimal m WHERE m.site = r.site AND (m.prefix = r.prefix OR starts_with(r.prefix, m.prefix || '/') OR starts_with(m.prefix, r.prefix || '/')))"""
)
def scope_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes of odd length are selected, the others rejected."""
    prefixes = planning.site_prefixes(views.snapshots(spark, sf_dir))
    return planning.plan_scope(prefixes.withColumn("selected", F.length("prefix") % 2 == 1), "site", "prefix", "selected")


@register(
    f"""WITH {_SITE_PREFIXES}, lists AS (SELECT site, list(DISTINCT prefix ORDER BY prefix) AS p FROM prefixes GROUP BY site)
    SELECT site, sha256('{{"allowed_file_prefixes":["/"],"allowed_page_prefixes":[' || list_aggregate(list_transform(p, lambda x: '"' || x || '"'), 'string_agg', ',') || '],"fetch_mode":"http","seed_url":"' || site || '"}}') AS fingerprint FROM lists"""
)
def scope_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scope for each site, of all its prefixes."""
    lists = planning.site_prefixes(views.snapshots(spark, sf_dir)).groupBy("site").agg(F.collect_set("prefix").alias("p"))
    return lists.select("site", identity.scope_fingerprint(F.concat("site", F.lit("/")), F.col("p"), F.array(F.lit("/")), F.lit("http")).alias("fingerprint"))


@register(
    f"""WITH {_SITE_PREFIXES}, lists AS (SELECT site, list(DISTINCT prefix ORDER BY prefix) AS p FROM prefixes GROUP BY site)
    SELECT site, sha256('{{"algorithm":"monitor-scope-semantic.v2","allowed_file_prefixes":["/"],"allowed_page_prefixes":[' || list_aggregate(list_transform(p, lambda x: '"' || x || '"'), 'string_agg', ',') || '],"file_scope_mode":"site_root","homepage_url":"' || site || '","max_depth":3,"max_files":20,"max_pages":' || len(p) || ',"seed_url":"' || site || '","site_key":"' || site || '","tree_strategy":"sections"}}') AS fingerprint FROM lists"""
)
def semantic_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan for each site, of all its prefixes."""
    lists = planning.site_prefixes(views.snapshots(spark, sf_dir)).groupBy("site").agg(F.collect_set("prefix").alias("p"))
    home = F.concat("site", F.lit("/"))
    return lists.select("site", identity.semantic_fingerprint(F.col("site"), home, home, F.col("p"), F.array(F.lit("/")), F.lit("sections"), F.lit("site_root"), F.lit(3), F.size("p"), F.lit(20)).alias("fingerprint"))


@register(f"""WITH s AS (SELECT DISTINCT {sql_origin('url')} AS site FROM pages) SELECT site, sha256('{{"canonical_origin":"' || site || '","identity_sha256":"' || sha256('monitor') || '","policy_version":"access-policy.v1"}}') AS cache_key FROM s""")
def policy_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "pages").select(urls.origin(F.col("url")).alias("site")).distinct()
    return s.select("site", identity.policy_key(F.col("site"), F.sha2(F.lit("monitor"), 256)).alias("cache_key"))


_ARTIFACT = """substr(sha256('{"manifest_version":"acquisition-manifest.v1","normalized_source_identity":"' || download_url || '","sha256":' || coalesce('"' || sha256 || '"', 'null') || ',"source_run_id":"' || run_id || '"}'), 1, 24)"""


@register(
    f"""WITH {views.FILES}, a AS (SELECT id, {_ARTIFACT} AS digest FROM files) SELECT id, 'artifact-' || digest AS artifact_id, 'version-' || digest AS version_id,
    'lineage-' || substr(sha256('{{"artifact_id":"artifact-' || digest || '","ordinal":' || id % 3 || ',"related_artifact_id":"artifact-0","relation":"derived_from"}}'), 1, 24) AS lineage_id FROM a"""
)
def artifact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.file_observations(spark, sf_dir)
    of = F.col("run_id").cast("string"), F.col("download_url"), F.col("sha256")
    ids = f.select("id", identity.artifact_id(*of).alias("artifact_id"), identity.version_id(*of).alias("version_id"))
    return ids.withColumn("lineage_id", identity.lineage_id(F.col("artifact_id"), F.lit("derived_from"), F.lit("artifact-0"), F.col("id") % 3))
