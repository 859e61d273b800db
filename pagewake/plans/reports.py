"""Queries of the change report, the baseline summary and the period analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewake.operators import changes, planning, review, summary
from pagewake.plans.changes import _BETWEEN, _cdc
from pagewake.plans.registry import register
from pagewake.sources import views
from pagewake.sources.views import CHANGES, FILES, SNAPSHOTS, sql_path, sql_prefix, sql_segments

RULES = (
    {"rule_type": "change_type", "match_value": "missing", "severity": "critical", "weight": 5, "reason_template": "{entity_url} is {change_type}", "recommended_action": "check_page"},
    {"rule_type": "prefix", "match_value": "/de", "severity": "high", "weight": 1, "reason_template": "{change_type} under /de", "recommended_action": "review_change"},
    {"rule_type": "keyword", "match_value": "utm", "severity": "low", "weight": 9, "reason_template": "tracking", "recommended_action": "ignore"},
    {"rule_type": "prefix", "match_value": "/en/1", "severity": "high", "weight": 3, "reason_template": "{severity} page", "recommended_action": "review_change"},
    {"rule_type": "file_type", "match_value": ".pdf", "severity": "medium", "weight": 2, "reason_template": "file", "recommended_action": "read_file"},
)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed pages, and the files seen on them in run 2."""
    pages = views.snapshots(spark, sf_dir).groupBy("page_id").agg(F.max_by("canonical_url", "id").alias("url"), F.max_by("site", "id").alias("site"))
    page_items = _cdc(spark, sf_dir).where("change <> 'same'").join(pages, "page_id").select("site", F.col("change").alias("change_type"), "url", F.lit(None).cast("string").alias("doc_type"))
    file_items = views.file_observations(spark, sf_dir).where("run_id = 2").select("site", F.lit("new_file").alias("change_type"), F.col("download_url").alias("url"), "doc_type")
    return page_items.unionByName(file_items.dropDuplicates(["url"]).drop("doc_type").withColumn("doc_type", F.lit("pdf")))


_MATCH = " ".join(
    f"WHEN {cond} THEN {i}"
    for i, cond in (
        (0, "change_type = 'missing'"),
        (3, f"starts_with({sql_path('url')}, '/en/1')"),
        (1, f"starts_with({sql_path('url')}, '/de')"),
        (4, "doc_type = 'pdf' OR ends_with(lower(url), '.pdf') OR contains(lower(url), '/pdf')"),
        (2, "contains(lower(url), 'utm')"),
    )
)
_ITEMS = f"""{_BETWEEN}, {FILES}, pg AS (SELECT page_id, arg_max(canonical_url, id) AS url, arg_max(site, id) AS site FROM snapshots GROUP BY page_id),
items AS (SELECT pg.site, change AS change_type, pg.url, NULL::VARCHAR AS doc_type FROM cdc JOIN pg USING (page_id) WHERE change <> 'same'
  UNION ALL SELECT any_value(site), 'new_file', download_url, 'pdf' FROM files WHERE run_id = 2 GROUP BY download_url),
m AS (SELECT *, CASE {_MATCH} END AS matched_rule FROM items),
reviewed AS (SELECT *, CASE matched_rule WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 3 THEN 'high' WHEN 4 THEN 'medium' WHEN 2 THEN 'low' ELSE CASE change_type WHEN 'new_file' THEN 'high' ELSE 'medium' END END AS severity,
  CASE matched_rule WHEN 0 THEN 5 WHEN 1 THEN 1 WHEN 2 THEN 9 WHEN 3 THEN 3 WHEN 4 THEN 2 ELSE 0 END AS policy_weight FROM m)"""


@register(
    f"""WITH {_ITEMS} SELECT site, change_type, url, matched_rule, severity, policy_weight,
    CASE matched_rule WHEN 0 THEN url || ' is ' || change_type WHEN 1 THEN change_type || ' under /de' WHEN 2 THEN 'tracking' WHEN 3 THEN severity || ' page' WHEN 4 THEN 'file' ELSE change_type || ' matched fallback change severity `' || severity || '`.' END AS reason,
    CASE matched_rule WHEN 0 THEN 'check_page' WHEN 2 THEN 'ignore' WHEN 4 THEN 'read_file' ELSE 'review_change' END AS recommended_action FROM reviewed"""
)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviewed = review.evaluate(_items(spark, sf_dir), RULES, ("url", "doc_type"))
    return reviewed.orderBy(*review.queue_order()).select("site", "change_type", "url", "matched_rule", "severity", "policy_weight", "reason", "recommended_action")


@register(
    f"""WITH {_ITEMS} SELECT site, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'high') AS n_high, count(*) FILTER (severity = 'medium') AS n_medium, count(*) FILTER (severity = 'low') AS n_low,
    arg_min(severity, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS highest, count(*) AS n_items,
    CASE WHEN count(*) FILTER (severity IN ('critical', 'high')) > 0 THEN 'review_now' ELSE 'review_later' END AS decision FROM reviewed GROUP BY site"""
)
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = review.summary(review.evaluate(_items(spark, sf_dir), RULES, ("url", "doc_type")), ["site"])
    return s.withColumn("decision", review.decision(F.col("n_critical") + F.col("n_high"), F.col("n_items")))


@register(
    f"""WITH {SNAPSHOTS}, st AS (SELECT page_id, min(run_id) AS first_seen, max(run_id) AS last_seen FROM snapshots GROUP BY page_id), cur AS (SELECT * FROM snapshots WHERE run_id = 2), prev AS (SELECT page_id, arg_max(content_hash, id) AS old FROM snapshots WHERE run_id < 2 GROUP BY page_id)
    SELECT st.page_id, CASE WHEN st.first_seen = 2 THEN 'new' WHEN st.last_seen = 2 AND prev.old <> '' AND prev.old <> cur.content_hash THEN 'changed' WHEN st.last_seen < 2 THEN 'missing' END AS change_type FROM st LEFT JOIN cur USING (page_id) LEFT JOIN prev USING (page_id)
    WHERE st.first_seen = 2 OR st.last_seen < 2 OR (prev.old <> '' AND prev.old <> cur.content_hash)"""
)
def report_page_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page changes of run 2, from the state as of that run, its snapshots and the ones before."""
    s = views.snapshots(spark, sf_dir)
    state = s.groupBy("page_id").agg(F.min("run_id").alias("first_seen"), F.max("run_id").alias("last_seen"))
    now = s.where("run_id = 2").select("page_id", "content_hash")
    old = changes.before_run(s, ["page_id"], "run_id", 2, "content_hash", "id")
    kind = F.when(F.col("first_seen") == 2, "new").when(F.col("last_seen") < 2, "missing").when((F.col("previous_content_hash") != "") & (F.col("previous_content_hash") != F.col("content_hash")), "changed")
    return state.join(now, "page_id", "left").join(old, "page_id", "left").select("page_id", kind.alias("change_type")).where("change_type IS NOT NULL")


def _sql_levels(rows: str, name: str) -> str:
    return f"SELECT level, directory, count(*) AS {name} FROM (SELECT unnest([1, 2]) AS level, unnest([{sql_prefix('path', 1)}, {sql_prefix('path', 2)}]) AS directory FROM {rows}) GROUP BY ALL"


_OBSERVED = f"{SNAPSHOTS}, {FILES}, pr AS (SELECT * FROM snapshots WHERE run_id = 1), fr AS (SELECT f.id, s.path, s.canonical_url FROM files f JOIN snapshots s ON s.page_id = f.page_id AND s.run_id = f.run_id WHERE f.run_id = 1)"


DIRECTORIES = f"WITH {_OBSERVED}, a AS ({_sql_levels('pr', 'pages')}), b AS ({_sql_levels('fr', 'files')}), c AS (SELECT 1 AS level, '/research' AS directory) SELECT 1 AS run_id, coalesce(a.level, b.level, c.level) AS level, coalesce(a.directory, b.directory, c.directory) AS directory, coalesce(pages, 0) AS pages, coalesce(files, 0) AS files FROM a FULL JOIN b ON a.level = b.level AND a.directory = b.directory FULL JOIN c ON c.level = coalesce(a.level, b.level) AND c.directory = coalesce(a.directory, b.directory)"


@register(DIRECTORIES)
def baseline_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.snapshots(spark, sf_dir).where("run_id = 1").select("run_id", "page_id", "path")
    files = views.file_observations(spark, sf_dir).where("run_id = 1").select("page_id").join(pages, "page_id").select("run_id", "path")
    chosen = spark.range(1).select(F.lit(1).alias("run_id"), F.lit(1).alias("level"), F.lit("/research").alias("directory"))
    return summary.directories(pages, files, ["run_id"], "path", chosen)


@register(f"WITH {_OBSERVED} SELECT canonical_url, count(*) AS file_count FROM fr GROUP BY canonical_url ORDER BY count(*) DESC, min(id) LIMIT 12")
def top_source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.snapshots(spark, sf_dir).where("run_id = 1").select("page_id", "canonical_url")
    seen = views.file_observations(spark, sf_dir).where("run_id = 1").join(pages, "page_id")
    counted = seen.groupBy("canonical_url").agg(F.count("*").alias("file_count"), F.min("id").alias("first"))
    return counted.orderBy(F.col("file_count").desc(), "first").limit(12).select("canonical_url", "file_count")


@register(f"WITH {_OBSERVED}, n AS (SELECT site, count(*) AS pages FROM pr GROUP BY site), f AS (SELECT s.site, count(*) AS files FROM files f JOIN snapshots s ON s.page_id = f.page_id AND s.run_id = f.run_id WHERE f.run_id = 1 GROUP BY s.site) SELECT n.site, pages, coalesce(files, 0) AS files, pages >= 5 AS truncated, CASE WHEN pages >= 5 THEN 'low' WHEN coalesce(files, 0) = 0 THEN 'medium' ELSE 'high' END AS confidence FROM n LEFT JOIN f ON f.site = n.site")
def baseline_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page budget of five for each site."""
    s = views.snapshots(spark, sf_dir).where("run_id = 1").select("site", "page_id")
    files = views.file_observations(spark, sf_dir).where("run_id = 1").select("page_id").join(s, "page_id").groupBy("site").agg(F.count("*").alias("files"))
    n = s.groupBy("site").agg(F.count("*").alias("pages")).join(files, "site", "left").withColumn("files", F.coalesce("files", F.lit(0)))
    cut = summary.truncated(F.lit(None).cast("int"), F.col("pages"), F.lit(5))
    none = F.lit(0)
    return n.withColumn("truncated", cut).withColumn("confidence", summary.confidence(F.col("pages"), F.col("files"), F.col("truncated"), none, none))


@register(
    f"""WITH {SNAPSHOTS}, chosen AS (SELECT DISTINCT site, {sql_prefix('path', 1)} AS prefix FROM snapshots WHERE run_id = 1), seen AS (SELECT DISTINCT site, path FROM snapshots WHERE run_id = 2)
    SELECT site, prefix FROM chosen c WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.site = c.site AND (c.prefix = '/' OR s.path = c.prefix OR starts_with(s.path, c.prefix || '/')))"""
)
def low_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-level prefixes of run 1 under which run 2 saw nothing."""
    from pagewake.functions import urls

    s = views.snapshots(spark, sf_dir)
    chosen = s.where("run_id = 1").select("site", urls.path_prefix(F.col("path"), 1).alias("prefix")).distinct()
    return summary.low_coverage(chosen, s.where("run_id = 2").select("site", F.col("path").alias("prefix")).distinct(), "site", "prefix")


@register(
    f"""WITH {SNAPSHOTS}, two AS (SELECT DISTINCT site, {sql_prefix('path', 2)} AS prefix FROM snapshots WHERE run_id = 2 AND len({sql_segments('path')}) >= 2), roots AS (SELECT DISTINCT site, {sql_prefix('path', 1)} AS prefix FROM snapshots WHERE run_id = 1)
    SELECT t.site, t.prefix FROM two t JOIN roots r ON r.site = t.site AND (r.prefix = t.prefix OR starts_with(t.prefix, r.prefix || '/')) WHERE NOT EXISTS (SELECT 1 FROM snapshots f WHERE f.run_id = 1 AND f.site = t.site AND f.path = t.prefix)"""
)
def unselected_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches seen in run 2 below the roots of run 1 that its pages didn't cover."""
    from pagewake.functions import urls

    s = views.snapshots(spark, sf_dir)
    two = s.where((F.col("run_id") == 2) & (urls.path_level(F.col("path")) >= 2)).select("site", urls.path_prefix(F.col("path"), 2).alias("prefix")).distinct()
    roots = s.where("run_id = 1").select("site", urls.path_prefix(F.col("path"), 1).alias("prefix")).distinct()
    focus = s.where("run_id = 1").select("site", F.col("path").alias("prefix")).distinct()
    return planning.covered_by(two, roots, "site", "prefix").join(focus, ["site", "prefix"], "left_anti")


@register(f"WITH {CHANGES} SELECT change_type, count(*) AS n, count(DISTINCT site_id) AS n_sites, list_sort(list(DISTINCT site_id))[1:5] AS first_sites FROM changes WHERE detected_at >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY change_type")
def period_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.changes(spark, sf_dir).where(F.col("detected_at") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    per_site = c.groupBy("change_type", "site_id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("change_type").orderBy("site_id"))
    first = per_site.where("site_id IS NOT NULL").withColumn("_r", rank).where("_r <= 5").groupBy("change_type").agg(F.array_sort(F.collect_list("site_id")).alias("first_sites"))
    return per_site.groupBy("change_type").agg(F.sum("n").alias("n"), F.count("*").alias("n_sites")).join(first, "change_type", "left")


@register(f"WITH {FILES} SELECT site, doc_type, count(*) AS n, sum(file_size)::BIGINT AS bytes FROM files GROUP BY ALL")
def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.file_observations(spark, sf_dir).groupBy("site", F.coalesce(F.when(F.col("doc_type") != "", F.col("doc_type")), F.lit("unknown")).alias("doc_type")).agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"))


@register(f"WITH {FILES}, {SNAPSHOTS}, pg AS (SELECT page_id, arg_max(canonical_url, id) AS page_url FROM snapshots GROUP BY page_id), n AS (SELECT *, row_number() OVER (PARTITION BY run_id, download_url ORDER BY id) AS nth FROM files) SELECT n.id, 'item-' || substr(sha256(n.run_id::VARCHAR || ':' || n.download_url), 1, 16) AS item_id, 'sha256-' || substr(sha256, 1, 16) AS asset_id, coalesce(page_url, '') AS page_url FROM n LEFT JOIN pg USING (page_id) WHERE nth = 1")
def manifest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first observation of each file in a run, with its identities."""
    from pagewake.functions import identity
    from pagewake.operators import state

    first = state.first_by(views.file_observations(spark, sf_dir), ["run_id", "download_url"], F.col("id"))
    pages = views.snapshots(spark, sf_dir).groupBy("page_id").agg(F.max_by("canonical_url", "id").alias("page_url"))
    return first.join(pages, "page_id", "left").select("id", identity.item_id(F.col("run_id"), F.col("download_url")).alias("item_id"), identity.asset_id(F.col("sha256"), F.col("id")).alias("asset_id"), F.coalesce("page_url", F.lit("")).alias("page_url"))


@register()
def manifest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON manifest for each run and site; an envelope holds a site's items."""
    item = F.struct("id", "item_id", "asset_id", "page_url")
    items = manifest_items(spark, sf_dir).join(views.file_observations(spark, sf_dir).select("id", "run_id", "site"), "id")
    return items.groupBy("run_id", "site").agg(F.to_json(F.struct(F.lit("v1").alias("version"), F.count("*").alias("count"), F.array_sort(F.collect_list(item)).alias("discovered_items"))).alias("manifest"))
