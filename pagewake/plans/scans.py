"""Queries that scan, filter, sort and look up; joins of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewake.functions import texts, urls
from pagewake.operators import state
from pagewake.plans.registry import register
from pagewake.sources import views
from pagewake.sources.tables import table
from pagewake.sources.views import ATTEMPTS, CHANGES, FILES, JOBS, SNAPSHOTS

SINCE = "2024-01-15 00:00:00"


@register(f"WITH {CHANGES} SELECT * FROM changes WHERE site_id = 7 AND detected_at >= TIMESTAMP '{SINCE}'")
def changes_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.changes(spark, sf_dir).where((F.col("site_id") == 7) & (F.col("detected_at") >= F.lit(SINCE).cast("timestamp_ntz"))).orderBy(F.col("detected_at").desc(), F.col("id").desc())


@register("SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src3' AND lang = 'en' ORDER BY doc_id DESC")
def documents_of_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("source = 'src3' AND lang = 'en'").select("doc_id", "lang", "n_chars").orderBy(F.col("doc_id").desc())


@register(f"WITH {JOBS} SELECT * FROM jobs WHERE job_type = '1-URGENT' ORDER BY finished_at DESC NULLS LAST, job_id DESC LIMIT 50")
def jobs_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.top(views.jobs(spark, sf_dir).where("job_type = '1-URGENT'"), 50, F.col("finished_at").desc_nulls_last(), F.col("job_id").desc())


@register(f"WITH {JOBS} SELECT scope_id, max((finished_at, job_id))[2] AS job_id, max(finished_at) AS finished_at, arg_max(status, (finished_at, job_id)) AS status FROM jobs GROUP BY scope_id")
def job_latest_of_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("finished_at", "job_id")
    return views.jobs(spark, sf_dir).groupBy("scope_id").agg(F.max(at)["job_id"].alias("job_id"), F.max("finished_at").alias("finished_at"), F.max_by("status", at).alias("status"))


@register(f"WITH {JOBS} SELECT scope_id, max((finished_at, job_id))[2] AS job_id FROM jobs WHERE status = 'F' GROUP BY scope_id")
def job_latest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest finished job of each scope."""
    return views.jobs(spark, sf_dir).where("status = 'F'").groupBy("scope_id").agg(F.max(F.struct("finished_at", "job_id"))["job_id"].alias("job_id"))


@register(f"WITH {SNAPSHOTS} SELECT DISTINCT site, canonical_url FROM snapshots ORDER BY 1, 2")
def tracked_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.snapshots(spark, sf_dir).select("site", "canonical_url").distinct().orderBy("site", "canonical_url")


@register(f"WITH {SNAPSHOTS} SELECT id, canonical_url, content_hash FROM snapshots WHERE run_id = 2")
def snapshots_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.snapshots(spark, sf_dir).where("run_id = 2").select("id", "canonical_url", "content_hash")


@register(f"WITH {ATTEMPTS} SELECT request_id, position, executor FROM attempts")
def attempts_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.attempts(spark, sf_dir).select("request_id", "position", "executor").orderBy("request_id", "position", "executor")


@register(f"WITH {FILES} SELECT download_url, min(id) AS id, arg_min(sha256, id) AS sha256 FROM files GROUP BY download_url")
def document_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.file_observations(spark, sf_dir).groupBy("download_url").agg(F.min("id").alias("id"), F.min_by("sha256", "id").alias("sha256"))


@register(f"WITH {FILES} SELECT sha256, min(id) AS id, count(*) AS copies FROM files GROUP BY sha256")
def document_by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.file_observations(spark, sf_dir).groupBy("sha256").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


@register("SELECT 'dev' AS catalog, s_suppkey AS site_key, s_name AS name FROM supplier WHERE s_suppkey <= 3 UNION ALL SELECT 'smoke', s_suppkey, s_name FROM supplier")
def catalog_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site_key"), F.col("s_name").alias("name"))
    return s.where("site_key <= 3").select(F.lit("dev").alias("catalog"), "*").unionByName(s.select(F.lit("smoke").alias("catalog"), "*"))


@register("SELECT s_suppkey AS site_key, list_filter([CASE WHEN s_acctbal < 0 THEN 'balance' END, CASE WHEN s_nationkey > 20 THEN 'nation' END, CASE WHEN length(s_name) = 0 THEN 'name' END], lambda x: x IS NOT NULL) AS errors FROM supplier")
def catalog_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("site_key"), F.array_compact(F.array(F.when(F.col("s_acctbal") < 0, "balance"), F.when(F.col("s_nationkey") > 20, "nation"), F.when(F.length("s_name") == 0, "name"))).alias("errors"))


@register(f"WITH {SNAPSHOTS}, {FILES}, tp AS (SELECT page_id, arg_max(canonical_url, id) AS page_url FROM snapshots GROUP BY page_id), tf AS (SELECT download_url, arg_max(id, (run_id, id)) AS latest_document_id FROM files GROUP BY download_url) SELECT f.id, f.download_url, coalesce(tp.page_url, '') AS page_url, d.lang, d.n_chars FROM files f LEFT JOIN tf USING (download_url) JOIN documents d ON d.doc_id = coalesce(CASE WHEN f.id % 4 > 0 THEN f.id END, tf.latest_document_id) LEFT JOIN tp ON tp.page_id = f.page_id")
def scope_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed files with their document, or else the file's latest one, and their page."""
    f = views.file_observations(spark, sf_dir)
    pages = views.snapshots(spark, sf_dir).groupBy("page_id").agg(F.max_by("canonical_url", "id").alias("page_url"))
    latest = f.groupBy("download_url").agg(F.max(F.struct("run_id", "id"))["id"].alias("latest_document_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    wanted = f.join(latest, "download_url", "left").withColumn("doc_id", F.coalesce(F.when(F.col("id") % 4 > 0, F.col("id")), "latest_document_id"))
    return wanted.join(docs, "doc_id").join(pages, "page_id", "left").select("id", "download_url", F.coalesce("page_url", F.lit("")).alias("page_url"), "lang", "n_chars")


@register(f"WITH {SNAPSHOTS}, {FILES} SELECT s.run_id, f.id, s.canonical_url FROM snapshots s JOIN files f ON f.page_id = s.page_id AND f.run_id = s.run_id")
def observations_with_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.snapshots(spark, sf_dir).drop("id", "site").join(views.file_observations(spark, sf_dir), ["page_id", "run_id"]).select("run_id", "id", "canonical_url")


@register(f"WITH {FILES} SELECT sha256 FROM files WHERE run_id = 1 EXCEPT SELECT sha256 FROM files WHERE run_id = 2")
def prunable_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests that no reference of the later run holds."""
    f = views.file_observations(spark, sf_dir)
    return f.where("run_id = 1").join(f.where("run_id = 2"), "sha256", "left_anti").select("sha256").distinct()


@register(f"WITH {SNAPSHOTS}, {FILES} SELECT id, page_id FROM files f WHERE NOT EXISTS (SELECT 1 FROM snapshots s WHERE s.page_id = f.page_id AND s.run_id = f.run_id)")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.file_observations(spark, sf_dir).join(views.snapshots(spark, sf_dir).select("page_id", "run_id").distinct(), ["page_id", "run_id"], "left_anti").select("id", "page_id")


@register(f"WITH {FILES}, n AS (SELECT *, row_number() OVER (PARTITION BY download_url ORDER BY id) AS a, row_number() OVER (PARTITION BY sha256 ORDER BY id) AS b FROM files) SELECT id, CASE WHEN a > 1 THEN 'url' WHEN b > 1 THEN 'digest' ELSE 'none' END AS duplicate_reason FROM n")
def duplicate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an earlier file has the URL, or else the digest."""
    f = views.file_observations(spark, sf_dir).select("id", "download_url", "sha256")
    by_url = f.groupBy("download_url").agg(F.min("id").alias("of_url"))
    by_digest = f.groupBy(F.col("sha256").alias("digest")).agg(F.min("id").alias("of_digest"))
    both = f.join(by_url, "download_url").join(by_digest, F.col("sha256").eqNullSafe(F.col("digest")))
    return both.select("id", F.when(F.col("id") > F.col("of_url"), "url").when(F.col("id") > F.col("of_digest"), "digest").otherwise("none").alias("duplicate_reason"))


@register(f"WITH {views.CAPTURES}, l AS (SELECT page_id, run_id, CASE WHEN run_id = 1 AND page_id % 2 = 0 THEN [] ELSE {views.LINKS} END AS links FROM captures) SELECT a.page_id, list_filter(b.links, lambda x: NOT list_contains(a.links, x)) AS new_links FROM l a JOIN l b ON a.page_id = b.page_id AND a.run_id = 1 AND b.run_id = 2")
def new_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the second run that the first run lacks, repeats kept; of every second page, the first run kept none."""
    c = views.captures(spark, sf_dir).select("page_id", "run_id", texts.links(F.col("html")).alias("links"))
    a, b = c.where("run_id = 1").select("page_id", F.when(F.col("page_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.col("links")).alias("old")), c.where("run_id = 2").select("page_id", "links")
    return a.join(b, "page_id").select("page_id", texts.new_items(F.col("links"), F.col("old")).alias("new_links"))


@register(f"SELECT page_id, unnest({views.ABSOLUTE}) AS link FROM pages")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(texts.absolute_links(F.col("html"), F.col("url"))).alias("link"))


@register(f"WITH e AS (SELECT page_id, {views.sql_origin('url')} AS site, unnest({views.ABSOLUTE}) AS link FROM pages) SELECT site, count(*) AS n_links, count(DISTINCT link) AS n_targets, count(*) FILTER (regexp_matches(lower({views.sql_path('link')}), '\\.(pdf|docx|doc|xlsx|xls|pptx|ppt)$')) AS n_documents FROM e GROUP BY site")
def site_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(urls.origin(F.col("url")).alias("site"), "url", "html")
    e = p.select("site", F.explode(texts.absolute_links(F.col("html"), F.col("url"))).alias("link"))
    return e.groupBy("site").agg(F.count("*").alias("n_links"), F.count_distinct("link").alias("n_targets"), F.count_if(urls.is_document(F.col("link"))).alias("n_documents"))
