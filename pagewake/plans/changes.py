"""Queries over crawl runs: state, changes and their counters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewake.operators import changes, state
from pagewake.plans.registry import register
from pagewake.sources import views
from pagewake.sources.folders import shared_folder
from pagewake.streaming import changes as streaming

_BETWEEN = f"""{views.SNAPSHOTS}, a AS (SELECT site, page_id, content_hash FROM snapshots WHERE run_id = 1), b AS (SELECT site, page_id, content_hash FROM snapshots WHERE run_id = 2),
cdc AS (SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.site, b.site) AS site,
  CASE WHEN a.page_id IS NULL THEN 'new' WHEN b.page_id IS NULL THEN 'missing' WHEN a.content_hash <> '' AND a.content_hash <> b.content_hash THEN 'changed' ELSE 'same' END AS change,
  a.content_hash AS old_hash, b.content_hash AS new_hash FROM a FULL JOIN b ON a.page_id = b.page_id)"""


def _cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.snapshots(spark, sf_dir)
    return changes.between(s.where("run_id = 1"), s.where("run_id = 2"), "page_id", "content_hash")


@register(f"WITH {_BETWEEN} SELECT page_id, change, old_hash, new_hash FROM cdc")
def cdc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cdc(spark, sf_dir)


@register(f"WITH {_BETWEEN} SELECT page_id, CASE WHEN change = 'missing' AND page_id % 2 = 1 THEN 'unknown' ELSE change END AS change FROM cdc")
def cdc_pages_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an incomplete run: only confirmed not-found pages (even ids) are missing."""
    s = views.snapshots(spark, sf_dir)
    confirmed = s.where("page_id % 2 = 0").select("page_id")
    return changes.between(s.where("run_id = 1"), s.where("run_id = 2"), "page_id", "content_hash", F.lit(False), confirmed).select("page_id", "change")


@register(f"WITH {_BETWEEN} SELECT site, count(*) FILTER (change = 'new') AS n_new, count(*) FILTER (change = 'changed') AS n_changed, count(*) FILTER (change = 'missing') AS n_missing, count(*) FILTER (change <> 'same') AS n_changes FROM cdc GROUP BY site")
def cdc_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = views.snapshots(spark, sf_dir).select("page_id", "site").distinct()
    return changes.counters(_cdc(spark, sf_dir).join(sites, "page_id"), ["site"])


@register(
    f"""WITH {views.FILES}, one AS (SELECT download_url, run_id, arg_max(sha256, id) AS sha256 FROM files GROUP BY ALL), a AS (SELECT * FROM one WHERE run_id = 1), b AS (SELECT * FROM one WHERE run_id = 2)
    SELECT coalesce(a.download_url, b.download_url) AS download_url, CASE WHEN a.download_url IS NULL THEN 'new' WHEN b.download_url IS NULL THEN 'missing' WHEN a.sha256 <> b.sha256 THEN 'changed' ELSE 'same' END AS change,
    a.sha256 AS old_hash, b.sha256 AS new_hash FROM a FULL JOIN b ON a.download_url = b.download_url"""
)
def cdc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.file_observations(spark, sf_dir).groupBy("download_url", "run_id").agg(F.max_by("sha256", "id").alias("sha256"))
    return changes.between(f.where("run_id = 1"), f.where("run_id = 2"), "download_url", "sha256")


@register(f"WITH {views.SNAPSHOTS} SELECT canonical_url, min(run_id) AS first_seen_run_id, max(run_id) AS last_seen_run_id, arg_max(content_hash, id) AS latest_hash, arg_max(id, id) AS latest_id, 0 AS miss_count, true AS is_active FROM snapshots GROUP BY canonical_url")
def tracked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.tracked(views.snapshots(spark, sf_dir), ["canonical_url"], "run_id", "id", "content_hash", ["id"])


@register(f"WITH {views.FILES} SELECT download_url, min(run_id) AS first_seen_run_id, max(run_id) AS last_seen_run_id, arg_max(sha256, (run_id, id)) AS latest_hash, arg_max(id, (run_id, id)) AS latest_id, 0 AS miss_count, true AS is_active FROM files GROUP BY download_url")
def tracked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.tracked(views.file_observations(spark, sf_dir), ["download_url"], "run_id", "id", "sha256", ["id"])


@register(f"WITH {views.FILES} SELECT download_url, min(id) AS id, arg_max(sha256, (run_id, id)) AS sha256, max(run_id) AS run_id FROM files GROUP BY download_url")
def document_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.file_observations(spark, sf_dir).select("id", "download_url", "sha256", "run_id")
    return state.upsert_last(f.where("run_id = 1"), f.where("run_id = 2"), "download_url", "id", "run_id")


@register(f"WITH {views.FILES} SELECT sha256, min(id) AS first_seen_at, max(id) AS last_seen_at, arg_max(doc_type, id) AS doc_type, arg_max(file_size, id) AS file_size FROM files GROUP BY sha256")
def blob_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.blobs(views.file_observations(spark, sf_dir), "sha256", "id", "doc_type", "file_size")


@register(f"WITH {views.SNAPSHOTS} SELECT site, arg_max(canonical_url, id) AS canonical_url, max(id) AS id FROM snapshots GROUP BY site")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.first_by(views.snapshots(spark, sf_dir), ["site"], F.col("id").desc()).select("site", "canonical_url", "id")


@register(f"WITH {views.SNAPSHOTS} SELECT id, page_id, run_id, lag(content_hash) OVER (PARTITION BY page_id ORDER BY run_id) AS previous_content_hash FROM snapshots")
def previous_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.previous(views.snapshots(spark, sf_dir), ["page_id"], "run_id", "content_hash").select("id", "page_id", "run_id", "previous_content_hash")


@register(f"WITH {views.FILES} SELECT page_id, arg_max(sha256, (run_id, id)) AS previous_sha256 FROM files WHERE run_id < 2 GROUP BY page_id")
def previous_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.before_run(views.file_observations(spark, sf_dir), ["page_id"], "run_id", 2, "sha256", "id")


@register(f"WITH {views.FILES} SELECT download_url, count(DISTINCT sha256) AS payloads FROM files GROUP BY download_url HAVING count(DISTINCT sha256) > 1")
def insert_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.conflicts(views.file_observations(spark, sf_dir), ["download_url"], F.col("sha256"))


@register(f"WITH {views.JOBS} SELECT job_id, scope_id, job_type, CASE WHEN job_id % 10 = 0 THEN 'X' ELSE status END AS status, finished_at FROM jobs")
def job_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = views.jobs(spark, sf_dir)
    updates = j.where("job_id % 10 = 0").select("job_id", F.lit("X").alias("status"), F.lit(0).alias("scope_id"))
    return state.patch(j, updates, "job_id", ["status"])


@register(f"WITH {views.SNAPSHOTS}, {views.ATTEMPTS} SELECT id, page_id FROM snapshots WHERE page_id IN (SELECT request_id FROM attempts WHERE executor = 'assistant')")
def guarded_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = views.attempts(spark, sf_dir).where("executor = 'assistant'").select(F.col("request_id").alias("page_id"))
    return state.insert_guarded(views.snapshots(spark, sf_dir), accepted, ["page_id"]).select("id", "page_id")


@register("SELECT user_id AS site_id, ts::DATE AS day, event_type AS change_type, count(*) AS n FROM events GROUP BY ALL")
def change_log_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.changes(spark, sf_dir).groupBy("site_id", F.to_date("detected_at").alias("day"), "change_type").agg(F.count("*").alias("n"))


@register("SELECT ts::DATE::TIMESTAMP AS start, event_type AS change_type, count(*) AS n FROM events GROUP BY ALL")
def stream_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of the log read as a stream; each micro-batch rewrites the counts in the shared folder."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema("ts timestamp_ntz, event_type string").option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counts = streaming.windowed_counts(source.select(F.col("ts").alias("detected_at"), F.col("event_type").alias("change_type")))
    query = counts.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/counts")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/counts").withColumn("start", F.col("start").cast("timestamp_ntz"))
