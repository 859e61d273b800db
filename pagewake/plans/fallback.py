"""Queries over chains of acquisition adapters and governed results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewake.functions import texts
from pagewake.operators import fallback
from pagewake.plans.registry import register
from pagewake.sources import views
from pagewake.sources.tables import table
from pagewake.sources.views import ATTEMPTS

_SIZE = "len(list_filter(regexp_split_to_array(body, '[ \\t\\n\\r\\f]+'), lambda x: x <> ''))"
#: What the views add to the attempts of a chain: its adapter by place, status by its words and code by their number.
_MADE = f"""{ATTEMPTS}, made AS (
  SELECT request_id, position, ['web_http', 'sitemap', 'browser', 'cloakbrowser', 'archive'][position % 5 + 1] AS adapter, position % 7 <> 6 AS enabled, position % 5 <> 1 AS executable, request_id % 3 = 0 AS permitted,
    CASE WHEN w >= 60 THEN 'passed' WHEN w % 4 = 0 THEN 'error' WHEN w % 4 = 1 THEN 'blocked' ELSE 'failed_quality_gate' END AS status, CASE WHEN w % 11 = 0 THEN 404 WHEN w % 11 = 1 THEN 403 WHEN w % 11 = 2 THEN 401 ELSE 200 END AS code,
    w % 8 = 0 AS retryable, w % 16 <> 8 AS safe, w % 13 <> 5 AS final_ok FROM (SELECT *, {_SIZE} AS w FROM attempts)
)"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = texts.word_count(F.col("body"))
    p = F.col("position")
    return views.attempts(spark, sf_dir).withColumn("w", w).select(
        "request_id", "position",
        F.get(F.array(*map(F.lit, ("web_http", "sitemap", "browser", "cloakbrowser", "archive"))), (p % 5).cast("int")).alias("adapter"),
        (p % 7 != 6).alias("enabled"), (p % 5 != 1).alias("executable"), (F.col("request_id") % 3 == 0).alias("permitted"),
        F.when(F.col("w") >= 60, "passed").when(F.col("w") % 4 == 0, "error").when(F.col("w") % 4 == 1, "blocked").otherwise("failed_quality_gate").alias("status"),
        F.when(F.col("w") % 11 == 0, 404).when(F.col("w") % 11 == 1, 403).when(F.col("w") % 11 == 2, 401).otherwise(200).alias("status_code"),
        (F.col("w") % 8 == 0).alias("retryable"), (F.col("w") % 16 != 8).alias("safe"), (F.col("w") % 13 != 5).alias("final_url_safe"),
    )


#: A chain walked one attempt at a time; a request whose id is divisible by 17 has an unsafe URL, and chains take six attempts at most.
_CHAINS = f"""WITH RECURSIVE {_MADE}, tried AS (
  SELECT *, adapter = 'cloakbrowser' AND enabled AND NOT permitted AS barred, NOT enabled OR (NOT executable AND NOT (adapter = 'cloakbrowser' AND NOT permitted)) AS skipped FROM made WHERE position < 6
), told AS (
  SELECT *, CASE WHEN barred THEN 'permission_denied' WHEN skipped THEN 'not_applicable' WHEN NOT final_ok THEN 'permission_denied' WHEN code = 404 THEN 'not_found' WHEN code = 401 THEN 'auth_required' WHEN code = 403 AND status <> 'blocked' THEN 'permission_denied' WHEN status = 'passed' THEN 'present' ELSE status END AS data_status,
    CASE WHEN barred THEN 'unsafe_escalation' WHEN skipped THEN 'adapter_not_applicable' WHEN NOT final_ok THEN 'unsafe_final_url' WHEN code = 404 THEN 'not_found' WHEN code = 401 THEN 'auth_required' WHEN code = 403 AND status <> 'blocked' THEN 'permission_denied' WHEN status = 'passed' THEN 'usable_data_found' WHEN status = 'failed_quality_gate' THEN 'insufficient_data' ELSE status END AS stop_reason
  FROM tried
), ruled AS (
  SELECT *, data_status IN ('failed_quality_gate', 'blocked', 'not_applicable') OR (data_status = 'error' AND retryable AND safe) AS goes_on FROM told
), walk AS (
  SELECT DISTINCT request_id, -1::BIGINT AS position, 0::BIGINT AS n, 0::BIGINT AS skips, true AS goes_on, NULL::VARCHAR AS adapter, true AS ok, false AS has_data, 'not_applicable' AS data_status, 'no_available_adapter' AS stop_reason FROM made WHERE request_id % 17 <> 0
  UNION ALL SELECT r.request_id, r.position, w.n + CASE WHEN r.barred THEN 0 ELSE 1 END, w.skips + CASE WHEN r.skipped THEN 1 ELSE 0 END, r.goes_on, r.adapter, CASE WHEN r.barred OR (NOT r.skipped AND NOT r.final_ok) THEN false ELSE r.skipped OR r.status <> 'error' END,
    NOT r.skipped AND NOT r.barred AND r.final_ok AND r.data_status = 'present', r.data_status, r.stop_reason FROM walk w JOIN ruled r ON r.request_id = w.request_id AND r.position = w.position + 1 WHERE w.goes_on
), last AS (SELECT request_id, max(position) AS position FROM walk GROUP BY request_id)
SELECT w.request_id, w.adapter AS tool, ok, has_data, data_status, CASE WHEN w.goes_on THEN CASE WHEN w.position + 1 >= 6 THEN 'max_attempts_reached' ELSE 'no_available_adapter' END ELSE stop_reason END AS stop_reason, n AS n_attempts, skips AS n_skipped FROM walk w JOIN last USING (request_id, position)
UNION ALL SELECT DISTINCT request_id, '', false, false, 'permission_denied', 'unsafe_url', 0, 0 FROM made WHERE request_id % 17 = 0"""


@register(_CHAINS)
def fallback_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the chain of each request ended."""
    a = _attempts(spark, sf_dir)
    requests = a.select("request_id", (F.col("request_id") % 17 != 0).alias("url_safe")).distinct()
    return fallback.chains(requests, a, "request_id", "position", max_attempts=6)


_GATES, _MARKERS = {"min_words": 60, "min_links": 1, "min_document_links": 0}, ("Anand", "ßung")


@register(
    f"""WITH p AS (SELECT page_id, page_id % 19 AS k, url, html, {views.LINKS} AS links FROM pages), r AS (
      SELECT page_id, k, url, html, k = 0 AS absent, k = 1 AS stray, CASE k WHEN 2 THEN 'Executor_Protocol' WHEN 3 THEN 'READ_TIMEOUT' WHEN 4 THEN 'is_blocked' WHEN 5 THEN NULL END AS code, k BETWEEN 2 AND 5 AS failed, CASE WHEN k = 6 THEN 'https://elsewhere.org/' ELSE url END AS final_url,
        CASE k WHEN 7 THEN 410 WHEN 8 THEN 503 ELSE 200 END AS status, k >= 14 AS is_file, length(html) - length(replace(html, ' ', '')) AS words, len(links) AS links FROM p
    ) SELECT page_id, CASE WHEN absent THEN 'protocol_error' WHEN stray THEN 'lineage_mismatch' WHEN failed THEN CASE WHEN code = 'Executor_Protocol' THEN 'integrity_error' WHEN code = 'READ_TIMEOUT' THEN 'timeout' WHEN code = 'is_blocked' THEN 'blocked' ELSE 'executor_error' END
        WHEN {views.sql_origin('final_url')} <> {views.sql_origin('url')} THEN 'unsafe_redirect' WHEN status = 410 THEN 'not_found' WHEN status = 503 THEN 'failed_quality_gate'
        WHEN is_file THEN CASE k WHEN 14 THEN 'failed_quality_gate' WHEN 15 THEN 'integrity_error' WHEN 16 THEN 'integrity_error' ELSE 'accepted' END
        WHEN words < 60 OR links < 1 THEN 'failed_quality_gate' WHEN contains(lower(html), 'anand') OR contains(lower(html), 'ßung') THEN 'blocked' ELSE 'accepted' END AS decision,
      absent OR stray OR coalesce(code = 'Executor_Protocol', false) OR (NOT failed AND ({views.sql_origin('final_url')} <> {views.sql_origin('url')} OR status = 410 OR k IN (15, 16))) AS terminal,
      CASE WHEN absent OR stray OR failed OR k IN (6, 7) THEN '' WHEN k = 8 THEN 'successful_content' WHEN k = 14 THEN 'document_representation' WHEN k = 15 THEN 'document_base64' WHEN k = 16 THEN 'document_sha256' WHEN is_file THEN ''
        ELSE concat_ws(',', CASE WHEN words < 60 THEN 'min_words' END, CASE WHEN links < 1 THEN 'min_links' END) END AS failed_rules FROM r"""
)
def governed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions over pages and, as Base64, files; by its number a page lacks a result, its lineage, its success, its origin, its status or its digest."""
    k = F.col("page_id") % 19
    p = table(spark, sf_dir, "pages")
    encoded = F.base64(F.encode("html", "UTF-8"))
    c = p.select(
        "page_id", "url", (k != 0).alias("present"), F.when(k.between(2, 5), "failed").otherwise("succeeded").alias("state"),
        F.when(k == 2, "Executor_Protocol").when(k == 3, "READ_TIMEOUT").when(k == 4, "is_blocked").alias("error_code"),
        F.when(k == 6, "https://elsewhere.org/").otherwise(F.col("url")).alias("final_url"), F.when(k == 7, 410).when(k == 8, 503).otherwise(200).alias("status_code"),
        F.when(k >= 14, F.when(k == 15, F.concat(F.lit("*"), encoded)).otherwise(encoded)).otherwise(F.col("html")).alias("content"), F.when(k >= 14, "document").otherwise("page").alias("kind"),
        F.when(k == 14, "text").otherwise("base64").alias("representation"), F.lit("decoded-bytes").alias("sha256_scope"), F.when(k == 16, "0").otherwise(F.sha2("html", 256)).alias("sha256"),
        (F.length("html") - F.length(F.replace("html", F.lit(" ")))).alias("word_count"), F.size(texts.links(F.col("html"))).alias("link_count"), F.lit(0).alias("document_link_count"),
        F.lit("run").alias("asked_run"), F.when(k == 1, "other").otherwise("run").alias("told_run"),
    )
    return c.select("page_id", fallback.governed(_GATES, _MARKERS, [("asked_run", "told_run")]).alias("d")).select("page_id", "d.decision", "d.terminal", F.array_join("d.failed_rules", ",").alias("failed_rules"))
