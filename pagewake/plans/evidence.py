"""Queries over acquisition evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewake.operators import evidence
from pagewake.plans.registry import register
from pagewake.sources import views
from pagewake.sources.views import ATTEMPTS


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON artifact for each chain of attempts: a list of them, its last one bare or wrapped, a list in an object, only a profile, a scalar, or text that is no JSON."""
    k = F.col("request_id") % 8
    row = F.struct("position", F.struct(F.lit(evidence.BARE).alias("schema_version"), F.col("executor").alias("adapter"), F.when(F.length("body") % 2 == 0, "passed").otherwise("blocked").alias("status"), F.when(F.col("position") % 2 == 1, "browser").alias("recommended_next_adapter"), F.concat(F.lit("https://a.org/"), F.col("position").cast("string")).alias("url")).alias("a"))
    chains = views.attempts(spark, sf_dir).groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["a"]).alias("all"))
    last = F.element_at("all", -1)
    profile = F.struct(F.lit("web_http").alias("default_adapter"))
    made = (
        F.when(k == 0, F.to_json("all")).when(k == 1, F.to_json(last)).when(k == 2, F.to_json(F.struct(last.alias("attempt"), profile.alias("profile"))))
        .when(k == 3, F.to_json(F.struct(F.col("all").alias("attempts"), F.lit("wait").alias("next_action")))).when(k == 4, F.to_json(F.struct(profile.alias("profile")))).when(k == 5, "7").when(k == 6, "{bad").otherwise("[1]")
    )
    return chains.select("request_id", made.alias("payload"))


_EVIDENCE = f"""WITH {ATTEMPTS}, c AS (
  SELECT *, request_id % 8 AS k, CASE WHEN length(body) % 2 = 0 THEN 'passed' ELSE 'blocked' END AS status, CASE WHEN position % 2 = 1 THEN 'browser' END AS following,
    row_number() OVER (PARTITION BY request_id ORDER BY position) - 1 AS i, row_number() OVER (PARTITION BY request_id ORDER BY position DESC) AS back FROM attempts
)"""


@register(
    f"""{_EVIDENCE} SELECT request_id, CASE WHEN k IN (0, 3) THEN i WHEN k IN (1, 2) THEN 0 WHEN k = 7 THEN 0 END AS n, CASE k WHEN 0 THEN 'list' WHEN 1 THEN 'bare' WHEN 2 THEN 'wrapped' WHEN 3 THEN 'attempts' WHEN 7 THEN 'list' ELSE 'none' END AS form,
      CASE WHEN k < 4 THEN executor END AS adapter, CASE WHEN k < 4 THEN status END AS status, CASE WHEN k < 4 THEN 'https://a.org/' || position END AS url, CASE WHEN k < 4 THEN following END AS recommended_next_adapter,
      CASE k WHEN 5 THEN 'root_invalid' WHEN 6 THEN 'json_invalid' WHEN 7 THEN 'attempt_invalid' END AS error FROM c WHERE k IN (0, 3) OR back = 1"""
)
def evidence_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempts of all artifacts, whatever their form."""
    return evidence.attempts(_artifacts(spark, sf_dir), "request_id", "payload").select("request_id", "n", "form", "adapter", "status", "url", "recommended_next_adapter", "error")


@register(
    f"""{_EVIDENCE}, l AS (SELECT request_id, k, status, coalesce(following, '') AS following, CASE k WHEN 0 THEN i + 1 WHEN 3 THEN i + 1 WHEN 4 THEN 0 ELSE 1 END AS n FROM c WHERE back = 1)
    SELECT request_id, CASE WHEN k < 5 THEN n END AS n_attempts, CASE WHEN k < 4 THEN status END AS status, CASE WHEN k < 4 THEN following WHEN k = 4 THEN 'web_http' END AS recommended_next_adapter,
      CASE WHEN k = 3 THEN 'wait' WHEN k = 4 THEN 'use_profile_default:web_http' WHEN k < 3 THEN CASE WHEN status = 'passed' THEN 'use_adapter_output' WHEN following <> '' THEN 'try_adapter:' || following ELSE 'review_probe_failure' END END AS next_action,
      CASE k WHEN 5 THEN 'root_invalid' WHEN 6 THEN 'json_invalid' WHEN 7 THEN 'attempt_invalid' END AS error FROM l"""
)
def evidence_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each artifact says about the next step."""
    return evidence.summaries(evidence.attempts(_artifacts(spark, sf_dir), "request_id", "payload"), "request_id")
