"""Queries over small decisions: preflights, responses, job results, adapters, hosts, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewake.operators import decisions, governance
from pagewake.plans.governance import _rules
from pagewake.plans.registry import register
from pagewake.sources import views
from pagewake.sources.tables import table
from pagewake.sources.views import CHANGES, SNAPSHOTS

_OUTCOMES = (*decisions.DETERMINISTIC, *decisions.RETRYABLE, *decisions.UNSAFE, *decisions.SPENT, *decisions.HARMLESS, "transport_other", "other")


def _sql_list(names) -> str:
    return ", ".join(f"'{x}'" for x in names)


@register(
    f"""WITH t AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE [{_sql_list(_OUTCOMES)}][event_id % {len(_OUTCOMES)} + 1] END AS o, user_id % 3 AS r, value > 100 AS unsafe, event_id % 2 = 0 AS spent FROM events) SELECT event_id,
    CASE WHEN o IN ({_sql_list(decisions.DETERMINISTIC)}) THEN 'deterministic' WHEN o IN ({_sql_list(decisions.RETRYABLE)}) THEN CASE WHEN r = 2 THEN 'transient' WHEN spent THEN 'budget' END WHEN o IN ({_sql_list(decisions.UNSAFE)}) OR starts_with(o, 'transport_') THEN 'safety'
    WHEN o IN ({_sql_list(decisions.SPENT)}) THEN CASE WHEN spent THEN 'budget' ELSE 'safety' END WHEN unsafe THEN 'safety' WHEN spent THEN 'budget' WHEN o = 'other' THEN 'safety' END AS preflight FROM t"""
)
def preflight_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("event_id") % 11 != 0, F.get(F.array(*map(F.lit, _OUTCOMES)), F.col("event_id") % len(_OUTCOMES)))
    return table(spark, sf_dir, "events").select("event_id", decisions.preflight_class(outcome, F.col("user_id") % 3, F.col("value") > 100, F.col("event_id") % 2 == 0).alias("preflight"))


@register(
    """WITH t AS (SELECT 90 + event_id * 7 % 560 AS status FROM events), c AS (SELECT CASE WHEN status BETWEEN 200 AND 299 THEN 'body' WHEN status IN (401, 403) THEN 'authority' WHEN status IN (404, 410) THEN 'empty' WHEN status IN (301, 302, 303, 307, 308) THEN 'redirect'
    WHEN status BETWEEN 100 AND 199 THEN 'informational' WHEN status IN (408, 425, 429) OR status BETWEEN 500 AND 599 THEN 'transient' WHEN status BETWEEN 400 AND 499 THEN 'terminal' ELSE 'unclassified' END AS response FROM t) SELECT response, count(*) AS n FROM c GROUP BY response"""
)
def response_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.lit(90) + F.col("event_id") * 7 % 560
    return table(spark, sf_dir, "events").groupBy(decisions.response_class(status).alias("response")).agg(F.count("*").alias("n"))


@register(
    """WITH t AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderkey % 3 AS n FROM orders), k AS (SELECT *, CASE n WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['report_path'] ELSE ['count', 'report_path'] END AS keys FROM t)
    SELECT job_id, CASE status WHEN 'running' THEN 'accepted' ELSE status END AS stage, CASE status WHEN 'running' THEN 0 ELSE 100 END AS progress,
    CASE WHEN status = 'running' THEN 'running' WHEN status = 'failed' THEN 'error' WHEN n > 0 THEN 'artifact_only' ELSE 'not_applicable' END AS data_status,
    CASE WHEN status = 'running' THEN 'job_running' WHEN status = 'failed' THEN 'job_failed' WHEN n > 0 THEN 'job_completed_with_artifacts' ELSE 'job_completed' END AS stop_reason,
    len(keys)::INT AS artifact_count, array_to_string(keys, ',') AS artifact_keys, CASE WHEN n > 0 THEN 'report_path' ELSE '' END AS path_keys FROM k"""
)
def job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("job_id") % 3
    made = F.when(n == 1, F.create_map(F.lit("report_path"), F.lit("r"))).when(n == 2, F.create_map(F.lit("report_path"), F.lit("r"), F.lit("count"), F.lit("1")))
    status = F.when(F.col("status") == "F", "completed").when(F.col("status") == "O", "running").otherwise("failed")
    told = views.jobs(spark, sf_dir).select("job_id", status.alias("status"), decisions.artifact_summary(made).alias("a"))
    told = told.select("job_id", "a.*", decisions.job_result(F.col("status"), F.col("a.artifact_count") > 0).alias("r"))
    return told.select("job_id", "r.*", "artifact_count", F.array_join("artifact_keys", ",").alias("artifact_keys"), F.array_join("path_keys", ",").alias("path_keys"))


@register("SELECT event_id, CASE event_type WHEN 'view' THEN 'passed' WHEN 'error' THEN 'error' WHEN 'click' THEN 'blocked' ELSE 'failed_quality_gate' END AS capture_status FROM events")
def capture_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "view", "present").when(kind == "click", "auth_required").otherwise(kind)
    return table(spark, sf_dir, "events").select("event_id", decisions.capture_status(status).alias("capture_status"))


@register(
    f"""WITH t AS (SELECT p_partkey, [{_sql_list(decisions.CHAINS)}][p_size % 6 + 1] AS strategy, p_partkey % 2 AS n FROM part) SELECT p_partkey, CASE strategy {" ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in decisions.CHAINS.items())} ELSE CASE n WHEN 0 THEN 'web_http,rss' ELSE 'rss,web_http' END END AS chain FROM t"""
)
def adapter_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    strategy = F.get(F.array(*map(F.lit, decisions.CHAINS)), F.col("p_size") % 6)
    default = F.when(F.col("p_partkey") % 2 == 0, "web_http").otherwise("rss")
    chain = decisions.adapter_chain(strategy, default, F.array(F.lit("web_http"), F.lit("rss")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(chain, ",").alias("chain"))


@register(
    """WITH t AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@|:[0-9]+$', '', 'g') AS host, regexp_matches(coalesce(url, ''), '^[Hh][Tt][Tt][Pp][Ss]?://') AS web FROM pages)
    SELECT page_id, CASE WHEN NOT web OR coalesce(host, '') = '' THEN 'not_absolute' WHEN NOT (host = 'example.org' OR ends_with(host, '.example.org')) THEN 'outside_domains' END AS url_error FROM t"""
)
def url_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", decisions.input_url_error(F.col("url"), ["example.org"]).alias("url_error"))


@register(
    """WITH s AS (SELECT c_custkey AS site, 'https://S' || c_custkey || '.example.org/news' AS url, CASE WHEN c_custkey % 3 = 0 THEN 'browser' ELSE 'http' END AS mode FROM customer), c AS (
    SELECT site, 0 AS o, 'catalog' AS strategy, url, mode AS fetch_mode FROM s UNION ALL SELECT site, 1, 'browser', url, 'browser' FROM s WHERE mode <> 'browser'
    UNION ALL SELECT site, 2, 'sitemap', 'https://s' || site || '.example.org/sitemap.xml', 'http' FROM s UNION ALL SELECT site, 3, 'rss', 'https://s' || site || '.example.org/rss.xml', 'http' FROM s)
    SELECT site, (row_number() OVER (PARTITION BY site ORDER BY o) - 1)::INT AS ordinal, strategy, url, fetch_mode FROM c"""
)
def rescue_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    sites = table(spark, sf_dir, "customer").select(c.alias("site"), F.concat(F.lit("https://S"), c.cast("string"), F.lit(".example.org/news")).alias("url"), F.when(c % 3 == 0, "browser").otherwise("http").alias("fetch_mode"))
    return decisions.rescue_candidates(sites)


@register(
    """WITH t AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN NULL WHEN turn % 2 = 0 THEN 'passed' ELSE 'failed' END AS status, CASE WHEN conv_id % 2 = 0 THEN 'rss' ELSE '' END AS next FROM conversations) SELECT conv_id, turn,
    CASE WHEN status IS NULL THEN CASE WHEN next <> '' THEN 'use_profile_default:' || next ELSE 'review_acquisition_inputs' END WHEN status = 'passed' THEN 'use_adapter_output' WHEN next <> '' THEN 'try_adapter:' || next ELSE 'review_probe_failure' END AS action FROM t"""
)
def evidence_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("turn") == 0, F.lit(None)).when(F.col("turn") % 2 == 0, "passed").otherwise("failed")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", decisions.evidence_action(status, F.when(F.col("conv_id") % 2 == 0, "rss").otherwise("")).alias("action"))


@register(
    """WITH t AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN replace(url, '://', '://u@') WHEN 1 THEN url || chr(9) ELSE url END AS raw FROM pages) SELECT page_id,
    CASE WHEN regexp_matches(raw, '[\\x00-\\x1F\\x7F]') OR regexp_matches(raw, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*@') THEN 'sha256:' || sha256(raw) ELSE raw END AS evidence FROM t"""
)
def evidence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id") % 3
    raw = F.when(n == 0, F.replace("url", F.lit("://"), F.lit("://u@"))).when(n == 1, F.concat("url", F.lit("\t"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", decisions.safe_evidence(raw).alias("evidence"))


@register(f"WITH {CHANGES}, t AS (SELECT *, CASE change_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' END AS severity FROM changes) SELECT severity, CASE WHEN severity IS NOT NULL THEN 10 END AS weight, count(*) AS n FROM t GROUP BY ALL")
def change_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.severity_rules(views.changes(spark, sf_dir), {"error": "high", "purchase": "medium"}).groupBy("severity", "weight").agg(F.count("*").alias("n"))


@register(f"WITH {SNAPSHOTS} SELECT id, CASE WHEN starts_with(path, '/fr/2') THEN '9' WHEN regexp_matches(path, '^/de/.*1$') THEN '6' ELSE '8' END AS lines FROM snapshots WHERE run_id = 1 AND length(site) % 2 = 0 AND (starts_with(path, '/fr') OR regexp_matches(path, '^/de/.*1$'))")
def robots_rule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.snapshots(spark, sf_dir).where("run_id = 1")
    rules = governance.selected_rules(_rules(spark, sf_dir), "site", "Monitor")
    hits = s.join(rules, "site").where(F.rlike("path", governance.pattern_regex(F.col("pattern")))).select("id", "line", governance.specificity(F.col("pattern")).alias("octets"))
    return decisions.longest_rule_lines(hits, "id").select("id", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))
