"""Queries over acquisition attempts and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewake.functions import texts
from pagewake.operators import acquisition
from pagewake.plans.registry import register
from pagewake.sources import views
from pagewake.sources.tables import table
from pagewake.sources.views import ATTEMPTS, JOBS

_WORDS = "len(list_filter(regexp_split_to_array(body, '[ \\t\\n\\r\\f]+'), lambda x: x <> ''))"


def _sql_marker(text: str, markers: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({text}), '{m}') THEN '{m}'" for m in markers) + " ELSE '' END"


#: What the views add to an attempt: a status, links, and the outcome it came with; every seventh body is that of an interstitial.
_TOLD = f"""{ATTEMPTS}, seen AS (SELECT request_id, position, executor, CASE WHEN request_id % 7 = 0 THEN 'Captcha ' || body ELSE body END AS body, [200, 204, 404, NULL][request_id % 4 + 1] AS status, (position * 2)::BIGINT AS links,
    ['passed', 'passed', 'passed', 'error', 'blocked'][request_id % 5 + 1] AS before FROM attempts), told AS (SELECT *, {_WORDS} AS words, {_sql_marker('body', acquisition.BLOCKED)} AS marker FROM seen),
    gates AS (SELECT *, list_filter([CASE WHEN marker <> '' THEN 'blocked marker found: ' || marker END, CASE WHEN NOT coalesce(status BETWEEN 200 AND 299, false) THEN 'status_code ' || coalesce(status::VARCHAR, 'None') || ' is not OK' END,
    CASE WHEN words < 20 THEN 'word_count ' || words || ' < min_words 20' END, CASE WHEN links < 3 THEN 'link_count ' || links || ' < min_links 3' END], lambda x: x IS NOT NULL) AS failed FROM told)"""


@register(f"WITH {_TOLD} SELECT request_id, position, executor, CASE before WHEN 'error' THEN 'ReadTimeout' WHEN 'blocked' THEN 'blocked marker found: robot' ELSE array_to_string(failed, '; ') END AS failure_reason, CASE WHEN before IN ('error', 'blocked') THEN before WHEN len(failed) = 0 THEN 'passed' WHEN marker <> '' THEN 'blocked' ELSE 'failed_quality_gate' END AS outcome FROM gates")
def attempt_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality gates of attempts, with 20 words at least; errors and blocks keep the reasons that they came with."""
    by = F.col("request_id")
    pick = lambda *values: F.get(F.array(*map(F.lit, values)), by % len(values))
    body = F.when(by % 7 == 0, F.concat(F.lit("Captcha "), "body")).otherwise(F.col("body"))
    seen = views.attempts(spark, sf_dir).withColumn("body", body).withColumn("marker", F.coalesce(texts.blocked_marker(F.col("body"), acquisition.BLOCKED), F.lit("")))
    failed = acquisition.failed_gates(F.col("marker"), pick(200, 204, 404, None), texts.word_count(F.col("body")), F.col("position") * 2, F.lit(0), min_words=20)
    before = pick("passed", "passed", "passed", "error", "blocked")
    came_with = F.when(before == "error", "ReadTimeout").when(before == "blocked", "blocked marker found: robot").otherwise("")
    told = seen.withColumns({"failed": failed, "before": before, "came_with": came_with})
    return told.select("request_id", "position", "executor", acquisition.failure_reason(F.col("before"), F.col("came_with"), F.col("failed")).alias("failure_reason"), acquisition.outcome(F.col("before"), F.col("came_with"), F.col("marker"), F.col("failed")).alias("outcome"))


_KINDS = ("html", "xml_sitemap", "xml_feed")
#: What the views add to a document as a capture: status, source kind, links and items; every eleventh is an interstitial.
_CAPTURES = f"""c AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'Just a MOMENT ' || text ELSE text END AS body, [200, 301, 404, 403, NULL, 200, 200][doc_id % 7 + 1] AS status, ['html', 'xml_sitemap', 'xml_feed'][doc_id % 3 + 1] AS kind, doc_id % 13 AS links, doc_id % 5 AS items FROM documents),
    w AS (SELECT *, {_WORDS} AS words FROM c), verdicts AS (SELECT *, CASE WHEN {_sql_marker('substr(body, 1, 400)', acquisition.INTERSTITIALS)} <> '' THEN 'blocked_interstitial' WHEN status >= 400 THEN 'http_' || status
    WHEN kind = 'xml_sitemap' THEN CASE WHEN links >= 5 THEN 'sitemap_inventory' ELSE 'sitemap_too_small' END WHEN kind = 'xml_feed' THEN CASE WHEN items >= 3 OR links >= 3 OR words >= 10 THEN 'feed_inventory' ELSE 'feed_too_small' END
    WHEN words >= 50 THEN 'content_ok' ELSE 'too_little_content' END AS reason FROM w)"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.col("doc_id")
    statuses = F.array(*[F.lit(s).cast("int") for s in (200, 301, 404, 403, None, 200, 200)])
    body = F.when(by % 11 == 0, F.concat(F.lit("Just a MOMENT "), "text")).otherwise(F.col("text"))
    c = table(spark, sf_dir, "documents").select("doc_id", "source", body.alias("body"), F.get(statuses, by % 7).alias("status"), F.get(F.array(*map(F.lit, _KINDS)), by % 3).alias("kind")).withColumn("words", F.coalesce(texts.word_count(F.col("body")), F.lit(0)))
    return c.select("doc_id", "source", "status", "words", acquisition.capture_verdict(F.col("status"), F.col("kind"), F.col("words"), by % 13, by % 5, F.coalesce("body", F.lit(""))).alias("v")).select("doc_id", "source", "status", "words", "v.*")


@register(f"WITH {_CAPTURES} SELECT doc_id, reason IN ('sitemap_inventory', 'feed_inventory', 'content_ok') AS passed, reason FROM verdicts")
def capture_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select("doc_id", "passed", "reason")


_LADDER = ("catalog", "browser", "sitemap", "rss")


@register(
    f"""WITH {_CAPTURES}, l AS (SELECT doc_id // 4 AS site_key, doc_id % 4 AS place, [{", ".join(f"'{x}'" for x in _LADDER)}][doc_id % 4 + 1] AS strategy, reason IN ('sitemap_inventory', 'feed_inventory', 'content_ok') AS passed FROM verdicts), f AS (SELECT site_key, min(place) FILTER (passed) AS won FROM l GROUP BY site_key)
    SELECT site_key, arg_min(strategy, place) AS primary_strategy, arg_min(strategy, place) FILTER (passed) AS resolved_strategy, any_value(won) IS NOT NULL AS resolved, count(*) FILTER (won IS NULL OR place <= won) AS n_attempts FROM l JOIN f USING (site_key) GROUP BY site_key"""
)
def rescue_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ladders of four strategies, tried in order until one passes."""
    at = F.col("doc_id") % 4
    ladder = _verdicts(spark, sf_dir).select(F.floor(F.col("doc_id") / 4).alias("site_key"), at.alias("place"), F.get(F.array(*map(F.lit, _LADDER)), at).alias("strategy"), "passed")
    return acquisition.rescue(ladder, ["site_key"], "place", "strategy", F.col("passed"))


@register(
    f"""WITH {ATTEMPTS}, t AS (SELECT *, {_WORDS} >= 15 AS passed FROM attempts) SELECT request_id, min(position) FILTER (passed) AS position, arg_min(body, position) FILTER (passed) AS body, count(*) AS n_attempts, count(*) FILTER (NOT passed) AS n_failed, bool_or(position > 0) AS fell_back,
    list_filter(['assistant', 'system', 'user'], lambda x: list_contains(list(executor), x)) AS executors FROM t GROUP BY request_id"""
)
def attempt_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = acquisition.winners(views.attempts(spark, sf_dir), ["request_id"], "position", texts.word_count(F.col("body")) >= 15, "body")
    return won.withColumn("executors", F.array_sort("executors"))


@register(f"WITH {ATTEMPTS}, t AS (SELECT request_id, list(DISTINCT executor) AS tried FROM attempts GROUP BY request_id) SELECT request_id, list_filter(['user', 'assistant', 'browser', 'archive'], lambda x: NOT list_contains(tried, x) AND x <> 'browser')[1] AS next_adapter FROM t")
def next_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = views.attempts(spark, sf_dir).groupBy("request_id").agg(F.collect_set("executor").alias("tried"))
    return tried.select("request_id", acquisition.next_adapter(["user", "assistant", "browser", "archive"], F.col("tried"), F.array(F.lit("browser"))).alias("next_adapter"))


_JOBS = f"""{JOBS}, made AS (SELECT job_id, job_type, CASE status WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, job_id % 4 AS n FROM jobs)"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with a map of the artifacts they made."""
    n = F.col("job_id") % 4
    maps = [F.map_from_arrays(F.array(*map(F.lit, m)), F.array(*map(F.lit, m.values()))) for m in ({"scope_path": "s", "task_path": "t"}, {"report_path": " ", "count": "1"}, {"yaml_path": "y", "summary_path": "z", "count": "1"})]
    made = F.when(n == 1, maps[0]).when(n == 2, maps[1]).when(n == 3, maps[2]).otherwise(F.create_map().cast("map<string,string>"))
    status = F.when(F.col("status") == "F", "completed").when(F.col("status") == "O", "running").otherwise("failed")
    return views.jobs(spark, sf_dir).select("job_id", "job_type", status.alias("status"), made.alias("made"))


@register(f"WITH {_JOBS} SELECT job_type, status, CASE WHEN status = 'running' THEN 'poll_job_status' WHEN status = 'failed' THEN 'inspect_job_error' WHEN n > 0 THEN 'read_job_artifacts' ELSE 'inspect_job_record' END AS next_action, count(*) AS n FROM made GROUP BY ALL")
def job_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).groupBy("job_type", "status", acquisition.next_action(F.col("status"), F.size("made")).alias("next_action")).agg(F.count("*").alias("n"))


@register(f"WITH {_JOBS} SELECT job_id, ['', 'task_path', '', 'yaml_path'][n + 1] AS primary_key, ['', 'monitor_task', '', 'yaml_artifact'][n + 1] AS primary_kind, ['', 't', '', 'y'][n + 1] AS primary_path, ['', 'scope_path,task_path', '', 'summary_path,yaml_path'][n + 1] AS path_keys FROM made")
def job_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _jobs(spark, sf_dir).select("job_id", acquisition.artifact_contract(F.col("made")).alias("a")).select("job_id", "a.*")
    return told.withColumn("path_keys", F.array_join("path_keys", ","))


_EXPECTATIONS = ("pass_http", "pass_http_limited", "known_blocked", "ssl_issue")
_SMOKE = f"""{_CAPTURES}, s AS (SELECT w.doc_id, d.source, w.doc_id % 3 > 0 AS required, [{", ".join(f"'{x}'" for x in _EXPECTATIONS)}][w.doc_id % 4 + 1] AS expectation, CASE w.doc_id % 6 WHEN 0 THEN 'catalog' WHEN 1 THEN 'browser' WHEN 2 THEN 'rss' END AS strategy, w.words, w.status FROM w JOIN documents d USING (doc_id)),
    b AS (SELECT *, coalesce(strategy, CASE WHEN expectation = 'pass_http_limited' AND status < 400 AND words > 0 THEN 'catalog' END) AS resolver, NOT required AND expectation IN ('known_blocked', 'ssl_issue') AS issue FROM s),
    smoke AS (SELECT *, resolver IS NOT NULL OR issue AS passed, CASE WHEN resolver = 'catalog' THEN CASE WHEN words >= 60 THEN 'ok' WHEN expectation = 'pass_http_limited' AND words > 0 THEN 'limited' ELSE 'too_little_content' END WHEN resolver IS NOT NULL THEN 'rescued_' || resolver WHEN issue THEN 'expected_issue' ELSE 'unresolved' END AS outcome, coalesce(resolver <> 'catalog', false) AS rescued FROM b)"""


def _smoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.col("doc_id")
    strategy = F.when(by % 6 == 0, "catalog").when(by % 6 == 1, "browser").when(by % 6 == 2, "rss")
    s = _verdicts(spark, sf_dir).select("doc_id", "source", (by % 3 > 0).alias("required"), F.get(F.array(*map(F.lit, _EXPECTATIONS)), by % 4).alias("expectation"), strategy.alias("strategy"), "words", "status")
    told = acquisition.smoke_outcome(F.col("required"), F.col("expectation"), F.col("strategy"), F.col("words"), F.col("status"), F.lit(60))
    return s.withColumn("told", told).select("doc_id", "source", "required", "told.*")


@register(f"WITH {_SMOKE} SELECT doc_id, required, passed, outcome, rescued FROM smoke")
def smoke_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sites of a smoke catalog, with 60 words expected."""
    return _smoke(spark, sf_dir).drop("source")


@register(f"WITH {_SMOKE} SELECT source, count(*) AS sites, count(*) FILTER (required) AS required_total, count(*) FILTER (required AND passed) AS required_passed, count(*) FILTER (NOT required AND outcome = 'expected_issue') AS expected_issues, count(*) FILTER (rescued) AS rescued FROM smoke GROUP BY source")
def smoke_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _smoke(spark, sf_dir).groupBy("source").agg(*acquisition.smoke_counts())


@register("SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'blocked_root' WHEN page_id % 5 = 0 THEN 'root_only' WHEN page_id % 23 >= greatest(10, page_id % 6 * 3) THEN 'unstable_tree' WHEN page_id % 6 < 3 THEN 'thin_tree' ELSE 'ok' END AS outcome FROM pages")
def tree_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.col("page_id")
    return table(spark, sf_dir, "pages").select("page_id", acquisition.tree_outcome(by % 6, by % 5, by % 23).alias("outcome"))
