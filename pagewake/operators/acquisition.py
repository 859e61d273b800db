"""Decisions about captures: usable or not, which attempt wins, what to try next."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewake.functions import texts


#: Marks of interstitial pages, of captures and of attempts (fixed values).
INTERSTITIALS = ("access denied", "performing security verification", "request unsuccessful", "just a moment", "verification successful. waiting for")
BLOCKED = ("access denied", "captcha", "cloudflare", "enable javascript", "forbidden")
#: Expectations of a smoke catalog under which an unresolved optional site passes (fixed values).
EXPECTED_ISSUES = ("known_blocked", "broken_upstream", "ssl_issue")
#: Keys of a job's artifacts, the first that is there being the primary one, and its kind. Kinds but that of the manifest are fixed values.
ARTIFACTS = {
    "manifest_json_path": "manifest",
    "output_path": "tracking_report",
    "yaml_path": "yaml_artifact",
    "report_path": "workflow_report",
    "summary_path": "workflow_summary",
    "task_path": "monitor_task",
    "scope_path": "monitor_scope",
}


def capture_verdict(status: Column, kind: Column, words: Column, links: Column, items: Column, text: Column, min_words: int = 50, min_links: int = 5) -> Column:
    """(passed, reason) of a capture of source kind `kind`; interstitials are told by the first 400 characters."""
    marked = texts.blocked_marker(F.substring(text, 1, 400), INTERSTITIALS).isNotNull()
    enough_items = (items >= 3) | (links >= 3) | (words >= max(10, min_words // 5))

    def verdict(passed: Column, good: str, bad: str) -> Column:
        return F.when(passed, good).otherwise(bad)

    reason = (
        F.when(marked, "blocked_interstitial")
        .when(status >= 400, F.concat(F.lit("http_"), status.cast("string")))
        .when(kind == "xml_sitemap", verdict(links >= min_links, "sitemap_inventory", "sitemap_too_small"))
        .when(kind == "xml_feed", verdict(enough_items, "feed_inventory", "feed_too_small"))
        .otherwise(verdict(words >= min_words, "content_ok", "too_little_content"))
    )
    return F.struct(reason.isin("sitemap_inventory", "feed_inventory", "content_ok").alias("passed"), reason.alias("reason"))


def failed_gates(marker: Column, status: Column, words: Column, links: Column, documents: Column, min_words: int = 120, min_links: int = 3, min_documents: int = 0, status_ok: bool = True) -> Column:
    """The reasons, in order, for which an attempt fails its quality gates; a missing status isn't OK."""

    def below(name: str, value: Column, least: int, gate: str) -> Column:
        return F.when(value < least, F.concat(F.lit(f"{name} "), value.cast("string"), F.lit(f" < {gate} {least}")))

    bad_status = F.when(F.lit(status_ok) & ~F.coalesce(status.between(200, 299), F.lit(False)), F.concat(F.lit("status_code "), F.coalesce(status.cast("string"), F.lit("None")), F.lit(" is not OK")))
    return F.array_compact(
        F.array(
            F.when(marker != "", F.concat(F.lit("blocked marker found: "), marker)),
            bad_status,
            below("word_count", words, min_words, "min_words"),
            below("link_count", links, min_links, "min_links"),
            below("document_link_count", documents, min_documents, "min_document_links"),
        )
    )


def was_blocked(before: Column, reason_before: Column) -> Column:
    return (before == "blocked") | F.contains(F.lower(reason_before), F.lit("blocked marker"))


def failure_reason(before: Column, reason_before: Column, failed: Column) -> Column:
    """The reason that an error or a block came with, or else the gates that failed."""
    return F.when((before == "error") | was_blocked(before, reason_before), reason_before).otherwise(F.array_join(failed, "; "))


def outcome(before: Column, reason_before: Column, marker: Column, failed: Column) -> Column:
    """Status of an attempt: an error stays, a block stays, a marker comes before other failed gates."""
    return F.when(before == "error", "error").when(was_blocked(before, reason_before), "blocked").when(F.size(failed) == 0, "passed").when(marker != "", "blocked").otherwise("failed_quality_gate")


def rescue(attempts: DataFrame, keys: Sequence[str], position: str, strategy: str, passed: Column) -> DataFrame:
    """For each site the first strategy of its ladder that passed (null if none), the primary one and the attempts made up to there."""
    at = F.min(F.when(passed, F.struct(position, strategy)))
    first = attempts.groupBy(*keys).agg(at.alias("_won"), F.min_by(strategy, position).alias("primary_strategy"), F.array_sort(F.collect_set(position)).alias("_at"))
    tried = F.filter("_at", lambda x: F.col("_won").isNull() | (x <= F.col("_won")[position]))
    return first.select(*keys, "primary_strategy", F.col("_won")[strategy].alias("resolved_strategy"), F.col("_won").isNotNull().alias("resolved"), F.size(tried).cast("bigint").alias("n_attempts"))


def word_success(expectation: Column, words: Column, least: Column) -> Column:
    """ok, limited (a limited site with any words) or too_little_content."""
    return F.when(words >= least, "ok").when((expectation == "pass_http_limited") & (words > 0), "limited").otherwise("too_little_content")


def smoke_outcome(required: Column, expectation: Column, resolved: Column, words: Column, status: Column, least: Column) -> Column:
    """(passed, outcome, rescued) of a catalog site, from its resolving strategy (null if none) and its primary capture."""
    limited = (expectation == "pass_http_limited") & F.coalesce(status < 400, F.lit(False)) & (words > 0)
    by = F.coalesce(resolved, F.when(limited, "catalog"))
    issue = ~required & expectation.isin(*EXPECTED_ISSUES)
    told = F.when(by == "catalog", word_success(expectation, words, least)).when(by.isNotNull(), F.concat(F.lit("rescued_"), by)).when(issue, "expected_issue").otherwise("unresolved")
    return F.struct((by.isNotNull() | issue).alias("passed"), told.alias("outcome"), F.coalesce(by != "catalog", F.lit(False)).alias("rescued"))


def smoke_counts() -> list[Column]:
    """Totals over rows of (required, passed, outcome, rescued)."""
    counts = {"sites": F.lit(True), "required_total": F.col("required"), "required_passed": F.col("required") & F.col("passed"), "expected_issues": ~F.col("required") & (F.col("outcome") == "expected_issue"), "rescued": F.col("rescued")}
    return [F.count_if(c).alias(name) for name, c in counts.items()]


def tree_outcome(pages: Column, child_pages: Column, failures: Column) -> Column:
    """Grade of a bounded crawl."""
    return F.when(pages == 0, "blocked_root").when(child_pages == 0, "root_only").when(failures >= F.greatest(F.lit(10), pages * 3), "unstable_tree").when(pages < 3, "thin_tree").otherwise("ok")


def winners(attempts: DataFrame, keys: Sequence[str], order: str, passed: Column, *values: str) -> DataFrame:
    """The first attempt of each chain that passed (null if none), how many it took, and the executors in order."""
    first = F.min(F.when(passed, F.struct(order, *values)))
    chain = F.transform(F.array_sort(F.collect_list(F.struct(order, "executor"))), lambda x: x["executor"])
    return attempts.groupBy(*keys).agg(
        first.alias("_first"), F.count("*").alias("n_attempts"), F.count_if(~passed).alias("n_failed"), F.bool_or(F.col(order) > 0).alias("fell_back"), F.array_distinct(chain).alias("executors")
    ).select(*keys, F.col("_first")[order].alias(order), *[F.col("_first")[v].alias(v) for v in values], "n_attempts", "n_failed", "fell_back", "executors")


def next_adapter(order: Sequence[str], attempted: Column, disabled: Column) -> Column:
    """The first adapter that is neither attempted nor disabled; null if none is left."""
    return F.get(F.filter(F.array(*map(F.lit, order)), lambda a: ~F.array_contains(attempted, a) & ~F.array_contains(disabled, a)), F.lit(0))


def next_action(status: Column, n_artifacts: Column) -> Column:
    """What to do with a job."""
    return F.when(status.isin("queued", "running"), "poll_job_status").when(status == "failed", "inspect_job_error").when(n_artifacts > 0, "read_job_artifacts").otherwise("inspect_job_record")


def artifact_contract(made: Column, kinds: Mapping[str, str] = ARTIFACTS) -> Column:
    """primary_key, primary_kind, primary_path and sorted path_keys of a map of artifacts: keys that end in `_path`, with a path."""
    paths = F.map_filter(made, lambda k, v: F.endswith(k, F.lit("_path")) & (F.trim(v) != ""))
    known = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("kind")) for k, v in kinds.items()])
    first = F.get(F.filter(known, lambda x: F.map_contains_key(paths, x["key"])), F.lit(0))
    found = (("primary_key", first["key"]), ("primary_kind", first["kind"]), ("primary_path", F.try_element_at(paths, first["key"])))
    return F.struct(*[F.coalesce(c, F.lit("")).alias(name) for name, c in found], F.array_sort(F.map_keys(paths)).alias("path_keys"))
