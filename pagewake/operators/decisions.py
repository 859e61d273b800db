"""Small decisions about responses, jobs, adapters, hosts and evidence, as native columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewake.functions import urls

# Outcomes of a request for a robots file, by what they mean for the request behind it.
DETERMINISTIC = ("terminal_http", "final_informational", "transport_malformed_status", "body_incomplete", "redirect_missing_location", "redirect_malformed_location")
RETRYABLE = ("transient_http", "body_remote_disconnected", "body_transient", "transport_dns", "transport_connect", "transport_remote_disconnected", "transport_connect_or_http", "transport_timeout")
UNSAFE = ("authority_http", "body_tls_policy", "robots_unsupported_mime_or_charset", "unclassified_http", "redirect_authority_failure", "unclassified_transport")
SPENT = ("wire_budget_exhausted", "decoded_budget_exhausted")
HARMLESS = ("success", "completed_empty", "redirect")
#: The last retry of a request, and the chains of adapters that have a name.
LAST_RETRY = 2
CHAINS = {
    "public_web_default": ("web_http", "browser_rendered", "sitemap", "rss"),
    "document_discovery": ("web_http", "sitemap", "browser_rendered", "rss"),
    "dynamic_page_default": ("web_http", "browser_rendered", "sitemap", "rss"),
    "authorized_fallback": ("web_http", "browser_rendered", "cloakbrowser", "batch_python"),
}


def preflight_class(outcome: Column, retry: Column, unsafe: Column, spent: Column) -> Column:
    """deterministic, transient, safety or budget, from the last outcome of a preflight and related evidence; else null."""
    known = F.coalesce(outcome, F.lit("success"))
    retried = F.when(F.coalesce(retry == LAST_RETRY, F.lit(False)), "transient").when(spent, "budget")
    return (
        F.when(known.isin(*DETERMINISTIC), "deterministic")
        .when(known.isin(*RETRYABLE), retried)
        .when(known.isin(*UNSAFE) | F.startswith(known, F.lit("transport_")), "safety")
        .when(known.isin(*SPENT), F.when(spent, "budget").otherwise("safety"))
        .when(unsafe, "safety")
        .when(spent, "budget")
        .when(~known.isin(*HARMLESS), "safety")
    )


def response_class(status: Column) -> Column:
    """What a status line asks for: its body, a retry, another place, or nothing."""
    return (
        F.when(status.between(200, 299), "body")
        .when(status.isin(401, 403), "authority")
        .when(status.isin(404, 410), "empty")
        .when(status.isin(301, 302, 303, 307, 308), "redirect")
        .when(status.between(100, 199), "informational")
        .when(status.isin(408, 425, 429) | status.between(500, 599), "transient")
        .when(status.between(400, 499), "terminal")
        .otherwise("unclassified")
    )


def artifact_summary(artifacts: Column) -> Column:
    """Struct of number, sorted keys and keys of paths of a map of artifacts; a null map is empty."""
    keys = F.coalesce(F.array_sort(F.map_keys(artifacts)), F.array().cast("array<string>"))
    return F.struct(F.size(keys).alias("artifact_count"), keys.alias("artifact_keys"), F.filter(keys, lambda k: F.endswith(k, F.lit("_path"))).alias("path_keys"))


def job_result(status: Column, has_artifacts: Column) -> Column:
    """Struct of stage, progress, data_status and stop_reason of a job."""
    ended = status.isin("completed", "failed")
    waits = status.isin("queued", "running")
    return F.struct(
        F.when(ended, status).otherwise("accepted").alias("stage"),
        F.when(ended, 100).otherwise(0).alias("progress"),
        F.when(waits, "running").when(status == "failed", "error").when(has_artifacts, "artifact_only").otherwise("not_applicable").alias("data_status"),
        F.when(waits, "job_running").when(status == "failed", "job_failed").when(has_artifacts, "job_completed_with_artifacts").otherwise("job_completed").alias("stop_reason"),
    )


def capture_status(data_status: Column) -> Column:
    """The status of a capture that a data status stands for."""
    return F.when(data_status == "present", "passed").when(data_status.isin("blocked", "permission_denied", "auth_required"), "blocked").when(data_status == "error", "error").otherwise("failed_quality_gate")


def adapter_chain(strategy: Column, default: Column, fallback: Column) -> Column:
    """The chain of a named strategy, or else the default and the fallback adapters, each once."""
    out = F.array_distinct(F.concat(F.array(default), fallback))
    for name, chain in CHAINS.items():
        out = F.when(strategy == name, F.array(*map(F.lit, chain))).otherwise(out)
    return out


def input_url_error(url: Column, domains: Sequence[str]) -> Column:
    """not_absolute, outside_domains, or null for a URL that may be asked for; without domains, all hosts may."""
    bare = F.coalesce(url, F.lit(""))
    absolute = F.rlike(bare, F.lit("^(?i)https?://")) & (urls.host(bare) != "")
    outside = ~urls.domain_allowed(urls.host(bare), domains) if domains else F.lit(False)
    return F.when(~absolute, "not_absolute").when(outside, "outside_domains")


def rescue_candidates(sites: DataFrame, site: str = "site", url: str = "url", mode: str = "fetch_mode") -> DataFrame:
    """site, ordinal, strategy, url, fetch_mode: what to try for a site, in order; no browser for sites that use one already."""
    root = urls.origin(F.col(url))

    def candidate(name: str, where: Column, how: Column) -> Column:
        return F.struct(F.lit(name).alias("strategy"), where.alias("url"), how.alias("fetch_mode"))

    tries = F.array_compact(
        F.array(
            candidate("catalog", F.col(url), F.col(mode)),
            F.when(F.coalesce(F.col(mode) != "browser", F.lit(True)), candidate("browser", F.col(url), F.lit("browser"))),
            candidate("sitemap", F.concat(root, F.lit("/sitemap.xml")), F.lit("http")),
            candidate("rss", F.concat(root, F.lit("/rss.xml")), F.lit("http")),
        )
    )
    return sites.select(site, F.posexplode(tries).alias("ordinal", "c")).select(site, "ordinal", "c.*")


def evidence_action(status: Column, recommended: Column) -> Column:
    """What to do after the latest attempt (null status: none), given the recommended adapter, or an empty text."""
    named = F.coalesce(recommended, F.lit(""))
    none = F.when(named != "", F.concat(F.lit("use_profile_default:"), named)).otherwise("review_acquisition_inputs")
    return F.when(status.isNull(), none).when(status == "passed", "use_adapter_output").when(named != "", F.concat(F.lit("try_adapter:"), named)).otherwise("review_probe_failure")


def safe_evidence(text: Column) -> Column:
    """The text, or its digest if it holds control characters or user information before a host."""
    unsafe = F.rlike(text, F.lit(r"[\x00-\x1F\x7F]")) | F.rlike(text, F.lit(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*@"))
    return F.when(unsafe, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)


def severity_rules(rows: DataFrame, severities: Mapping[str, str]) -> DataFrame:
    """Each row with the rule of its change_type: severity and weight 10; null for types without a rule."""
    known = F.create_map(*[F.lit(x) for pair in severities.items() for x in pair])
    severity = F.try_element_at(known, F.col("change_type"))
    return rows.select("*", severity.alias("severity"), F.when(severity.isNotNull(), 10).alias("weight"))


def longest_rule_lines(matches: DataFrame, row: str) -> DataFrame:
    """row and the sorted lines of its matching rules of the greatest specificity; matches are (row, line, octets)."""
    lines = matches.groupBy(row, "octets").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    return lines.groupBy(row).agg(F.max_by("lines", "octets").alias("lines"))
