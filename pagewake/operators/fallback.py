"""Chains of acquisition adapters: what a result means, whether the next adapter is tried, and how a chain ends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewake.functions import urls

# For each status of an attempt whether it is fine, whether it has data, its data status and its stop reason.
ATTEMPTS = {
    "passed": (True, True, "present", "usable_data_found"),
    "failed_quality_gate": (True, False, "failed_quality_gate", "insufficient_data"),
    "blocked": (True, False, "blocked", "blocked"),
    "error": (False, False, "error", "error"),
    "skipped": (True, False, "not_applicable", "adapter_not_applicable"),
}
# Data statuses that end a chain, and those after which it goes on.
TERMINAL = ("present", "artifact_only", "not_found", "auth_required", "permission_denied", "running")
OPEN = ("empty", "failed_quality_gate", "blocked")
# Parts of an error's code that end a governed request as not to be trusted.
UNTRUSTED = ("protocol", "identity", "lineage", "integrity", "runtime_mismatch")


def mapped(status: Column) -> Column:
    """Struct of ok, has_data, data_status and stop_reason of an attempt's status; an unknown status is an error."""
    def of(row: tuple[bool, bool, str, str]) -> Column:
        return F.struct(*[F.lit(v).alias(n) for v, n in zip(row, ("ok", "has_data", "data_status", "stop_reason"), strict=True)])

    out = of(ATTEMPTS["error"])
    for name, row in ATTEMPTS.items():
        out = F.when(status == name, of(row)).otherwise(out)
    return out


def by_status_code(data_status: Column, code: Column) -> Column:
    """The data status that an HTTP status forces, or else null: a 403 leaves a blocked result blocked."""
    return F.when(code.isin(404, 410), "not_found").when(code == 401, "auth_required").when((code == 403) & (data_status != "blocked"), "permission_denied")


def goes_on(data_status: Column, skipped: Column, retryable: Column, safe: Column) -> Column:
    """Whether the next adapter is tried after a result; an error needs to be retryable and safe to escalate."""
    return F.coalesce(
        F.when(data_status.isin(*TERMINAL), False).when(data_status.isin(*OPEN), True).when(data_status == "not_applicable", skipped).when(data_status == "error", retryable & safe).otherwise(False), F.lit(False)
    )


def results(attempts: DataFrame, guarded: Sequence[str] = ("cloakbrowser",)) -> DataFrame:
    """Adds ok, has_data, data_status, stop_reason and `continues` to each attempt of a chain.

    Attempts: adapter, enabled, executable, permitted (a guarded adapter may be used), status, status_code, retryable, safe (null: false), final_url_safe.
    A disabled adapter or one that can't be run is skipped; a guarded one that isn't permitted, and a final URL that isn't safe, end the chain.
    """
    barred = F.col("enabled") & F.col("adapter").isin(*guarded) & ~F.col("permitted")
    skipped = ~F.col("enabled") | (~barred & ~F.col("executable"))
    x = attempts.withColumns({"skipped": skipped, "barred": barred}).withColumn("m", mapped(F.when(F.col("skipped"), "skipped").otherwise(F.coalesce("status", F.lit("error")))))
    x = x.withColumn("forced", F.when(~F.col("skipped"), by_status_code(F.col("m.data_status"), F.col("status_code"))))
    denied = F.col("barred") | (~F.col("skipped") & ~F.col("final_url_safe"))
    x = x.withColumns({
        "ok": F.when(denied, False).otherwise(F.col("m.ok")),
        "has_data": F.when(denied | F.col("forced").isNotNull(), False).otherwise(F.col("m.has_data")),
        "data_status": F.when(denied, "permission_denied").otherwise(F.coalesce("forced", "m.data_status")),
        "stop_reason": F.when(F.col("barred"), "unsafe_escalation").when(denied, "unsafe_final_url").otherwise(F.coalesce("forced", "m.stop_reason")),
    })
    no = F.lit(False)
    return x.withColumn("continues", goes_on(F.col("data_status"), F.col("skipped"), F.coalesce("retryable", no), F.coalesce("safe", no))).drop("m", "forced")


def chains(requests: DataFrame, attempts: DataFrame, key: str, position: str, max_attempts: int | None = None, guarded: Sequence[str] = ("cloakbrowser",)) -> DataFrame:
    """key, tool, ok, has_data, data_status, stop_reason, n_attempts, n_skipped: how the chain of each request ended.

    A chain ends with its first result that doesn't go on, so its end is the least place of such a result, and no chain is put into one group. Without one it ends with its
    last adapter, as out of attempts if the chain was as long as `max_attempts`, or else for want of adapters. requests: key, url_safe. Positions count from 0.
    """
    told = results(attempts, guarded)
    if max_attempts is not None:
        told = told.where(F.col(position) < max(0, max_attempts))
    fields = ["adapter", "ok", "has_data", "data_status", "stop_reason", "barred"]
    row = F.struct(position, *fields)
    ends = told.groupBy(key).agg(F.min(F.when(~F.col("continues"), row)).alias("end"), F.max(row).alias("last"), F.count("*").alias("n"))
    met = told.join(ends.where("end IS NOT NULL").select(key, F.col(f"end.{position}").alias("at")), key, "left").where(f"at IS NULL OR {position} <= at")
    counts = met.groupBy(key).agg(F.count_if(~F.col("barred")).alias("n_attempts"), F.count_if("skipped").alias("n_skipped"))
    out = F.lit("no_available_adapter") if max_attempts is None else F.when(F.col("n") >= max_attempts, "max_attempts_reached").otherwise("no_available_adapter")
    x = requests.select(key, "url_safe").join(ends, key, "left").join(counts, key, "left").withColumn("r", F.coalesce("end", "last"))
    safe, none = F.col("url_safe"), F.col("r").isNull()
    return x.select(
        key,
        F.when(~safe | none, "").otherwise(F.col("r.adapter")).alias("tool"),
        F.when(~safe, False).otherwise(F.coalesce("r.ok", F.lit(True))).alias("ok"),
        F.when(~safe | none, False).otherwise(F.col("r.has_data")).alias("has_data"),
        F.when(~safe, "permission_denied").when(none, "not_applicable").otherwise(F.col("r.data_status")).alias("data_status"),
        F.when(~safe, "unsafe_url").when(none, "no_available_adapter").when(F.col("end").isNull(), out).otherwise(F.col("r.stop_reason")).alias("stop_reason"),
        F.when(~safe, 0).otherwise(F.coalesce("n_attempts", F.lit(0))).cast("bigint").alias("n_attempts"),
        F.when(~safe, 0).otherwise(F.coalesce("n_skipped", F.lit(0))).cast("bigint").alias("n_skipped"),
    )


def governed(gates: dict[str, int], markers: Sequence[str], lineage: Sequence[tuple[str, str]]) -> Column:
    """Struct of decision, terminal and failed_rules of a governed request's result.

    Over columns present (there is a result), state, error_code, url, final_url, status_code, content (text), kind (page or document), representation, sha256_scope, sha256, and the measurements
    word_count, link_count and document_link_count. lineage: pairs of columns of request and result that must be equal.
    """
    code = F.lower(F.coalesce("error_code", F.lit("executor_error")))
    content = F.col("content")
    payload = F.try_to_binary(content, F.lit("base64"))
    described = content.isNotNull() & F.col("sha256").isNotNull() & F.coalesce(F.col("representation") == "base64", F.lit(False)) & F.coalesce(F.col("sha256_scope") == "decoded-bytes", F.lit(False))
    measured = (("min_words", "word_count"), ("min_links", "link_count"), ("min_document_links", "document_link_count"))
    short = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit(0)) < gates.get(rule, 0), rule) for rule, c in measured]))
    low = F.lower(F.coalesce(content, F.lit("")))
    marked = F.greatest(F.lit(False), F.lit(False), *[F.contains(low, F.lit(m.lower())) for m in markers])
    broken = F.greatest(F.lit(False), F.lit(False), *[~F.col(a).eqNullSafe(F.col(b)) for a, b in lineage])
    none = F.array().cast("array<string>")

    def told(decision: str, terminal: bool = False, rules: Column = none) -> Column:
        return F.struct(F.lit(decision).alias("decision"), F.lit(terminal).alias("terminal"), rules.alias("failed_rules"))

    def rule(name: str) -> Column:
        return F.array(F.lit(name))

    document = (
        F.when(~described, told("failed_quality_gate", rules=rule("document_representation")))
        .when(payload.isNull(), told("integrity_error", True, rule("document_base64")))
        .when(F.sha2(payload, 256) != F.col("sha256"), told("integrity_error", True, rule("document_sha256")))
        .otherwise(told("accepted"))
    )
    page = F.when(F.size(short) > 0, told("failed_quality_gate", rules=short)).when(marked, told("blocked")).otherwise(told("accepted"))
    failed = F.when(F.rlike(code, F.lit("|".join(UNTRUSTED))), told("integrity_error", True)).when(F.contains(code, F.lit("timeout")), told("timeout")).when(F.contains(code, F.lit("block")), told("blocked")).otherwise(told("executor_error"))
    fine = F.coalesce((F.col("status_code") >= 200) & (F.col("status_code") < 300), F.lit(False)) & content.isNotNull()
    return (
        F.when(~F.col("present"), told("protocol_error", True))
        .when(broken, told("lineage_mismatch", True))
        .when(~F.col("state").eqNullSafe("succeeded"), failed)
        .when(urls.origin(F.coalesce("final_url", "url")) != urls.origin(F.col("url")), told("unsafe_redirect", True))
        .when(F.col("status_code").isin(404, 410), told("not_found", True))
        .when(~fine, told("failed_quality_gate", rules=rule("successful_content")))
        .when(F.col("kind") == "document", document)
        .otherwise(page)
    )
