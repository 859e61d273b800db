"""Review of changes: severity rules, the review queue and its summary."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewake.functions import urls

#: Order of severities, and the severity of a change that no rule matches.
SEVERITIES = ("critical", "high", "medium", "low")
FALLBACK = {"new_file": "high"}
FIELDS = ("url", "page_url", "download_url", "preferred_display_path", "title", "doc_type", "content_type")


def severity_rank(severity: Column) -> Column:
    """0 for critical to 3 for low, 4 for any other."""
    return reduce(lambda out, s: F.when(severity == s[1], s[0]).otherwise(out), reversed(list(enumerate(SEVERITIES))), F.lit(len(SEVERITIES)))


def matches(rule: dict, fields: Sequence[str] = FIELDS) -> Column:
    """Whether an item row matches a rule by change type, path prefix, file type or keyword."""
    kind, value = rule["rule_type"], rule["match_value"]
    values = [F.coalesce(F.lower(F.col(f)), F.lit("")) for f in fields]
    if kind == "change_type":
        return F.lower("change_type") == value.lower()
    if kind == "prefix":
        return reduce(lambda a, b: a | b, [F.startswith(F.coalesce(urls.path_of(F.col(f)), F.lit("")), F.lit(value)) for f in fields if f in ("url", "page_url", "preferred_display_path")])
    if kind == "file_type":
        plain = value.lower().lstrip(".")
        one = lambda v: F.endswith(v, F.lit(f".{plain}")) | F.contains(v, F.lit(f"/{plain}")) | F.array_contains(F.split(v, "/"), plain)
        return reduce(lambda a, b: a | b, map(one, values))
    if kind == "keyword":
        return reduce(lambda a, b: a | b, [F.contains(v, F.lit(value.lower())) for v in values])
    return F.lit(False)


def evaluate(items: DataFrame, rules: Sequence[dict], fields: Sequence[str] = FIELDS) -> DataFrame:
    """Items with severity, policy_weight, matched_rule (its number, null for the fallback), reason and recommended_action.

    Of the rules that match, the most severe wins, then the heaviest, then the first. Rules are a
    short parameter list, so they are compiled into columns instead of being joined.
    """
    rank = {s: i for i, s in enumerate(SEVERITIES)}
    order = sorted(range(len(rules)), key=lambda i: (rank.get(rules[i]["severity"], 4), -int(rules[i].get("weight") or 0), i))
    fallback = reduce(lambda out, kv: F.when(F.col("change_type") == kv[0], kv[1]).otherwise(out), FALLBACK.items(), F.lit("medium"))
    chosen = F.lit(None).cast("int")
    for i in reversed(order):
        chosen = F.when(matches(rules[i], fields), i).otherwise(chosen)
    out = items.withColumn("matched_rule", chosen)

    def of(field: str, default: Column) -> Column:
        return reduce(lambda o, r: F.when(F.col("matched_rule") == r[0], F.lit(r[1].get(field))).otherwise(o), enumerate(rules), default)

    out = out.withColumn("severity", of("severity", fallback)).withColumn("policy_weight", of("weight", F.lit(0)).cast("int"))
    template = of("reason_template", F.lit("{change_type} matched fallback change severity `{severity}`."))
    for name, value in (("{change_type}", "change_type"), ("{entity_url}", "url"), ("{severity}", "severity")):
        template = F.replace(template, F.lit(name), F.coalesce(F.col(value), F.lit("")))
    return out.withColumn("reason", template).withColumn("recommended_action", of("recommended_action", F.lit("review_change")))


def queue_order() -> list[Column]:
    """Severity, weight, then the URL."""
    return [severity_rank(F.col("severity")), F.col("policy_weight").desc(), F.col("url")]


def summary(reviewed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of severities and the highest one."""
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES]
    return reviewed.groupBy(*by).agg(*counts, F.min_by("severity", severity_rank(F.col("severity"))).alias("highest"), F.count("*").alias("n_items"))


def decision(n_high: Column, n_items: Column) -> Column:
    return F.when(n_high > 0, "review_now").when(n_items > 0, "review_later").otherwise("no_change")
