"""Scope planning: prefixes, and what a selection of them allows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewake.functions import urls


def site_prefixes(snapshots: DataFrame) -> DataFrame:
    """Distinct site and prefix, of the first two path levels."""
    both = F.explode(F.array(urls.path_prefix(F.col("path"), 1), urls.path_prefix(F.col("path"), 2))).alias("prefix")
    return snapshots.select("site", both).distinct()


def ancestors(prefix: str):
    """The prefixes that cover a prefix, itself left out: those of its own segments, and the root."""
    parts = urls.segments(F.col(prefix))
    upper = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(parts) > 0, F.concat(F.array(F.lit("/")), upper)).otherwise(F.array().cast("array<string>"))


def covered_by(rows: DataFrame, others: DataFrame, key: str, prefix: str) -> DataFrame:
    """Distinct key and prefix of rows that another table's prefix of the same key covers; an equi-join on ancestors."""
    up = rows.select(key, prefix, F.explode(ancestors(prefix)).alias("_up"))
    return up.join(others.select(key, F.col(prefix).alias("_up")), [key, "_up"], "left_semi").select(key, prefix).distinct()


def minimal_prefixes(prefixes: DataFrame, key: str, prefix: str) -> DataFrame:
    """Prefixes that no other of the same key covers."""
    return prefixes.join(covered_by(prefixes, prefixes, key, prefix), [key, prefix], "left_anti").select(key, prefix)


def plan_scope(prefixes: DataFrame, key: str, prefix: str, selected: str) -> DataFrame:
    """key, prefix, role: allowed (minimal selected), focus (selected below them) or excluded (no overlap with them)."""
    chosen, rejected = prefixes.where(selected).select(key, prefix), prefixes.where(~F.col(selected)).select(key, prefix)
    allowed = minimal_prefixes(chosen, key, prefix)
    focus = chosen.join(allowed, [key, prefix], "left_anti")
    below = covered_by(rejected, allowed, key, prefix)
    above = allowed.select(key, F.explode(ancestors(prefix)).alias(prefix))
    excluded = rejected.join(allowed.unionByName(below).unionByName(above), [key, prefix], "left_anti")
    tagged = ((allowed, "allowed"), (focus, "focus"), (excluded, "excluded"))
    return tagged[0][0].withColumn("role", F.lit("allowed")).unionByName(tagged[1][0].withColumn("role", F.lit("focus"))).unionByName(tagged[2][0].withColumn("role", F.lit("excluded")))
