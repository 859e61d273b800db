"""Change detection between crawl runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def between(old: DataFrame, new: DataFrame, key: str, hashed: str, complete: Column | None = None, not_found: DataFrame | None = None) -> DataFrame:
    """key, change (new, changed, missing or same), old and new hash.

    A key without a new row is missing if the run was complete, or if its URL was confirmed not
    found; else it is unknown. An empty old hash means that nothing is known to have changed.
    """
    a = old.select(key, F.col(hashed).alias("old_hash"))
    b = new.select(key, F.col(hashed).alias("new_hash"), F.lit(True).alias("_seen"))
    both = a.withColumn("_known", F.lit(True)).join(b, key, "full")
    gone = F.lit(True) if complete is None else complete
    if not_found is not None:
        both = both.join(not_found.select(key, F.lit(True).alias("_gone")).distinct(), key, "left")
        gone = gone | F.coalesce("_gone", F.lit(False))
    change = (
        F.when(F.col("_known").isNull(), "new")
        .when(F.col("_seen").isNull(), F.when(gone, "missing").otherwise("unknown"))
        .when((F.col("old_hash") != "") & (F.col("old_hash") != F.col("new_hash")), "changed")
        .otherwise("same")
    )
    return both.select(key, change.alias("change"), "old_hash", "new_hash")


def previous(rows: DataFrame, keys: list[str], run: str, value: str, *order: str) -> DataFrame:
    """Rows with the value of the key's row before, in run order."""
    w = Window.partitionBy(*keys).orderBy(run, *order)
    return rows.withColumn(f"previous_{value}", F.lag(value).over(w))


def before_run(rows: DataFrame, keys: list[str], run: str, limit: int, value: str, order: str) -> DataFrame:
    """The latest value of each key before a run."""
    return rows.where(F.col(run) < limit).groupBy(*keys).agg(F.max_by(value, F.struct(run, order)).alias(f"previous_{value}"))


def counters(changes: DataFrame, by: list[str]) -> DataFrame:
    """Numbers of new, changed and missing rows, and of all three."""
    each = [F.count_if(F.col("change") == c).alias(f"n_{c}") for c in ("new", "changed", "missing")]
    return changes.groupBy(*by).agg(*each, F.count_if(F.col("change").isin("new", "changed", "missing")).alias("n_changes"))
