"""Tables of current state, folded from observations, and writes as new versions of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in an order, which should be total."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n")


def tracked(observed: DataFrame, keys: Sequence[str], run: str, order: str, hashed: str, latest: Sequence[str] = ()) -> DataFrame:
    """State of each key: first and last run, the hash last seen that isn't empty, and latest values.

    A fold over all observations with partial aggregates; no window, so hot keys reduce first.
    """
    at = F.struct(run, order)
    return observed.groupBy(*keys).agg(
        F.min(run).alias("first_seen_run_id"),
        F.max(run).alias("last_seen_run_id"),
        F.max_by(F.when(F.col(hashed) != "", F.col(hashed)), F.when(F.col(hashed) != "", at)).alias("latest_hash"),
        *[F.max_by(c, at).alias(f"latest_{c}") for c in latest],
        F.lit(0).alias("miss_count"),
        F.lit(True).alias("is_active"),
    )


def upsert_last(current: DataFrame, incoming: DataFrame, key: str, id_col: str, order: str) -> DataFrame:
    """Last write wins for each key, under the least id that the key has had."""
    rows = current.unionByName(incoming)
    kept = [c for c in rows.columns if c not in (key, id_col)]
    return rows.groupBy(key).agg(F.min(id_col).alias(id_col), *[F.max_by(c, F.struct(order, id_col)).alias(c) for c in kept])


def blobs(seen: DataFrame, sha256: str, at: str, *latest: str) -> DataFrame:
    """Content index: first and last time of each digest, and the latest values."""
    return seen.groupBy(sha256).agg(F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"), *[F.max(F.struct(at, c))[c].alias(c) for c in latest])


def patch(rows: DataFrame, updates: DataFrame, key: str, allowed: Sequence[str]) -> DataFrame:
    """Rows with the non-null values of an update of the same key; only allowed columns change."""
    new = updates.select(key, *[F.col(c).alias(f"_{c}") for c in allowed])
    return rows.join(new, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in allowed else F.col(c) for c in rows.columns])


def conflicts(rows: DataFrame, keys: Sequence[str], payload: Column) -> DataFrame:
    """Keys that were written with different payloads."""
    return rows.groupBy(*keys).agg(F.count_distinct(payload).alias("payloads")).where("payloads > 1")


def insert_guarded(rows: DataFrame, accepted: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows that refer to an accepted attempt."""
    return rows.join(accepted.select(*on).distinct(), list(on), "left_semi")


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in a total order."""
    return rows.orderBy(*order).limit(n)
