"""Acquisition evidence of changing shape: one attempt row from a bare object, a wrapped one, or a list, by `VARIANT`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The version that marks a bare attempt, and the fields of an attempt.
BARE = "capture-attempt.v1"
FIELDS = ("adapter", "status", "url", "final_url", "failure_reason", "recommended_next_adapter")
BAD_JSON, BAD_ROOT, BAD_ENTRY = "json_invalid", "root_invalid", "attempt_invalid"


def _kind(v: Column) -> Column:
    """object, list, or the name of a scalar's type."""
    schema = F.schema_of_variant(v)
    return F.when(F.startswith(schema, F.lit("OBJECT")), "object").when(F.startswith(schema, F.lit("ARRAY")), "list").otherwise(F.lower(schema))


def attempts(artifacts: DataFrame, key: str, payload: str) -> DataFrame:
    """key, n (from 0; null if there are none), form, next_action, default_adapter, the fields of the attempt, and error: at least one row for each artifact.

    Forms: list (of attempts), bare (an object of version BARE), wrapped (`attempt`), attempts (a list in `attempts`) and none. The first that fits counts. A text that is no JSON, a root that is
    neither object nor list, and an entry that is no object are errors of their rows. Null counts as no evidence. Numbers and booleans in text fields become text.
    """
    v = F.try_parse_json(F.col(payload))
    x = artifacts.select(key, F.col(payload).alias("_text"), v.alias("v")).withColumn("root", _kind(F.col("v")))
    get = lambda path, kind="string": F.try_variant_get(F.col("v"), path, kind)
    is_object = F.col("root") == "object"
    listed = lambda value: F.try_variant_get(value, "$", "array<variant>")
    form = (
        F.when(F.col("_text").isNull() | (F.col("root") == "void"), "none")
        .when(F.col("root") == "list", "list")
        .when(is_object & (get("$.schema_version") == BARE), "bare")
        .when(is_object & (_kind(get("$.attempt", "variant")) == "object"), "wrapped")
        .when(is_object & (_kind(get("$.attempts", "variant")) == "list"), "attempts")
        .otherwise("none")
    )
    x = x.withColumn("form", form).withColumn(
        "items",
        F.when(F.col("form") == "list", listed(F.col("v"))).when(F.col("form") == "bare", F.array("v")).when(F.col("form") == "wrapped", F.array(get("$.attempt", "variant"))).when(F.col("form") == "attempts", listed(get("$.attempts", "variant"))),
    )
    root_error = F.when(F.col("_text").isNotNull() & F.col("v").isNull(), BAD_JSON).when(F.col("_text").isNotNull() & ~F.col("root").isin("object", "list", "void"), BAD_ROOT)
    told = x.select(key, "form", F.coalesce(F.when(is_object, get("$.next_action")), F.lit("")).alias("next_action"), F.when(is_object, get("$.profile.default_adapter")).alias("default_adapter"), root_error.alias("root_error"), F.posexplode_outer("items").alias("n", "item"))
    wrong = F.col("n").isNotNull() & ~F.coalesce(_kind(F.col("item")) == "object", F.lit(False))
    fields = [F.when(~wrong, F.try_variant_get(F.col("item"), f"$.{f}", "string")).alias(f) for f in FIELDS]
    return told.select(key, "n", "form", "next_action", "default_adapter", *fields, F.coalesce("root_error", F.when(wrong, BAD_ENTRY)).alias("error"))


def summaries(told: DataFrame, key: str) -> DataFrame:
    """key, n_attempts, latest status, recommended_next_adapter, next_action and error of each artifact.

    An error anywhere leaves only itself. The adapter is that of the last attempt, or else the profile's default; the action is the artifact's own, or else follows from both.
    """
    last = F.max_by(F.struct(F.coalesce("status", F.lit("")).alias("status"), F.coalesce("recommended_next_adapter", F.lit("")).alias("next")), "n")
    x = told.groupBy(key).agg(F.count("n").alias("n_attempts"), last.alias("last"), F.max("next_action").alias("own"), F.max("default_adapter").alias("by_default"), F.max("error").alias("error"))
    some = F.col("n_attempts") > 0
    adapter = F.when(some, F.col("last.next")).otherwise(F.coalesce("by_default", F.lit("")))
    action = (
        F.when(~some, F.when(adapter != "", F.concat(F.lit("use_profile_default:"), adapter)).otherwise("review_acquisition_inputs"))
        .when(F.col("last.status") == "passed", "use_adapter_output")
        .when(adapter != "", F.concat(F.lit("try_adapter:"), adapter))
        .otherwise("review_probe_failure")
    )
    fine = F.col("error").isNull()
    return x.select(key, F.when(fine, F.col("n_attempts")).alias("n_attempts"), F.when(fine & some, F.col("last.status")).alias("status"), F.when(fine, adapter).alias("recommended_next_adapter"), F.when(fine, F.coalesce(F.nullif("own", F.lit("")), action)).alias("next_action"), "error")
