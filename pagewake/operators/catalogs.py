"""Catalogs of sites as JSON entries: the first rule that an entry breaks, by `VARIANT`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields that an entry must have, those that are flags and whole numbers, and the values that two of them may take.
SMOKE_FIELDS = (
    "abbreviation", "expected_min_words", "fetch_config_json", "fetch_mode", "full_name", "homepage_url", "js_heavy_candidate", "monitor_url",
    "notes", "priority", "site_key", "smoke_expectation", "smoke_required", "source_name", "source_row", "website_status",
)
SMOKE_FLAGS, SMOKE_NUMBERS, SMOKE_URLS = ("priority", "smoke_required", "js_heavy_candidate"), ("expected_min_words", "source_row"), ("homepage_url", "monitor_url")
TREE_LISTS, TREE_NUMBERS = ("tree_page_prefixes", "tree_file_prefixes"), ("tree_max_depth", "tree_max_pages", "tree_max_files")
EXPECTATIONS = ("broken_upstream", "known_blocked", "pass_http", "pass_http_browser_ua", "pass_http_limited", "ssl_issue")
FETCH_MODES = ("http", "browser", "auto")
FLAGS = ("true", "1", "yes", "false", "0", "no")
DEV_FIELDS = ("base_url", "document_url", "expected_min_doc_links", "expected_min_document_words", "expected_min_monitor_words", "monitor_url", "sample_download_limit", "site_key", "site_name")
DEV_URLS = ("base_url", "monitor_url", "document_url")
DEV_NUMBERS = ("expected_min_doc_links", "expected_min_monitor_words", "expected_min_document_words", "sample_download_limit")
DEV_SITES = ("soa", "cas", "iaa")
SECURE = "https://"


def _get(field: str) -> Column:
    return F.try_variant_get(F.col("v"), f"$.{field}", "variant")


def _text(field: str) -> Column:
    """The field as trimmed text; JSON null reads None."""
    return F.trim(F.coalesce(F.try_variant_get(F.col("v"), f"$.{field}", "string"), F.lit("None")))


def _is(field: str, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(_get(field)), F.lit(kind)), F.lit(False))


def _given(field: str) -> Column:
    """There, and not JSON null."""
    return _get(field).isNotNull() & ~F.is_variant_null(_get(field))


def _whole(field: str) -> Column:
    return F.try_variant_get(F.col("v"), f"$.{field}", "bigint")


def _entries(catalog: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Parsed entries with their site key, the fields they lack, and whether an earlier entry of the catalog has the key."""
    v = F.try_parse_json("entry")
    x = catalog.select(*keys, "position", v.alias("v")).withColumn("is_object", F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False)))
    lacks = F.array_compact(F.array(*[F.when(_get(f).isNull(), f) for f in fields]))
    x = x.withColumns({"lacks": lacks, "site_key": F.when(F.col("is_object"), F.lower(_text("site_key")))})
    first = x.where(F.size("lacks") == 0).groupBy(*keys, "site_key").agg(F.min("position").alias("first"))
    return x.join(first, [*keys, "site_key"], "left")


def _first_error(x: DataFrame, keys: Sequence[str], rules: Sequence[tuple[Column, str]]) -> DataFrame:
    error = F.when(~F.col("is_object"), "not_an_object").when(F.size("lacks") > 0, F.concat(F.lit("missing:"), F.array_join("lacks", ","))).when(F.col("site_key") == "", "site_key").when(F.col("position") > F.col("first"), "duplicate_site_key")
    for broken, name in rules:
        error = error.when(broken, name)
    return x.select(*keys, "position", F.when(F.size("lacks") == 0, F.col("site_key")).alias("site_key"), error.alias("error"))


def smoke_errors(catalog: DataFrame, *keys: str) -> DataFrame:
    """keys, position, site_key, and the first rule of smoke catalogs that the entry breaks (null: none). catalog: keys, position, entry (JSON)."""
    rules = [(~F.startswith(_text(f), F.lit(SECURE)), f) for f in SMOKE_URLS]
    rules += [(~_text("smoke_expectation").isin(*EXPECTATIONS), "smoke_expectation"), (~F.lower(_text("fetch_mode")).isin(*FETCH_MODES), "fetch_mode"), (~_is("fetch_config_json", "OBJECT"), "fetch_config_json")]
    seed = F.when(_get("tree_seed_url").isNotNull(), _text("tree_seed_url")).otherwise("")
    rules += [((seed != "") & ~F.startswith(seed, F.lit(SECURE)), "tree_seed_url")]
    rules += [(_given(f) & ~_is(f, "ARRAY") & ~_text(f).isin("", "false", "0"), f) for f in TREE_LISTS]
    rules += [(_given(f) & _whole(f).isNull(), f) for f in TREE_NUMBERS]
    rules += [(~F.lower(_text(f)).isin(*FLAGS), f) for f in SMOKE_FLAGS] + [(_whole(f).isNull(), f) for f in SMOKE_NUMBERS]
    return _first_error(_entries(catalog, keys, SMOKE_FIELDS), keys, rules)


def dev_errors(catalog: DataFrame, *keys: str) -> DataFrame:
    """The same for development targets; a catalog without one of its own sites has a row of no position for each."""
    rules = [(~F.startswith(_text(f), F.lit(SECURE)), f) for f in DEV_URLS] + [(F.coalesce(_whole(f) < 0, F.lit(True)), f) for f in DEV_NUMBERS]
    x = _entries(catalog, keys, DEV_FIELDS)
    wanted = catalog.select(*keys).distinct().withColumn("site_key", F.explode(F.array(*map(F.lit, DEV_SITES))))
    absent = wanted.join(x.where(F.size("lacks") == 0).select(*keys, "site_key"), [*keys, "site_key"], "left_anti")
    told = absent.select(*keys, F.lit(None).cast(catalog.schema["position"].dataType).alias("position"), "site_key", F.lit("required_site_missing").alias("error"))
    return _first_error(x, keys, rules).unionByName(told)
