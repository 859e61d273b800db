"""Catalog rules: literal entries."""

import json

from pagewake.operators import catalogs

SMOKE = {
    "site_key": "SOA ", "abbreviation": "SOA", "full_name": "Society", "priority": True, "homepage_url": "https://a.org", "monitor_url": "https://a.org/m", "fetch_mode": "auto", "fetch_config_json": {}, "smoke_required": "no",
    "smoke_expectation": "ssl_issue", "expected_min_words": 0, "js_heavy_candidate": 1, "website_status": "", "source_name": "", "source_row": "3", "notes": None,
}
DEV = {"site_key": "soa", "site_name": "n", "base_url": "https://a", "monitor_url": "https://a", "document_url": "https://a", "expected_min_doc_links": 1, "expected_min_monitor_words": "2", "expected_min_document_words": 0, "sample_download_limit": 0}


def run(spark, check, entries):
    rows = spark.createDataFrame([("c", i, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(entries)], "catalog string, position int, entry string")
    return sorted((tuple(r)[1:] for r in check(rows, "catalog").collect()), key=repr)


def test_smoke_rules(spark):
    changes = [{}, {"fetch_mode": "ftp"}, {"fetch_config_json": []}, {"smoke_required": 2}, {"tree_page_prefixes": {"a": 1}}, {"tree_page_prefixes": []}, {"tree_max_depth": None}, {"tree_max_depth": "deep"}, {"tree_seed_url": ""}, {"homepage_url": None}, {"source_row": "x"}]
    found = run(spark, catalogs.smoke_errors, [SMOKE | c | {"site_key": f"k{i}"} for i, c in enumerate(changes)])
    assert [r[2] for r in sorted(found)] == [None, "fetch_mode", "fetch_config_json", "smoke_required", "tree_page_prefixes", None, None, "tree_max_depth", None, "homepage_url", "source_row"]


def test_entries_that_are_none_and_duplicates(spark):
    lacking = {k: v for k, v in SMOKE.items() if k not in ("notes", "priority")}
    assert sorted(run(spark, catalogs.smoke_errors, [lacking, SMOKE, SMOKE | {"site_key": "soa"}, "[]", "{"])) == [(0, None, "missing:notes,priority"), (1, "soa", None), (2, "soa", "duplicate_site_key"), (3, None, "not_an_object"), (4, None, "not_an_object")]


def test_dev_rules(spark):
    found = run(spark, catalogs.dev_errors, [DEV, DEV | {"site_key": "CAS", "expected_min_doc_links": -1}, DEV | {"site_key": "x", "base_url": "http://a"}, DEV | {"site_key": "y", "sample_download_limit": "z"}])
    assert found == [(0, "soa", None), (1, "cas", "expected_min_doc_links"), (2, "x", "base_url"), (3, "y", "sample_download_limit"), (None, "iaa", "required_site_missing")]
