"""Chains and decisions: literal cases."""

import base64
import hashlib

from pagewake.operators import fallback

ATTEMPT = "request bigint, place int, adapter string, enabled boolean, executable boolean, permitted boolean, status string, status_code int, retryable boolean, safe boolean, final_url_safe boolean"


def attempt(place, adapter, status="failed_quality_gate", code=200, enabled=True, executable=True, permitted=False, retryable=None, safe=None, final=True):
    return place, adapter, enabled, executable, permitted, status, code, retryable, safe, final


CASES = {
    "second passes": ([attempt(0, "web_http"), attempt(1, "browser_rendered", "passed")], ("browser_rendered", True, True, "present", "usable_data_found", 2, 0)),
    "first passes": ([attempt(0, "web_http", "passed"), attempt(1, "browser_rendered", "passed")], ("web_http", True, True, "present", "usable_data_found", 1, 0)),
    "reserved in between": ([attempt(0, "web_http"), attempt(1, "sitemap", None, executable=False), attempt(2, "browser_rendered", "passed")], ("browser_rendered", True, True, "present", "usable_data_found", 3, 1)),
    "disabled": ([attempt(0, "web_http", "passed", enabled=False)], ("web_http", True, False, "not_applicable", "no_available_adapter", 1, 1)),
    "stealth not permitted": ([attempt(0, "web_http"), attempt(1, "cloakbrowser", "passed")], ("cloakbrowser", False, False, "permission_denied", "unsafe_escalation", 1, 0)),
    "stealth permitted": ([attempt(0, "cloakbrowser", "passed", permitted=True)], ("cloakbrowser", True, True, "present", "usable_data_found", 1, 0)),
    "gone": ([attempt(0, "web_http", "passed", 410), attempt(1, "browser_rendered", "passed")], ("web_http", True, False, "not_found", "not_found", 1, 0)),
    "forbidden": ([attempt(0, "web_http", code=403), attempt(1, "browser_rendered", "passed")], ("web_http", True, False, "permission_denied", "permission_denied", 1, 0)),
    "blocked with 403 goes on": ([attempt(0, "web_http", "blocked", 403), attempt(1, "browser_rendered", "passed")], ("browser_rendered", True, True, "present", "usable_data_found", 2, 0)),
    "login": ([attempt(0, "web_http", "passed", 401)], ("web_http", True, False, "auth_required", "auth_required", 1, 0)),
    "error ends": ([attempt(0, "web_http", "error"), attempt(1, "browser_rendered", "passed")], ("web_http", False, False, "error", "error", 1, 0)),
    "safe error goes on": ([attempt(0, "web_http", "error", retryable=True, safe=True), attempt(1, "browser_rendered", "passed")], ("browser_rendered", True, True, "present", "usable_data_found", 2, 0)),
    "unsafe final": ([attempt(0, "web_http", "passed", final=False)], ("web_http", False, False, "permission_denied", "unsafe_final_url", 1, 0)),
    "none passes": ([attempt(0, "web_http"), attempt(1, "browser_rendered", "blocked")], ("browser_rendered", True, False, "blocked", "no_available_adapter", 2, 0)),
    "no adapter": ([], ("", True, False, "not_applicable", "no_available_adapter", 0, 0)),
}


def run(spark, cases, max_attempts=None, unsafe=()):
    rows = [(i, *a) for i, (attempts, _) in enumerate(cases) for a in attempts]
    requests = spark.createDataFrame([(i, i not in unsafe) for i in range(len(cases))], "request bigint, url_safe boolean")
    found = fallback.chains(requests, spark.createDataFrame(rows, ATTEMPT), "request", "place", max_attempts)
    return [tuple(r)[1:] for r in sorted(found.collect())]


def test_chains(spark):
    assert run(spark, CASES.values()) == [want for _, want in CASES.values()]


def test_limits_and_unsafe_urls(spark):
    two = [CASES["second passes"]]
    assert run(spark, two, max_attempts=1) == [("web_http", True, False, "failed_quality_gate", "max_attempts_reached", 1, 0)]
    assert run(spark, two, max_attempts=0) == [("", True, False, "not_applicable", "no_available_adapter", 0, 0)]
    assert run(spark, two, unsafe={0}) == [("", False, False, "permission_denied", "unsafe_url", 0, 0)]


def test_governed_documents(spark):
    good, digest = base64.b64encode(b"%PDF-1.4").decode(), hashlib.sha256(b"%PDF-1.4").hexdigest()
    schema = "id int, present boolean, state string, error_code string, url string, final_url string, status_code int, content string, kind string, representation string, sha256_scope string, sha256 string, word_count int, link_count int, document_link_count int, a string, b string"
    base = dict(id=0, present=True, state="succeeded", error_code=None, url="https://a.org/x", final_url=None, status_code=200, content=good, kind="document", representation="base64", sha256_scope="decoded-bytes", sha256=digest, word_count=0, link_count=0, document_link_count=0, a="r", b="r")
    cases = [({}, "accepted", False, []), ({"content": "%%%"}, "integrity_error", True, ["document_base64"]), ({"sha256": "0"}, "integrity_error", True, ["document_sha256"]), ({"sha256": None}, "failed_quality_gate", False, ["document_representation"]), ({"final_url": "https://b.org/x"}, "unsafe_redirect", True, []),
             ({"b": None}, "lineage_mismatch", True, []), ({"state": "failed", "error_code": "runtime_mismatch"}, "integrity_error", True, []), ({"state": None}, "executor_error", False, []), ({"status_code": None}, "failed_quality_gate", False, ["successful_content"]), ({"kind": "page", "word_count": 3}, "failed_quality_gate", False, ["min_words"]),
             ({"kind": "page", "word_count": 9, "content": "Access DENIED now"}, "blocked", False, []), ({"kind": "page", "word_count": 9}, "accepted", False, [])]
    rows = spark.createDataFrame([tuple((base | change | {"id": i}).values()) for i, (change, *_) in enumerate(cases)], schema)
    found = rows.select("id", fallback.governed({"min_words": 5}, ["access denied"], [("a", "b")]).alias("d")).select("id", "d.*").collect()
    assert [tuple(r)[1:] for r in sorted(found)] == [tuple(want) for _, *want in cases]
