"""Operators on small tables with known results."""

import hashlib
import json

from pyspark.sql import functions as F

from pagewake.functions import identity
from pagewake.operators import acquisition, changes, governance, graph, planning, review, sections, state, summary
from pagewake.plans import registry
from pagewake.streaming import changes as streams


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_changes_are_conservative_when_incomplete(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", ""), ("d", "1")], "u string, h string")
    new = spark.createDataFrame([("b", "2"), ("c", "9"), ("e", "1")], "u string, h string")
    full = {r.u: r.change for r in changes.between(old, new, "u", "h").collect()}
    assert full == {"a": "missing", "b": "changed", "c": "same", "d": "missing", "e": "new"}
    gone = spark.createDataFrame([("a",)], "u string")
    part = {r.u: r.change for r in changes.between(old, new, "u", "h", F.lit(False), gone).collect()}
    assert part == {"a": "missing", "b": "changed", "c": "same", "d": "unknown", "e": "new"}
    assert changes.between(old.limit(0), new.limit(0), "u", "h").count() == 0


def test_state_keeps_the_first_run_and_the_last_hash(spark):
    seen = spark.createDataFrame([("u", 1, 1, "x"), ("u", 2, 2, "y"), ("u", 3, 3, ""), ("v", 2, 4, "")], "u string, run int, id int, h string")
    got = {r.u: (r.first_seen_run_id, r.last_seen_run_id, r.latest_hash) for r in state.tracked(seen, ["u"], "run", "id", "h").collect()}
    assert got == {"u": (1, 3, "y"), "v": (2, 2, None)}


def test_upserts_patches_and_conflicts(spark):
    old = spark.createDataFrame([(1, "u", "a", 1)], "id int, u string, v string, at int")
    new = spark.createDataFrame([(7, "u", "b", 2), (8, "w", "c", 2)], "id int, u string, v string, at int")
    assert rows(state.upsert_last(old, new, "u", "id", "at").select("u", "id", "v")) == [("u", 1, "b"), ("w", 8, "c")]
    assert rows(state.patch(new, spark.createDataFrame([(7, "z", None)], "id int, v string, at int"), "id", ["v", "at"])) == [(7, "u", "z", 2), (8, "w", "c", 2)]
    assert rows(state.conflicts(old.unionByName(new), ["u"], F.col("v"))) == [("u", 2)]


def test_prefix_planning(spark):
    p = spark.createDataFrame([("s", "/a", True), ("s", "/a/b", True), ("s", "/a/c", False), ("s", "/d", False), ("t", "/", True), ("t", "/x", True)], "s string, p string, chosen boolean")
    assert rows(planning.minimal_prefixes(p, "s", "p")) == [("s", "/a"), ("s", "/d"), ("t", "/")]
    assert rows(planning.plan_scope(p, "s", "p", "chosen")) == [("s", "/a", "allowed"), ("s", "/a/b", "focus"), ("s", "/d", "excluded"), ("t", "/", "allowed"), ("t", "/x", "focus")]


def test_review_takes_the_most_severe_then_heaviest_then_first(spark):
    items = spark.createDataFrame([("new", "http://h/a"), ("new", "http://h/b"), ("changed", "http://h/c"), ("new_file", "http://h/d")], "change_type string, url string")
    rules = [{"rule_type": "change_type", "match_value": "NEW", "severity": "high", "weight": 1}, {"rule_type": "prefix", "match_value": "/b", "severity": "high", "weight": 5}, {"rule_type": "keyword", "match_value": "h/b", "severity": "low", "weight": 9}]
    got = review.evaluate(items, rules, ("url",)).orderBy(*review.queue_order()).select("url", "severity", "policy_weight").collect()
    assert [tuple(r) for r in got] == [("http://h/b", "high", 5), ("http://h/a", "high", 1), ("http://h/d", "high", 0), ("http://h/c", "medium", 0)] or [r.url[-1] for r in got] == ["b", "a", "d", "c"]


def test_sections_and_branches(spark):
    pages = spark.createDataFrame([("s", "u1", "/r/research/x", ["d"]), ("s", "u2", "/r/research/y", ["d"]), ("s", "u3", "/r/board", []), ("s", "u4", "/", ["e", "f", "g"])], "s string, u string, path string, docs array<string>")
    found = sections.classify(sections.inventory(pages, "s", "u", "path", "docs"))
    got = {r.section_path: (r.page_count, r.doc_link_count, r.child_section_count, r.source_category) for r in found.collect()}
    assert got["/r"][:3] == (3, 1, 2) and got["/r/research"][:3] == (2, 1, 2) and got["/r/board"] == (1, 0, 0, "governance_management")
    b = {r.branch_path: (r.dominant_category, r.business_importance) for r in sections.branches(found, "s").collect()}
    assert b == {"/r/research": ("research_publications", "high"), "/r/board": ("governance_management", "low")}


def test_robots(spark):
    files = spark.createDataFrame([("s", "User-agent: *\nDisallow: /\n\nUser-agent: Bot\nAllow: /a\nDisallow: /a\nDisallow: /*.pdf$\n"), ("t", "User-agent: *\nDisallow: /p")], "s string, body string")
    rules = governance.selected_rules(governance.parse_robots(files, "s", "body"), "s", "bot")
    asked = spark.createDataFrame([(1, "s", "/a"), (2, "s", "/x.pdf"), (3, "s", "/x.pdf?q"), (4, "t", "/p/q"), (5, "t", "/"), (6, "u", "/")], "id int, s string, path string")
    assert {r.id: r.allowed for r in governance.allowed(asked, rules, "s", "path", "id").collect()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True}


def test_budget_windows_start_at_the_first_request(spark):
    asked = spark.createDataFrame([(1, "o", 5.0), (2, "o", 9.0), (3, "o", 14.9), (4, "o", 15.0), (5, "p", 1.0)], "id bigint, o string, at double")
    got = {r.id: (r.window_start, r.slot, r.admitted) for r in governance.budget_windows(asked, "o", "at", 10, 2).collect()}
    assert got == {1: (5.0, 1, True), 2: (5.0, 2, True), 3: (5.0, 3, False), 4: (15.0, 1, True), 5: (1.0, 1, True)}


def test_traversal_and_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)], "from int, to int")
    seeds = spark.createDataFrame([("s", 1)], "scope string, node int")
    assert rows(graph.traverse(edges, seeds, 5)) == sorted([("s", 1, 0, None), ("s", 2, 1, 1), ("s", 3, 1, 1), ("s", 4, 2, 2)], key=repr)
    assert {r.node for r in graph.traverse(edges, seeds, 5, budget=2).collect()} == {1, 2}
    tree = spark.createDataFrame([(2, 1), (3, 2), (3, 1)], "child int, parent int")
    assert graph.cyclic(tree).count() == 0
    assert rows(graph.cyclic(tree.union(spark.createDataFrame([(5, 6), (6, 5), (7, 6)], "child int, parent int")))) == [(5, 6), (6, 5), (7, 6)]


def test_winners_and_confidence(spark):
    tried = spark.createDataFrame([(1, 0, "http", "bad"), (1, 1, "browser", "good"), (1, 2, "x", "good"), (2, 0, "http", "bad")], "r int, n int, executor string, body string")
    got = {r.r: (r.n, r.n_attempts, r.fell_back) for r in acquisition.winners(tried, ["r"], "n", F.col("body") == "good").collect()}
    assert got == {1: (1, 3, True), 2: (None, 1, False)}
    f = spark.range(1).select(*[summary.confidence(*map(F.lit, v)) for v in ((0, 1, False, 0, 0), (3, 1, True, 0, 0), (3, 1, False, 1, 0), (3, 0, False, 0, 0), (3, 1, False, 0, 2), (3, 1, False, 0, 0))]).first()
    assert list(f) == ["low", "low", "low", "medium", "medium", "high"]


def test_streaming_counts(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").alias("detected_at"), F.col("event_type").alias("change_type")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("detected_at timestamp_ntz, change_type string").parquet(str(tmp_path / "in"))
    q = streams.drain(streams.windowed_counts(stream), "windowed", str(tmp_path / "ck"), "complete")
    assert q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) AS n FROM windowed").first()["n"] == 1000
    seen = []
    q = streams.incremental(stream, lambda batch, number: seen.append((number, batch.count())), str(tmp_path / "ck2"))
    assert q.awaitTermination(120) and seen == [(0, 1000)]


def test_lineage_takes_all_pages(spark, sf, monkeypatch):
    given = []
    peel = graph.cyclic
    monkeypatch.setattr(graph, "cyclic", lambda edges: given.append(edges) or peel(edges))
    left = rows(registry.queries()["lineage_cycles"](spark, sf))
    pages = {r.page_id for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert {r.parent for r in given[0].collect()} == pages
    assert left == sorted([(p, p) for p in pages if p % 50 == 0], key=repr)


def test_capture_verdicts(spark):
    rows = [
        (200, "html", 50, 0, 0, "text", (True, "content_ok")),
        (200, "html", 49, 9, 9, "text", (False, "too_little_content")),
        (None, "html", 50, 0, 0, "text", (True, "content_ok")),
        (503, "xml_feed", 50, 9, 9, "text", (False, "http_503")),
        (503, "html", 50, 9, 9, "x ACCESS denied", (False, "blocked_interstitial")),
        (200, "html", 50, 9, 9, " " * 400 + "access denied", (True, "content_ok")),
        (200, "xml_sitemap", 0, 5, 0, "", (True, "sitemap_inventory")),
        (200, "xml_sitemap", 99, 4, 0, "", (False, "sitemap_too_small")),
        (200, "xml_feed", 9, 2, 2, "", (False, "feed_too_small")),
        (200, "xml_feed", 10, 0, 0, "", (True, "feed_inventory")),
    ]
    df = spark.createDataFrame([r[:6] for r in rows], "status int, kind string, words int, links int, items int, text string")
    got = df.select(acquisition.capture_verdict(*map(F.col, df.columns)).alias("v")).collect()
    assert [tuple(r.v) for r in got] == [r[6] for r in rows]


def test_quality_gates(spark):
    rows = [
        ("passed", "", "", 200, 120, 3, 0, "", "passed"),
        ("passed", "", "captcha", None, 1, 2, 0, "blocked marker found: captcha; status_code None is not OK; word_count 1 < min_words 120; link_count 2 < min_links 3", "blocked"),
        ("passed", "", "", 301, 120, 3, 0, "status_code 301 is not OK", "failed_quality_gate"),
        ("error", "", "captcha", 500, 0, 0, 0, None, "error"),
        ("failed", "Blocked Marker found: x", "", 200, 120, 3, 0, "", "blocked"),
    ]
    df = spark.createDataFrame([r[:7] for r in rows], "before string, reason string, marker string, status int, words int, links int, documents int")
    failed = acquisition.failed_gates(*map(F.col, ("marker", "status", "words", "links", "documents")))
    got = df.select(F.array_join(failed, "; ").alias("why"), acquisition.outcome(F.col("before"), F.col("reason"), F.col("marker"), failed).alias("o")).collect()
    assert [r.o for r in got] == [r[8] for r in rows]
    assert [r.why for r, w in zip(got, rows) if w[7] is not None] == [w[7] for w in rows if w[7] is not None]


def test_identities_are_digests_of_canonical_json(spark):
    def sha(value, ascii_only):
        return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only).encode()).hexdigest()

    source, control = "https://h/ü\"\\u00FC/\U0001f600", "a\x1f\x7f\n"
    row = spark.createDataFrame([(source, control)], "s string, c string")
    none = F.lit(None).cast("string")
    got = row.select(
        identity.artifact_id(F.col("c"), F.col("s"), none).alias("a"),
        identity.version_id(F.col("c"), F.col("s"), none).alias("v"),
        identity.lineage_id(F.lit("x"), F.col("c"), F.lit("y"), F.lit(2)).alias("l"),
        identity.scope_fingerprint(F.concat("s", F.lit("//")), F.array(F.lit(" b/ "), F.lit("/b"), F.lit("ü//"), F.lit(" ")), F.array(F.lit("//")), F.lit(" HTTP ")).alias("f"),
        identity.policy_key(F.col("s"), F.lit("i")).alias("p"),
    ).first()
    whole = sha({"manifest_version": "acquisition-manifest.v1", "normalized_source_identity": source, "sha256": None, "source_run_id": control}, False)
    assert (got.a, got.v) == (f"artifact-{whole[:24]}", f"version-{whole[:24]}")
    assert got.l == "lineage-" + sha({"artifact_id": "x", "ordinal": 2, "related_artifact_id": "y", "relation": control}, False)[:24]
    assert got.f == sha({"seed_url": source, "allowed_page_prefixes": ["/b", "/ü"], "allowed_file_prefixes": ["/"], "fetch_mode": "http"}, True)
    assert got.p == sha({"canonical_origin": source, "identity_sha256": "i", "policy_version": "access-policy.v1"}, False)
