"""Feeds, redaction and whole runs on literal rows."""

import pytest
from pyspark.sql import functions as F

from pagewake.functions import feeds
from pagewake.operators import governance, runs, sources_of_files


def test_listings():
    rss = "<rss><channel><title>T</title><item><title>A</title><link>http://a</link></item><item><link>http://b</link></item></channel></rss>"
    assert feeds.listing(rss) == ("feed", "- [A](http://a)\n- [http://b](http://b)", 2)
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>A</title><link href='http://a'/></entry></feed>"
    assert feeds.listing(atom) == ("feed", "- [A](http://a)", 1)
    assert feeds.listing("<urlset><url><loc> http://a </loc></url><url><loc/></url></urlset>") == ("sitemap", "- http://a", 1)
    assert feeds.listing("<a>x <b>y</b></a>") == ("xml", "x y", 0)
    assert feeds.listing("<!DOCTYPE a [<!ENTITY e 'x'>]><a>&e;</a>")[0] == feeds.listing("<a>")[0] == feeds.listing(None)[0] == "invalid"


def test_masked_json():
    assert feeds.masked_json('{"b": [{"API-Key": "x", "n": 1}], "a": "y"}') == '{"a":"y","b":[{"API-Key":"[REDACTED]","n":1}]}'
    assert feeds.masked_json("no") is None and feeds.masked_json(None) is None


@pytest.mark.parametrize(
    ("url", "want"),
    [("http://u:p@h/x?token=1&a=2", "http://h/x?token=[REDACTED]&a=2"), ("http://h/x#my_secret_y=1", "http://h/x#my_secret_y=[REDACTED]"), ("http://h/@x", "http://h/@x")],
)
def test_redacted_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(feeds.redacted_url(F.col("u")).alias("x")).first().x == want


def test_an_incomplete_run_reports_nothing_missing(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "from int, to int")
    seeds = spark.createDataFrame([("s", 0)], "scope string, node int")
    old = spark.createDataFrame([(0, "a"), (1, "a"), (9, "a")], "node int, hash string")
    now = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "a")], "node int, hash string")
    told, counters = runs.incremental(old, now, edges, seeds, 3)
    assert {r.node: r.change for r in told.collect()} == {0: "same", 1: "changed", 2: "new", 3: "new", 9: "missing"}
    assert tuple(counters.first()) == (True, 4)
    told, counters = runs.incremental(old, now, edges, seeds, 2)
    assert {r.node: r.change for r in told.collect()} == {0: "same", 1: "changed", 2: "new", 9: "unknown"}
    assert not counters.first().complete


def test_pacing_is_the_recurrence(spark):
    asked = spark.createDataFrame([(1, "o", 0.0), (2, "o", 1.0), (3, "o", 2.0), (4, "o", 50.0), (5, "p", 3.0)], "id int, o string, at double")
    assert {r.id: r.not_before for r in runs.not_before(asked, "o", "at", 10.0).collect()} == {1: 0.0, 2: 10.0, 3: 20.0, 4: 50.0, 5: 3.0}


def test_windows_and_reservations(spark):
    w = spark.createDataFrame([("o", 0.0, 10.0), ("o", 9.0, 19.0), ("o", 19.0, 29.0)], "o string, start double, end double")
    assert [r.start for r in runs.windows_overlap(w, "o").collect()] == [9.0]
    v = spark.range(1).select(*[runs.reservation_valid(*map(F.lit, x), 10.0) for x in ((1, 2, 0.0, 5.0), (3, 2, 0.0, 5.0), (1, 2, 0.0, 10.0))]).first()
    assert list(v) == [True, False, False]


def test_userinfo_and_dispositions(spark):
    df = spark.createDataFrame([("http://h/a@b", "valid_200"), ("x http://u@h", "timeout"), ("http:%2F%2Fu%40h", "http_404"), ("http:%252F%252Fu%2540h", "other")], "t string, kind string")
    got = df.select(governance.has_userinfo(F.col("t")).alias("u"), governance.disposition(F.col("kind"), F.lit(False)).alias("d")).collect()
    assert [r.u for r in got] == [False, True, True, True]
    assert [tuple(r.d) if r.d else None for r in got] == [("reject", "robots.disallowed", False), ("error", "robots.timeout", True), ("allow", "robots.absent", False), None]


def test_source_pages(spark):
    p = spark.createDataFrame([("http://h/news/exam-1", "", None, 5), ("http://h/x", "Research", "", 3), ("http://h/x", "", "in 1999", 1), ("http://h/x", None, None, 0)], "u string, t string, e string, n int")
    got = sources_of_files.classify(p, "u", "t", "e", "n").select("source_category", "business_importance", "conversion_priority").collect()
    assert [tuple(r) for r in got] == [("exam_education", "low", "skip"), ("research_publications", "high", "high"), ("archive_reference", "low", "skip"), ("general_reference", "medium", "medium")]
