"""Pages are parsed and compared in slices of bounded size."""

import difflib

import pyarrow as pa
from pyspark.sql import functions as F

from pagewake.functions import html
from pagewake.plans import texts
from pagewake.sources import views


def test_a_worker_holds_the_results_of_a_slice(spark, monkeypatch):
    pages, caught = spark.createDataFrame([], "page_id bigint, html string"), []
    monkeypatch.setattr(type(pages), "mapInArrow", lambda self, run, schema: caught.append(run) or self)
    html.normalize(pages)
    batch = pa.record_batch({"page_id": list(range(600)), "html": ["<p>" + "word " * 2000 + "</p>"] * 598 + [None, "<p>" * 2_000_000]})
    made = list(caught[0](iter([batch])))
    assert sum(map(len, made)) == 600 and max(map(len, made)) < 120
    assert [x.as_py() for b in made for x in b.column(0)] == list(range(600))


def test_normalized_pages_keep_struct_keys(spark):
    pages = spark.createDataFrame([(1, "<h1>a</h1><p>b</p>"), (2, None)], "page_id bigint, html string")
    plain = {r.page_id: r[1:] for r in html.normalize(pages).collect()}
    nested = {r.page_id.k: r[1:] for r in html.normalize(pages.select(F.struct(F.col("page_id").alias("k"), F.lit("x").alias("y")).alias("page_id"), "html")).collect()}
    assert plain == nested and plain[1] == ("a\nb", "# a\n\nb", ["a"], 0, 2, 2) and plain[2] == ("", "", [], 0, 0, 0)


def test_diffs_are_a_plain_recomputation_s(spark, sf):
    runs = {1: {}, 2: {}}
    for r in views.captures(spark, sf).collect():
        runs[r.run_id][r.page_id] = html.outline(r.html)[1] + "\nlast line" * (r.run_id == 2)
    want = {k: "\n".join(list(difflib.unified_diff(a.splitlines(), runs[2][k].splitlines(), lineterm="", n=3))[:50]) for k, a in runs[1].items() if k in runs[2]}
    got = {r.page_id: r.diff for r in texts.text_diffs(spark, sf).collect()}
    assert got and all(want[k] == d for k, d in got.items()) and all(not d or k in got for k, d in want.items())
