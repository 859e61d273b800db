"""Links of pages: cases, and texts that must not take long or overflow the stack."""

import time

import pytest
from pyspark.sql import functions as F

from pagewake.functions import texts

CASES = {
    '<a href="x">': ["x"],
    "<A class=b HREF='y'>t</A>": ["y"],
    "<a href = z >": ["z"],
    '<a title="href=no" href="yes">': ["yes"],
    "<a title='a > b' href=ok>": ["ok"],
    "<a name=n><a href=m>": ["m"],
    "<abbr href=no><area href=no>": [],
    '<a data-href="no">': [],
    "<a href=''>": [""],
    '<!-- <a href="no"> --><a href="yes">': ["yes"],
    '<!-- open <a href="yes">': ["yes"],
    "<a href=\"a&amp;b\"> <a\nhref='q'>": ["a&b", "q"],
    '<a href="open': [],
    '<a class="c"href="glued">': ["glued"],
}


def test_cases(spark):
    rows = spark.createDataFrame(list(CASES), "string").select("value", texts.links(F.col("value")).alias("links")).collect()
    assert {r.value: r.links for r in rows} == CASES


LONG = {
    "anchor": "<a " + "x" * 1_000_000,
    "anchors": "<a " * 330_000,
    "anchors of attributes": "<a b=c href " * 80_000,
    "quotes": "<a \"'" * 200_000,
    "comments": "<!-- " * 200_000,
    "comments and one end": "<!-- " * 200_000 + "-->",
    "nested": "<p><a>x</a>" * 90_000,
    "letters": "a" * 1_000_000,
    "dots": "a." * 500_000,
    "spaces": "<a " + " " * 1_000_000,
    "links of feeds": "<rss>" + "<link " * 160_000,
}


@pytest.mark.parametrize("shape", LONG)
def test_a_million_characters_take_seconds(spark, shape):
    rows = spark.createDataFrame([(LONG[shape],)], "html string")
    began = time.time()
    rows.select(F.size(texts.absolute_links(F.col("html"), F.lit("https://a.org/")))).collect()
    assert time.time() - began < 8
