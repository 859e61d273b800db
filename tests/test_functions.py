"""Column functions on literal rows."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pagewake.functions import html, texts, urls
from pagewake.operators import governance


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "request_url", "canonical"),
    [
        ("https://Example.com/section/page-a/?utm_source=test&b=2#a", "https://example.com/section/page-a/?b=2", "https://example.com/section/page-a?b=2"),
        ("http://a.b", "http://a.b/", "http://a.b/"),
        ("http://a.b/?b=1&a&fbclid=x", "http://a.b/?a=&b=1", "http://a.b/?a=&b=1"),
        ("http://A.b:8080//", "http://a.b:8080//", "http://a.b:8080"),
        ("/relative", "", ""),
        ("", "", ""),
    ],
)
def test_canonical(spark, url, request_url, canonical):
    assert one(spark, urls.request_url(F.col("u")), u=url) == request_url
    assert one(spark, urls.canonical_url(F.col("u")), u=url) == canonical


def test_prefixes_match_by_segment(spark):
    lists = lambda *p: F.array(*map(F.lit, p)).cast("array<string>")
    got = [one(spark, urls.matches_prefixes(F.col("p"), lists(*q)), p="/section/a") for q in (["/section"], ["/sec"], ["/"], [])]
    assert got == [True, False, True, False]
    assert one(spark, urls.in_scope(F.col("u"), F.lit("https://a.b"), lists("/section")), u="https://a.b/section/page-a")
    assert not one(spark, urls.in_scope(F.col("u"), F.lit("https://a.b"), lists("/section")), u="https://other.b/section/page-a")


def test_normal_text(spark):
    assert one(spark, texts.normal_text(F.col("t")), t="A\n\n\nB\n   \nC") == "A\n\nB\n\nC"
    assert one(spark, texts.normal_text(F.col("t")), t="\r\n a \t b\r\n\r\n") == "a b"
    assert one(spark, texts.content_hash(F.col("t")), t="") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_small_text_functions(spark):
    assert one(spark, texts.fit_markdown(F.col("t")), t="a\na\n---\n\n\nb  ") == "a\n\nb"
    assert one(spark, texts.tidy_markdown(F.col("t")), t="a  \n\n\n\nb") == "a\n\nb"
    assert one(spark, texts.string_list(F.col("t")), t='[" a ", "", "b"]') == ["a", "b"]
    assert one(spark, texts.string_list(F.col("t")), t="a, ,b") == ["a", "b"]
    assert one(spark, texts.redacted(F.col("t")), t="token: abc http://u:p@h/") == "token: [REDACTED] http://[REDACTED]@h/"
    assert one(spark, texts.one_line(F.col("t")), t=" a  b\nc ") == "a b c"
    assert one(spark, texts.magic_type(F.col("t").cast("binary")), t="%PDF-1.7") == "pdf"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://Ex.com:80/a/./b/../%7euser?q=%2f#f", "http://ex.com/a/~user?q=%2F"),
        ("https://bücher.example", "https://xn--bcher-kva.example/"),
        ("https://a.b:444/..", "https://a.b:444/"),
        ("https://u:p@a.b/", None),
        ("ftp://a.b/", None),
        (None, None),
    ],
)
def test_strict_url(url, want):
    assert html.strict_url(url) == want


def test_outline_takes_the_root_with_most():
    text, markdown, headings, links, words, lines = html.outline("<body><nav>menu</nav><p>x</p><main><h1>Head</h1><p>Some <a href='/u'>linked</a> words</p><li>item</li></main></body>")
    assert markdown == "# Head\n\nSome [linked](/u) words\n\n- item"
    assert (text, headings, links, words, lines) == ("Head\nSome linked words\nitem", ["Head"], 1, 5, 3)
    assert html.outline(None)[1] == ""


@pytest.mark.parametrize(
    ("ref", "want"),
    [
        ("/a", "https://h.org/a"), ("b.html", "https://h.org/x/y/b.html"), ("../c?q=1#f", "https://h.org/x/c?q=1#f"), ("//k.org/d", "https://k.org/d"), ("./", "https://h.org/x/y/"),
        ("?p=2", "https://h.org/x/y/z?p=2"), ("#top", "https://h.org/x/y/z?q=0#top"), ("", "https://h.org/x/y/z?q=0#f"), ("mailto:a@b", "mailto:a@b"), ("../../../e", "https://h.org/e"), ("HTTP://O.org/p", "HTTP://O.org/p"),
    ],
)
def test_references_are_joined(spark, ref, want):
    assert urljoin("https://h.org/x/y/z?q=0#f", ref) == want
    assert one(spark, urls.joined(F.col("b"), F.col("r")), b="https://h.org/x/y/z?q=0#f", r=ref) == want


def test_links_however_written(spark):
    page = """<a href="/one">1</a><A class=x HREF='two?a=1&amp;b=2'>2</A><a href=//k.org/three>3</a><a title="a > b" href="../four">4</a>
    <a name="href">no</a><a data-href="/no">no</a><!-- <a href="/gone"> --><a href="mailto:x@y">m</a><a href="/one">again</a>"""
    want = ["https://h.org/four", "https://h.org/one", "https://h.org/x/two?a=1&b=2", "https://k.org/three"]
    assert one(spark, texts.absolute_links(F.col("h"), F.col("u")), h=page, u="https://h.org/x/y") == want
    feed = """ <?xml version="1.0"?><feed><link href="https://h.org/f"/><link>https://h.org/g</link><loc> https://h.org/l?a&amp;b </loc><loc>ftp://h/x</loc></feed>"""
    assert one(spark, texts.absolute_links(F.col("h"), F.col("u")), h=feed, u="https://h.org/") == ["https://h.org/f", "https://h.org/g", "https://h.org/l?a&b"]


def test_queries_are_decoded_and_written_again(spark):
    for url, want in (
        ("\n https://H.org/p?b=a%20b&a=1%2b2&utm_source=x&c ", "https://h.org/p?a=1%2B2&b=a+b&c="),
        ("https://h.org/?q=100%&r=~*é", "https://h.org/?q=100%25&r=~%2A%C3%A9"),
    ):
        assert one(spark, urls.request_url(F.col("u")), u=url) == want


def test_prefixes_whatever_slashes_end_them(spark):
    for path, prefix, want in (("/section/", "/section", True), ("/section", "/section/", True), ("/section/a/", "/section//", True), ("/sections", "/section/", False), ("", "/", True)):
        assert one(spark, urls.matches_prefixes(F.col("p"), F.array(F.col("q"))), p=path, q=prefix) is want


def test_white_space_of_normal_texts(spark):
    assert one(spark, texts.normal_text(F.col("t")), t=" a\tb \x0bc\x85\x85 d \r\r e　") == "a b\nc\n\nd\n\ne"
    name, text = texts.compare_basis(("fit_markdown", F.lit(" \n")), ("markdown", F.lit(None).cast("string")), ("content_text", F.col("t")))
    assert (one(spark, name, t=" x "), one(spark, text, t=" x ")) == ("content_text", " x ")


def test_robots_rules_are_matched_in_normal_form(spark):
    body = "User-agent: *\nDisallow: /\n\nUser-agent: Monitor\nDisallow:\n\nUser-agent: bad/1.0\nDisallow: /x\n\nUser-agent: other\nDisallow: /caf%c3%a9\nAllow: /%7Euser*?q=1$\nDisallow: /~user\n"
    rules = governance.parse_robots(spark.createDataFrame([("s", body)], "site string, body string"), "site", "body")
    assert {r.agent for r in rules.collect()} == {"*", "monitor", "other"}
    rows = spark.createDataFrame([(1, "s", "/x/1"), (2, "s", "/café/a"), (3, "s", "/~user/a?q=1"), (4, "s", "/%7euser/a?q=12"), (5, "s", "")], "id int, site string, target string")
    told = lambda agent: {r.id: (r.allowed, r.specificity) for r in governance.allowed(rows, governance.selected_rules(rules, "site", agent), "site", "target", "id").collect()}
    assert told("monitor") == dict.fromkeys(range(1, 6), (True, 0))
    assert told("unnamed") == dict.fromkeys(range(1, 6), (False, 1))
    assert told("other") == {1: (True, 0), 2: (False, 6), 3: (True, 10), 4: (False, 6), 5: (True, 0)}


def test_userinfo_however_escaped(spark):
    for text, want in (
        ("see https://u:p@h/x", True), ("https%3a%2f%2fu%3ap%40h", True), ("https%253A%252F%252Fu%2540h", True), ("https://u＠h/", True), ("https:%2F%2Fu%ef%bc%a0h", True),
        ("https://h/a@b", False), ("mail a@b", False), ("https%3a%2f%2fh%2fx%40y", False),
    ):
        assert one(spark, governance.has_userinfo(F.col("t")), t=text) is want, text
