"""Operators that read each row by itself: language, HTML, BPE, URLs, decontamination."""

import hashlib
import math
import tracemalloc
import zlib
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagewake.llm import bpe, decontaminate, html_text, language_id, queries, url_filters

DOCS = "doc_id bigint, text string, lang string, n_words string, score string, items string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "y", "z") for i, t, lang in rows], DOCS)


def test_bpe_is_the_library_s(spark):
    texts = [None, "", " ", "a  b", "it's we'll  \n\n x", "x<|endoftext|> y<|endoftext|>", "é ñ 12 34a\x1c b\x85 c\xa0d", "  lead", "trail  ", "日本 語 😀", "x" * 30_000, "a. b, a. ", "a. b, a. "]
    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in bpe.encode(docs(spark, [(i, t, None) for i, t in enumerate(texts)]), public_tokenizers.path("byte_bpe_50k.json")).collect()}
    for i, t in enumerate(texts):
        ids = ref.encode(t or "", add_special_tokens=False).ids
        assert got[i].token_ids == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded == ref.decode(ids, skip_special_tokens=False)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_query_over_the_documents(spark, sf):
    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op5_bpe(spark, sf).collect():
        ids = ref.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_html_parts_that_are_no_article():
    page = """<html><head><title>T</title><script>var a="</p><p>no</p>";</script></head><body><div id="top-menu"><a href=x>home</a></div>
    <article><h1>Head</h1><p>One &amp;\n two&nbsp;<b>b</b>old<br>next<p>short</p><form><p>mail</p></form><aside>see</aside>
    <section class="comments"><article>me too</article></section></article><footer>foot</footer></body></html>"""
    assert html_text.main_text(page) == "Head One & two bold next short"
    assert html_text.main_text(None) == html_text.main_text("") == ""
    assert html_text.main_text("<nav><p>never closed <main><p>kept</p></main>") == "kept"


def test_html_by_the_distribution_alone():
    long = "Words of a long paragraph follow each other here. " * 4
    page = f"<body><ul><li><a href=a>one</a></li><li><a href=b>two</a></li></ul><div></div><div></div><div></div><p>{long}</p><p>End.</p><div></div><div></div><div></div><div></div><p>(c) us</p></body>"
    assert html_text.main_text(page) == " ".join((long + " End.").split())


def test_html_body_outside_marks_and_under_compound_names():
    body = " ".join(["Words of a long paragraph follow each other here."] * 5)
    # A teaser as the only article; a wrapper with a listed word in its name, and comments in it; wrappers that are no empty lines.
    assert html_text.main_text(f"<body><div><p>{body}</p></div><article><a href=x>Teaser</a> more soon</article></body>") == body
    for name in ("content with-sidebar", "has-comments", "search-page"):
        page = f'<body><div class="{name}"><p>{body}</p><div class="comment-list"><p>me too</p></div></div><div id="search-box"><p>go</p></div></body>'
        assert html_text.main_text(page) == body
        assert html_text.main_text(page.replace("<p>W", "<article><p>W").replace(".</p>", ".</p></article>")) == body
    assert html_text.main_text(f"<div><div>\n<div><p>{body}</p></div></div>\n</div><div><div>\n<div><p>End.</p></div></div></div>") == body + " End."


def test_html_frame(spark):
    rows = [(1, "u", "<p>a</p>", "clash"), (1, "u", "<p>a</p>", "clash"), (2, None, None, None), (None, "v", "<p>" + "b " * 50_000 + "</p>", None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 99_999), (1, 1), (1, 1), (2, 0)]
    assert html_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_language_held_out_accuracy(spark):
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.98 * len(got) > 100
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    train = docs(spark, [(i, t, lang) for i, (t, lang) in enumerate([("the of and the house", "en"), ("der die das und haus", "de"), ("le la les et maison", "fr")] * 5)])
    model = language_id.train(train, F.lit(True))
    got = {r.doc_id: r for r in language_id.predict(docs(spark, [(1, None, None), (2, "123 !?", None), (3, "", "en"), (4, "the and of", None), (5, "die und der", None), (None, "les et la", "x")]), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, None)] == ["und"] * 3 + ["en", "de", "fr"]
    assert got[1].score == 0.0
    assert language_id.train(train.where("false"), F.lit(True)) is None
    assert {r.lang_pred for r in language_id.predict(train, None).collect()} == {"und"}
    one = language_id.train(train.where("lang = 'en'"), F.lit(True))
    assert {r.lang_pred for r in language_id.predict(train, one).collect()} == {"en"}


def test_language_prediction_is_a_plain_recomputation_s(spark):
    """Features by counting n-grams one by one, machines and votes by loops over all weights."""
    train = docs(spark, [(i, f"{t} {i}", lang) for i, (t, lang) in enumerate([("the of and the house", "en"), ("der die das und haus", "de"), ("le la les et maison", "fr"), ("el la los y casa", "es"), ("il lo gli e casa", "it")] * 8)])
    model = language_id.train(train, F.lit(True))
    texts = ["the and", "DIE UND", "et la maison", "y los", "é", "gli 12 e lo", "x" * 30_000, "the la die e y", "the la die e y"]

    def plain(text):
        data, grams = [], Counter()
        for b in b" " + text.lower().encode() + b" ":
            c = b if b >= 0x80 or 97 <= b <= 122 else 32
            if not (c == 32 and data and data[-1] == 32):
                data.append(c)
        for n in language_id.ORDERS:
            for i in range(len(data) - n + 1):
                h = 0
                for c in data[i : i + n]:
                    h = (h * 257 + c) % 2**32
                grams[h * 2654435761 % 2**32 >> 20] += 1
        total = sum(grams.values())
        x = {k: math.sqrt(v / total) for k, v in grams.items()}
        margin = [b + sum(w[k] * v for k, v in x.items()) for w, b in zip(model.weights, model.bias, strict=True)]
        best = max(range(len(model.groups)), key=lambda g: (margin[g], -g))
        votes, sums = Counter(), Counter()
        for (a, b), m in zip(model.pairs, margin[len(model.groups) :], strict=True):
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        return model.languages[max(model.groups[best], key=lambda i: (votes[i], sums[i], -i))]

    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs(spark, [(i, t, None) for i, t in enumerate(texts)]), model).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert {plain(t) for t in texts} > {"en", "de"}


def test_language_sample(spark):
    assert language_id.share(10**10, 750) > 0 and language_id.share(3, 750) == 1
    one = spark.range(3000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("the house").alias("text"), F.lit("en").alias("lang"))  # a hot key
    rows = one.unionByName(docs(spark, [(2, "das haus", "de"), (3, "½ ² ①", "de"), (4, None, "de")]).select("doc_id", "text", "lang"))
    model = language_id.train(rows, F.lit(True), sample_rows=20)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r.lang_pred for r in language_id.predict(rows, model).collect()}
    assert got == {1: "en", 2: "de", 3: "und", 4: "und"}
    assert {r.doc_id for r in language_id.determined(rows, None).collect()} == {1, 2}
    assert language_id.predict(rows.where("false"), model).count() == language_id.determined(rows.where("false"), model).count() == 0


def test_url_rules_and_list(spark):
    pages = spark.createDataFrame(
        [(1, "http://A.example.org/es/x?q", "c"), (2, "https://example.org/en/12", "c"), (3, "http://x.org/p", "c"), (4, "http://myorg/p", "c"), (5, "http://www.listed.net/a/", "c"), (6, "http://m.listed.net/a#f", "c"), (7, "http://other.net/a", "c"), (8, None, "c"), (9, "no url", "c"), (10, "http://b.com/de/1", "c"), (10, "http://b.com/de/1", "c")],
        "page_id bigint, url string, host string",
    )
    listed = spark.createDataFrame([("listed.net/a",), ("listed.net/a",), (None,), ("b.com/de/1",)], "u string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.listed) for r in url_filters.judge(pages, listed, queries.URL_RULES).collect()}
    assert got == {
        1: ("a.example.org", "/es/x", "example.org/es/", "block", False), 2: ("example.org", "/en/12", "example.org/en/1", "block", False),
        3: ("x.org", "/p", "org/", "allow", False), 4: ("myorg", "/p", None, "allow", False), 5: ("www.listed.net", "/a/", None, "block", True),
        6: ("m.listed.net", "/a", None, "block", True), 7: ("other.net", "/a", None, "allow", False), 8: ("", "", None, "allow", False),
        9: ("", "", None, "allow", False), 10: ("b.com", "/de/1", "com/de/", "block", True),
    }
    assert url_filters.judge(pages, listed, queries.URL_RULES).count() == 11
    assert {r.verdict for r in url_filters.judge(pages, listed.where("false"), ()).collect()} == {"allow"}


def brute(text, items, width=10):
    w, hit, ids = decontaminate.words(text), set(), set()
    for name, body in items:
        p = decontaminate.words(body)
        for i in range(max(1, len(p) - width + 1) if p else 0):
            window = p[i : i + width]
            for j in range(len(w) - len(window) + 1):
                if w[j : j + len(window)] == window:
                    hit |= set(range(j, j + len(window)))
                    ids.add(name)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_decontamination_is_brute_force_s(spark):
    items = [(1, "a b c d e f g h i j k l"), (2, "one"), (3, "x y x y x y x y x y x y"), (4, ""), (5, None), (6, "Ä-ö 3.5"), (6, "two words"), (None, "p q r")]
    texts = ["a b c d e f g h i j k l", "z A b, C d-e f g h i j z b c d e f g h i j k", "x y " * 30, "one one", "ä ö 3 5", None, "", "Ä ö 3 5 TWO  words", "p q r p q", "a b c d e f g h i x j"]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    names = [("" if i is None else str(i), t) for i, t in items]
    for limit in (decontaminate.PASS_BYTES, 20):  # the second takes several passes
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.search(docs(spark, [(i, t, None) for i, t in enumerate(texts)]), bench, pass_bytes=limit).collect()}
        for i, t in enumerate(texts):
            assert got[i][1:] == brute(t, names)[1:], (i, t)
            assert got[i][0] == brute(t, names)[0]
    assert not any(r.contaminated for r in decontaminate.search(docs(spark, [(1, "a", None)]), bench.where("false")).collect())


def test_decontamination_tables_are_small(spark):
    """Items with one ending, a hot passage, a very long text; and the memory of the tables."""
    ending = " ".join(f"e{i}" for i in range(9))
    items = [(str(i), f"w{i} {ending}") for i in range(20_000)]
    tracemalloc.start()
    tables = decontaminate.Tables(items, 10)
    size, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert size < 20 * sum(len(t) for _, t in items)
    text = f"w7 {ending} and w19999 {ending} " * 3000
    found = list(tables.search(decontaminate.words(text)))
    assert len(found) == 6000 and {tables.names[i] for _, _, of in found for i in of} == {"7", "19999"}
    assert decontaminate.search(docs(spark, []), spark.createDataFrame(items, "item_id string, text string")).count() == 0


def test_decontamination_query(spark, sf):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {}
    for name, body in items:
        p = decontaminate.words(body)
        for i in range(max(1, len(p) - 9)):
            windows.setdefault(tuple(p[i : i + 10]), set()).add(name)
    lengths = {len(p) for p in windows}
    found = 0
    for r in queries.op10_decontaminate(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect():
        w = decontaminate.words(r.text)
        at = [(j, n) for n in lengths for j in range(len(w) - n + 1) if tuple(w[j : j + n]) in windows]
        hit = {k for j, n in at for k in range(j, j + n)}
        ids = {x for j, n in at for x in windows[tuple(w[j : j + n])]}
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(ids), bool(hit))
        found += bool(hit)
    assert found > 0
