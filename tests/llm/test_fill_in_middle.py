"""Operator 13 against a plain version that keeps all units, and as a round trip."""

import hashlib
import random
import re
import tracemalloc

import regex

from pagewake.llm import fill_in_middle as fim
from pagewake.llm import queries

RECIPE = fim.Recipe()
SCHEMA = "doc_id bigint, text string, n string, form string, output string"


def plain(key, text, recipe=RECIPE):
    """The same from a list of all units."""
    text = text or ""
    hexed = hashlib.sha256(f"{recipe.seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = re.findall(recipe.units, text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in recipe.marks) or h3 % 100 >= recipe.percent:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < recipe.spm_percent:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def shaped():
    rnd = random.Random(6)
    rows = [(i, "".join(rnd.choice(["a", "é", "\n", "\n\n", "x y", "\r", " ", "𝒳", "<", "P>", "S"]) for _ in range(rnd.randrange(40)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "\n"), (903, "no line end"), (904, "holds <S> here\nand\nthere"), (None, "a\nb\nc\n"), (905, "same\nrow\n"), (905, "same\nrow\n"), (906, "\0\n\0")]
    return [*rows, (-5, "below\nzero\n"), (2**62, "a long text of lines\n" * 50_000), (907, "x" * 1_000_000), (908, "\n" * 1_000_000)]


def test_rows_are_those_of_the_plain_version(spark):
    rows = shaped()
    found = fim.transform(spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA))
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((k, *plain(k, t)) for k, t in rows), key=repr)


def test_every_output_restores_its_text(spark):
    rows = shaped()
    forms = set()
    for key, text in rows:
        *_, form, _, _, output = fim.transform_text(RECIPE, regex.compile(RECIPE.units), key, text or "")
        forms.add(form)
        assert fim.restore(RECIPE, form, output) == (text or "")
    assert forms == {"plain", "psm", "spm"}


def test_other_units_percentages_and_marks(spark):
    recipe = fim.Recipe(units=r"\S+\s*", seed=11, percent=60, spm_percent=0)
    rows = [(i, "one two  three\nfour " * (i % 5)) for i in range(200)]
    found = fim.transform(spark.createDataFrame(rows, "doc_id bigint, text string"), recipe).collect()
    assert sorted(map(tuple, found)) == sorted((k, *plain(k, t, recipe)) for k, t in rows)
    ambiguous = fim.Recipe(prefix="a", suffix="aa", middle="aaa")
    for key in range(60):
        *_, form, _, _, output = fim.transform_text(ambiguous, regex.compile(ambiguous.units), key, "b\nc\n" * 3)
        assert fim.restore(ambiguous, form, output) == "b\nc\n" * 3


def test_no_units_are_stored():
    """A million units take no more memory than their count."""
    text = "\n" * 1_000_000
    pattern = regex.compile(fim.LINES)
    tracemalloc.start()
    n, a, b = fim.cut(pattern, text, 777_777, 333_333)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (n, a, b) == (1_000_000, 333_333, 777_777) and peak < 100_000


def test_empty_table_and_query(spark, sf):
    empty = fim.transform(spark.createDataFrame([], SCHEMA), digests=True)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    texts = dict(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in queries.QUERIES["op13_fill_in_middle"](spark, sf).collect():
        *told, output = plain(r.doc_id, texts[r.doc_id])
        assert tuple(r) == (r.doc_id, *told, sha(output), sha(texts[r.doc_id] or ""))
