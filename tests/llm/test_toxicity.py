"""Operator 12: kernel against enumeration, folded machine against kernel sums, held-out accuracy, odd rows."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewake.llm import queries, toxicity

WORDS = ["".join(p) for p in itertools.product(("th", "er", "on", "an", "re"), ("ing", "tion", "ed", "ly", "ha"))]
INSULTS = ("idiot", "moron", "scum", "worthless")
SCHEMA = "doc_id bigint, text string, score string, predicted string, toxic string"


def enumerated(text):
    """Weights of all subsequences of four letters, straight from the definition."""
    found, letters, others = {}, [], []
    seen = 0
    for c in text:
        if toxicity.SYMBOLS[min(ord(c), 0xFFFF)]:
            letters.append(int(toxicity.SYMBOLS[ord(c)]))
            others.append(seen)
        else:
            seen += 1
    for at in itertools.combinations(range(len(letters)), 4):
        if at[3] - at[0] < toxicity.SPAN:
            code = 0
            for i in at:
                code = code << 5 | letters[i]
            weight = toxicity.INSERTED ** (at[3] - at[0] - 3) * toxicity.BROKEN ** (others[at[3]] - others[at[0]])
            found[code] = found.get(code, 0) + weight
    return found


def made(text):
    letters, others, starts = toxicity.spelled([text])
    return toxicity.subsequences(letters[: starts[1] - toxicity.SPAN], others[: starts[1] - toxicity.SPAN])


@pytest.mark.parametrize("text", ["idiot", "i.d.i.o.t", "an idXiot, hé", "abc", "", "  ..", "Ünö-straße ñ 12 ab"])
def test_subsequences_are_those_of_the_definition(text):
    code, weight = made(text)
    want = enumerated(text)
    assert dict(zip(code.tolist(), weight.tolist(), strict=True)) == pytest.approx(want, rel=1e-5)


def test_kernel_is_the_product_of_subsequences():
    texts = ["idiot", "i d i o t", "the idiots", "on the thing", "disgusting"]
    vectors = [enumerated(t) for t in texts]
    want = [[sum(w * b.get(c, 0) for c, w in a.items()) for b in vectors] for a in vectors]
    strings = [made(t) for t in texts]
    assert toxicity.kernel(strings, strings) == pytest.approx(np.array(want), rel=1e-5)


def test_table_scores_as_the_machine_over_landmarks():
    marks = [made(t) for t in ("idiot", "moron", "thing", "tion")]
    strings = [made(t) for t in ("you idiot there", "the moron", "the thing is", "onreing tion", "an id i ot")]
    y = np.array([1, 1, -1, -1, 1])
    nystrom = toxicity.Nystrom(marks)
    table = nystrom.table(strings, y, 1000.0)
    features = toxicity.kernel(strings, marks) @ nystrom.white
    scale = np.sqrt((features**2).sum(1).mean())
    decided = features / scale @ toxicity.machine(features / scale, y, 1000.0)
    assert [float((table[c] * w).sum()) for c, w in strings] == pytest.approx(decided.tolist(), abs=1e-3)
    assert ((decided > 1) == (y > 0)).all()


def test_scores_by_text_are_those_of_each_text_alone():
    rnd = np.random.default_rng(1)
    table = rnd.normal(size=2**20).astype(np.float32)
    table[~toxicity.whole(np.arange(2**20))] = 0
    model = toxicity.Model(table, np.zeros(4))
    texts = ["idiot", None, "", "a", "one two three four five six seven", "x" * 70_000, "the moron, " * 4000]
    alone = np.concatenate([model.raw([t]) for t in texts])
    assert model.raw(texts) == pytest.approx(alone, rel=1e-3, abs=1e-3)
    for t, row in zip(texts[:5], alone, strict=False):
        letters, others, starts = toxicity.spelled([t])
        code = [enumerated_from(letters[:-7], others[:-7], i) for i in range(len(letters) - 7)]
        sums = [sum(w * table[c] for found in code[i : i + toxicity.WINDOW] for c, w in found) for i in range(len(code))]
        assert row[0] == pytest.approx(max([0.0, *sums]), abs=1e-3)


def enumerated_from(letters, others, i):
    out = []
    for rest in itertools.combinations(range(i + 1, min(len(letters), i + toxicity.SPAN)), 3):
        code = 0
        for j in (i, *rest):
            code = code << 5 | int(letters[j])
        out.append((code, toxicity.INSERTED ** (rest[2] - i - 3) * toxicity.BROKEN ** int(others[rest[2]] - others[i])))
    return out


def labelled(n=700, seed=2):
    """Every fourth text holds insults, and half of these write them with gaps or inserted characters."""
    rnd = random.Random(seed)
    shapes = (lambda w: w, lambda w: w, lambda w: ".".join(w), lambda w: w[:2] + rnd.choice("xz*") + w[2:])
    texts, toxic = [], []
    for i in range(n):
        words = [rnd.choice(WORDS) for _ in range(rnd.randrange(20, 60))]
        if i % 4 == 0:
            for _ in range(5):
                words.insert(rnd.randrange(len(words)), rnd.choice(shapes)(rnd.choice(INSULTS)))
        texts.append(". ".join(" ".join(words[j : j + 9]) for j in range(0, len(words), 9)))
        toxic.append(int(i % 4 == 0))
    return texts, toxic


def test_held_out_texts_and_gapped_insults(spark):
    texts, toxic = labelled()
    docs = spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, F.col("doc_id") < 500)
    found = toxicity.score(docs, model).collect()
    assert found[0].__fields__ == ["doc_id", "score", "predicted"]
    held = [r for r in found if r.doc_id >= 500]
    assert sum(r.predicted == toxic[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)


def test_odd_rows(spark):
    texts, toxic = labelled(240)
    rows = [(i, t, "x", "x", "x") for i, t in enumerate(texts)]
    odd = [(1000, None), (1001, ""), (1002, "..."), (None, "idiot. " * 30), (1003, "same idiot text. " * 9), (1003, "same idiot text. " * 9), (1004, "the idiot and moron, worthless scum. " * 40), (1007, "the idiot and moron, worthless scum. " * 30_000), (1005, "𝒳" * 100), (1006, "a" * 1_000_000)]
    docs = spark.createDataFrame(rows + [(*r, None, None, None) for r in odd], SCHEMA)
    labels = spark.createDataFrame([*enumerate(toxic), (0, 0), (0, None), (None, 1), (9999, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    found = toxicity.score(docs, model).collect()
    assert len(found) == len(rows) + len(odd)
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r.score)
    assert by_id[1003][0] == by_id[1003][1] and by_id[1000] == by_id[1001] == by_id[1002]
    assert by_id[1000][0] < 0.5 and by_id[1004][0] > 0.5
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_samples_without_one_of_the_labels(spark):
    docs = spark.createDataFrame([(1, "a text", "", "", ""), (2, None, "", "", "")], SCHEMA)
    for given, want in (([], 0.0), ([(1, 0)], 0.0), ([(1, 1)], 1.0), ([(1, 1), (2, 0)], 0.5)):
        labels = spark.createDataFrame(given, "doc_id bigint, toxic int")
        assert [r.score for r in toxicity.score(docs, toxicity.train(docs, labels, F.lit(True))).collect()] == [want, want]


def test_query(spark, sf):
    found = queries.QUERIES["op12_toxicity"](spark, sf)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
