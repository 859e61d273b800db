"""Hierarchical language identification (operator 1).

A document's features are hashed byte n-grams of its letters, as square roots of relative
frequencies. One-versus-rest linear support vector machines choose a language family; within
it, one-versus-one machines separate the languages. Families are found from the training rows,
by joining the languages whose mean features are closest.

The model is fitted on a bounded sample of the rows that `train_if` admits: about `sample_rows`
distinct ones, split evenly over the languages and drawn by a hash of key and text. Their features
are computed by the executors and only they reach the driver. Prediction reads every whole text once,
without a shuffle.

Null texts and texts without a letter are `und` with score 0. Without training rows all are `und`.
Votes that tie go to the larger sum of margins, then to the first language by name. Repeated rows are
predicted alike and learned from once; an empty table gives an empty one; extra columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Labelled rows that the model is fitted on, about, over all languages.
SAMPLE_ROWS = 3000
#: Buckets of hashed n-grams of these orders.
BUCKETS = 4096
ORDERS = (2, 3, 4)
UNDETERMINED = "und"

LETTER = regex.compile(r"\p{L}")
LETTERS = bytes(b if b >= 0x80 or chr(b).islower() else 0x20 for b in range(256))


def features(text: str) -> np.ndarray:
    """Unit vector of the square roots of the n-gram counts."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(LETTERS) + b" ", np.uint8).astype(np.uint32)
    data = data[np.append(True, (data[1:] != 0x20) | (data[:-1] != 0x20))]
    counts, gram = np.zeros(BUCKETS), data
    for n in range(2, max(ORDERS) + 1):
        gram = gram[:-1] * np.uint32(257) + data[n - 1 :]
        if n in ORDERS:
            counts += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(32 - int(math.log2(BUCKETS))), minlength=BUCKETS)
    return np.sqrt(counts / max(1.0, counts.sum())).astype(np.float32)


def separate(x: np.ndarray, y: np.ndarray, cost: float = 100.0, steps: int = 120) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine with squared hinge loss; y is -1 or 1.

    Accelerated gradient descent; rows are weighted so that both sides count alike.
    """
    x1, y = np.hstack([x, np.ones((len(x), 1), np.float32)], dtype=np.float32), y.astype(np.float32)
    share = (np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum())) * cost).astype(np.float32)
    step = np.float32(1.0 / (1.0 + 2 * float(share @ (x1 * x1).sum(1))))
    w = v = np.zeros(x1.shape[1], np.float32)
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x1 @ v))
        new = v - step * (v - 2 * ((share * y * slack) @ x1))
        v = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def families(centres: np.ndarray, count: int) -> list[list[int]]:
    """Joins the closest groups of languages (by the mean distance) until `count` are left."""
    groups = [[i] for i in range(len(centres))]
    apart = ((centres[:, None] - centres[None]) ** 2).sum(-1)
    while len(groups) > count:
        a, b = min(combinations(range(len(groups)), 2), key=lambda p: apart[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[a] += groups.pop(b)
    return groups


@dataclass
class Model:
    """Languages, families (lists of language numbers), and all machines as one matrix: families first, then pairs."""

    languages: list[str]
    groups: list[list[int]]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        margin = self.weights @ x + self.bias
        k = len(self.groups)
        best = int(np.argmax(margin[:k]))
        sure = 1.0 if k == 1 else float(1 / (1 + math.exp(-max(-30.0, min(30.0, 3 * margin[best])))))
        votes = {i: [0, 0.0, math.inf] for i in self.groups[best]}
        for (a, b), m in zip(self.pairs, margin[k:], strict=True):
            if a in votes:  # pairs lie within a family
                winner, loser = (a, b) if m >= 0 else (b, a)
                votes[winner] = [votes[winner][0] + 1, votes[winner][1] + abs(m), min(votes[winner][2], abs(m))]
                votes[loser][1] -= abs(m)
        chosen = max(votes, key=lambda i: (votes[i][:2], -i))
        if math.isfinite(votes[chosen][2]):
            sure *= 1 / (1 + math.exp(-max(-30.0, min(30.0, 3 * votes[chosen][2]))))
        return self.languages[chosen], sure


def fit(x: np.ndarray, labels: list[str], count: int | None = None) -> Model:
    """Fits families and machines; `count` families, or the square root of the number of languages."""
    languages = sorted(set(labels))
    y = np.array([languages.index(v) for v in labels])
    groups = families(np.array([x[y == i].mean(0) for i in range(len(languages))]), count or math.ceil(math.sqrt(len(languages))))
    of = np.empty(len(languages), int)
    for g, members in enumerate(groups):
        of[members] = g
    if len(groups) == 1:
        machines = [(np.zeros(x.shape[1], np.float32), 0.0)]
    elif len(groups) == 2:  # one machine tells two families apart
        w, b = separate(x, np.where(of[y] == 0, 1, -1))
        machines = [(w, b), (-w, -b)]
    else:
        machines = [separate(x, np.where(of[y] == g, 1, -1)) for g in range(len(groups))]
    pairs = [p for members in groups for p in combinations(sorted(members), 2)]
    for a, b in pairs:
        rows = (y == a) | (y == b)
        machines.append(separate(x[rows], np.where(y[rows] == a, 1, -1)))
    return Model(languages, groups, pairs, np.array([m[0] for m in machines]), np.array([m[1] for m in machines]))


def share(rows: int, wanted: float) -> float:
    """Share of a language's rows that gives `wanted` of them; above 0 however many rows there are."""
    return min(1.0, wanted / max(1, rows))


def train(docs: DataFrame, train_if: Column, key: str = "doc_id", text: str = "text", label: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The model of a bounded sample of the admitted, labelled rows; None if there are none."""
    fine = train_if & F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")
    rows = docs.where(fine).select(F.col(label).cast("string").alias("label"), F.xxhash64(key, text).alias("h"), F.col(text).alias("body"))
    distinct = rows.groupBy("label").agg(F.approx_count_distinct("h").alias("n"))
    sizes = {r["label"]: r["n"] for r in distinct.collect()}  # a row for each language
    if not sizes:
        return None
    below = F.create_map(*[F.lit(v) for label_, n in sizes.items() for v in (label_, share(n, sample_rows / len(sizes)) * 2.0**63)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            found = [features(t.as_py()).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["label", "h", "x"])

    drawn = F.col("h").bitwiseAND(F.lit((1 << 63) - 1)).cast("double") <= below[F.col("label")]
    sample = rows.where(drawn).groupBy("label", "h").agg(F.first("body").alias("body"))
    got = sorted(map(tuple, sample.mapInArrow(run, "label string, h bigint, x binary").collect()))
    if not got:
        return None
    labels, x = [v for v, _, _ in got], np.empty((len(got), BUCKETS), np.float32)
    for i in reversed(range(len(got))):  # each row's bytes go as soon as they are in the matrix
        x[i] = np.frombuffer(got.pop()[2], np.float32)
    return fit(x, labels)


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: key, lang_pred, score."""
    kind = docs.schema[key].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            out = [held.value.predict(features(t)) if held.value and (t := v.as_py()) and LETTER.search(t) else (UNDETERMINED, 0.0) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], [key, "lang_pred", "score"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def determined(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows whose language can be told, with all their columns; one pass, no shuffle.

    Without a model, those whose text has a letter.
    """
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def tells(text_: str | None) -> bool:
        return bool(text_ and LETTER.search(text_)) and (held.value is None or held.value.predict(features(text_))[0] != UNDETERMINED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            yield batch.filter(pa.array([tells(v.as_py()) for v in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
