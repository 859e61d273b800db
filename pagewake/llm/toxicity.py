"""Toxicity by a subsequence string-kernel machine with Nyström landmarks (operator 12).

The kernel of two strings is the inner product of their gap-weighted subsequences of four letters: a
subsequence that skips k letters and s other characters counts `INSERTED`**k * `BROKEN`**s, with at most `SPAN` letters from
first to last. So an insult is met with letters put into it, and almost as it is when spaces,
dots or stars break it up. Letters are folded to 31 symbols without regard to case.

The kernel's values with landmarks, strings of the training sentences, whitened by the inverse root
of the landmarks' own kernel matrix, are the Nyström features on which a linear support vector machine
is trained. Its decision is a sum over landmarks, and each landmark is a sum over subsequences: both are folded into one
table of 2**20 weights, so a text is scored by looking its subsequences up, exactly as the machine would.

Labels are those of texts, but an insult stands in few of their sentences. Training sentences are first labelled
as their texts; then, in rounds, of each sentence the window that scores highest is kept, those of toxic texts only if they lie
above most clean ones, and the machine is trained again on these windows. Landmarks are short strings that tell toxic texts from clean ones
best, and random ones. Whole texts are judged by their highest window, the highest one of their third stretch, and the logarithm of
their letters: a logistic curve over them, fitted on whole texts that the machine wasn't trained on, gives the probability.

The sample is bounded: about `SAMPLE_ROWS` labelled texts, even over both labels and drawn by a hash, of each at most
`SENTENCES` sentences of at most `SENTENCE` letters. Scoring reads every whole text once, without a shuffle; a task holds a few MB
of text at a time, and a longer text alone.

Null and empty texts and texts without four letters have windows of 0 and get the curve's value there. If labels of a key differ, the
largest counts; texts without a label, or a null one, are not learned from; a sample without one of the labels gives the toxic share
it has for every text (0 without any rows). Of equal windows the first counts. Repeated rows are scored alike; an empty table gives an empty one; further columns
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, written
from .language_id import share

#: Labelled texts that the model is fitted on, about; half for the machine, half for the curve.
SAMPLE_ROWS = 6000
#: Sentences of a text, drawn by a hash, and their longest.
SENTENCES, SENTENCE = 24, 120
#: Landmarks that tell toxic texts best, and others; their letters.
TELLING, OTHERS, LENGTHS = 250, 350, (4, 5, 6)
#: Sentences of the first round; weight of the errors on all sentences of one label.
FIRST, COST = 6000, 1000.0
#: In each round after the first, the share of clean sentences that a toxic text's sentence must lie above.
ABOVE = (0.5, 0.8, 0.9, 0.9)
#: Share of clean sentences that score too low to be trained on after the first round.
HARD = 0.6
#: Weight of an inserted letter and of a character that isn't one; most letters of a subsequence with its gaps.
INSERTED, BROKEN, SPAN = 0.45, 0.9, 7
#: Letters at which a window's subsequences start.
WINDOW = 6
#: Letters of a stretch; the curve also takes the highest window of the third highest stretch, as insults seldom come alone.
STRETCH = 16
#: Letters beyond which the curve takes a text to be no longer.
LONG = 8000
BITS, LETTERS = 5, 4
#: Letters scored at a time, so that what is in hand stays in the cache.
BLOCK = 1 << 15


def _symbol(i: int) -> int:
    """0 for no letter, 1 to 26 for a to z, 27 to 31 for other letters."""
    c = chr(i).lower()[:1]
    if not c.isalpha():
        return 0
    return ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 5


SYMBOLS = np.array([0 if 0xD800 <= i < 0xE000 else _symbol(i) for i in range(0x10000)], np.uint8)


def spelled(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the letters of all texts, SPAN zeros after each text; the number of other characters before each; the starts of the texts and the end."""
    gap = "\0" * SPAN
    points = np.frombuffer("".join([(t or "") + gap for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = SYMBOLS[np.minimum(points, 0xFFFF)]
    ends = np.cumsum([len(t or "") + SPAN for t in texts]) if texts else np.zeros(0, np.int64)
    kept = symbols > 0
    kept[(ends[:, None] - 1 - np.arange(SPAN)).ravel()] = True
    at = np.flatnonzero(kept)
    starts = np.append(0, np.searchsorted(at, ends))
    return symbols[at].astype(np.int32), at - np.arange(len(at)), starts


def _pieces_of(letters: np.ndarray, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each form of a subsequence: its code at every start, and its weight. Both arrays end with SPAN letters that start none."""
    n = len(letters) - SPAN
    pair = [None, *((letters[: n + SPAN - a] << BITS) | letters[a:] for a in range(1, SPAN))]
    high = [None, *(p[:n] << 2 * BITS for p in pair[1:])]
    for t in range(LETTERS - 1, SPAN):
        weight = INSERTED ** (t + 1 - LETTERS) * BROKEN_POWERS[np.minimum(others[t : n + t] - others[:n], len(BROKEN_POWERS) - 1)]
        for a in range(1, t - 1):
            for b in range(a + 1, t):
                yield high[a] | pair[t - b][b : n + b], weight


BROKEN_POWERS = np.append(BROKEN ** np.arange(64.0), 0.0).astype(np.float32)


def whole(code: np.ndarray) -> np.ndarray:
    """Whether all four symbols of the codes are letters."""
    return np.logical_and.reduce([(code >> BITS * k) & (2**BITS - 1) > 0 for k in range(LETTERS)])


def starts_scores(letters: np.ndarray, others: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each letter, the sum of the weights of the subsequences that start there."""
    out = np.zeros(len(letters), np.float32)
    for at in range(0, len(letters) - SPAN, BLOCK):
        end = min(at + BLOCK, len(letters) - SPAN)
        piece, broken = letters[at : end + SPAN], others[at : end + SPAN]
        total, last, part = np.zeros(end - at, np.float32), None, None
        for code, weight in _pieces_of(piece, broken):
            if weight is not last:
                total += 0 if last is None else last * part
                last, part = weight, np.zeros(end - at, np.float32)
            part += table[code]
        out[at:end] = total + last * part
    return out


def windows(scores: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum over WINDOW neighbouring letters from each letter on; the SPAN zeros at the end of a text score 0."""
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    ends = np.minimum(np.arange(len(scores)) + WINDOW, np.repeat(starts[1:], np.diff(starts)))
    return total[ends] - total[:-1]


def highest(scores: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The highest window of each text and where it begins in it."""
    sums = windows(scores, starts)
    most = np.maximum.reduceat(sums, starts[:-1])
    first = np.flatnonzero(sums == np.repeat(most, np.diff(starts)))
    return most, first[np.searchsorted(first, starts[:-1])] - starts[:-1]


def subsequences(letters: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights of a string's subsequences, each code once."""
    padded = np.concatenate([letters, np.zeros(SPAN, letters.dtype)]), np.concatenate([others, np.full(SPAN, others[-1] if len(others) else 0)])
    found = list(_pieces_of(*padded))
    code, weight = np.concatenate([c for c, _ in found]), np.concatenate([w for _, w in found])
    kept = whole(code)
    code, at = np.unique(code[kept], return_inverse=True)
    return code, np.bincount(at, weight[kept], len(code))


def kernel(strings: list, marks: list) -> np.ndarray:
    """Kernel values of all strings with all landmarks; both are (codes, weights)."""
    codes, place = np.unique(np.concatenate([c for c, _ in marks]), return_inverse=True)
    order = np.argsort(place, kind="stable")
    owner = np.repeat(np.arange(len(marks)), [len(c) for c, _ in marks])[order]
    value = np.concatenate([w for _, w in marks])[order]
    first = np.append(0, np.cumsum(np.bincount(place, minlength=len(codes))))
    out = np.zeros((len(strings), len(marks)))
    for i, (c, w) in enumerate(strings):
        at = np.searchsorted(codes, c)
        hit = (at < len(codes)) & (codes[np.minimum(at, len(codes) - 1)] == c)
        at, w = at[hit], w[hit]
        sizes = first[at + 1] - first[at]
        posted = np.repeat(first[at] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        out[i] = np.bincount(owner[posted], value[posted] * np.repeat(w, sizes), len(marks))
    return out


def machine(x: np.ndarray, y: np.ndarray, cost: float, steps: int = 40) -> np.ndarray:
    """Weights w of a linear machine with squared hinge loss, by Newton's method on the rows within the margin.

    The bias is -1: a string that shares nothing with the landmarks lies on the clean side's margin, so clean strings
    strive for w @ x <= 0 and toxic ones for w @ x >= 2. The errors of each side weigh `cost` in all.
    """
    weight = 2 * cost * np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum()))
    target = np.where(y > 0, 2.0, 0.0)
    w, inside = np.zeros(x.shape[1]), np.ones(len(x), bool)
    for _ in range(steps):
        square, right = np.eye(x.shape[1]), np.zeros(x.shape[1])
        for at in range(0, len(x), 2000):
            rows = np.flatnonzero(inside[at : at + 2000]) + at
            part = x[rows].astype(np.float64)
            square += (part * weight[rows, None]).T @ part
            right += part.T @ (weight[rows] * target[rows])
        w = np.linalg.solve(square, right)
        now = y * (x @ w.astype(x.dtype) - 1) < 1
        if (now == inside).all():
            break
        inside = now
    return w


def runs(letters: np.ndarray, others: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Rows (code, owner), each once, of n letters that follow each other within a word; owner is the text of each letter."""
    size = len(letters) - n + 1
    code = np.zeros(size, np.int64)
    for k in range(n):
        code = (code << BITS) | letters[k : k + size]
    inside = (others[n - 1 :] == others[:size]) & (letters[:size] > 0) & (letters[n - 1 :] > 0) & (owner[n - 1 :] == owner[:size])
    return np.unique(np.column_stack([code, owner[:size]])[inside], axis=0)


def landmarks_of(letters: np.ndarray, others: np.ndarray, owner: np.ndarray, y: np.ndarray, rnd: np.random.Generator) -> list:
    """Strings of LENGTHS letters as landmarks: those that tell toxic texts best, by the two-sample z of their shares, and some others.

    owner is the text of each letter, y the label (-1 or 1) of each text.
    """
    found = []
    sizes = (y > 0).sum(), (y < 0).sum()
    for n in LENGTHS:
        pairs = runs(letters, others, owner, n)
        code, at = np.unique(pairs[:, 0], return_inverse=True)
        toxic = np.bincount(at, y[pairs[:, 1]] > 0, len(code))
        both = np.bincount(at, minlength=len(code))
        share_ = both / len(y)
        z = (toxic / sizes[0] - (both - toxic) / sizes[1]) / np.sqrt(share_ * (1 - share_) * (1 / sizes[0] + 1 / sizes[1]) + 1e-12)
        found.append((code, z, np.full(len(code), n)))
    code, z, n = (np.concatenate(x) for x in zip(*found, strict=True))
    best = np.argsort(-z, kind="stable")[: TELLING]
    chosen = np.concatenate([best[z[best] > 2], rnd.permutation(len(z))[:OTHERS]])
    strings = [np.array([(c >> BITS * (k - 1 - i)) & (2**BITS - 1) for i in range(k)], np.int32) for c, k in zip(code[chosen].tolist(), n[chosen].tolist(), strict=True)]
    return [subsequences(x, np.zeros(len(x), np.int64)) for x in strings]


class Nystrom:
    """Kernel values with the landmarks, whitened by the inverse root of the landmarks' own kernel matrix."""

    def __init__(self, marks: list):
        self.marks = marks
        size, vectors = np.linalg.eigh(kernel(marks, marks))
        kept = size > 1e-6 * size[-1]
        self.white = vectors[:, kept] / np.sqrt(size[kept])

    def table(self, strings: Iterable, y: np.ndarray, cost: float) -> np.ndarray:
        """A machine's weight of each of the 2**20 subsequences; y is -1 or 1. Only the features of the strings are held."""
        features = np.concatenate([(kernel(some, self.marks) @ self.white).astype(np.float32) for some in batched(strings, 500)])
        scale = float(np.sqrt((features**2).sum(1).mean())) or 1.0
        features /= scale
        shares = self.white @ machine(features, y, cost) / scale
        table = np.zeros(2 ** (BITS * LETTERS), np.float32)
        for (code, weight), a in zip(self.marks, shares, strict=True):
            table[code] += a * weight
        return table


def third(sums: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The third highest of the highest windows in stretches of STRETCH letters of each text; 0 if there are fewer."""
    sizes = np.diff(starts)
    parts = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(sizes)), parts)
    first = np.append(0, np.cumsum(parts))
    cuts = starts[owner] + (np.arange(len(owner)) - first[owner]) * STRETCH
    tops = np.maximum.reduceat(sums, cuts)
    order = np.lexsort((-tops, owner))
    at = first[:-1] + 2
    return np.where(parts > 2, tops[order][np.minimum(at, len(order) - 1)], 0.0)


@dataclass
class Model:
    """Weights of subsequences, and of the curve: highest window, third stretch, logarithm of the letters, bias."""

    table: np.ndarray
    curve: np.ndarray

    def raw(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text: highest window, third stretch, logarithm of the letters, 1."""
        letters, others, starts = spelled(texts)
        sums = windows(starts_scores(letters, others, self.table), starts)
        return np.column_stack([np.maximum.reduceat(sums, starts[:-1]), third(sums, starts), np.log1p(np.minimum(np.diff(starts) - SPAN, LONG)), np.ones(len(texts))])

    def predict(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(texts) @ self.curve, -40, 40)))


def curve(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights of a logistic regression on rows of `raw`, by Newton's method, slightly held back."""
    w = np.zeros(x.shape[1])
    weight = weight / weight.mean()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (weight * (toxic - p)) - 0.01 * w
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 0.01 * np.eye(x.shape[1])
        step = np.linalg.solve(bend, slope)
        w += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return w


def fit(sentences: list[tuple[int, str, int]], cost: float = COST) -> np.ndarray:
    """The table of weights from sentences: number of the text, words, label of the text (1 or 0)."""
    rnd = np.random.default_rng(12)
    y = np.array([1 if toxic else -1 for *_, toxic in sentences])
    letters, others, starts = spelled([s for _, s, _ in sentences])
    number = np.unique([i for i, *_ in sentences], return_inverse=True)[1]
    labels = np.zeros(number.max() + 1, int)
    labels[number] = y
    nystrom = Nystrom(landmarks_of(letters, others, np.repeat(number, np.diff(starts)), labels, rnd))
    spans = list(zip(starts, starts[1:] - SPAN, strict=False))
    some = np.concatenate([rnd.permutation(np.flatnonzero(y == sign))[: FIRST // 2] for sign in (1, -1)])
    table = nystrom.table((subsequences(letters[a:b], others[a:b]) for a, b in (spans[i] for i in some)), y[some], cost)
    for quantile in ABOVE:
        most, first = highest(starts_scores(letters, others, table), starts)
        above = np.quantile(most[y < 0], quantile)
        chosen = np.flatnonzero(most >= np.where(y < 0, np.quantile(most[y < 0], HARD), above))
        met = [(a + f, min(a + f + WINDOW + SPAN - 1, b)) for (a, b), f in ((spans[i], first[i]) for i in chosen)]
        table = nystrom.table((subsequences(letters[a:b], others[a:b]) for a, b in met), y[chosen], cost)
    return table


def sentences_of(text: str, most: int, longest: int) -> list[str]:
    """Sentences of a text, long ones cut at a space; the `most` ones of least hash."""
    found: dict[str, None] = {}
    for line in text.replace("!", ".").replace("?", ".").replace("\n", ".").split("."):
        words, size = [], 0
        for word in line.split():
            if size + len(word) > longest and words:
                found[" ".join(words)[:longest]] = None
                words, size = [], 0
            words.append(word)
            size += len(word) + 1
        if words:
            found[" ".join(words)[:longest]] = None
    return sorted(found, key=lambda s: hash32(s))[:most]


def hash32(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def admitted(labels: DataFrame, key: str, label: str) -> DataFrame:
    """key, label (1 or 0) of the labelled keys; of several labels the largest."""
    return labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg((F.max(label) > 0).cast("int").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, train_if: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model | float:
    """The model of a bounded sample of the labelled texts that `train_if` (on the key) admits; without texts of both labels, the share of toxic ones."""
    known = admitted(labels.where(train_if), key, label)
    sizes = dict(map(tuple, known.groupBy("toxic").agg(F.count("*").alias("n")).collect()))  # a row for each label
    if len(sizes) < 2:
        return float(1 in sizes)
    least = F.when(F.col("toxic") == 1, share(sizes[1], sample_rows / 2) * 2.0**32).otherwise(share(sizes[0], sample_rows / 2) * 2.0**32)
    drawn = known.where(F.crc32(F.concat(F.lit("sample:"), F.col(key).cast("string"))) <= least)
    half = (F.crc32(F.concat(F.lit("half:"), F.col(key).cast("string"))) % 2).alias("half")
    sample = written(docs.select(F.col(key), F.col(text).cast("string").alias("body")).where("body IS NOT NULL").join(drawn.hint("broadcast"), key).select(half, F.xxhash64(F.col(key).cast("string"), "body").alias("h"), "toxic", "body").dropDuplicates(["h", "toxic"]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, s, toxic) for h, toxic, body in zip(*(c.to_pylist() for c in batch.columns), strict=True) for s in sentences_of(body, SENTENCES, SENTENCE)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int32()))], ["h", "body", "toxic"])

    sentences = sorted(map(tuple, sample.where("half = 0").select("h", "toxic", "body").mapInArrow(cut, "h bigint, body string, toxic int").collect()))
    if len({toxic for *_, toxic in sentences}) < 2:
        return sizes[1] / (sizes[0] + sizes[1])
    table = fit(sentences)
    held = docs.sparkSession.sparkContext.broadcast(Model(table, np.zeros(4)))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(iter([batch]), 2):
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(held.value.raw(piece.column(2).to_pylist()).tolist(), pa.list_(pa.float64()))], ["h", "toxic", "x"])

    rated = sorted(map(tuple, sample.where("half = 1").select("h", "toxic", "body").mapInArrow(rate, "h bigint, toxic int, x array<double>").collect()))
    toxic = np.array([r[1] for r in rated])
    if len(set(toxic.tolist())) < 2:
        return sizes[1] / (sizes[0] + sizes[1])
    weight = np.where(toxic == 1, sizes[1] / (toxic == 1).sum(), sizes[0] / (toxic == 0).sum())
    return Model(table, curve(np.array([r[2] for r in rated]), toxic, weight))


def score(docs: DataFrame, model: Model | float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: key, score, predicted (1 if the score is 0.5 or more)."""
    kind = docs.schema[key].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            found = held.value.predict(batch.column(1).to_pylist()) if isinstance(held.value, Model) else np.full(len(batch), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], [key, "score", "predicted"])

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, score double, predicted int")
