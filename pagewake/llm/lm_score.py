"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation (operator 3).

Symbols are the most frequent training words, the end of a text, and `CLASSES` classes of all other
words by their first two bytes, which tell much of a word's language. The number of words with a
symbol grows as the square root of the training tokens, up to what `MODEL_WORDS` vectors hold. The
score of a symbol after two others is the product of the sum of their vectors with its own, plus its
bias. Symbols in byte order are cut into groups; probabilities are normalised exactly by a softmax
over the groups, whose vectors are trained too, and one over the symbols of a group. A word of a class
has the class's probability times its share of the class, smoothed as the unigram base is, with
one share for all unseen words of the class; so probabilities of tokens sum to 1.

Training reads all training texts: words are counted (before the shuffle for each part of the
input), then each task runs once over its texts in numpy, with noise drawn from the symbol
frequencies, and the parameters are averaged by the tokens that each task has seen. A task gets at
least `TOKENS_A_PARAMETER` tokens for each parameter, where there are as many.

Scoring reads each text once, in slices of a few MB. Counts of the `FREQUENT` most frequent words (a
bounded table) are broadcast; other words are joined with their counts by the word itself. None of
these is more frequent than the least of the table, so a key has one of `FREQUENT` tokens at most.

Null texts count as empty: one token, the end. Repeated rows are scored alike, whatever their keys;
without training rows all counts are 0 and the symbols nearly equally likely; an empty table gives an
empty one. Equally frequent words are taken in their own order. Extra columns are not carried.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, shared_folder, words

#: Classes of the words without a symbol of their own.
CLASSES = 256
#: Most words with a symbol of their own (300 bytes each in the model), and words whose counts are broadcast.
MODEL_WORDS, FREQUENT = 50_000, 50_000
DIMENSION, BATCH, NOISE, RATE = 24, 4096, 32, 0.05
#: Least tokens of a training task, for each parameter and in all.
TOKENS_A_PARAMETER, TOKENS_A_TASK = 4, 1_000_000
#: Tokens that are scored together and in one matrix product, and parameters of a block when models are averaged.
SLICE, PART, PARAMETERS = 65_536, 1024, 4096
#: Sums of exponentials up to which a row is taken again, so that none loses digits in 32 bits.
FAINT = np.float32(1e-25)
#: The word that stands for the end of a text in the counts; words are never empty.
END_WORD = ""


class Shape:
    """Symbols of a model: tail classes first, then the words in byte order, then the end; groups are runs of `size` symbols."""

    def __init__(self, n_words: int):
        self.end = CLASSES + n_words
        self.start = self.end + 1  # only stands before a text
        self.predicted = self.end + 1
        self.size = math.ceil(math.sqrt(self.predicted))
        self.groups = -(-self.predicted // self.size)
        self.parts = [(self.start + 1, DIMENSION), (self.start + 1, DIMENSION), (self.predicted, DIMENSION + 1), (self.groups, DIMENSION + 1)]
        self.length = sum(a * b for a, b in self.parts)

    def tables(self, flat: np.ndarray) -> list[np.ndarray]:
        """Vectors of the symbols as first and second context, then vectors and biases of symbols and of groups as prediction."""
        ends = np.cumsum([a * b for a, b in self.parts])
        return [x.reshape(p) for x, p in zip(np.split(flat, ends[:-1]), self.parts, strict=True)]


def initial(shape: Shape, frequency: np.ndarray) -> np.ndarray:
    """Small vectors, and the logarithms of the frequencies as biases."""
    flat = np.random.default_rng(3).normal(0, 0.1, shape.length).astype(np.float32)
    _, _, out, heads = shape.tables(flat)
    out[:, -1] = np.log(frequency)
    heads[:, -1] = np.log(np.add.reduceat(frequency, np.arange(0, len(frequency), shape.size)))
    return flat


def nudge(table: np.ndarray, past: np.ndarray, at: np.ndarray, gradient: np.ndarray) -> None:
    """An Adagrad step on the rows `at`, which may repeat."""
    order = np.argsort(at.astype(np.uint16), kind="stable")  # a radix sort; there are less than 2**16 symbols
    rows = at[order]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    g, rows = np.add.reduceat(gradient[order], first, axis=0), rows[first]
    seen = past[rows]
    seen += g * g
    past[rows] = seen
    table[rows] += RATE * g / np.sqrt(seen, out=seen)


def contrast(h1: np.ndarray, target: np.ndarray, table: np.ndarray, past: np.ndarray, log_share: np.ndarray, cumulated: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One step of noise-contrastive estimation of a prediction table, with NOISE samples shared by the batch; the gradient of h1, vectors with a 1 behind for the bias.

    `log_share` holds the logarithms of the expected number of samples of each row.
    """
    noise = np.minimum(np.searchsorted(cumulated, rng.random(NOISE, np.float32)), len(log_share) - 1)
    rows, others = table[target], table[noise]
    against = -others
    against[:, -1] += log_share[noise]
    good, down = np.einsum("ij,ij->i", h1, rows) - log_share[target], h1 @ against.T
    up = 1 / (1 + np.exp(np.clip(good, -30, 30)))  # of the logarithm of the posterior of data, and of noise
    np.exp(np.minimum(down, 30, out=down), out=down)
    down += 1
    np.divide(-1, down, out=down)
    gradient = np.empty((len(target) + NOISE, h1.shape[1]), np.float32)
    np.multiply(h1, up[:, None], out=gradient[: len(target)])
    np.matmul(down.T, h1, out=gradient[len(target) :])
    nudge(table, past, np.concatenate([target, noise]), gradient)
    rows *= up[:, None]
    rows += down @ others
    return rows


class Trainer:
    """Parameters that learn from runs of symbols, in order."""

    def __init__(self, shape: Shape, flat: np.ndarray, frequency: np.ndarray, seed: int):
        self.shape, self.flat, self.rng = shape, flat.copy(), np.random.default_rng(seed)
        self.tables, self.past = shape.tables(self.flat), [np.ones(p, np.float32) for p in shape.parts]
        groups = np.add.reduceat(frequency, np.arange(0, len(frequency), shape.size))
        self.frequencies = [(np.log(NOISE * f.astype(np.float32)), np.cumsum(f) / f.sum()) for f in (frequency, groups)]

    def learn(self, symbols: np.ndarray) -> None:
        """A step for each BATCH of the symbols of some texts, START twice before each."""
        at = np.flatnonzero(symbols != self.shape.start)
        self.rng.shuffle(at)
        far, near, out, heads = self.tables
        for start in range(0, len(at), BATCH):
            t = at[start : start + BATCH]
            a, b, w = symbols[t - 2], symbols[t - 1], symbols[t]
            h1 = np.ones((len(t), DIMENSION + 1), np.float32)
            np.add(far[a], near[b], out=h1[:, :-1])
            dh = contrast(h1, w, out, self.past[2], *self.frequencies[0], self.rng)
            dh += contrast(h1, w // self.shape.size, heads, self.past[3], *self.frequencies[1], self.rng)
            nudge(far, self.past[0], a, dh[:, :-1])
            nudge(near, self.past[1], b, dh[:, :-1])


def log_softmax_at(h1: np.ndarray, table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithms of the softmax over a table's rows, at one row for each h1 (a 1 behind each vector); in parts that stay in the cache.

    The greatest score of a part is taken off all of it, and rows far below that are taken again by their own.
    """
    out, columns, ones = np.empty(len(h1), np.float32), np.ascontiguousarray(table.T), np.ones(len(table), np.float32)
    for start in range(0, len(h1), PART):
        part = slice(start, start + PART)
        scores = h1[part] @ columns
        scores -= scores.max()
        chosen = scores[np.arange(len(scores)), at[part]]
        total = np.exp(scores, out=scores) @ ones
        out[part] = chosen - np.log(np.maximum(total, FAINT))
        if len(faint := start + np.flatnonzero(total <= FAINT)):
            scores = h1[faint] @ columns
            scores -= scores.max(1, keepdims=True)
            out[faint] = scores[np.arange(len(scores)), at[faint]] - np.log(np.exp(scores).sum(1))
    return out


def log_probabilities(shape: Shape, flat: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Natural logarithms of the model's probability of each symbol but START, normalised by matrix products over all groups and over the symbols of a group."""
    far, near, out, heads = shape.tables(flat)
    result = np.zeros(len(symbols))
    at = np.flatnonzero(symbols != shape.start)
    for start in range(0, len(at), SLICE):
        t = at[start : start + SLICE]
        w = symbols[t]
        t = t[np.argsort(w.astype(np.uint16), kind="stable")]
        w = symbols[t]
        h1 = np.ones((len(t), DIMENSION + 1), np.float32)
        np.add(far[symbols[t - 2]], near[symbols[t - 1]], out=h1[:, :-1])
        group = w // shape.size
        result[t] = log_softmax_at(h1, heads, group)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        for i, j in zip(first, [*first[1:], len(t)], strict=True):
            members = slice(group[i] * shape.size, min(shape.predicted, (group[i] + 1) * shape.size))
            result[t[i:j]] += log_softmax_at(h1[i:j], out[members], w[i:j] - members.start)
    return result


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """word and n of the tokens of all texts, the end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        held: Counter = Counter()
        for batch in pieces(batches, 0):
            for value in batch.column(0):
                held.update(words(value.as_py()))
                held[b""] += 1
                if len(held) > 400_000:
                    yield out()
                    held.clear()
        yield out()

    return texts.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame) -> list:
    """(word, n) of the most frequent words, FREQUENT at most, by count and then word.

    A histogram of counts, of some hundred classes, says which count is enough, so that no task
    sends more than its share of the table.
    """
    size = F.floor(F.log2("n") * 16)
    enough, total = None, 0
    for level, words_ in sorted(map(tuple, counts.groupBy(size.alias("size")).count().collect()), reverse=True):
        if (total := total + words_) > FREQUENT:
            break
        enough = level
    found = counts.where(size >= enough).collect() if enough is not None else []
    return sorted(found, key=lambda r: (-r["n"], r["word"]))


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[:2]) % CLASSES


class Words(dict):
    """Numbers of the frequent words, from 1; for another word -1 less the number of its class."""

    def __missing__(self, word: bytes) -> int:
        return -1 - zlib.crc32(word[:2]) % CLASSES


def class_of(word: Column) -> Column:
    return F.crc32(F.substring(word.cast("binary"), 1, 2)) % CLASSES


def numbered(tokens: list[bytes], vocabulary: Words) -> np.ndarray:
    return np.fromiter(map(vocabulary.__getitem__, tokens), np.int64, len(tokens))


def symbols(texts: list[np.ndarray], symbol_of: np.ndarray, shape: Shape) -> np.ndarray:
    """START, START, the symbols of the numbered words of a text and the end, for each text."""
    out = [np.empty(0, np.int64)]
    for ids in texts:
        out += [(shape.start, shape.start), np.where(ids > 0, symbol_of[np.maximum(ids, 0)], -1 - ids), (shape.end,)]
    return np.concatenate(out)


def fit(texts: DataFrame, text: str, tokens: int, shape: Shape, vocabulary, symbol_of: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """Parameters trained on all texts, averaged over the tasks by the tokens that each has seen."""
    flat = initial(shape, frequency)
    told = texts.sparkSession.sparkContext.broadcast((flat, frequency, symbol_of))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat_, frequency_, symbol_of_ = told.value
        trainer, seen = None, 0
        for batch in pieces(batches, 0):
            found = symbols([numbered(words(v.as_py()), vocabulary.value) for v in batch.column(0)], symbol_of_, shape)
            trainer = trainer or Trainer(shape, flat_, frequency_, zlib.crc32(found.tobytes()))
            trainer.learn(found)
            seen += int((found != shape.start).sum())
        for start in range(0, shape.length if seen else 0, PARAMETERS):
            part = trainer.flat[start : start + PARAMETERS].astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays([pa.array([start], pa.int64()), pa.array([part.tobytes()], pa.binary()), pa.array([seen], pa.int64())], ["start", "x", "seen"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for start, x, seen in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held = total.setdefault(start, [0.0, 0])
                total[start] = [held[0] + np.frombuffer(x), held[1] + seen]
        for start, (x, seen) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([start], pa.int64()), pa.array([(x / seen).astype(np.float32).tobytes()], pa.binary()), pa.array([seen], pa.int64())], ["start", "x", "seen"])

    tasks = max(1, tokens // max(TOKENS_A_TASK, TOKENS_A_PARAMETER * shape.length))
    learned = texts.select(text).coalesce(tasks).mapInArrow(learn, "start bigint, x binary, seen bigint")
    means = learned.repartition("start").mapInArrow(add, "start bigint, x binary, seen bigint").select("start", "x").collect()  # the model, of bounded size
    for start, x in means:
        flat[start : start + PARAMETERS] = np.frombuffer(x, np.float32)
    return flat


def score(docs: DataFrame, train_if: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the whole text) of each row."""
    spark = docs.sparkSession
    shared_folder(spark)
    learned = docs.where(train_if)
    counts = word_counts(learned, text).checkpoint()
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = sum(r["n"] for r in counts.where(F.col("word") == END_WORD).collect())
    top = frequent(counts.where(F.col("word") != END_WORD))
    vocabulary = Words({r["word"].encode(): i for i, r in enumerate(top, 1)})
    log_count = np.log10(np.array([1.0, *[r["n"] + 0.5 for r in top]]))  # 0 for a word that has to be joined

    listed = sorted((r["word"].encode(), i) for i, r in enumerate(top[: min(MODEL_WORDS, math.isqrt(total))], 1))
    shape = Shape(len(listed))
    symbol_of = np.array([0, *[tail_class(r["word"].encode()) for r in top]])
    symbol_of[[i for _, i in listed]] = CLASSES + np.arange(len(listed))
    mass, held = np.zeros(CLASSES), np.zeros(CLASSES)  # tokens and words of the classes
    for class_, n, v in counts.where(F.col("word") != END_WORD).groupBy(class_of(F.col("word"))).agg(F.sum("n"), F.count("*")).collect():  # a row for each class
        mass[class_], held[class_] = n, v
    for word, i in listed:
        class_ = tail_class(word)
        mass[class_], held[class_] = mass[class_] - top[i - 1]["n"], held[class_] - 1
    frequency = np.concatenate([mass, [top[i - 1]["n"] for _, i in listed], [ends]]) + 0.5
    frequency /= frequency.sum()
    of_class = np.log10(mass + 0.5 * (held + 1))

    told = spark.sparkContext.broadcast(vocabulary)
    flat = fit(learned, text, total, shape, told, symbol_of, frequency)
    model = spark.sparkContext.broadcast((flat, log_count, symbol_of, of_class))
    end_log = math.log10(ends + 0.5)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat_, logs, symbol_of_, of_class_ = model.value
        for batch in pieces(batches, 1):
            out: dict[str, list] = {k: [] for k in ("n", "known", "logs", "rest_logs", "far")}
            texts = []
            for value in batch.column(1):
                tokens = words(value.as_py())
                ids = numbered(tokens, told.value)
                texts.append(ids)
                known = ids[ids > 0]
                out["n"].append(len(tokens) + 1)
                out["known"].append(len(known) + (ends > 0))
                out["logs"].append(float(logs[known].sum()) + end_log)
                rest, far = known[symbol_of_[known] < CLASSES], np.flatnonzero(ids < 0)
                out["rest_logs"].append(float(logs[rest].sum() - of_class_[symbol_of_[rest]].sum() - of_class_[-1 - ids[far]].sum()))
                out["far"].append([tokens[i].decode() for i in far.tolist()])
            found = symbols(texts, symbol_of_, shape)
            begins = np.cumsum([0, *[len(ids) + 3 for ids in texts[:-1]]])
            lm = np.add.reduceat(log_probabilities(shape, flat_, found), begins) / math.log(10)
            kinds_ = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, k) for v, k in zip(out.values(), kinds_, strict=True)], pa.array(lm)], [key, *out, "lm"])

    scored = docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n bigint, known bigint, logs double, rest_logs double, far array<string>, lm double").checkpoint()
    scored = scored.withColumn("row", F.monotonically_increasing_id())  # of a checkpoint, which doesn't change
    joined = scored.select("row", F.explode("far").alias("word")).join(counts.withColumnRenamed("n", "c"), "word", "left")
    tails = joined.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("far_logs"), F.count("c").alias("far_known"))
    far_logs, far_known = F.coalesce("far_logs", F.lit(0.0)), F.coalesce("far_known", F.lit(0))
    return scored.join(tails, "row", "left").select(
        key,
        F.col("n").alias("n_tokens"),
        (F.col("known") + far_known).alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("logs") + far_logs - F.col("n") * math.log10(total + 0.5 * (kinds + 1))).alias("base_score"),
        (F.col("lm") + F.col("rest_logs") + far_logs).alias("score"),
    )
