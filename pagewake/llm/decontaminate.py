"""Benchmark decontamination (operator 10): Wu-Manber search for the word windows of benchmark items.

Symbols are words (A-Z lower-cased, between ASCII characters that are no letter or digit).
A pattern is a window of `width` item words; an item of fewer words is one shorter pattern.
Patterns of one length form a searcher: its shift table, keyed by blocks of two words, skips
positions at which no pattern can end; where the shift is 0, the bucket of the suffix's hash gives
the patterns to test, and a comparison of all words confirms. The hash takes in the whole pattern, so
patterns with a common ending don't share a bucket.

Documents are read once a pass and never shuffled, so a hot passage, source or long document costs
what its own words cost. Items stream through the driver and are broadcast as tables of `pass_bytes`
of item text at most (a longer item stands alone), some 16 times that in memory; a larger benchmark
takes several passes, with a checkpoint between them.

Null or empty texts have no words and hit nothing. Repeated items count once an item_id; a null
item_id counts as the empty string. Repeated documents each get their row, and an empty table gives an
empty one; extra columns are not carried. An empty benchmark hits nothing. Overlapping and repeated
occurrences all count; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, shared_folder

#: Benchmark text (bytes of UTF-8) that one pass broadcasts.
PASS_BYTES = 4 << 20
BLANKS = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(BLANKS).split() if text else []


class Searcher:
    """Wu-Manber tables of patterns of one length: `starts` in the items' words, and the item of each."""

    def __init__(self, length: int, text: np.ndarray, starts: np.ndarray, items: np.ndarray, kinds: int):
        self.length, self.text, self.kinds = length, text, kinds
        m, self.block = length, min(2, length)
        b = self.block
        self.most = m - b + 1
        keys = text if b == 1 else text[:-1] * kinds + text[1:]
        self.shift: dict[int, int] = {}
        for end in range(b, m + 1):  # the least shift of a block is written last
            self.shift.update(zip(np.unique(keys[starts + end - b]).tolist(), repeat(m - end)))
        # Odd factors, all different, make the hash depend on the order of the words.
        self.factors = np.random.default_rng(10).integers(1, 1 << 62, m, np.uint64) * np.uint64(2) + np.uint64(1)
        hashes = self.hashed(sliding_window_view(text, m)[starts])
        by_hash = np.argsort(hashes, kind="stable")
        self.hashes, self.starts, self.items = hashes[by_hash], starts[by_hash], items[by_hash]

    def hashed(self, windows: np.ndarray) -> np.ndarray:
        x = windows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(29))) * self.factors).sum(1, dtype=np.uint64)

    def search(self, ids: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """Starts of occurrences, in order, with the numbers of the items of each."""
        m, most, shift, n, kinds, pair = self.length, self.most, self.shift.get, len(ids), self.kinds, self.block == 2
        ends, i = [], m
        while i <= n:
            if step := shift(ids[i - 2] * kinds + ids[i - 1] if pair else ids[i - 1], most):
                i += step
            else:
                ends.append(i)
                i += 1
        if not ends:
            return
        at = np.array(ends) - m
        windows = sliding_window_view(np.array(ids), m)[at]
        hashes = self.hashed(windows)
        low, high = np.searchsorted(self.hashes, hashes), np.searchsorted(self.hashes, hashes, "right")
        for k in np.flatnonzero(low < high):
            tested = self.starts[low[k] : high[k]]
            equal = (self.text[tested[:, None] + np.arange(m)] == windows[k]).all(1)
            if equal.any():
                yield int(at[k]), self.items[low[k] : high[k]][equal]


class Tables:
    """The searchers of some items, the numbers of their words (from 1; 0 for others) and their names."""

    def __init__(self, items: Iterable[tuple[str, str]], width: int):
        self.names: list[str] = []
        self.numbers: dict[bytes, int] = {}
        text: list[int] = []
        patterns: dict[int, list[tuple[np.ndarray, int]]] = {}
        for name, body in items:
            if w := words(body):
                m = min(width, len(w))
                patterns.setdefault(m, []).append((len(text) + np.arange(len(w) - m + 1), len(self.names)))
                text += [self.numbers.setdefault(x, len(self.numbers) + 1) for x in w]
                self.names.append(name)
        every = np.array(text, np.int64)
        self.searchers = [Searcher(m, every, np.concatenate([s for s, _ in p]), np.concatenate([np.full(len(s), i) for s, i in p]), len(self.numbers) + 1) for m, p in patterns.items()]

    def search(self, text: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
        """Start, end and items (numbers) of the occurrences in a text."""
        if self.searchers:
            ids = list(map(self.numbers.get, text, repeat(0)))
            for s in self.searchers:
                for start, items in s.search(ids):
                    yield start, start + s.length, items


def spans(found: list[tuple[int, int]]) -> list[int]:
    """Disjoint, ordered start, end, start, end ... that cover the same words."""
    out: list[int] = []
    for start, end in sorted(found):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def passes(benchmark: DataFrame, item: str, item_text: str, width: int, pass_bytes: int) -> Iterator:
    """Broadcast tables of one part of the items after another; at least one."""
    listed = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("name"), F.col(item_text).alias("body")).where(F.col("body").isNotNull())
    held, size, told = [], 0, False
    for r in listed.toLocalIterator():
        more = len(r["body"].encode("utf-8", "surrogatepass"))
        if held and size + more > pass_bytes:
            yield benchmark.sparkSession.sparkContext.broadcast(Tables(held, width))
            held, size, told = [], 0, True
        held.append((r["name"], r["body"]))
        size += more
    if held or not told:
        yield benchmark.sparkSession.sparkContext.broadcast(Tables(held, width))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 10, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows that hold no benchmark window, with all their columns; no shuffle."""
    at = docs.columns.index(text)

    def filter_by(tables):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, at):
                texts = (words(v.as_py()) for v in batch.column(at))
                yield batch.filter(pa.array([not any(True for _ in tables.value.search(w)) for w in texts], pa.bool_()))

        return run

    out = docs
    for i, tables in enumerate(passes(benchmark, item, item_text, width, pass_bytes)):
        if i:
            shared_folder(docs.sparkSession)
            out = out.checkpoint()
        out = out.mapInArrow(filter_by(tables), docs.schema)
    return out


def search(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 10, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """A row for each document: key, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans and items.

    hit_spans holds the word positions start, end (exclusive), start, end ... of disjoint runs.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = (key, "text", "n_words", "hit_spans", "items")
    schema = f"`{key}` {kind}, text string, n_words bigint, hit_spans array<bigint>, items array<string>"

    def finder(tables):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, 1):
                out: dict[str, list] = {k: [] for k in names[2:]}
                for body, held, had in zip(batch.column(1), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                    w = words(body.as_py())
                    found, items = list(zip(held[::2], held[1::2], strict=True)), set(had)
                    for start, end, of in tables.value.search(w):
                        found.append((start, end))
                        items.update(tables.value.names[i] for i in of.tolist())
                    out["n_words"].append(len(w))
                    out["hit_spans"].append(spans(found))
                    out["items"].append(sorted(items))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out["n_words"], pa.int64()), pa.array(out["hit_spans"], pa.list_(pa.int64())), pa.array(out["items"], pa.list_(pa.string()))], names)

        return run

    state = docs.select(F.col(key), F.col(text).cast("string").alias("text"), F.lit(0).cast("bigint").alias("n_words"), F.array().cast("array<bigint>").alias("hit_spans"), F.array().cast("array<string>").alias("items"))
    for i, tables in enumerate(passes(benchmark, item, item_text, width, pass_bytes)):
        if i:
            shared_folder(docs.sparkSession)
            state = state.checkpoint()
        state = state.mapInArrow(finder(tables), schema)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda a, x: x - a)  # ends less starts: the sign turns at each step
    return state.select(
        key,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "hit_spans",
        "items",
    )
