"""Running folds over ordered rows of a key, as numpy scans over range partitions.

The rows are sorted by key and order into range partitions, so a key with many rows lies in several of
them. Each partition is scanned once for what its last key leaves open; these summaries (one row for each
partition) are composed into what each partition takes over, and a second scan adds it. No key is ever in one
task as a whole, and a task holds one batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewake.sources.folders import shared_folder

#: Names of the scan's own columns.
PART, INDEX = "_part", "_index"


@dataclass(frozen=True)
class Polynomial:
    """The running sum of value(i) * base**i modulo `modulus`, i from 0; base 1 without a modulus is a plain sum."""

    value: str
    base: int = 1
    modulus: int | None = None

    def powers(self, index: np.ndarray) -> np.ndarray:
        """base**index, by squaring."""
        out, square, left = np.ones(len(index), np.int64), self.base, index.copy()
        while self.base != 1 and left.any():
            out[left & 1 == 1] = self.reduced(out[left & 1 == 1] * square)
            square, left = square * square % self.modulus, left >> 1
        return out

    def reduced(self, value):
        return value % self.modulus if self.modulus else value


def running(sums: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running sums that begin anew at each start."""
    total = np.cumsum(sums)
    before = np.concatenate([[0], total])[starts]
    return total - np.repeat(before, np.diff(np.append(starts, len(sums))))


class Scan:
    """The folds of a stream of batches; `length` and `sums` are those of the key met last."""

    def __init__(self, folds: tuple[Polynomial, ...], key: int | None = None, length: int = 0, sums: tuple[int, ...] | None = None):
        self.folds, self.key, self.length, self.sums = folds, key, length, sums or (0,) * len(folds)

    def take(self, keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Index of each row in its key, and each fold up to it."""
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        index = np.arange(len(keys)) - np.repeat(starts, sizes)
        going_on = self.key is not None and keys[0] == self.key
        first = sizes[0]
        if going_on:
            index[:first] += self.length
        out = []
        for fold, value, carried in zip(self.folds, values, self.sums, strict=True):
            terms = fold.reduced(fold.reduced(value) * fold.powers(index))
            total = running(terms, starts)
            if going_on:
                total[:first] += carried
            out.append(fold.reduced(total))
        self.key, self.length, self.sums = int(keys[-1]), int(index[-1]) + 1, tuple(int(x[-1]) for x in out)
        return index, out

    def after(self, other: Scan) -> Scan:
        """What is open after `other` (the first part) and then this one, which is of the same key."""
        sums = tuple(int(f.reduced(a + b * int(f.powers(np.array([other.length]))[0]))) for f, a, b in zip(self.folds, other.sums, self.sums, strict=True))
        return Scan(self.folds, self.key, self.length + other.length, sums)


def _columns(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batches, none empty, each of one range partition."""
    for batch in batches:
        parts = _columns(batch, [PART])[0]
        cuts = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])).tolist() if len(parts) else []
        for start, end in zip(cuts, [*cuts[1:], len(parts)], strict=True):
            yield int(parts[start]), batch.slice(start, end - start)


def scan(rows: DataFrame, key: str, order: list[str | Column], keep: list[str], folds: dict[str, Polynomial]) -> DataFrame:
    """The columns `keep` (key included), `_index` (from 0) of the row in its key, and the folds under their names.

    `key` is a bigint without nulls. Rows alike in `order` come in any order. Only `keep` is checkpointed.
    """
    shared_folder(rows.sparkSession)
    ordered = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    parts = ordered.select(*keep, F.spark_partition_id().alias(PART)).checkpoint()
    polynomials = tuple(folds.values())
    names = [p.value for p in polynomials]

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, tuple[int, Scan]] = {}
        for part, batch in _by_part(batches):
            keys, *values = _columns(batch, [key, *names])
            _, state = open_.setdefault(part, (int(keys[0]), Scan(polynomials)))
            state.take(keys, values)
        for part, (first, state) in open_.items():
            ints = [pa.array([x], pa.int64()) for x in (part, first, state.key, state.length)]
            yield pa.RecordBatch.from_arrays([*ints, pa.array([list(state.sums)], pa.list_(pa.int64()))], ["part", "first", "last", "length", "sums"])

    told = parts.select(PART, key, *dict.fromkeys(names)).mapInArrow(summary, "part bigint, first bigint, last bigint, length bigint, sums array<bigint>").collect()
    carried, state = {}, Scan(polynomials)
    for r in sorted(told):  # one row for each range partition
        carried[r.part] = (state.key, state.length, state.sums)
        own = Scan(polynomials, r.last, r.length, tuple(r.sums))
        state = own.after(state) if r.first == r.last == state.key else own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for part, batch in _by_part(batches):
            if part != at:
                at, state = part, Scan(polynomials, *carried[part])
            keys, *values = _columns(batch, [key, *names])
            index, sums = state.take(keys, values)
            kept = [batch.column(batch.schema.get_field_index(n)) for n in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(index), *map(pa.array, sums)], [*keep, INDEX, *folds])

    schema = ", ".join([*(f"`{n}` {parts.schema[n].dataType.simpleString()}" for n in keep), f"{INDEX} bigint", *(f"`{n}` bigint" for n in folds)])
    return parts.mapInArrow(run, schema)
