"""Approximate nearest neighbours by a permutation index (operator 4).

A vector is represented by the order of its nearest pivots. Candidates lie in blocks; each block
keeps an inverted file for each pivot, of the vectors that have it among their nearest and of its
place in their order. A query reads the files of its own nearest pivots and so gets the
footrule distance (places of missing pivots count as the order's length) to every candidate
that shares a pivot; the closest are reranked by inner product in double precision.

Pivots are a bounded sample (`n_pivots` vectors of least hash, equal rows once), the only vectors at the
driver. Blocks are cut from the partitions as they are read, at most `BLOCK` rows each, so equal
vectors or keys gather nowhere. Query blocks meet candidate blocks by an equi-join on the number
of the query block: each pair of blocks is one row and one index search.

Vectors that are null, zero or empty, hold null or non-finite components, or have another
dimension than the pivots take no part; nor do rows with a null key. Candidates with the query's key
are its own. Repeated rows of a key count once, in each block too: of them the largest product is
taken before the k best keys are cut. Ties go to the smaller key. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder

#: Pivots, and how many of them make a vector's order.
PIVOTS, ORDER = 512, 64
#: Rows of a block of candidates or of queries.
BLOCK = 4096
#: Share of a block's keys, and least number, that are reranked for each query.
SHARE, LEAST = 0.3, 400


def orders(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Numbers of each row's pivots of largest inner product, in order; ties to the lower number."""
    products = np.round(x @ pivots.T, 9)
    return np.argsort(-products, axis=1, kind="stable")[:, :length].astype(np.int16)


def inverted_files(order: np.ndarray, n_pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings of all pivots one after another: rows, places, and where each pivot's begin."""
    n, length = order.shape
    flat = order.ravel()
    by_pivot = np.argsort(flat, kind="stable")
    starts = np.searchsorted(flat[by_pivot], np.arange(n_pivots + 1))
    return (by_pivot // length).astype(np.int32), (by_pivot % length).astype(np.int32), starts


def nearest(query: np.ndarray, order: np.ndarray, x: np.ndarray, keys: np.ndarray, firsts: np.ndarray, own: int, files: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First rows and largest inner products of the k best keys of a block, whose rows are in the order of keys; firsts are the keys' first rows."""
    rows, places, starts = files
    length, n = len(order), len(firsts)
    # The footrule distance is a constant less twice the sum, over shared pivots, of length - max(place, place).
    files_read = [slice(starts[p], starts[p + 1]) for p in order]
    read = np.concatenate([rows[f] for f in files_read])
    later = np.maximum(np.concatenate([places[f] for f in files_read]), np.repeat(np.arange(length), [f.stop - f.start for f in files_read]))
    gain = np.bincount(read, weights=length - later, minlength=len(keys)).astype(np.int64)
    gain = np.maximum.reduceat(gain, firsts)  # of a key, its closest row's
    wanted = max(LEAST, k + 1, int(np.ceil(SHARE * n)))
    if wanted < n:
        rank = gain * n + (n - 1 - np.arange(n))  # ties to the smaller key
        chosen = np.sort(np.argpartition(-rank, wanted)[:wanted])
    else:
        chosen = np.arange(n)
    chosen = chosen[keys[firsts[chosen]] != own]
    if not len(chosen):
        return chosen, np.zeros(0)
    sizes = np.diff(firsts, append=len(keys))[chosen]
    begins = np.cumsum(sizes) - sizes
    taken = np.repeat(firsts[chosen] - begins, sizes) + np.arange(sizes.sum())
    products = np.maximum.reduceat((x[taken] * query).sum(1), begins)
    best = np.lexsort((keys[firsts[chosen]], -products))[:k]
    return firsts[chosen[best]], products[best]


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def blocks(rows: DataFrame, dimension: int) -> DataFrame:
    """keys and vectors of at most BLOCK rows, packed, from rows (key, vector); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(keys: list, vectors: list) -> pa.RecordBatch:
            k, v = np.concatenate(keys), np.concatenate(vectors)
            return pa.RecordBatch.from_arrays([pa.array([k.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["keys", "vectors"])

        keys, vectors, held = [], [], 0
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(k), dimension)
            for start in range(0, len(k), BLOCK):
                part = slice(start, start + BLOCK)
                if held and held + len(k[part]) > BLOCK:
                    yield pack(keys, vectors)
                    keys, vectors, held = [], [], 0
                keys.append(k[part])
                vectors.append(v[part])
                held += len(k[part])
        if held:
            yield pack(keys, vectors)

    return rows.mapInArrow(run, "keys binary, vectors binary")


def search(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, n_pivots: int = PIVOTS, order: int = ORDER) -> DataFrame:
    """query_id, rank (from 1), key and score of the k best found for each query row, against all rows."""
    shared_folder(vectors.sparkSession)
    fit = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("asked"))
    told_apart = fit.select("key", "vector", F.xxhash64("key", "vector").alias("h"))
    least = [r["h"] for r in told_apart.select("h").distinct().orderBy("h").limit(n_pivots).collect()]
    sample = [r["vector"] for r in told_apart.where(F.col("h").isin(least)).dropDuplicates(["h"]).orderBy("h").collect()]
    result = f"query_id bigint, `{key}` bigint, score double"
    if not sample:
        return vectors.sparkSession.createDataFrame([], result.replace(f"`{key}`", f"rank int, `{key}`"))
    dimension = len(sample[0])
    pivots = np.array([p for p in sample if len(p) == dimension])
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    length = min(order, len(pivots))
    told = vectors.sparkSession.sparkContext.broadcast(pivots)
    fit = fit.where(F.size("vector") == dimension)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["keys", "vectors", "rows", "places", "starts"]
        for batch in batches:
            for keys, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k_, x = np.frombuffer(keys, np.int64), np.frombuffer(data).reshape(-1, dimension)
                by_key = np.argsort(k_, kind="stable")
                k_, x = k_[by_key], x[by_key]
                files = inverted_files(orders(x, told.value, length), len(told.value))
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (k_, x, *files)], names)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qk, qv, keys, data, rows, places, starts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids, queries = np.frombuffer(qk, np.int64), np.frombuffer(qv).reshape(-1, dimension)
                k_, x = np.frombuffer(keys, np.int64), np.frombuffer(data).reshape(-1, dimension)
                files = np.frombuffer(rows, np.int32), np.frombuffer(places, np.int32), np.frombuffer(starts, np.int64)
                firsts = np.flatnonzero(np.append(True, k_[1:] != k_[:-1]))
                found = [nearest(q, o, x, k_, firsts, i, files, k) for i, q, o in zip(ids, queries, orders(queries, told.value, length), strict=True)]
                sizes = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, sizes)), pa.array(k_[np.concatenate([f[0] for f in found])]), pa.array(np.concatenate([f[1] for f in found]))],
                    ["query_id", key, "score"],
                )

    index = blocks(fit.select("key", "vector"), dimension).mapInArrow(indexed, "keys binary, vectors binary, rows binary, places binary, starts binary").checkpoint()
    asked = fit.where("asked").select("key", "vector").dropDuplicates(["key"])
    parts = max(1, -(-asked.count() // BLOCK))
    numbered = blocks(asked.repartition(parts), dimension).select(F.xxhash64("keys").alias("q"), F.col("keys").alias("qk"), F.col("vectors").alias("qv")).checkpoint()
    names = [r["q"] for r in numbered.select("q").collect()]  # a number for each block of queries
    meeting = index.withColumn("q", F.explode(F.lit(names).cast("array<bigint>"))).repartition("q", F.xxhash64("keys"))
    joined = meeting.join(F.broadcast(numbered) if len(names) * BLOCK * dimension * 8 < 64 << 20 else numbered, "q")
    found = joined.select("qk", "qv", "keys", "vectors", "rows", "places", "starts").mapInArrow(searched, result)
    best = found.groupBy("query_id", key).agg(F.max("score").alias("score"))
    by_nearness = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key))
    return best.withColumn("rank", F.row_number().over(by_nearness)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")
