"""Whole runs: bounded crawls of captures, their changes, and the artifacts they store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewake.operators import changes, graph


def incremental(previous: DataFrame, captures: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Changes of a run and its completeness.

    previous and captures are (node, hash); a walk from the seeds decides which captures the run has
    reached. A node on the last level with links onwards makes the run incomplete; then
    nodes not reached are unknown, not missing. Returns (node, change, old_hash, new_hash), and one
    row of (complete, pages).
    """
    edges = graph.checkpointed(edges.select("from", "to"))
    reached = graph.traverse(edges, seeds, depth)
    cut = reached.where(F.col("depth") == depth).join(edges, F.col("node") == F.col("from"), "left_semi").limit(1).count() > 0
    got = captures.join(reached.select("node").distinct(), "node", "left_semi")
    told = changes.between(previous, got, "node", "hash", F.lit(not cut))
    return told, got.agg(F.lit(not cut).alias("complete"), F.count("*").alias("pages"))


def not_before(requests: DataFrame, origin: str, at: str, interval: float) -> DataFrame:
    """Requests with the time at which each may start: its own, or the start of the one before and the interval.

    Of n requests in order, start(n) is the greatest over i <= n of at(i) + (n - i) * interval: a
    running maximum of at(i) - i * interval, so the recurrence needs no loop.
    """
    w = Window.partitionBy(origin).orderBy(at, "id")
    n = F.row_number().over(w)
    ranked = requests.withColumn("_n", n).withColumn("_base", F.col(at) - F.col("_n") * interval)
    return ranked.withColumn("not_before", F.max("_base").over(w) + F.col("_n") * interval).drop("_n", "_base")


def stored(observations: DataFrame, sha256: str, source: str, run: str) -> tuple[DataFrame, DataFrame]:
    """Blobs (one for each digest) and versions (one for each run, source and digest) of observations."""
    return observations.select(sha256).distinct(), observations.groupBy(run, source, sha256).agg(F.count("*").alias("observations"))


def evidence(pages: DataFrame, files: DataFrame, key: str, page: str, k: int = 5) -> DataFrame:
    """For each site: numbers of pages and files, and the k pages with most files, ties by name."""
    per_page = files.groupBy(key, page).agg(F.count("*").alias("n"))
    ranked = per_page.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), page))).where(F.col("_r") <= k)
    top = ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", page))), lambda x: x[page]).alias("top_pages"))
    counts = pages.groupBy(key).agg(F.count("*").alias("n_pages")).join(files.groupBy(key).agg(F.count("*").alias("n_files")), key, "left")
    return counts.join(top, key, "left").select(key, "n_pages", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("top_pages", F.array().cast("array<string>")).alias("top_pages"))


def reservation_valid(slot: Column, limit: Column, start: Column, at: Column, seconds: float) -> Column:
    """A reservation's slot is between 1 and the limit, and its time in its window."""
    return (slot >= 1) & (slot <= limit) & (at >= start) & (at < start + seconds)


def windows_overlap(windows: DataFrame, origin: str) -> DataFrame:
    """Windows that start before the origin's one before has ended."""
    end = F.lag("end").over(Window.partitionBy(origin).orderBy("start", "end"))
    return windows.withColumn("previous_end", end).where(F.col("start") < F.col("previous_end"))
