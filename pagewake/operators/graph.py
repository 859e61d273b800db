"""Link graphs: bounded traversal and acyclicity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewake.sources.folders import shared_folder


def checkpointed(rows: DataFrame) -> DataFrame:
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def traverse(edges: DataFrame, seeds: DataFrame, depth: int, budget: int | None = None) -> DataFrame:
    """scope, node, depth, parent of what a breadth-first walk from each scope's seeds reaches.

    Edges are (from, to), seeds (scope, node). A level's pages are met in the order of their parent and
    their own name; with a budget, a scope takes only so many pages. The edges are written once, by their start. Each level is one join,
    checkpointed, and levels are kept apart; the loop runs once for each level.
    """
    edges = checkpointed(edges.select("from", "to").repartition("from"))
    seen = checkpointed(seeds.select("scope", "node", F.lit(0).alias("depth"), F.lit(None).cast(seeds.schema["node"].dataType).alias("parent")).dropDuplicates(["scope", "node"]))
    frontier, levels = seen, [seen]
    for level in range(1, depth + 1):
        step = frontier.join(edges, F.col("node") == F.col("from")).groupBy("scope", F.col("to").alias("node")).agg(F.min("from").alias("parent"))
        new = step.join(seen, ["scope", "node"], "left_anti").select("scope", "node", F.lit(level).alias("depth"), "parent")
        if budget is not None:
            used = seen.groupBy("scope").agg(F.count("*").alias("used"))
            rank = F.row_number().over(Window.partitionBy("scope").orderBy("parent", "node"))
            new = new.withColumn("_n", rank).join(used, "scope").where(F.col("_n") + F.col("used") <= budget).select("scope", "node", "depth", "parent")
        frontier = checkpointed(new)
        if not frontier.limit(1).count():
            break
        levels.append(frontier)
        seen = reduce(DataFrame.unionByName, levels)
    return seen


def cyclic(edges: DataFrame) -> DataFrame:
    """The edges (child, parent) left when nodes without parents are peeled off, again and again: empty if acyclic."""
    left = checkpointed(edges.select("child", "parent").distinct())
    size = left.count()
    while size:
        rest = checkpointed(left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("child", "parent"))
        now = rest.count()
        if now == size:
            break
        left, size = rest, now
    return left
