"""Connected components by minimum labels on a graph that shrinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """v and label, the smallest vertex of its component, for each vertex of edges (a, b); loops are fine.

    In a step each vertex takes the least label among itself and its neighbours, then that label's own
    label. The edges are drawn anew between the labels, without loops and repeats, so that only the first
    step reads all of them and a large component soon has none left. Whatever its label, a vertex stays
    connected with it, as its edges go on from there; so the least vertex of a component ends as its label.
    Edges and labels are written at each step, so that Spark joins them by size; only whether an edge is left reaches the driver.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while True:
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("e")).select("e.*")
        near = written(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("label")))
        jump = near.select(F.col("v").alias("label"), F.col("label").alias("further"))
        step = written(near.join(jump, "label").select("v", F.col("further").alias("next")))
        labels = step.withColumnRenamed("next", "label") if labels is None else written(labels.join(step.withColumnRenamed("v", "label"), "label", "left").select("v", F.coalesce("next", "label").alias("label")))
        drawn = edges.where("a <> b").join(step.select(F.col("v").alias("a"), F.col("next").alias("x")), "a").join(step.select(F.col("v").alias("b"), F.col("next").alias("y")), "b")
        edges = written(drawn.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if not edges.limit(1).count():
            return labels
