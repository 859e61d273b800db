"""Summary of a baseline run: directories, coverage, truncation and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewake.functions import urls
from pagewake.operators import planning


def directories(pages: DataFrame, files: DataFrame, keys: list[str], path: str, selected: DataFrame | None = None) -> DataFrame:
    """Pages and files of each directory of one and of two levels; selected prefixes are listed even without any."""
    def counted(rows: DataFrame, name: str) -> DataFrame:
        levels = F.explode(F.array(F.struct(F.lit(1).alias("level"), urls.path_prefix(F.col(path), 1).alias("directory")), F.struct(F.lit(2).alias("level"), urls.path_prefix(F.col(path), 2).alias("directory"))))
        return rows.select(*keys, levels.alias("d")).groupBy(*keys, "d.level", "d.directory").agg(F.count("*").alias(name))

    on = [*keys, "level", "directory"]
    out = counted(pages, "pages").join(counted(files, "files"), on, "full")
    if selected is not None:
        out = out.join(selected, on, "full")
    return out.select(*on, F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("files", F.lit(0)).alias("files"))


def low_coverage(selected: DataFrame, observed: DataFrame, key: str, prefix: str) -> DataFrame:
    """Selected prefixes under which nothing was seen: none of the ancestors of an observed prefix, or itself."""
    up = observed.select(key, F.explode(F.array_append(planning.ancestors(prefix), F.col(prefix))).alias(prefix))
    return selected.join(up, [key, prefix], "left_anti")


def truncated(seen: Column, counted: Column, budget: Column) -> Column:
    """Whether the greater of two numbers reached a budget above 0."""
    return (budget > 0) & (F.greatest(F.coalesce(seen, F.lit(0)), counted) >= budget)


def confidence(pages: Column, files: Column, truncated_: Column, low: Column, unselected: Column) -> Column:
    return F.when((pages == 0) | truncated_ | (low > 0), "low").when((unselected > 0) | (files == 0), "medium").otherwise("high")
