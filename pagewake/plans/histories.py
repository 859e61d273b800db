"""Histories and ordered listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewake.operators import graph
from pagewake.plans import reports
from pagewake.plans.governance import WALK
from pagewake.plans.registry import register
from pagewake.plans.sections import _INVENTORY, _inventory
from pagewake.sources import views
from pagewake.sources.views import FILES, SNAPSHOTS

SITE, SOURCE, TOP = "https://blog.tionsh.example.net", "src3", 5


@register(f"WITH {SNAPSHOTS} SELECT page_id, run_id, id, content_hash, row_number() OVER (PARTITION BY page_id ORDER BY run_id DESC, id DESC) AS nth FROM snapshots")
def page_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshots of every page, newest first."""
    newest = Window.partitionBy("page_id").orderBy(F.col("run_id").desc(), F.col("id").desc())
    return views.snapshots(spark, sf_dir).select("page_id", "run_id", "id", "content_hash", F.row_number().over(newest).alias("nth"))


@register(f"WITH {SNAPSHOTS} SELECT run_id, id, page_id, canonical_url, content_hash FROM snapshots WHERE site = '{SITE}' ORDER BY run_id, id")
def scope_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshots of one scope, oldest first."""
    return views.snapshots(spark, sf_dir).where(F.col("site") == SITE).select("run_id", "id", "page_id", "canonical_url", "content_hash").orderBy("run_id", "id")


@register(f"WITH {FILES} SELECT id, page_id, download_url, sha256 FROM files WHERE site = '{SOURCE}' AND run_id = 1 ORDER BY id")
def file_observations_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file observations of one scope in one run, by their ids."""
    return views.file_observations(spark, sf_dir).where((F.col("site") == SOURCE) & (F.col("run_id") == 1)).select("id", "page_id", "download_url", "sha256").orderBy("id")


@register(f"WITH {_INVENTORY}, r AS (SELECT site, section_path, page_count, row_number() OVER (PARTITION BY site ORDER BY page_count DESC, section_path) AS place FROM inv) SELECT * FROM r WHERE place <= {TOP}")
def top_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of each site with most pages."""
    most = Window.partitionBy("site").orderBy(F.col("page_count").desc(), "section_path")
    return _inventory(spark, sf_dir).select("site", "section_path", "page_count", F.row_number().over(most).alias("place")).where(F.col("place") <= TOP)


@register(f"WITH {_INVENTORY} SELECT site, section_path, row_number() OVER (PARTITION BY site ORDER BY section_level, child_section_count DESC, page_count DESC, section_path) AS place FROM inv")
def section_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of each site by level, then most children, most pages, and path."""
    order = Window.partitionBy("site").orderBy("section_level", F.col("child_section_count").desc(), F.col("page_count").desc(), "section_path")
    return _inventory(spark, sf_dir).select("site", "section_path", F.row_number().over(order).alias("place"))


@register(f"WITH t AS ({reports.DIRECTORIES}) SELECT directory, pages, files, greatest(pages, files) AS most FROM t WHERE level = 2 ORDER BY most DESC, directory")
def directory_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of two levels, those with most pages or files first."""
    d = reports.baseline_directories(spark, sf_dir).where("level = 2")
    return d.select("directory", "pages", "files", F.greatest("pages", "files").alias("most")).orderBy(F.col("most").desc(), "directory")


@register(f"{WALK}, r AS (SELECT scope, node, depth, row_number() OVER (PARTITION BY scope ORDER BY depth, node) AS place FROM best WHERE depth <= 1) SELECT * FROM r WHERE place <= {TOP}")
def section_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pages that a walk of each site meets: those at depth 1 at most, by depth and URL."""
    met = graph.traverse(views.page_graph(spark, sf_dir), views.page_seeds(spark, sf_dir), 1).select("scope", "node", "depth")
    return met.withColumn("place", F.row_number().over(Window.partitionBy("scope").orderBy("depth", "node"))).where(F.col("place") <= TOP)
