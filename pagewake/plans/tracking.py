"""Queries over tracked files in versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewake.operators.tracking import Versions
from pagewake.plans.registry import register
from pagewake.sources import views
from pagewake.sources.folders import shared_folder
from pagewake.sources.views import FILES


def _versions(spark: SparkSession, sf_dir: str) -> Versions:
    """Run 1 as one batch, run 2 as the next, which is run twice. By its number an attempt isn't known, is of another run, not accepted, or a page's."""
    f = views.file_observations(spark, sf_dir)
    n = F.col("id")
    captures = f.select(F.col("site").alias("scope_id"), F.col("run_id").cast("bigint").alias("run_id"), "page_id", F.col("download_url").alias("url"), "sha256", n.alias("seq"), n.alias("attempt_id"))
    attempts = f.where(n % 13 != 0).select(n.alias("attempt_id"), F.col("site").alias("scope_id"), (F.col("run_id") + (n % 17 == 0).cast("int")).cast("bigint").alias("run_id"), F.when(n % 11 == 0, "page").otherwise("document").alias("kind"), (n % 7 != 0).alias("accepted"))
    versions = Versions(f"{shared_folder(spark)}/tracking-{uuid.uuid4().hex}")
    for number, run in ((0, 1), (1, 2), (1, 2)):
        versions.apply(captures.where(F.col("run_id") == run), attempts, number)
    return versions


_TOLD = f"""WITH {FILES}, c AS (SELECT *, CASE WHEN id % 13 = 0 THEN 'attempt_unknown' WHEN id % 17 = 0 THEN 'attempt_of_other_run' WHEN id % 7 = 0 THEN 'attempt_not_accepted' WHEN id % 11 = 0 THEN 'attempt_of_other_kind' END AS reason FROM files),
fine AS (SELECT * FROM c WHERE reason IS NULL), o AS (SELECT site, run_id, page_id, download_url, arg_max(sha256, id) AS sha256 FROM fine GROUP BY ALL)"""


@register(
    f"""{_TOLD}, n AS (SELECT site, download_url, count(*) AS n_observations FROM o GROUP BY ALL)
    SELECT f.site AS scope_id, f.download_url AS url, arg_max(f.sha256, f.run_id * 1000000000 + f.id) AS sha256, min(f.run_id) AS first_run, max(f.run_id) AS last_run, any_value(n.n_observations) AS n_observations, true AS linked
    FROM fine f JOIN n ON n.site = f.site AND n.download_url = f.download_url GROUP BY f.site, f.download_url"""
)
def tracked_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked files after both runs with the number of their observations, and whether all three tables agree."""
    v = _versions(spark, sf_dir)
    files, documents, seen = (v.read(spark, 1, n) for n in ("files", "documents", "observations"))
    per_file = seen.groupBy("file_id").agg(F.count("*").alias("n_observations"), F.count_distinct("document_id").alias("n"), F.max("document_id").alias("d"))
    x = files.join(documents.select("document_id", F.col("url").alias("document_url")), "document_id", "left").join(per_file, "file_id", "left")
    return x.select("scope_id", "url", "sha256", "first_run", "last_run", "n_observations", F.coalesce((F.col("document_url") == F.col("url")) & (F.col("n") == 1) & (F.col("d") == F.col("document_id")), F.lit(False)).alias("linked"))


@register(f"{_TOLD} SELECT run_id, reason, count(*) AS n FROM c WHERE reason IS NOT NULL GROUP BY ALL")
def tracking_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of each run that no attempt vouches for, by reason."""
    v = _versions(spark, sf_dir)
    return v.read(spark, 0, "conflicts").unionByName(v.read(spark, 1, "conflicts")).groupBy("run_id", "reason").agg(F.count("*").alias("n"))
