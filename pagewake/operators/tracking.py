"""Tracked files: documents, files and observations of a batch of captures, three linked tables that are written as one version.

Keys are digests of what identifies a row, so a batch that is run again makes the same keys. A version lies under its number and is made from the one before;
running it again overwrites it with the same rows. A capture whose attempt doesn't vouch for it is no row but a conflict, with its reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = "document_id string, url string, sha256 string, first_run bigint, last_run bigint"
FILES = "file_id string, scope_id string, url string, document_id string, sha256 string, first_run bigint, last_run bigint"
OBSERVATIONS = "observation_id string, scope_id string, run_id bigint, page_id bigint, file_id string, document_id string, url string, sha256 string, attempt_id bigint"
CONFLICTS = "attempt_id bigint, scope_id string, run_id bigint, url string, reason string"
SCHEMAS = {"documents": DOCUMENTS, "files": FILES, "observations": OBSERVATIONS, "conflicts": CONFLICTS}
UNKNOWN, OTHER_LINEAGE, NOT_ACCEPTED, OTHER_KIND = "attempt_unknown", "attempt_of_other_run", "attempt_not_accepted", "attempt_of_other_kind"


def key(*parts: str) -> Column:
    """A digest of the parts, told apart by their lengths."""
    texts = [F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("\x1f", *[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts]), 256)


def judged(captures: DataFrame, attempts: DataFrame) -> DataFrame:
    """Captures with the reason why their attempt doesn't vouch for them, null if it does.

    captures: scope_id, run_id, page_id, url, sha256, seq, attempt_id. attempts: attempt_id (unique), scope_id, run_id, kind, accepted.
    """
    a = attempts.select("attempt_id", F.col("scope_id").alias("a_scope"), F.col("run_id").alias("a_run"), "kind", "accepted", F.lit(True).alias("there"))
    reason = (
        F.when(F.col("there").isNull(), UNKNOWN)
        .when(~(F.col("a_scope").eqNullSafe(F.col("scope_id")) & F.col("a_run").eqNullSafe(F.col("run_id"))), OTHER_LINEAGE)
        .when(~F.coalesce("accepted", F.lit(False)), NOT_ACCEPTED)
        .when(~F.col("kind").eqNullSafe("document"), OTHER_KIND)
    )
    return captures.join(a, "attempt_id", "left").select(captures.columns + [reason.alias("reason")])


def _merged(rows: DataFrame, known: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Upserts: values of the latest run and capture, the first and the last run of each key. Both are reduced before they are shuffled."""
    old = known.select(*keys, *values, "first_run", "last_run", F.lit(-1).cast("bigint").alias("seq"))
    new = rows.select(*keys, *values, F.col("run_id").alias("first_run"), F.col("run_id").alias("last_run"), "seq")
    latest = F.max_by(F.struct(*values), F.struct("last_run", "seq", *values)).alias("v")
    return old.unionByName(new).groupBy(*keys).agg(latest, F.min("first_run").alias("first_run"), F.max("last_run").alias("last_run")).select(*keys, "v.*", "first_run", "last_run")


def track(captures: DataFrame, attempts: DataFrame, documents: DataFrame, files: DataFrame, observations: DataFrame) -> dict[str, DataFrame]:
    """The tables after a batch. Of captures of one file on one page in one run the last one is observed, which makes an observation idempotent."""
    told = judged(captures, attempts)
    fine = told.where("reason IS NULL").withColumns({"document_id": key("url"), "file_id": key("scope_id", "url"), "observation_id": key("scope_id", "run_id", "page_id", "url")})
    row = [c for c in observations.columns if c != "observation_id"]
    seen = fine.groupBy("observation_id").agg(F.max_by(F.struct(*row), F.struct("seq", "sha256", "attempt_id")).alias("r")).select("observation_id", "r.*")
    return {
        "documents": _merged(fine, documents, ["document_id", "url"], ["sha256"]),
        "files": _merged(fine, files, ["file_id", "scope_id", "url"], ["document_id", "sha256"]).select(files.columns),
        "observations": observations.join(seen.select("observation_id"), "observation_id", "left_anti").unionByName(seen.select(observations.columns)),
        "conflicts": told.where("reason IS NOT NULL").select("attempt_id", "scope_id", "run_id", "url", "reason"),
    }


@dataclass(frozen=True)
class Versions:
    """Versions of the tables in a shared folder: version=n/<table>."""

    folder: str

    def read(self, spark: SparkSession, number: int, name: str) -> DataFrame:
        """A table of a version; empty before the first."""
        return spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/version={number}/{name}") if number >= 0 else spark.createDataFrame([], SCHEMAS[name])

    def apply(self, captures: DataFrame, attempts: DataFrame, number: int) -> None:
        """Writes version `number` from the one before and a batch."""
        spark = captures.sparkSession
        before = [self.read(spark, number - 1, n) for n in ("documents", "files", "observations")]
        for name, rows in track(captures, attempts, *before).items():
            rows.write.mode("overwrite").parquet(f"{self.folder}/version={number}/{name}")
