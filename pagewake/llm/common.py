"""What several of the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewake.functions.batches import pieces as pieces
from pagewake.sources.folders import shared_folder

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo `parts`; null for a null key."""
    return F.crc32(key.cast("string")).cast("long") % parts


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def written(rows: DataFrame) -> DataFrame:
    """The rows from a table of their own in the shared folder.

    As a checkpoint it cuts the lineage. Spark knows a table's size, though, and so plans joins with a
    small one without a shuffle, and reads it in as few tasks as its size asks for.
    """
    folder = f"{shared_folder(rows.sparkSession)}/table-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
