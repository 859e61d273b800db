"""Corpus pipeline: language, line and near duplicates, benchmark passages, tokens.

Each stage takes the documents that its predecessor kept, written as Parquet and read again, and
returns the documents it keeps, with the columns of `documents`; the last one adds the encoding.

* language: documents without a determined language go (null texts, texts without a letter).
* lines: repeated line chunks are cut from the texts; documents left without text go.
* near duplicates: one document of each group of five-word-shingle similarity 0.8 stays, the one
  with the least doc_id; of repeated rows, one.
* benchmark: documents that hold a benchmark passage go.
* tokens: byte-level BPE ids, their number and digests.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewake.llm import bpe, decontaminate, language_id, line_dedup, near_duplicates
from pagewake.llm.common import table
from pagewake.llm.queries import TOKENIZER
from pagewake.sources.folders import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts and texts without a letter go; repeated rows stay or go together; without labels the letter alone decides. Further columns pass through."""
    return language_id.determined(docs, language_id.train(docs, F.lit(True)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of one key and text count as one document; texts that are null, empty or blank afterwards go. Further columns pass through, whatever their names."""
    return line_dedup.dedup(docs).where(F.trim("text") != "").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by key and text: of repeated rows one stays, and texts without a key are copies if equal.

    Null and empty texts have no shingles and stay, once for each key. A row travels as one value, so its columns can't clash.
    """
    found = near_duplicates.find(docs, size=5, percent=80)
    told = found.groupBy("doc_id", "text_hash").agg(F.every("kept").alias("kept"), F.count("*").alias("rows")).where("NOT kept OR rows > 1").checkpoint()
    told = told.select(F.col("doc_id").alias("told_key"), F.col("text_hash").alias("told_hash"), "kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("key"), F.xxhash64("text").alias("hash"))
    same = F.col("told_key").eqNullSafe(F.col("key")) & (F.col("told_hash") == F.col("hash"))
    single = rows.join(told.hint("shuffle_hash"), same, "left_anti")
    repeated = rows.join(told.where("kept").hint("shuffle_hash"), same, "left_semi").dropDuplicates(["key", "hash"])
    return single.unionByName(repeated).select("row.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an occurrence of a benchmark window go; null and empty texts stay, and with an empty benchmark all do. Further columns pass through."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row, repeated ones too; a null text is encoded as the empty one."""
    return bpe.encode(docs, public_tokenizers.path(TOKENIZER), with_decoded=False)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_duplicates", near_dedup),
    ("decontaminate", benchmark),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}-{name}")
            docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs


#: Hashes, trained models and tokenizers have no SQL form.
ORACLE_SQL = None
