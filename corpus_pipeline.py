"""The corpus pipeline: language filter, exact and near deduplication, masking, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from dockmill.llm import exact_dedup, language, near_jaccard, packing, pii
from dockmill.llm.common import ensure_checkpoint_dir, remove_folder, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language."""
    return language.keep_known_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles of similarity 0.8 link."""
    return near_jaccard.drop_near_copies(docs)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.mask_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.pack_documents(docs, packing.default_vocabulary())


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("pii", mask), ("packing", pack)]
#: Several stages can't be put in SQL; the tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet in the shared folder before the next reads it.

    Null texts and blank ones have no language and go in the first stage; repeated rows and copies
    leave one row; an empty table gives no rows; further columns are carried up to the last stage.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, before)  # what comes next reads this stage alone
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
