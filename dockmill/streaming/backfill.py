"""Vectors for rows that lack them or have changed, in batches that a restart goes on with.

What is to be done is found by comparing content hashes with a ledger and written once, dealt to
numbered batches. Each batch is written as a folder of its own, which Spark commits as a whole: a
batch is done if its commit mark is there, so a job that is killed loses the batch it was at and
repeats no other. At the end the ledger is merged with the finished batches.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockmill.functions.cases import semantic_text, text

BATCH_ROWS = 50_000
VECTORS = "id string, content_hash string, provider string, model string, dims int, vector array<float>"


def content_hash(*fields: Column) -> Column:
    """SHA-256 of the text that is embedded: the fields that say something, joined."""
    return F.sha2(semantic_text(*fields), 256)


def must_embed(hash_now: Column, provider: str, model: str, *, force: bool = False) -> Column:
    """Whether a row with the columns of a ledger beside it (all null if it has none) needs a vector: always, if forced; else if there is none, or none of this text, provider and model."""
    kept = (F.size(F.coalesce("vector", F.array().cast("array<float>"))) > 0) & (F.coalesce("dims", F.lit(0)) > 0)
    same = (text(F.col("content_hash")) == hash_now) & (text(F.col("provider")) == provider) & (text(F.col("model")) == model)
    return F.lit(force) | ~(kept & same)


def pending(rows: DataFrame, ledger: DataFrame, provider: str, model: str, *, id_col: str = "id", text_col: str = "text", force: bool = False) -> DataFrame:
    """(id, text, content_hash) of the rows that need a vector; blank texts never do."""
    now = rows.select(F.col(id_col).cast("string").alias("id"), text(F.col(text_col)).alias("text")).withColumn("hash_now", content_hash(F.col("text")))
    joined = now.where(F.trim("text") != "").join(ledger, "id", "left")
    return joined.where(must_embed(F.col("hash_now"), provider, model, force=force)).select("id", "text", F.col("hash_now").alias("content_hash"))


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def committed(spark: SparkSession, path: str) -> bool:
    """Whether Spark finished writing the folder."""
    target, store = _path(spark, f"{path}/_SUCCESS")
    return store.exists(target)


def plan_batches(todo: DataFrame, folder: str, batch_rows: int = BATCH_ROWS) -> int:
    """Deal ``todo`` to batches below ``folder``/plan, once; how many there are. A plan that is there already stays as it is."""
    spark = todo.sparkSession
    if not committed(spark, f"{folder}/plan"):
        batches = max(1, -(-todo.count() // batch_rows))
        todo.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")).write.mode("overwrite").partitionBy("batch").parquet(f"{folder}/plan")
    return (spark.read.schema("id string, text string, content_hash string, batch int").parquet(f"{folder}/plan").agg(F.max("batch")).first()[0] or 0) + 1


def embed_batches(spark: SparkSession, folder: str, batches: int, embed: Callable[[pd.Series], list], provider: str, model: str, *, most: int | None = None) -> int:
    """Embed the batches that aren't done, ``most`` of them at once; how many are left."""
    plan = spark.read.schema("id string, text string, content_hash string, batch int").parquet(f"{folder}/plan")

    def run(frames):
        for part in frames:
            vectors = [[*map(float, v)] for v in embed(part["text"])]
            yield pd.DataFrame({"id": part["id"], "content_hash": part["content_hash"], "provider": provider, "model": model, "dims": [len(v) for v in vectors], "vector": vectors})

    left = [k for k in range(batches) if not committed(spark, f"{folder}/done/{k}")]
    for k in left[:most]:
        plan.where(F.col("batch") == k).mapInPandas(run, VECTORS).write.mode("overwrite").parquet(f"{folder}/done/{k}")
    return len(left) - len(left[:most])


def merged_ledger(ledger: DataFrame, folder: str, batches: int) -> DataFrame:
    """The ledger with the vectors of the finished batches in place of older ones."""
    spark = ledger.sparkSession
    done = [f"{folder}/done/{k}" for k in range(batches) if committed(spark, f"{folder}/done/{k}")]
    if not done:
        return ledger
    new = spark.read.schema(VECTORS).parquet(*done)
    return ledger.select(*new.columns).join(new.select("id"), "id", "left_anti").unionByName(new)


def backfill(rows: DataFrame, ledger: DataFrame, folder: str, embed: Callable[[pd.Series], list], *, provider: str, model: str, id_col: str = "id", text_col: str = "text", batch_rows: int = BATCH_ROWS, most: int | None = None, force: bool = False) -> tuple[DataFrame, int]:
    """The ledger brought up to date, and how many batches are left; call again with the same ``folder`` to go on.

    ``embed`` takes a pandas series of texts and gives a vector for each. The plan in ``folder`` is
    that of the first call; rows that change meanwhile are found by the next backfill, which takes a
    new folder. Ids are unique.
    """
    spark = rows.sparkSession
    batches = plan_batches(pending(rows, ledger, provider, model, id_col=id_col, text_col=text_col, force=force), folder, batch_rows)
    left = embed_batches(spark, folder, batches, embed, provider, model, most=most)
    return merged_ledger(ledger, folder, batches), left
