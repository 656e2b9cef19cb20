"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder from ``spark.checkpoint.dir``.

    A local session without that setting (tests) gets a folder of its own; on a cluster, whose
    machines share no temporary folder, the setting is required.
    """
    if spark.sparkContext.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="dockmill-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove ``path`` and what lies in it, whichever store it is in."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def partitions_for(rows: int, per_partition: int) -> int:
    """How many groups of about ``per_partition`` rows hold ``rows`` rows."""
    return max(1, -(-rows // per_partition))


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def guarded(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns that could clash with the operators' own (they begin with two underscores) renamed, and the new name of every column."""
    taken, names = {*df.columns}, {}
    for k, c in enumerate(df.columns):
        names[c] = c
        while names[c].startswith("__") or (names[c] != c and names[c] in taken):
            names[c] = f"column{k}{names[c]}"
    return df.toDF(*names.values()), names


#: Rows of a key and a hash (some 50 bytes each in memory) that may be broadcast; beyond it Spark joins by shuffle.
BROADCAST_KEYS = 500_000


def keep_rows(df: DataFrame, found: DataFrame, id_col: str, key: Column) -> DataFrame:
    """The rows of ``df`` that ``found`` keeps, with their columns.

    ``found`` has doc_id, key and kept, one row for each row of ``df``, where ``key`` tells rows of
    one id apart. Of rows with equal id and key one stays if any of them is kept. Whole rows are
    shuffled only if more than ``BROADCAST_KEYS`` keys go; ids and keys that stay are never joined.
    """
    keys = found.groupBy("doc_id", "key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    odd = cut(keys.where(~F.col("kept") | (F.col("n") > 1)).select(F.col("doc_id").alias("__id"), F.col("key").alias("__other"), "kept"))
    sizes = {r.kept: r["count"] for r in odd.groupBy("kept").count().collect()}
    columns, rows = df.columns, df.withColumn("key of this row", key)
    if any(c.startswith("__") for c in columns):
        rows, names = guarded(rows)
        id_col = names[id_col]
    rows = rows.withColumnRenamed("key of this row", "__key")

    def side(kept: bool) -> tuple[DataFrame, Column]:
        part = odd.where(F.col("kept") == kept)
        part = F.broadcast(part) if sizes.get(kept, 0) <= BROADCAST_KEYS else part
        return part, rows[id_col].eqNullSafe(part["__id"]) & (rows["__key"] == part["__other"])

    if sizes.get(False):
        rows = rows.join(*side(False), "left_anti")
    if sizes.get(True):
        repeated = rows.join(*side(True), "left_semi").dropDuplicates([id_col, "__key"])
        rows = rows.join(*side(True), "left_anti").unionByName(repeated)
    return rows.drop("__key").toDF(*columns)


#: Rows of one key from which on the key is no longer left to a single task.
HOT_ROWS = 1000


def hot_rows(rows: int) -> int:
    """From how many rows on a key is hot, so that at most ``BROADCAST_KEYS`` of ``rows`` rows' keys are."""
    return max(HOT_ROWS, rows // BROADCAST_KEYS)


def join_counted(rows: DataFrame, one: DataFrame, keys: list[str], count_col: str) -> DataFrame:
    """``rows`` joined with ``one``, which has a row for each key and tells in ``count_col`` how many rows have it.

    Hot keys, at most ``BROADCAST_KEYS``, are broadcast, so their rows stay where they are; the rest is shuffled.
    """
    one = cut(one)
    total = one.agg(F.sum(count_col)).first()[0] or 0
    hot = F.col(count_col) > hot_rows(total)
    often = cut(one.where(hot))
    if often.isEmpty():
        return rows.join(one, keys)
    rest = rows.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(one.where(~hot), keys)
    return rows.join(F.broadcast(often), keys).unionByName(rest)


def gaps(values: list) -> Iterator[int]:
    """Positions of None, found at the speed of ``list.index``."""
    k = -1
    try:
        while True:
            k = values.index(None, k + 1)
            yield k
    except ValueError:
        return


#: Rows and bytes of whole texts that go to a Python worker at once. Spark's own number of rows is meant for short ones.
TEXT_ROWS, TEXT_BYTES = 500, 32 << 20
ARROW_ROWS, ARROW_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with this session's Arrow batches held to ``TEXT_ROWS`` rows and ``TEXT_BYTES``, so that a worker's memory stays bounded.

    Both are settings of the session, which Spark reads when it plans; smaller ones of the caller stay.
    """
    conf = df.sparkSession.conf
    for name, most in ((ARROW_ROWS, TEXT_ROWS), (ARROW_BYTES, TEXT_BYTES)):
        now = conf.get(name, None)
        number = int(str(now).lower().removesuffix("b")) if now is not None and str(now).lower().removesuffix("b").lstrip("-").isdigit() else None
        if number is None or number <= 0 or number > most:
            conf.set(name, str(most))
    return df


class Remembered:
    """A bounded cache of two generations: what was not asked for since the last change goes."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most // 2, {}, {}

    def get(self, key: str):
        if (value := self.young.get(key)) is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key: str, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value
