"""Intermediate tables in the folder that a cluster's machines share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and go on from the written rows, so that it is computed once.

    A local session without that setting (tests) gets a folder of its own; a cluster needs it.
    """
    _ensure_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(df: DataFrame, rows: int = 500) -> DataFrame:
    """``df``, with this session's Arrow batches held to ``rows`` rows and 32 MB, as a worker's memory follows its batch; smaller settings stay."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20)):
        now = str(conf.get(name, None)).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df


def _ensure_folder(spark) -> None:
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="dockmill-checkpoint-"))
