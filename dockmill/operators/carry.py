"""Values carried forward along an order, in pieces, so that a group of any length is never one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockmill.sources.shared import cut

#: Rows of piece summaries that may be broadcast; beyond, Spark joins by shuffle.
BROADCAST_PIECES = 200_000


def in_pieces(rows: DataFrame, group: list[str], order: list[str], pieces: int | None = None) -> DataFrame:
    """``rows`` dealt by ranges of group and order, each range a piece, written once; ``__piece`` rises with the order."""
    n = pieces or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(n, *group, *order).withColumn("__piece", F.spark_partition_id()))


def carried(rows: DataFrame, group: str | list[str], order: str | list[str], heading: str, out: str, pieces: int | None = None) -> DataFrame:
    """``rows`` with the last heading at or before each, in the order within its group; null before the first.

    Within a piece the value is carried by a window. What is the last of a piece goes on to the next
    ones by a scan of the pieces' summaries, one row for each group and piece. Rows of equal order
    may get each other's heading. Null groups are a group.
    """
    group, order = ([x] if isinstance(x, str) else x for x in (group, order))
    dealt = in_pieces(rows, group, order, pieces)
    here = Window.partitionBy(*group, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumn("__own", F.last(heading, ignorenulls=True).over(here))
    last = dealt.where(F.col(heading).isNotNull()).groupBy(*group, "__piece").agg(F.max_by(heading, F.struct(*order)).alias("__last"))
    every = dealt.select(*group, "__piece").distinct().alias("e")
    summary = every.join(last.alias("l"), [F.col(f"e.{c}").eqNullSafe(F.col(f"l.{c}")) for c in (*group, "__piece")], "left").select(*(f"e.{c}" for c in group), "e.__piece", "__last")
    before = Window.partitionBy(*group).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    handed = cut(summary.withColumn("__handed", F.last("__last", ignorenulls=True).over(before)).where(F.col("__handed").isNotNull()).drop("__last"))
    handed = handed.select(*(F.col(c).alias(f"__g{k}") for k, c in enumerate(group)), F.col("__piece").alias("__at"), "__handed")
    few = F.broadcast(handed) if handed.count() <= BROADCAST_PIECES else handed
    same = [F.col(c).eqNullSafe(F.col(f"__g{k}")) for k, c in enumerate(group)]
    joined = local.join(few, [*same, F.col("__piece") == F.col("__at")], "left")
    return joined.withColumn(out, F.coalesce("__own", "__handed")).drop("__own", "__handed", "__piece", "__at", *(f"__g{k}" for k in range(len(group))))
