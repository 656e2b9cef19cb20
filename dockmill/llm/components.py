"""Connected components by alternating stars, with lineage cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockmill.llm.common import cut, partitions_for

#: Edges that a task reads at once; it only decides how many tasks and files a round has.
EDGES = 100_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _each(df: DataFrame, *pairs: tuple[str, str], names: tuple[str, str] = ("u", "v")) -> DataFrame:
    """A row for each of the ``pairs`` of columns; unlike a union it keeps how the rows are dealt."""
    one, two = names
    return df.select(F.explode(F.array(*(F.struct(F.col(a).alias(one), F.col(b).alias(two)) for a, b in pairs))).alias("x")).select("x.*")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b); root is the smallest node reachable.

    Each round is a grouped minimum and a join on the node, never a collected neighbourhood, so a
    node with many links is split like any skewed key. The number of rounds grows with the
    logarithm of a component's width. A round's tasks and files follow the number of edges, not the
    session's number of partitions. No links give no rows; repeated links and loops change nothing.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = cut(edges)
    before, now = None, _state(edges)
    while now != before:
        before = now
        tasks = partitions_for(now[0], EDGES)
        both = _each(edges.coalesce(tasks), ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _each(large.join(below, "u").coalesce(tasks), ("v", "m"), ("u", "m")).where("u <> v")
        edges = cut(small.distinct().coalesce(tasks))
        now = _state(edges)
    return _each(edges.coalesce(partitions_for(now[0], EDGES)), ("u", "v"), ("v", "v"), names=("node", "root")).distinct()
