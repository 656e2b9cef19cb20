"""Reports on extraction and agreement, and further statistics over counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockmill.functions.cases import rate


def against_baseline(now: DataFrame, before: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, improved, regressed, changed): values gained, lost and different from one state of the rows to the next."""
    joined = now.alias("n").join(before.alias("b"), key)
    cols = []
    for f in fields:
        new, old = (F.coalesce(F.trim(F.col(f"{s}.{f}").cast("string")), F.lit("")) for s in "nb")
        cols.append(F.struct(F.lit(f).alias("field"), ((old == "") & (new != "")).cast("long").alias("improved"), ((old != "") & (new == "")).cast("long").alias("regressed"), ((old != "") & (new != "") & (old != new)).cast("long").alias("changed")))
    return joined.select(F.explode(F.array(*cols)).alias("x")).groupBy("x.field").agg(*(F.sum(f"x.{c}").alias(c) for c in ("improved", "regressed", "changed")))


def error_summary(errors: DataFrame, dims: list[str], most: int = 10) -> DataFrame:
    """(dim, key, n): the commonest values of each dimension, from one pass."""
    pairs = F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("key")) for d in dims))
    counts = errors.select(F.explode(pairs).alias("x")).groupBy("x.dim", "x.key").agg(F.count(F.lit(1)).alias("n"))
    from dockmill.operators.analytics import top_per_group

    return top_per_group(counts, "dim", "key", most).select("dim", "key", "n")


def set_agreement(rows: DataFrame, group: str, member: str, item: str) -> DataFrame:
    """By group: how many members there are, how many items all of them have, and the mean Jaccard similarity of their pairs.

    Members are few (the voices of one council), items may be many; only counts of shared items meet in pairs.
    """
    own = rows.select(group, member, item).distinct()
    sizes = own.groupBy(group, member).agg(F.count(F.lit(1)).alias("size"))
    members = sizes.groupBy(group).agg(F.count(F.lit(1)).alias("members"))
    common = own.groupBy(group, item).agg(F.count(F.lit(1)).alias("n")).join(members, group).groupBy(group).agg(F.sum((F.col("n") == F.col("members")).cast("long")).alias("in_all"))
    a, b = (own.select(group, F.col(member).alias(n), item) for n in "ab")
    shared = a.join(b, [group, item]).where("a < b").groupBy(group, "a", "b").agg(F.count(F.lit(1)).alias("both"))
    x, y = (sizes.select(group, F.col(member).alias(n), F.col("size").alias(f"size_{n}")) for n in "ab")
    pairs = x.join(y, group).where("a < b").join(shared, [group, "a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    mean = pairs.groupBy(group).agg(F.round(F.avg(F.col("both") / (F.col("size_a") + F.col("size_b") - F.col("both"))), 6).alias("mean_jaccard"))
    return members.join(common, group).join(mean, group, "left").withColumn("mean_jaccard", F.coalesce("mean_jaccard", F.lit(1.0)))


def audit_scores(scores: DataFrame, group: str, score: str) -> DataFrame:
    """Mean score and the shares of at least 4 and at least 3, by group."""
    n = F.count(F.lit(1))
    return scores.groupBy(group).agg(n.alias("n"), F.round(F.avg(score), 2).alias("mean"), *(rate(F.sum((F.col(score) >= k).cast("long")), n).alias(f"share_{k}") for k in (4, 3)))


def series_shape(rates: DataFrame, key: str, year: str = "year", value: str = "win_rate") -> DataFrame:
    """Least, greatest, unweighted mean and last less first of each key's yearly values."""
    return rates.groupBy(key).agg(F.min(value).alias("least"), F.max(value).alias("greatest"), F.round(F.avg(value), 1).alias("mean"), F.round(F.max_by(value, year) - F.min_by(value, year), 1).alias("change"))


def row_percent(matrix: DataFrame, row: str, value: str = "n") -> DataFrame:
    """A matrix in long form with each cell's share of its row, and the greatest cell of all beside it."""
    totals = matrix.groupBy(row).agg(F.sum(value).alias("__total"))
    most = matrix.agg(F.max(value).alias("greatest"))
    return matrix.join(totals, row).crossJoin(F.broadcast(most)).withColumn("percent", rate(F.col(value), F.col("__total"))).drop("__total")  # one row


def precedent_scores(cases: DataFrame, question: str, fields: list[str], bonus: list[str]) -> DataFrame:
    """``cases`` with how many words of the question (three signs and more) occur in their fields, and one for each bonus field that isn't empty."""
    words = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in question.lower()).split() if len(w) >= 3]
    if not words:
        return cases.withColumn("score", F.lit(0))
    hay = F.concat_ws(" | ", *(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields))
    parts = [F.contains(hay, F.lit(w)).cast("int") for w in words] + [(F.coalesce(F.col(b).cast("string"), F.lit("")) != "").cast("int") for b in bonus]
    return cases.withColumn("score", reduce(lambda a, b: a + b, parts)).where("score > 0")
