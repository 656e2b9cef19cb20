"""Aggregates over cases. Every function takes and returns DataFrames and leaves the plan to Spark.

Cases have case_id, court, year, decided, outcome, won, nature, subclass, country; not all of them
are needed by each function. Counts are longs; rates are percentages to one decimal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockmill.functions import vocabulary as v
from dockmill.functions.cases import confidence, lift, rate, split_concepts


def success(cases: DataFrame, *keys: str | Column) -> DataFrame:
    """total, wins, win_rate by ``keys``; one partial aggregate before the shuffle."""
    return cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.col("won").cast("long")), F.lit(0)).alias("wins")).withColumn("win_rate", rate(F.col("wins"), F.col("total")))


def success_summary(cases: DataFrame, groups: Column) -> DataFrame:
    """Success by group of bodies, with losses and a confidence class."""
    return success(cases, groups.alias("court_group")).withColumns({"losses": F.col("total") - F.col("wins"), "confidence": confidence(F.col("total"))})


def filter_cases(cases: DataFrame, *, courts: list[str] | None = None, year_from: int = 0, year_to: int = 0, natures: list[str] | None = None, subclasses: list[str] | None = None, outcomes: list[str] | None = None) -> DataFrame:
    """The analytics filter: every given condition holds; a year bound leaves out year 0."""
    tests = []
    if courts:
        tests.append(F.col("court").isin(courts))
    if year_from or year_to:
        tests.append(F.col("year") > 0)
    if year_from:
        tests.append(F.col("year") >= year_from)
    if year_to:
        tests.append(F.col("year") <= year_to)
    if natures:
        tests.append(F.lower(F.trim("nature")).isin([n.strip().lower() for n in natures]))
    if subclasses:
        tests.append(F.col("subclass").isin(subclasses))
    if outcomes:
        tests.append(F.lower("outcome").isin([o.lower() for o in outcomes]))
    return reduce(lambda df, t: df.where(t), tests, cases)


def long_counts(cases: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """(dim, key, n) of several dimensions in one pass over the rows."""
    pairs = F.array(*(F.struct(F.lit(d).alias("dim"), c.cast("string").alias("key")) for d, c in dims.items()))
    return cases.select(F.explode(pairs).alias("x")).where("x.key is not null").groupBy("x.dim", "x.key").agg(F.count(F.lit(1)).alias("n"))


def grouping_stats(cases: DataFrame) -> DataFrame:
    """Dashboard counts by court, year, nature and subclass, and the total, by grouping sets."""
    sets = cases.groupingSets([["court"], ["year"], ["nature"], ["subclass"], []], "court", "year", "nature", "subclass").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    dim = F.when(F.col("g") == 0b0111, "court").when(F.col("g") == 0b1011, "year").when(F.col("g") == 0b1101, "nature").when(F.col("g") == 0b1110, "subclass").otherwise("total")
    return sets.select(dim.alias("dim"), F.coalesce("court", F.col("year").cast("string"), "nature", "subclass", F.lit("")).alias("key"), "n")


def top(df: DataFrame, n: int, by: str = "total", *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(n)


def matrix_long(cases: DataFrame, row: str, column: str, rows: int) -> DataFrame:
    """Counts of every pair of the ``rows`` commonest row values and all column values, zeros included."""
    counts = cases.groupBy(F.col(row).alias("row_key"), F.col(column).alias("column_key")).agg(F.count(F.lit(1)).alias("n"))
    kept = top(counts.groupBy("row_key").agg(F.sum("n").alias("total")), rows, "total", "row_key").select("row_key")
    grid = kept.crossJoin(counts.select("column_key").distinct())  # at most rows x labels, both few by definition
    return grid.join(counts, ["row_key", "column_key"], "left").select("row_key", "column_key", F.coalesce("n", F.lit(0)).alias("n"))


def pivot_years(cases: DataFrame, courts: list[str]) -> DataFrame:
    """One row a year, one column a court; the courts are given, so no extra pass finds them."""
    return cases.where("year > 0").groupBy("year").pivot("court", courts).count().na.fill(0, courts)


def unpivot_years(wide: DataFrame, courts: list[str]) -> DataFrame:
    """(year, court, n) of a wide table, positive counts only."""
    return wide.unpivot(["year"], courts, "court", "n").where("n > 0")


def flow_links(cases: DataFrame, top_n: int = 8, top_outcomes: int | None = None) -> DataFrame:
    """Links court to nature to outcome; natures and outcomes beyond the ``top_n`` (``top_outcomes``) commonest are put together."""
    counts = cases.groupBy("court", F.when(F.col("nature") == "", "Unknown").otherwise(F.coalesce("nature", F.lit("Unknown"))).alias("nature"), "outcome").agg(F.count(F.lit(1)).alias("n"))
    natures = top(counts.groupBy("nature").agg(F.sum("n").alias("total")), top_n, "total", "nature").select(F.col("nature").alias("kept_nature"))
    outcomes = top(counts.groupBy("outcome").agg(F.sum("n").alias("total")), top_outcomes or top_n, "total", "outcome").select(F.col("outcome").alias("kept_outcome"))
    # both sides are at most top_n rows
    named = counts.join(F.broadcast(natures), F.col("nature") == F.col("kept_nature"), "left").join(F.broadcast(outcomes), F.col("outcome") == F.col("kept_outcome"), "left")
    named = named.select("court", F.coalesce("kept_nature", F.lit("Other Nature")).alias("nature"), F.coalesce("kept_outcome", F.lit("Other")).alias("outcome"), "n")
    first = named.groupBy(F.lit(0).alias("layer"), F.col("court").alias("source"), F.col("nature").alias("target")).agg(F.sum("n").alias("n"))
    return first.unionByName(named.groupBy(F.lit(1).alias("layer"), F.col("nature").alias("source"), F.col("outcome").alias("target")).agg(F.sum("n").alias("n")))


def with_concepts(cases: DataFrame, raw: DataFrame, known: dict[str, str]) -> DataFrame:
    """One row per case and canonical concept."""
    exploded = raw.select("case_id", F.explode(split_concepts(F.col("concepts_raw"), known)).alias("concept"))
    return cases.join(exploded, "case_id")


def concept_effect(cases: DataFrame, tagged: DataFrame, limit: int = 30) -> DataFrame:
    """Success and lift of the commonest concepts against all cases."""
    overall = cases.agg(rate(F.sum(F.col("won").cast("long")), F.count(F.lit(1))).alias("overall"))
    return top(success(tagged, "concept"), limit, "total", "concept").crossJoin(F.broadcast(overall)).select("concept", "total", "wins", "win_rate", lift(F.col("win_rate"), F.col("overall")).alias("lift"))


def concept_combinations(tagged: DataFrame, size: int, *, most: int | None = None, top_concepts: int = 15, least: int = 2) -> DataFrame:
    """Sets of two or three of the ``top_concepts`` commonest concepts that cases hold, with success; with ``most``, only a case's first such by name count."""
    top_names = top(tagged.groupBy("concept").agg(F.count(F.lit(1)).alias("n")), top_concepts, "n", "concept").select("concept")
    lists = tagged.join(F.broadcast(top_names), "concept").groupBy("case_id").agg(F.sort_array(F.collect_set("concept")).alias("c"), F.max("won").alias("won"))  # at most 30 names by the limit's range
    lists = lists if most is None else lists.withColumn("c", F.slice("c", 1, most))
    pairs = F.flatten(F.transform("c", lambda a: F.transform(F.filter("c", lambda b: b > a), lambda b: F.array(a, b))))
    if size == 3:
        pairs = F.flatten(F.transform(pairs, lambda p: F.transform(F.filter("c", lambda x: x > p[1]), lambda x: F.concat(p, F.array(x)))))
    found = success(lists.select("won", F.explode(pairs).alias("set")), "set").where(F.col("total") >= least)
    return found.select(*(F.col("set")[k].alias(f"concept_{'abc'[k]}") for k in range(size)), "total", "wins", "win_rate")


def with_lift(rates: DataFrame, cases: DataFrame) -> DataFrame:
    """``rates`` with the lift of win_rate over that of all cases."""
    overall = cases.agg(rate(F.sum(F.col("won").cast("long")), F.count(F.lit(1))).alias("overall"))
    return rates.crossJoin(F.broadcast(overall)).withColumn("lift", lift(F.col("win_rate"), F.col("overall"))).drop("overall")  # one row


def concept_growth(tagged: DataFrame, last_year: int) -> DataFrame:
    """Cases of the last two years against those of the two before, in percent; without history 100."""
    recent = F.sum(F.when(F.col("year").between(last_year - 1, last_year), 1).otherwise(0))
    before = F.sum(F.when(F.col("year").between(last_year - 3, last_year - 2), 1).otherwise(0))
    counts = tagged.groupBy("concept").agg(recent.alias("recent"), before.alias("previous")).where("recent + previous > 0")
    growth = F.when(F.col("previous") == 0, 100.0).otherwise(F.round(F.lit(100.0) * (F.col("recent") - F.col("previous")) / F.col("previous"), 1))
    return counts.withColumn("growth", growth).withColumn("trend", F.when(F.col("growth") > 25, "emerging").when(F.col("growth") < -25, "declining").otherwise("stable"))


def concept_effectiveness(cases: DataFrame, tagged: DataFrame, limit: int = 30) -> DataFrame:
    """concept, court, total, wins, win_rate, lift, baseline of the ``limit`` (1 to 100) commonest concepts: a row for all courts, where court is null, and one for each.

    Totals and courts come from one aggregate, of which the totals are sums.
    """
    limit = min(100, max(1, limit))
    parts = tagged.groupBy("concept", "court").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("won").cast("long")).alias("wins"))
    whole = parts.groupBy("concept").agg(F.sum("total").alias("total"), F.sum("wins").alias("wins")).withColumn("court", F.lit(None).cast("string"))
    kept = top(whole, limit, "total", "concept")
    courts = parts.where(F.coalesce("court", F.lit("")) != "").join(F.broadcast(kept.select("concept")), "concept")  # at most 100 rows
    overall = cases.agg(rate(F.sum(F.col("won").cast("long")), F.count(F.lit(1))).alias("baseline"))
    rows = kept.unionByName(courts).withColumn("win_rate", rate(F.col("wins"), F.col("total"))).crossJoin(F.broadcast(overall))
    return rows.select("concept", "court", "total", "wins", "win_rate", lift(F.col("win_rate"), F.col("baseline")).alias("lift"), "baseline")


def concept_trends(tagged: DataFrame, limit: int = 10, last_year: int | None = None) -> DataFrame:
    """concept, year, total, wins, win_rate, and the concept's growth and trend, of the ``limit`` (1 to 30) commonest concepts.

    Growth is that of the last two years up to ``last_year``, by default the last there is, as in ``concept_growth``; a concept without
    cases in the last four has neither.
    """
    limit = min(30, max(1, limit))
    yearly = success(tagged.where("year > 0"), "concept", "year")
    kept = F.broadcast(top(tagged.groupBy("concept").agg(F.count(F.lit(1)).alias("n")), limit, "n", "concept").select("concept"))  # at most 30 rows
    until = last_year or tagged.agg(F.max("year")).first()[0] or 0
    growth = concept_growth(tagged.join(kept, "concept"), until).select("concept", "growth", "trend")
    return yearly.join(kept, "concept").join(F.broadcast(growth), "concept", "left")


def outcome_trend(cases: DataFrame, least: int = 10) -> DataFrame:
    """year, total, affirmed_rate, win_rate: the share of affirmed cases and of those an applicant may call a win in any body, for years of at least ``least`` cases."""
    affirmed, won = F.col("outcome") == "Affirmed", F.col("outcome").isin(v.ANY_WINS)
    counts = cases.where("year > 0").groupBy("year").agg(F.count(F.lit(1)).alias("total"), F.count_if(affirmed).alias("a"), F.count_if(won).alias("w")).where(F.col("total") >= least)
    return counts.select("year", "total", rate(F.col("a"), F.col("total")).alias("affirmed_rate"), rate(F.col("w"), F.col("total")).alias("win_rate"))


def merged_suggestions(rows: DataFrame, key: str, *, summed: bool = False) -> DataFrame:
    """name, canonical, n of suggestions (``key``, name, canonical, n, place) that are the same: the longest name, the first canonical one, the greatest count or the sum; commonest first."""
    order = F.struct((-F.length("name")).alias("less"), "place")
    n = F.sum("n") if summed else F.max("n")
    return rows.groupBy(key).agg(F.min_by("name", order).alias("name"), F.min_by("canonical", "place").alias("canonical"), n.alias("n")).orderBy(F.desc("n"), "name").select("name", "canonical", "n")


def judge_leaderboard(judged: DataFrame, *, min_cases: int = 1, limit: int = 50, by: str = "total") -> DataFrame:
    """Success, years and commonest court of each judge; a case counts once for a judge."""
    per_court = judged.groupBy("judge", "court").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("won").cast("long")).alias("w"), F.min("year").alias("y0"), F.max("year").alias("y1"))
    board = per_court.groupBy("judge").agg(
        F.sum("n").alias("total"), F.sum("w").alias("wins"), F.min("y0").alias("first_year"), F.max("y1").alias("last_year"), F.count(F.lit(1)).alias("courts"),
        F.min(F.struct((-F.col("n")).alias("n"), "court"))["court"].alias("primary_court"),
    )
    board = board.where(F.col("total") >= min_cases).withColumn("win_rate", rate(F.col("wins"), F.col("total")))
    order = {"total": [F.desc("total"), F.asc("judge")], "rate": [F.desc("win_rate"), F.desc("total"), F.asc("judge")], "name": [F.asc("judge")]}[by]
    return board.orderBy(*order).limit(limit)


def top_per_group(counts: DataFrame, group: str, value: str, n: int = 3) -> DataFrame:
    """The ``n`` commonest values of each group, ranked."""
    w = Window.partitionBy(group).orderBy(F.desc("n"), value)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def judge_against_court(judged: DataFrame, cases: DataFrame) -> DataFrame:
    """A judge's rate in each court next to the court's own."""
    base = success(cases, "court").select("court", F.col("win_rate").alias("court_rate"))
    return success(judged, "judge", "court").join(base, "court").withColumn("delta", F.round(F.col("win_rate") - F.col("court_rate"), 1))


def with_registry(counts: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Every registry row with its count, 0 if there is none."""
    return registry.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def percent_of_total(counts: DataFrame, group: str, value: str = "n") -> DataFrame:
    return counts.withColumn("percent", rate(F.col(value), F.sum(value).over(Window.partitionBy(group))))


def peak_years(counts: DataFrame, key: str = "court") -> DataFrame:
    """Total, active years, first peak year and mean of each key."""
    best = F.min(F.struct((-F.col("n")).alias("n"), "year"))
    return counts.groupBy(key).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("active_years"), best["year"].alias("peak_year"), F.max("n").alias("peak_n"), F.round(F.avg("n"), 1).alias("per_year"))


def zero_filled(counts: DataFrame, first: int, last: int, key: str = "court") -> DataFrame:
    """A row for every key and year of the span."""
    grid = counts.select(key).distinct().select(key, F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    return grid.join(counts, [key, "year"], "left").select(key, "year", F.coalesce("n", F.lit(0)).alias("n"))


def transition_impact(counts: DataFrame, moves: DataFrame) -> DataFrame:
    """For (old, new, since): mean of the old key's two years before and of the new key's two years from ``since``, and the change in percent."""
    old = moves.join(counts, (F.col("court") == F.col("old")) & F.col("year").between(F.col("since") - 2, F.col("since") - 1), "left").groupBy("old", "new", "since").agg(F.avg("n").alias("before"))
    new = moves.join(counts, (F.col("court") == F.col("new")) & F.col("year").between(F.col("since"), F.col("since") + 1), "left").groupBy("old", "new", "since").agg(F.avg("n").alias("after"))
    change = F.when(F.col("before") > 0, F.round(F.lit(100.0) * (F.col("after") - F.col("before")) / F.col("before"), 1))
    return old.join(new, ["old", "new", "since"]).withColumn("change", change)


def has_all(c: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), c)) == 0


def has_any(c: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(c, F.array(*map(F.lit, wanted)))
