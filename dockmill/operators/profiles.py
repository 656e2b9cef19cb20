"""What is known of each judge: every breakdown of a profile from one pass over the rows, leaderboards and comparisons.

``judged`` has one row for each judge and case: judge, case_id, court, year, decided, outcome
(normalised), won, subclass, nature, concepts (canonical names), represented (as written), country;
``display_name`` is optional. A row becomes its pairs of section and key, which are counted with
map-side combining, so a judge with a third of all cases is a few rows a task when they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockmill.functions import vocabulary as v
from dockmill.functions.cases import court_type, lift, rate, representation, text
from dockmill.sources.shared import cut

#: Sections of a profile: how many keys of each are told, None for all.
SECTIONS = {"all": None, "outcome": None, "court": None, "year": None, "visa": None, "nature": None, "concept": 30, "representation": None, "country": 20}
RECENT_YEARS, RECENT_CASES = 3, 10
FEWEST, MOST = 2, 4


def counts_by_section(judged: DataFrame, sections: tuple[str, ...] = (*SECTIONS,)) -> DataFrame:
    """(judge, section, key, total, wins): every breakdown of ``sections`` at once; empty keys and years of 0 are left out of theirs. Columns of others need not be there."""

    def pair(section: str, key: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"))

    single = {
        "all": F.lit("all"), "outcome": F.col("outcome"), "court": F.col("court"), "year": F.when(F.col("year") != 0, F.col("year")), "visa": F.col("subclass"),
        "nature": F.col("nature"), "representation": F.nullif(representation(F.col("represented")), F.lit("unknown")), "country": F.trim(text(F.col("country"))),
    }
    pairs = F.array(*(pair(s, c) for s, c in single.items() if s in sections))
    if "concept" in sections:
        pairs = F.concat(pairs, F.transform(F.coalesce("concepts", F.array().cast("array<string>")), lambda c: pair("concept", c)))
    rows = judged.select("judge", "won", F.explode(pairs).alias("x")).where(F.col("x.key") != "")
    return rows.groupBy("judge", "x.section", "x.key").agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.col("won").cast("long")), F.lit(0)).alias("wins"))


def profiles(judged: DataFrame, court_rates: DataFrame | None = None) -> DataFrame:
    """judge, section, key, rank, total, wins, win_rate, baseline, lift, delta: all breakdowns of every judge.

    Years come in order, other keys by total, then by name. ``lift`` tells a concept's rate over the
    judge's own; with ``court_rates`` (court, rate) the baseline of a court is its own rate and
    ``delta`` the judge's difference from it. ``recent`` repeats the last three years of activity.
    """
    counts = counts_by_section(judged).withColumn("win_rate", rate(F.col("wins"), F.col("total")))
    own = Window.partitionBy("judge")
    mine = F.max(F.when(F.col("section") == "all", F.col("win_rate"))).over(own)
    last = F.max(F.when(F.col("section") == "year", F.col("key").cast("int"))).over(own)
    counts = counts.withColumns({"own_rate": mine, "last_year": last})
    by_year = F.when(F.col("section") == "year", F.col("key").cast("int"))
    rank = F.row_number().over(Window.partitionBy("judge", "section").orderBy(by_year, F.desc("total"), "key"))
    most = F.coalesce(*(F.when(F.col("section") == s, n) for s, n in SECTIONS.items() if n is not None), F.lit(1 << 30))
    ranked = counts.withColumn("rank", rank).where(F.col("rank") <= most)
    if court_rates is not None:  # as many rows as there are courts
        known = F.broadcast(court_rates.select(F.col("court").alias("rated_court"), F.col("rate").alias("court_rate")))
        ranked = ranked.join(known, (F.col("section") == "court") & (F.col("key") == F.col("rated_court")), "left")
    else:
        ranked = ranked.withColumn("court_rate", F.lit(None).cast("double"))
    concept = F.col("section") == "concept"
    out = ranked.withColumns({
        "baseline": F.when(concept, F.col("own_rate")).otherwise(F.col("court_rate")),
        "lift": F.when(concept, lift(F.col("win_rate"), F.col("own_rate"))),
        "delta": F.round(F.col("win_rate") - F.col("court_rate"), 1),
    })
    recent = (F.col("section") == "year") & (F.col("key").cast("int") > F.col("last_year") - RECENT_YEARS)
    out = out.withColumn("section", F.explode(F.when(recent, F.array(F.lit("year"), F.lit("recent"))).otherwise(F.array("section"))))
    return out.select("judge", "section", "key", "rank", "total", "wins", "win_rate", "baseline", "lift", "delta")


#: What a summary tells of; a leaderboard needs no more columns of ``judged`` than these.
TOLD = ("all", "outcome", "court", "year", "visa", "representation")


def summaries(judged: DataFrame) -> DataFrame:
    """One row a judge: total, wins, approval_rate, courts, court_type, first_year, last_year, unknown_representation, outcomes (a map), primary_court, top_subclasses."""
    counts = counts_by_section(judged, TOLD)

    def of(section: str, value: Column) -> Column:
        return F.when(F.col("section") == section, value)

    year = F.col("key").cast("int")
    # a judge's courts, outcomes and subclasses are few by definition
    pairs = F.array_sort(F.collect_list(of("visa", F.struct((-F.col("total")).alias("less"), F.col("key").alias("key")))))
    out = counts.groupBy("judge").agg(
        F.max(of("all", F.col("total"))).alias("total"), F.max(of("all", F.col("wins"))).alias("wins"), F.array_sort(F.collect_set(of("court", F.col("key")))).alias("courts"),
        F.min(of("year", year)).alias("first_year"), F.max(of("year", year)).alias("last_year"), F.coalesce(F.sum(of("representation", F.col("total"))), F.lit(0)).alias("told"),
        F.map_from_entries(F.array_sort(F.collect_list(of("outcome", F.struct("key", "total"))))).alias("outcomes"),
        F.min(of("court", F.struct((-F.col("total")).alias("less"), F.col("key").alias("key"))))["key"].alias("primary_court"), pairs.alias("subclasses"),
    )
    kind = court_type(F.arrays_overlap("courts", F.array(*map(F.lit, v.TRIBUNALS))), F.arrays_overlap("courts", F.array(*map(F.lit, v.COURTS))))
    return out.select(
        "judge", "total", "wins", rate(F.col("wins"), F.col("total")).alias("approval_rate"), "courts", kind.alias("court_type"), "first_year", "last_year",
        (F.col("total") - F.col("told")).alias("unknown_representation"), "outcomes", "primary_court",
        F.transform(F.slice("subclasses", 1, 3), lambda x: F.struct(x["key"].alias("subclass"), (-x["less"]).alias("count"))).alias("top_subclasses"),
    )


ORDERS = {"cases": ["total", "approval_rate"], "approval_rate": ["approval_rate", "total"]}


def leaderboard(judged: DataFrame, *, by: str = "cases", name: str = "", min_cases: int = 1, limit: int = 50) -> DataFrame:
    """The first judges by cases, rate or name, with ``total_judges`` of all that pass; ``name`` is looked for in the name and the display name."""
    if by not in (*ORDERS, "name"):
        raise ValueError(f"by is one of {sorted([*ORDERS, 'name'])}")
    rows = judged
    if name.strip():
        want = F.lit(name.strip().lower())
        shown = F.lower(text(F.col("display_name"))) if "display_name" in judged.columns else F.lit("")
        rows = rows.where(F.contains(F.lower(F.col("judge")), want) | F.contains(shown, want))
    board = cut(summaries(rows).where(F.col("total") >= max(1, min_cases)))  # a row a judge, counted and ordered
    everyone = board.agg(F.count(F.lit(1)).alias("total_judges"))
    order = [F.lower("judge"), F.col("judge")] if by == "name" else [*(F.desc(c) for c in ORDERS[by]), F.asc("judge")]
    return board.orderBy(*order).limit(min(200, max(1, limit))).crossJoin(F.broadcast(everyone))  # one row


def compared(judged: DataFrame, names: list[str], court_rates: DataFrame | None = None) -> DataFrame:
    """Profiles of two to four different judges side by side, in the order asked; capitals don't matter, and a judge without cases has a single row."""
    asked = list(dict.fromkeys(n.strip().lower() for n in names if n.strip()))
    if not FEWEST <= len(asked) <= MOST:
        raise ValueError("name two to four judges")
    place = F.array_position(F.array(*map(F.lit, asked)), F.lower("judge")).cast("int")
    found = profiles(judged.where(F.lower("judge").isin(asked)), court_rates).withColumn("place", place)
    spark = judged.sparkSession
    wanted = spark.createDataFrame([(k + 1, n) for k, n in enumerate(asked)], "asked_place int, asked_name string")
    joined = F.broadcast(wanted).join(found, F.col("asked_place") == F.col("place"), "left")
    empty = F.col("judge").isNull()
    filled = {c: F.when(empty, value).otherwise(F.col(c)) for c, value in (("judge", F.col("asked_name")), ("section", F.lit("all")), ("key", F.lit("all")), ("total", F.lit(0)), ("wins", F.lit(0)), ("win_rate", F.lit(0.0)), ("rank", F.lit(1)))}
    return joined.withColumn("place", F.col("asked_place")).withColumns(filled).drop("asked_place", "asked_name")


def recent_cases(judged: DataFrame, n: int = RECENT_CASES) -> DataFrame:
    """The last ``n`` cases of every judge by year, date and number, ranked; Spark takes the first of each task before it shuffles, so a judge of very many cases is ``n`` rows a task."""
    order = [F.coalesce("year", F.lit(0)).desc(), F.coalesce(F.col("decided").cast("string"), F.lit("")).desc(), F.desc("case_id")]
    return judged.withColumn("rank", F.row_number().over(Window.partitionBy("judge").orderBy(*order))).where(F.col("rank") <= n)
