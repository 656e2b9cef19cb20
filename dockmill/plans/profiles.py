"""Queries of judges' profiles, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockmill.functions.vocabulary import CONTEXT_RULES
from dockmill.operators import analytics as a
from dockmill.operators import likeness, profiles
from dockmill.plans.analytics import lift_sql, tagged
from dockmill.sources.cases import CASES_SQL, CONCEPTS_SQL, JUDGES_SQL, analogue_cases, analogue_judges, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


REPRESENTED = "CASE case_id % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN ' SELF ' WHEN 3 THEN 'unknown' ELSE '' END"


def judged(spark, d) -> DataFrame:
    """Analogue cases with their judges, concepts and representation; every case is written once, however many judges it has."""
    cases = analogue_cases(spark, d)
    concepts = tagged(spark, d).groupBy("case_id").agg(F.collect_set("concept").alias("concepts"))
    cases = cases.join(concepts, "case_id", "left").withColumn("represented", F.expr(REPRESENTED))
    return cases.join(analogue_judges(spark, d), "case_id")


ROWS_SQL = f"""{CASES_SQL}, {JUDGES_SQL}, {CONCEPTS_SQL}, j AS (SELECT judge, cases.*, {REPRESENTED} AS represented FROM cases JOIN judges USING (case_id)),
pairs AS (SELECT judge, won, 'all' AS section, 'all' AS key FROM j UNION ALL SELECT judge, won, 'outcome', outcome FROM j UNION ALL SELECT judge, won, 'court', court FROM j UNION ALL SELECT judge, won, 'year', CAST(year AS VARCHAR) FROM j
UNION ALL SELECT judge, won, 'visa', subclass FROM j UNION ALL SELECT judge, won, 'nature', nature FROM j UNION ALL SELECT judge, won, 'country', country FROM j UNION ALL SELECT judge, won, 'concept', concept FROM j JOIN concepts USING (case_id)
UNION ALL SELECT judge, won, 'representation', CASE represented WHEN 'Yes' THEN 'represented' WHEN 'no' THEN 'self_represented' WHEN ' SELF ' THEN 'self_represented' END FROM j),
g AS (SELECT judge, section, key, count(*) AS total, CAST(sum(CAST(won AS INTEGER)) AS BIGINT) AS wins, round(100.0 * sum(CAST(won AS INTEGER)) / count(*), 1) AS win_rate FROM pairs WHERE key IS NOT NULL GROUP BY 1, 2, 3)"""


@query(f"""WITH {ROWS_SQL}, b AS (SELECT court, round(100.0 * sum(CAST(won AS INTEGER)) / count(*), 1) AS court_rate FROM cases GROUP BY 1),
o AS (SELECT judge, max(win_rate) FILTER (section = 'all') AS own_rate, max(TRY_CAST(key AS INTEGER)) FILTER (section = 'year') AS last_year FROM g GROUP BY 1),
r AS (SELECT g.*, own_rate, last_year, court_rate, row_number() OVER (PARTITION BY judge, section ORDER BY CASE WHEN section = 'year' THEN TRY_CAST(key AS INTEGER) END, total DESC, key) AS rank FROM g JOIN o USING (judge) LEFT JOIN b ON section = 'court' AND key = court),
k AS (SELECT * FROM r WHERE rank <= CASE section WHEN 'concept' THEN 30 WHEN 'country' THEN 20 ELSE 1000000 END)
SELECT judge, section, key, CAST(rank AS INTEGER) AS rank, total, wins, win_rate, CASE WHEN section = 'concept' THEN own_rate ELSE court_rate END AS baseline,
CASE WHEN section = 'concept' THEN CASE WHEN own_rate > 0 THEN {lift_sql('win_rate', 'own_rate')} ELSE 0.0 END END AS lift, round(win_rate - court_rate, 1) AS delta FROM k
UNION ALL SELECT judge, 'recent', key, CAST(rank AS INTEGER), total, wins, win_rate, NULL, NULL, NULL FROM k WHERE section = 'year' AND TRY_CAST(key AS INTEGER) > last_year - 3""")
def judge_breakdowns(spark, d):
    rates = a.success(analogue_cases(spark, d), "court").select("court", F.col("win_rate").alias("rate"))
    return profiles.profiles(judged(spark, d), rates)


@query(f"""WITH {ROWS_SQL}, t AS (SELECT judge, total, wins, win_rate FROM g WHERE section = 'all'), n AS (SELECT * FROM t WHERE total >= 5 AND contains(lower(judge), '1')),
c AS (SELECT judge, key, row_number() OVER (PARTITION BY judge ORDER BY total DESC, key) AS k FROM g WHERE section = 'court'),
s AS (SELECT judge, array_to_string(list(key || ':' || total ORDER BY key), '|') AS outcomes FROM g WHERE section = 'outcome' GROUP BY 1),
v AS (SELECT judge, array_to_string(list(key || ':' || total ORDER BY total DESC, key)[:3], '|') AS top_subclasses FROM g WHERE section = 'visa' GROUP BY 1),
y AS (SELECT judge, min(TRY_CAST(key AS INTEGER)) AS first_year, max(TRY_CAST(key AS INTEGER)) AS last_year FROM g WHERE section = 'year' GROUP BY 1),
u AS (SELECT judge, count(*) FILTER (case_id % 5 > 2) AS unknown_representation FROM j GROUP BY 1)
SELECT judge, total, wins, win_rate AS approval_rate, first_year, last_year, unknown_representation, c.key AS primary_court, outcomes, top_subclasses, (SELECT count(*) FROM n) AS total_judges
FROM n JOIN c USING (judge) JOIN s USING (judge) JOIN v USING (judge) JOIN y USING (judge) JOIN u USING (judge) WHERE k = 1 ORDER BY win_rate DESC, total DESC, judge LIMIT 30""")
def judge_board(spark, d):
    cases = analogue_cases(spark, d).withColumn("represented", F.expr(REPRESENTED))  # a board tells nothing of concepts
    board = profiles.leaderboard(cases.join(analogue_judges(spark, d), "case_id"), by="approval_rate", name="1", min_cases=5, limit=30)
    outcomes = F.array_join(F.transform(F.map_entries("outcomes"), lambda x: F.concat_ws(":", x["key"], x["value"])), "|")
    top = F.array_join(F.transform("top_subclasses", lambda x: F.concat_ws(":", x["subclass"], x["count"])), "|")
    return board.select("judge", "total", "wins", "approval_rate", "first_year", "last_year", "unknown_representation", "primary_court", outcomes.alias("outcomes"), top.alias("top_subclasses"), "total_judges")


@query(f"""WITH {CASES_SQL}, {JUDGES_SQL}, r AS (SELECT judge, case_id, year, row_number() OVER (PARTITION BY judge ORDER BY year DESC, CAST(decided AS VARCHAR) DESC, case_id DESC) AS rank FROM cases JOIN judges USING (case_id))
SELECT judge, case_id, year, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def judge_recent_cases(spark, d):
    rows = analogue_cases(spark, d).join(analogue_judges(spark, d), "case_id")
    return profiles.recent_cases(rows).select("judge", "case_id", "year", "rank")


#: Who an order is: a surname, what else the name tells, the kind of body and the year.
WHO = {
    "surname": "CASE o_orderkey % 4 WHEN 0 THEN 'graham' WHEN 1 THEN 'murphy' WHEN 2 THEN 'downes' ELSE 'smith' END",
    "part": "CASE o_custkey % 6 WHEN 0 THEN '-' WHEN 1 THEN 'ann' WHEN 2 THEN 'j.' WHEN 3 THEN 'tegen' WHEN 4 THEN 'friedman' ELSE 'x' END",
    "court": "CASE o_custkey % 3 WHEN 0 THEN 'MRTA' WHEN 1 THEN 'FCA' ELSE 'AATA' END",
    "year": "CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 1996 + CAST(o_orderkey % 29 AS INTEGER) END",
}
RULES_SQL = "rules(surname, part, court, grp, y0, y1, priority, person) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in CONTEXT_RULES) + ")"


@query(f"""WITH {RULES_SQL}, p AS (SELECT o_orderkey, {', '.join(f'{sql} AS {c}' for c, sql in WHO.items())} FROM orders), g AS (SELECT *, CASE WHEN court = 'FCA' THEN 'court' ELSE 'tribunal' END AS grp FROM p),
f AS (SELECT o_orderkey, person, row_number() OVER (PARTITION BY o_orderkey ORDER BY r.priority, person) AS k FROM g JOIN rules r ON r.surname = g.surname AND (r.part IS NULL OR r.part = g.part) AND (r.court IS NULL OR r.court = g.court) AND (r.grp IS NULL OR r.grp = g.grp)
 AND ((r.y0 IS NULL AND r.y1 IS NULL) OR (g.year > 0 AND g.year >= coalesce(r.y0, 0) AND g.year <= coalesce(r.y1, 9999))))
SELECT g.o_orderkey, person AS resolved FROM g LEFT JOIN f ON f.o_orderkey = g.o_orderkey AND k = 1""")
def judges_in_context(spark, d):
    people = table(spark, d, "orders").selectExpr("o_orderkey", *(f"{sql} AS {c}" for c, sql in WHO.items()))
    people = people.withColumns({"parts": F.array("part"), "court_group": F.when(F.col("court") == "FCA", "court").otherwise("tribunal")})
    rules = spark.createDataFrame(CONTEXT_RULES, "surname string, part string, court string, court_group string, year_from int, year_to int, priority int, person string")
    return likeness.in_context(people, rules).select("o_orderkey", "resolved")


@query(None)
def alike_names(spark, d):
    """Words of at least six letters of the passages as names, in the order of their first passage."""
    words = table(spark, d, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"), F.lit(1))).alias("name"))
    names = words.groupBy("name").agg(F.min(F.struct("item_id", "name")).alias("place"))
    return likeness.alike_groups(names, "name", "place").select("name", "leader")
