"""Analytics queries over the analogue cases, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from dockmill.operators import analytics as a
from dockmill.sources.cases import ANALOGUE_CONCEPTS, ANALOGUE_TRIBUNALS, CASES_SQL, CONCEPTS_SQL, JUDGES_SQL, analogue_cases, analogue_concept_text, analogue_judges, table

QUERIES, ORACLE_SQL = {}, {}
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def lift_sql(share: str, overall: str) -> str:
    """The quotient of two rates of one decimal to two decimals, halves up, in whole numbers: of doubles, 32.8 / 32.0 = 1.025 is rounded down."""
    a, b = (f"CAST(round(10 * ({x})) AS BIGINT)" for x in (share, overall))
    return f"CAST((200 * {a} + {b}) // (2 * {b}) / 100.0 AS DOUBLE)"


RATE = "CASE WHEN total > 0 THEN round(100.0 * wins / total, 1) ELSE 0.0 END"
SUMS = "count(*) AS total, CAST(sum(CAST(won AS INTEGER)) AS BIGINT) AS wins"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def tagged(spark, d):
    return a.with_concepts(analogue_cases(spark, d), analogue_concept_text(spark, d), ANALOGUE_CONCEPTS)


def judged(spark, d):
    return analogue_cases(spark, d).join(analogue_judges(spark, d), "case_id")


def court_years(spark, d):
    return analogue_cases(spark, d).where("year > 0").groupBy("court", "year").agg(F.count(F.lit(1)).alias("n"))


YEARS_SQL = f"WITH {CASES_SQL}, years AS (SELECT court, year, count(*) AS n FROM cases WHERE year > 0 GROUP BY 1, 2)"


@query(f"""WITH {CASES_SQL}, g AS (SELECT CASE WHEN court IN ('AFRICA', 'ASIA') THEN 'tribunal' ELSE 'court' END AS court_group, {SUMS} FROM cases GROUP BY 1)
SELECT court_group, total, wins, {RATE} AS win_rate, total - wins AS losses, CASE WHEN total > 100 THEN 'high' WHEN total >= 20 THEN 'medium' ELSE 'low' END AS confidence FROM g""")
def success_rate_by_court_group(spark, d):
    return a.success_summary(analogue_cases(spark, d), F.when(F.col("court").isin(ANALOGUE_TRIBUNALS), "tribunal").otherwise("court"))


@query(f"WITH {CASES_SQL}, g AS (SELECT court, year, {SUMS} FROM cases GROUP BY 1, 2) SELECT court, year, total, wins, {RATE} AS win_rate FROM g")
def success_by_court_year(spark, d):
    return a.success(analogue_cases(spark, d), "court", "year")


@query(f"""WITH {CASES_SQL}, f AS (SELECT * FROM cases WHERE court IN ('ASIA', 'EUROPE') AND year BETWEEN 1996 AND 1999 AND lower(nature) IN ('building', 'machinery') AND subclass <> '5-LOW' AND subclass IN ('1-URGENT', '2-HIGH')),
g AS (SELECT nature, {SUMS} FROM f GROUP BY 1) SELECT nature, total, wins, {RATE} AS win_rate FROM g""")
def filtered_success(spark, d):
    kept = a.filter_cases(analogue_cases(spark, d), courts=["ASIA", "EUROPE"], year_from=1996, year_to=1999, natures=["Building", " machinery "], subclasses=["1-URGENT", "2-HIGH"])
    return a.success(kept, "nature")


@query(f"""WITH {CASES_SQL}
SELECT 'court' AS dim, court || '|' || outcome AS key, count(*) AS n FROM cases GROUP BY 2 UNION ALL
SELECT 'year', CAST(year AS VARCHAR) || '|' || outcome, count(*) FROM cases WHERE year > 0 GROUP BY 2 UNION ALL
SELECT 'subclass', subclass || '|' || outcome, count(*) FROM cases GROUP BY 2""")
def outcome_counts_long(spark, d):
    def by(c):
        return F.concat_ws("|", F.col(c).cast("string"), "outcome")

    return a.long_counts(analogue_cases(spark, d), {"court": by("court"), "year": F.when(F.col("year") > 0, by("year")), "subclass": by("subclass")})


@query(YEARS_SQL + " SELECT court, year, n FROM years")
def court_year_trends(spark, d):
    return court_years(spark, d)


@query(f"""WITH {CASES_SQL} SELECT year, {", ".join(f'count(*) FILTER (court = {chr(39)}{r}{chr(39)}) AS "{r}"' for r in REGIONS)} FROM cases WHERE year > 0 GROUP BY year""")
def court_year_pivot(spark, d):
    return a.pivot_years(analogue_cases(spark, d), REGIONS)


@query(YEARS_SQL + " SELECT year, court, n FROM years WHERE n > 0")
def court_year_unpivot(spark, d):
    return a.unpivot_years(a.pivot_years(analogue_cases(spark, d), REGIONS), REGIONS)


@query(f"""WITH {CASES_SQL}
SELECT 'court' AS dim, court AS key, count(*) AS n FROM cases GROUP BY 2 UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*) FROM cases GROUP BY 2 UNION ALL
SELECT 'nature', nature, count(*) FROM cases GROUP BY 2 UNION ALL SELECT 'subclass', subclass, count(*) FROM cases GROUP BY 2 UNION ALL SELECT 'total', '', count(*) FROM cases""")
def dashboard_stats_long(spark, d):
    return a.grouping_stats(analogue_cases(spark, d))


@query(f"""WITH {CASES_SQL}, c AS (SELECT nature, outcome, count(*) AS n FROM cases GROUP BY 1, 2), t AS (SELECT nature, sum(n) AS t FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4)
SELECT t.nature AS row_key, o.outcome AS column_key, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM t CROSS JOIN (SELECT DISTINCT outcome FROM c) o LEFT JOIN c ON c.nature = t.nature AND c.outcome = o.outcome""")
def nature_outcome_matrix_long(spark, d):
    return a.matrix_long(analogue_cases(spark, d), "nature", "outcome", 4)


@query(f"WITH {CASES_SQL}, g AS (SELECT strftime(decided, '%Y-%m') AS month, {SUMS} FROM cases GROUP BY 1) SELECT month, total, wins, {RATE} AS win_rate FROM g")
def monthly_trends(spark, d):
    return a.success(analogue_cases(spark, d), F.date_format("decided", "yyyy-MM").alias("month"))


@query("""WITH c AS (SELECT p_brand AS family, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25 GROUP BY 1)
SELECT f.family, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT p_brand AS family FROM part) f LEFT JOIN c USING (family)""")
def registry_counts(spark, d):
    part = table(spark, d, "part")
    counts = table(spark, d, "lineitem").join(part.where("p_size > 25"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("family")).agg(F.count(F.lit(1)).alias("n"))
    return a.with_registry(counts, part.select(F.col("p_brand").alias("family")).distinct(), "family")


@query("""WITH r AS (SELECT o_orderstatus = 'F' AS won, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT p_type AS family, count(*) AS total, CAST(sum(CAST(won AS INTEGER)) AS BIGINT) AS wins FROM r JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT family, total, wins, """ + RATE + " AS win_rate FROM g")
def family_rates(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return a.success(lines.select(F.col("p_type").alias("family"), (F.col("o_orderstatus") == "F").alias("won")), "family")


@query(f"WITH {CASES_SQL} SELECT country, count(*) AS total FROM cases GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def country_topn(spark, d):
    return a.top(analogue_cases(spark, d).groupBy("country").agg(F.count(F.lit(1)).alias("total")), 10, "total", "country")


@query(f"""WITH {CASES_SQL}, n AS (SELECT nature, count(*) AS t FROM cases GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3), o AS (SELECT outcome, count(*) AS t FROM cases GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2),
m AS (SELECT court, CASE WHEN nature IN (SELECT nature FROM n) THEN nature ELSE 'Other Nature' END AS nature, CASE WHEN outcome IN (SELECT outcome FROM o) THEN outcome ELSE 'Other' END AS outcome FROM cases)
SELECT 0 AS layer, court AS source, nature AS target, count(*) AS n FROM m GROUP BY 2, 3 UNION ALL SELECT 1, nature, outcome, count(*) FROM m GROUP BY 2, 3""")
def flow_links(spark, d):
    return a.flow_links(analogue_cases(spark, d), 3, 2)


@query(f"WITH {CASES_SQL}, {CONCEPTS_SQL} SELECT concept, count(*) AS total FROM cases JOIN concepts USING (case_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def concept_topn(spark, d):
    return a.top(tagged(spark, d).groupBy("concept").agg(F.count(F.lit(1)).alias("total")), 3, "total", "concept")


@query(f"""WITH {CASES_SQL}, {CONCEPTS_SQL}, b AS (SELECT round(100.0 * sum(CAST(won AS INTEGER)) / count(*), 1) AS overall FROM cases), g AS (SELECT concept, {SUMS} FROM cases JOIN concepts USING (case_id) GROUP BY 1)
SELECT concept, total, wins, {RATE} AS win_rate, {lift_sql(RATE, 'overall')} AS lift FROM g CROSS JOIN b""")
def concept_lift(spark, d):
    return a.concept_effect(analogue_cases(spark, d), tagged(spark, d))


@query(f"WITH {CASES_SQL}, {CONCEPTS_SQL}, g AS (SELECT concept, court, {SUMS} FROM cases JOIN concepts USING (case_id) GROUP BY 1, 2) SELECT concept, court, total, wins, {RATE} AS win_rate FROM g")
def concept_by_court(spark, d):
    return a.success(tagged(spark, d), "concept", "court")


@query(f"""WITH {CASES_SQL}, {CONCEPTS_SQL}, g AS (SELECT x.concept AS concept_a, y.concept AS concept_b, {SUMS} FROM concepts x JOIN concepts y ON x.case_id = y.case_id AND x.concept < y.concept JOIN cases ON cases.case_id = x.case_id GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT concept_a, concept_b, total, wins, {RATE} AS win_rate FROM g""")
def concept_pairs(spark, d):
    return a.concept_combinations(tagged(spark, d), 2, most=8)


@query(f"""WITH {CASES_SQL}, {CONCEPTS_SQL}, g AS (SELECT x.concept AS concept_a, y.concept AS concept_b, z.concept AS concept_c, {SUMS} FROM concepts x JOIN concepts y ON x.case_id = y.case_id AND x.concept < y.concept
JOIN concepts z ON x.case_id = z.case_id AND y.concept < z.concept JOIN cases ON cases.case_id = x.case_id GROUP BY 1, 2, 3 HAVING count(*) >= 2) SELECT concept_a, concept_b, concept_c, total, wins, {RATE} AS win_rate FROM g""")
def concept_triples(spark, d):
    return a.concept_combinations(tagged(spark, d), 3)


@query(f"""WITH {CASES_SQL}, {CONCEPTS_SQL}, g AS (SELECT concept, count(*) FILTER (year IN (1999, 2000)) AS recent, count(*) FILTER (year IN (1997, 1998)) AS previous FROM cases JOIN concepts USING (case_id) GROUP BY 1),
h AS (SELECT *, CASE WHEN previous = 0 THEN 100.0 ELSE round(100.0 * (recent - previous) / previous, 1) END AS growth FROM g WHERE recent + previous > 0)
SELECT concept, recent, previous, CAST(growth AS DOUBLE) AS growth, CASE WHEN growth > 25 THEN 'emerging' WHEN growth < -25 THEN 'declining' ELSE 'stable' END AS trend FROM h""")
def concept_growth(spark, d):
    return a.concept_growth(tagged(spark, d), 2000)


@query(f"""WITH {CASES_SQL}, {JUDGES_SQL}, j AS (SELECT * FROM cases JOIN judges USING (case_id)), c AS (SELECT judge, court, count(*) AS n FROM j GROUP BY 1, 2),
p AS (SELECT judge, court, row_number() OVER (PARTITION BY judge ORDER BY n DESC, court) AS k FROM c),
g AS (SELECT judge, {SUMS}, min(year) AS first_year, max(year) AS last_year, count(DISTINCT court) AS courts FROM j GROUP BY 1)
SELECT g.judge, total, wins, first_year, last_year, courts, p.court AS primary_court, {RATE} AS win_rate FROM g JOIN p ON p.judge = g.judge AND k = 1 WHERE total >= 5 ORDER BY total DESC, g.judge LIMIT 50""")
def judge_leaderboard(spark, d):
    return a.judge_leaderboard(judged(spark, d), min_cases=5)


@query(f"""WITH {CASES_SQL}, {JUDGES_SQL}, c AS (SELECT judge, subclass, count(*) AS n FROM cases JOIN judges USING (case_id) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY judge ORDER BY n DESC, subclass) AS rank FROM c)
SELECT judge, subclass, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def judge_top3_subclasses(spark, d):
    return a.top_per_group(judged(spark, d).groupBy("judge", "subclass").agg(F.count(F.lit(1)).alias("n")), "judge", "subclass")


@query(f"""WITH {CASES_SQL}, {JUDGES_SQL}, g AS (SELECT judge, court, {SUMS} FROM cases JOIN judges USING (case_id) GROUP BY 1, 2), b AS (SELECT court, round(100.0 * sum(CAST(won AS INTEGER)) / count(*), 1) AS court_rate FROM cases GROUP BY 1)
SELECT judge, court, total, wins, {RATE} AS win_rate, court_rate, round(({RATE}) - court_rate, 1) AS delta FROM g JOIN b USING (court)""")
def judge_vs_court_baseline(spark, d):
    return a.judge_against_court(judged(spark, d), analogue_cases(spark, d))


@query(f"""WITH {CASES_SQL}, {JUDGES_SQL}, j AS (SELECT * FROM cases JOIN judges USING (case_id) WHERE judge IN ('Supplier#000000001', 'Supplier#000000002'))
SELECT judge, 'outcome' AS dim, outcome AS key, count(*) AS n FROM j GROUP BY 1, 3 UNION ALL SELECT judge, 'nature', nature, count(*) FROM j GROUP BY 1, 3 UNION ALL
SELECT judge, 'country', country, count(*) FROM j GROUP BY 1, 3 UNION ALL SELECT judge, 'year', CAST(year AS VARCHAR), count(*) FROM j GROUP BY 1, 3""")
def judge_profiles(spark, d):
    some = judged(spark, d).where(F.col("judge").isin("Supplier#000000001", "Supplier#000000002"))
    dims = F.array(*(F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("key")) for c in ("outcome", "nature", "country", "year")))
    return some.select("judge", F.explode(dims).alias("x")).groupBy("judge", "x.dim", "x.key").agg(F.count(F.lit(1)).alias("n"))


@query(YEARS_SQL + " SELECT court, year, n, round(100.0 * n / sum(n) OVER (PARTITION BY year), 1) AS percent FROM years")
def percent_of_total(spark, d):
    return a.percent_of_total(court_years(spark, d), "year")


@query(YEARS_SQL + """ SELECT court, CAST(sum(n) AS BIGINT) AS total, count(*) AS active_years, (SELECT y.year FROM years y WHERE y.court = x.court ORDER BY y.n DESC, y.year LIMIT 1) AS peak_year, max(n) AS peak_n, round(avg(n), 1) AS per_year
FROM years x GROUP BY court""")
def peak_years(spark, d):
    return a.peak_years(court_years(spark, d))


@query(YEARS_SQL + """ SELECT c.court, CAST(s.year AS INTEGER) AS year, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT court FROM years) c CROSS JOIN (SELECT unnest(generate_series(1993, 2003)) AS year) s LEFT JOIN years y ON y.court = c.court AND y.year = s.year""")
def court_sparkline(spark, d):
    return a.zero_filled(court_years(spark, d), 1993, 2003)


@query(YEARS_SQL + """, m AS (SELECT 'AFRICA' AS old, 'ASIA' AS new, 1998 AS since UNION ALL SELECT 'EUROPE', 'AMERICA', 1997),
e AS (SELECT old, new, since, (SELECT avg(n) FROM years WHERE court = old AND year BETWEEN since - 2 AND since - 1) AS before, (SELECT avg(n) FROM years WHERE court = new AND year BETWEEN since AND since + 1) AS after FROM m)
SELECT old, new, since, before, after, CASE WHEN before > 0 THEN round(100.0 * (after - before) / before, 1) END AS change FROM e""")
def transition_impact(spark, d):
    moves = spark.createDataFrame([("AFRICA", "ASIA", 1998), ("EUROPE", "AMERICA", 1997)], "old string, new string, since int")
    return a.transition_impact(court_years(spark, d), moves)


@query(f"""WITH {CASES_SQL}, {CONCEPTS_SQL}, l AS (SELECT case_id FROM concepts WHERE concept IN ('Size', 'Promotion') GROUP BY 1 HAVING count(*) = 2), g AS (SELECT court, {SUMS} FROM cases JOIN l USING (case_id) GROUP BY 1) SELECT court, total, wins, {RATE} AS win_rate FROM g""")
def superset_filter(spark, d):
    lists = tagged(spark, d).groupBy("case_id").agg(F.collect_set("concept").alias("c")).where(a.has_all(F.col("c"), ["Size", "Promotion"]))
    return a.success(analogue_cases(spark, d).join(lists, "case_id", "left_semi"), "court")


@query(f"""WITH {CASES_SQL}, {CONCEPTS_SQL}, g AS (SELECT court, {SUMS} FROM cases WHERE case_id IN (SELECT case_id FROM concepts WHERE concept IN ('Economy', 'Standard')) GROUP BY 1) SELECT court, total, wins, {RATE} AS win_rate FROM g""")
def overlap_filter(spark, d):
    lists = tagged(spark, d).groupBy("case_id").agg(F.collect_set("concept").alias("c")).where(a.has_any(F.col("c"), ["Economy", "Standard"]))
    return a.success(analogue_cases(spark, d).join(lists, "case_id", "left_semi"), "court")


@query(f"""WITH {CASES_SQL}, y AS (SELECT min(year) AS a, max(year) AS b FROM cases), t AS (SELECT court, count(*) AS n FROM cases GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT (SELECT count(*) FROM cases) AS total, court AS top_court, round(100.0 * n / (SELECT count(*) FROM cases), 1) AS top_share, (SELECT count(DISTINCT year) FROM cases) AS active_years,
(SELECT count(*) FROM cases, y WHERE year = b) - (SELECT count(*) FROM cases, y WHERE year = a) AS delta FROM t""")
def dashboard_insights(spark, d):
    cases = analogue_cases(spark, d)
    courts = cases.groupBy("court").agg(F.count(F.lit(1)).alias("n"))
    years = cases.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    first = courts.agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("n"), "court")).alias("t"))
    span = years.agg(F.count(F.lit(1)).alias("active_years"), (F.max_by("n", "year") - F.min_by("n", "year")).alias("delta"))
    return first.crossJoin(span).select("total", F.col("t.court").alias("top_court"), F.round(F.lit(-100.0) * F.col("t.n") / F.col("total"), 1).alias("top_share"), "active_years", "delta")  # one row each


@query(f"WITH {CASES_SQL} SELECT DISTINCT 'court' AS dim, court AS value FROM cases UNION ALL SELECT DISTINCT 'nature', nature FROM cases UNION ALL SELECT DISTINCT 'subclass', subclass FROM cases UNION ALL SELECT DISTINCT 'year', CAST(year AS VARCHAR) FROM cases")
def filter_options(spark, d):
    return a.long_counts(analogue_cases(spark, d), {c: F.col(c) for c in ("court", "nature", "subclass", "year")}).select("dim", F.col("key").alias("value"))


@query(f"""WITH {CASES_SQL}, {CONCEPTS_SQL}, b AS (SELECT round(100.0 * sum(CAST(won AS INTEGER)) / count(*), 1) AS baseline FROM cases), t AS (SELECT concept, court, won FROM cases JOIN concepts USING (case_id)),
g AS (SELECT concept, NULL AS court, {SUMS} FROM t GROUP BY 1 UNION ALL SELECT concept, court, {SUMS} FROM t GROUP BY 1, 2), k AS (SELECT concept FROM t GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)
SELECT concept, court, total, wins, {RATE} AS win_rate, CASE WHEN baseline > 0 THEN {lift_sql(RATE, 'baseline')} ELSE 0.0 END AS lift, baseline FROM g JOIN k USING (concept) CROSS JOIN b""")
def concept_effectiveness(spark, d):
    return a.concept_effectiveness(analogue_cases(spark, d), tagged(spark, d), 3)


@query(f"""WITH {CASES_SQL}, {CONCEPTS_SQL}, t AS (SELECT concept, year, won FROM cases JOIN concepts USING (case_id)), k AS (SELECT concept FROM t GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3), m AS (SELECT max(year) AS y FROM t),
c AS (SELECT concept, count(*) FILTER (year BETWEEN y - 1 AND y) AS recent, count(*) FILTER (year BETWEEN y - 3 AND y - 2) AS previous FROM t CROSS JOIN m GROUP BY 1),
h AS (SELECT concept, CAST(CASE WHEN previous = 0 THEN 100.0 ELSE round(100.0 * (recent - previous) / previous, 1) END AS DOUBLE) AS growth FROM c WHERE recent + previous > 0), g AS (SELECT concept, year, {SUMS} FROM t GROUP BY 1, 2)
SELECT concept, year, total, wins, {RATE} AS win_rate, growth, CASE WHEN growth > 25 THEN 'emerging' WHEN growth < -25 THEN 'declining' WHEN growth IS NOT NULL THEN 'stable' END AS trend FROM g JOIN k USING (concept) LEFT JOIN h USING (concept)""")
def concept_trends(spark, d):
    return a.concept_trends(tagged(spark, d), 3)


@query(f"""WITH {CASES_SQL} SELECT year, count(*) AS total, round(100.0 * count(*) FILTER (outcome = 'Affirmed') / count(*), 1) AS affirmed_rate, round(100.0 * count(*) FILTER (outcome IN ('Allowed', 'Remitted', 'Set Aside', 'Granted', 'Quashed')) / count(*), 1) AS win_rate FROM cases GROUP BY 1 HAVING count(*) >= 10""")
def outcome_trend(spark, d):
    return a.outcome_trend(analogue_cases(spark, d))


@query("""WITH s AS (SELECT lower(p_brand) || '/' || length(p_type) AS k, p_name AS name, p_type AS canonical, CAST(p_size AS BIGINT) AS n, p_partkey AS place FROM part)
SELECT arg_min(name, (-length(name), place)) AS name, arg_min(canonical, place) AS canonical, max(n) AS n FROM s GROUP BY k""")
def merged_suggestions(spark, d):
    rows = table(spark, d, "part").select(F.concat(F.lower("p_brand"), F.lit("/"), F.length("p_type")).alias("k"), F.col("p_name").alias("name"), F.col("p_type").alias("canonical"), F.col("p_size").cast("long").alias("n"), F.col("p_partkey").alias("place"))
    return a.merged_suggestions(rows, "k")
