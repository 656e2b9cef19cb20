"""Queries of extraction, identity, quality, sinks and text matching, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from dockmill.operators import analytics as a
from dockmill.operators import carry
from dockmill.operators import identity as i
from dockmill.operators import quality as q
from dockmill.operators import retrieval as t
from dockmill.plans.analytics import RATE, SUMS, judged, lift_sql, tagged
from dockmill.sinks import files
from dockmill.sources.cases import CASES_SQL, CONCEPTS_SQL, JUDGES_SQL, analogue_cases, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query("""WITH p AS (SELECT s_name AS name, CAST(s_suppkey % 50 AS BIGINT) AS n FROM supplier) SELECT name, n, CASE WHEN list_contains(regexp_extract_all(lower(name), '[a-z0-9'']+'), '000000001') THEN 3 WHEN len(list_filter(regexp_extract_all(lower(name), '[a-z0-9'']+'), lambda x: starts_with(x, '000000001'))) > 0 OR starts_with(lower(name), '000000001') THEN 2 ELSE 1 END AS match
FROM p WHERE contains(lower(name), '000000001') ORDER BY match DESC, n DESC, lower(name) LIMIT 20""")
def name_completions(spark, d):
    names = table(spark, d, "supplier").select(F.col("s_name").alias("name"), (F.col("s_suppkey") % 50).alias("n"))
    return i.completions(names, "000000001")


@query("SELECT min(p_partkey) AS p_partkey, p_name FROM part WHERE contains(lower(p_name), 'steel') AND contains(lower(p_name), 'gear') GROUP BY p_name ORDER BY length(p_name), p_name LIMIT 1")
def name_of_all_words(spark, d):
    return i.all_words(table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey")), "Gear STEEL", "p_name").select("p_partkey", "p_name")


@query("""WITH a AS (SELECT c_custkey AS key, unnest(['customer ' || c_custkey, c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS alias FROM customer),
r(alias, full_name, source) AS (SELECT c_mktsegment, 'segment ' || c_mktsegment, 1 FROM customer GROUP BY 1 HAVING c_mktsegment < 'F' UNION ALL SELECT CAST(n_nationkey AS VARCHAR), n_name, 2 FROM nation WHERE n_nationkey < 15),
b AS (SELECT key, full_name, row_number() OVER (PARTITION BY key ORDER BY source, -length(r.alias), r.alias, full_name) AS k FROM a JOIN r ON a.alias = r.alias)
SELECT c_custkey AS key, full_name FROM customer LEFT JOIN b ON b.key = c_custkey AND k = 1""")
def names_by_alias(spark, d):
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.array(F.concat(F.lit("customer "), "c_custkey"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("aliases"))
    segments = table(spark, d, "customer").select(F.col("c_mktsegment").alias("alias")).distinct().where("alias < 'F'").select("alias", F.concat(F.lit("segment "), "alias").alias("full_name"), F.lit(1).alias("source"))
    nations = table(spark, d, "nation").where("n_nationkey < 15").select(F.col("n_nationkey").cast("string").alias("alias"), F.col("n_name").alias("full_name"), F.lit(2).alias("source"))
    return i.by_alias(people, segments.unionByName(nations), "key").select("key", "full_name")


@query("SELECT p_brand || '/' || p_size AS surname, min(p_type) AS name FROM part GROUP BY 1 HAVING count(DISTINCT p_type) = 1")
def unique_surnames(spark, d):
    names = table(spark, d, "part").select(F.concat("p_brand", F.lit("/"), "p_size").alias("surname"), F.col("p_type").alias("name"), F.col("p_size").alias("priority"))
    return i.unique_surnames(names)


@query(f"""WITH {CASES_SQL}, {JUDGES_SQL}, n AS (SELECT judge AS name, right(judge, 1) AS surname, count(*) AS case_count, sum(CAST(won AS INTEGER)) AS wins FROM cases JOIN judges USING (case_id) GROUP BY 1, 2)
SELECT surname, arg_min(name, (-case_count, name)) AS canonical_name, CAST(sum(case_count) AS BIGINT) AS case_count, CAST(sum(wins) AS BIGINT) AS wins, array_to_string(list_sort(list(name)), '|') AS variants, round(sum(wins) / sum(case_count), 6) AS success_rate FROM n GROUP BY 1""")
def merged_judges(spark, d):
    records = a.success(judged(spark, d), "judge").select(F.col("judge").alias("name"), F.substring("judge", -1, 1).alias("surname"), F.col("total").alias("case_count"), "wins")
    return i.merged_records(records, "surname").withColumn("variants", F.array_join("variants", "|"))


@query("""WITH h AS (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM conversations) SELECT conv_id, turn, count(*) AS n, max(asked) AS asked FROM h GROUP BY 1, 2""")
def carried_headings(spark, d):
    rows = table(spark, d, "conversations").withColumns({"place": F.struct("turn", "role", "text"), "heading": F.when(F.col("role") == "user", F.col("turn"))})
    return carry.carried(rows, "conv_id", "place", "heading", "asked").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.max("asked").alias("asked"))


@query("""SELECT * FROM (SELECT 'o_orderpriority' AS field, CAST(0 AS BIGINT) AS improved, count(*) FILTER (o_orderkey % 10 = 0) AS regressed, CAST(0 AS BIGINT) AS changed FROM orders UNION ALL
SELECT 'o_orderstatus', 0, 0, count(*) FILTER (o_orderkey % 3 = 0 AND o_orderstatus <> 'X') FROM orders UNION ALL SELECT 'note', count(*) FILTER (o_orderkey % 5 = 0), 0, 0 FROM orders)""")
def baseline_changes(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", F.lit("").alias("note"))
    k = F.col("o_orderkey")
    now = orders.withColumns({"o_orderpriority": F.when(k % 10 == 0, " ").otherwise(F.col("o_orderpriority")), "o_orderstatus": F.when(k % 3 == 0, "X").otherwise(F.col("o_orderstatus")), "note": F.when(k % 5 == 0, "new").otherwise("")})
    return q.against_baseline(now, orders, "o_orderkey", ["o_orderpriority", "o_orderstatus", "note"])


@query("""WITH c AS (SELECT 'event_type' AS dim, event_type AS key, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY n DESC, key) AS k FROM c) SELECT dim, key, n FROM r WHERE k <= 10""")
def error_summary(spark, d):
    return q.error_summary(table(spark, d, "events"), ["event_type", "user_id"])


@query("""WITH o AS (SELECT DISTINCT o_orderpriority AS grp, l_returnflag AS member, l_partkey AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
z AS (SELECT grp, member, count(*) AS size FROM o GROUP BY 1, 2), m AS (SELECT grp, count(*) AS members FROM z GROUP BY 1),
c AS (SELECT grp, CAST(sum(CASE WHEN n = members THEN 1 ELSE 0 END) AS BIGINT) AS in_all FROM (SELECT grp, item, count(*) AS n FROM o GROUP BY 1, 2) JOIN m USING (grp) GROUP BY 1),
p AS (SELECT x.grp, x.size AS sx, y.size AS sy, (SELECT count(*) FROM o u JOIN o v ON u.grp = v.grp AND u.item = v.item WHERE u.grp = x.grp AND u.member = x.member AND v.member = y.member) AS n FROM z x JOIN z y ON x.grp = y.grp AND x.member < y.member)
SELECT grp, members, in_all, round(avg(n / (sx + sy - n)), 6) AS mean_jaccard FROM m JOIN c USING (grp) JOIN p USING (grp) GROUP BY ALL""")
def set_agreement(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return q.set_agreement(lines.select(F.col("o_orderpriority").alias("grp"), F.col("l_returnflag").alias("member"), F.col("l_partkey").alias("item")), "grp", "member", "item")


@query("SELECT l_returnflag AS grp, count(*) AS n, round(avg(s), 2) AS mean, round(100.0 * count(*) FILTER (s >= 4) / count(*), 1) AS share_4, round(100.0 * count(*) FILTER (s >= 3) / count(*), 1) AS share_3 FROM (SELECT *, l_quantity % 5 + 1 AS s FROM lineitem) GROUP BY 1")
def audit_scores(spark, d):
    return q.audit_scores(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), (F.col("l_quantity") % 5 + 1).alias("s")), "grp", "s")


@query(f"""WITH {CASES_SQL}, g AS (SELECT court, year, {SUMS} FROM cases GROUP BY 1, 2), r AS (SELECT court, year, {RATE} AS v FROM g)
SELECT court, min(v) AS least, max(v) AS greatest, round(avg(v), 1) AS mean, round(arg_max(v, year) - arg_min(v, year), 1) AS change FROM r GROUP BY 1""")
def rate_series(spark, d):
    return q.series_shape(a.success(analogue_cases(spark, d), "court", "year"), "court")


@query(f"""WITH {CASES_SQL}, c AS (SELECT nature, outcome, count(*) AS n FROM cases GROUP BY 1, 2) SELECT nature, outcome, n, max(n) OVER () AS greatest, round(100.0 * n / sum(n) OVER (PARTITION BY nature), 1) AS percent FROM c""")
def matrix_percent(spark, d):
    return q.row_percent(analogue_cases(spark, d).groupBy("nature", "outcome").agg(F.count(F.lit(1)).alias("n")), "nature")


@query("""WITH s AS (SELECT p_partkey, CAST(contains(h, 'steel') AS INTEGER) + CAST(contains(h, 'promo') AS INTEGER) + CAST(p_brand <> '' AS INTEGER) AS score FROM (SELECT *, lower(p_name) || ' | ' || lower(p_type) AS h FROM part)) SELECT p_partkey, score FROM s WHERE score > 0""")
def precedent_scores(spark, d):
    return q.precedent_scores(table(spark, d, "part"), "Is STEEL a promo?", ["p_name", "p_type"], ["p_brand"]).select("p_partkey", "score")


@query(f"""WITH {CASES_SQL} SELECT count(*) AS total_cases, array_to_string(list_sort(list(DISTINCT court)), '|') AS courts, min(year) AS min_year, max(year) AS max_year FROM cases""")
def json_header(spark, d):
    return files.json_header(analogue_cases(spark, d)).withColumn("courts", F.array_join("courts", "|"))


@query(f"""WITH {CASES_SQL} SELECT 'total' AS section, '' AS key, count(*) AS n FROM cases UNION ALL SELECT 'court', court, count(*) FROM cases GROUP BY 2 UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*) FROM cases GROUP BY 2 UNION ALL SELECT 'natures', '', count(DISTINCT nature) FROM cases""")
def summary_report(spark, d):
    return files.summary(analogue_cases(spark, d))


@query(f"""WITH {CASES_SQL}, b AS (SELECT case_id, CASE WHEN case_id % 9 = 0 THEN NULL ELSE year END AS year FROM cases) SELECT case_id, year FROM b ORDER BY year DESC NULLS LAST, case_id LIMIT 50000""")
def export_stream(spark, d):
    cases = analogue_cases(spark, d).select("case_id", F.when(F.col("case_id") % 9 != 0, F.col("year")).alias("year"))
    return files.stream_rows(cases)


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY lpad(regexp_extract(p_brand, '\\d+', 0), 4, '0'), 1 LIMIT 12")
def numeric_text_order(spark, d):
    counts = table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.lpad(F.regexp_extract("p_brand", r"\d+", 0), 4, "0"), "p_brand").limit(12)


@query(f"""WITH {CASES_SQL}, {CONCEPTS_SQL}, k AS (SELECT concept FROM concepts GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3), b AS (SELECT round(100.0 * sum(CAST(won AS INTEGER)) / count(*), 1) AS overall FROM cases), t AS (SELECT * FROM concepts WHERE concept IN (SELECT concept FROM k)),
g AS (SELECT x.concept AS concept_a, y.concept AS concept_b, {SUMS} FROM t x JOIN t y ON x.case_id = y.case_id AND x.concept < y.concept JOIN cases ON cases.case_id = x.case_id GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT concept_a, concept_b, total, wins, {RATE} AS win_rate, {lift_sql(RATE, 'overall')} AS lift FROM g CROSS JOIN b""")
def co_occurrence(spark, d):
    cases = analogue_cases(spark, d)
    return a.with_lift(a.concept_combinations(tagged(spark, d), 2, most=8, top_concepts=3, least=5), cases)


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(coalesce(text, '')), '(^|[^a-z0-9])the([^a-z0-9]|$)') AND regexp_matches(lower(coalesce(text, '')), '(^|[^a-z0-9])from([^a-z0-9]|$)')")
def match_all_words(spark, d):
    return t.match_words(table(spark, d, "documents"), "text", ["the", "from"]).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) || ' ', ' of the ')")
def match_phrase(spark, d):
    return t.match_phrase(table(spark, d, "documents"), "text", "of THE").select("doc_id")
