"""Row-level and text queries, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from dockmill.functions import cases as c
from dockmill.operators import rows as r
from dockmill.sources.cases import CASES_SQL, analogue_cases, table
from dockmill.streaming.events import windowed_counts

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def documents(spark, d):
    return table(spark, d, "documents")


@query(f"WITH {CASES_SQL} SELECT case_id, year, court FROM cases WHERE year < 1999 OR (year = 1999 AND case_id < 5000) ORDER BY year DESC, case_id DESC LIMIT 50")
def seek_page(spark, d):
    return r.seek_page(analogue_cases(spark, d).select("case_id", "year", "court"), 1999, 5000, 50)


@query(f"WITH {CASES_SQL} SELECT case_id, year, court FROM (SELECT * FROM cases WHERE year > 1996 OR (year = 1996 AND case_id > 400) ORDER BY year, case_id LIMIT 50)")
def seek_page_backwards(spark, d):
    return r.seek_page(analogue_cases(spark, d).select("case_id", "year", "court"), 1996, 400, 50, backwards=True)


@query(f"WITH {CASES_SQL} SELECT case_id, year, nature FROM cases ORDER BY decided DESC, case_id LIMIT 20 OFFSET 60")
def offset_page(spark, d):
    return r.offset_page(analogue_cases(spark, d), [F.desc("decided"), F.asc("case_id")], 4, 20).select("case_id", "year", "nature")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'gear') OR contains(lower(p_brand), 'gear') OR contains(lower(p_type), 'gear')")
def keyword_filter(spark, d):
    return r.keyword_filter(table(spark, d, "part"), "GEAR", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name", "p_brand")


@query("""WITH a AS (SELECT * FROM customer WHERE c_custkey = 7), s AS (SELECT c.c_custkey, c.c_acctbal, CASE WHEN c.c_mktsegment = a.c_mktsegment THEN 3 ELSE 0 END + CASE WHEN c.c_nationkey = a.c_nationkey THEN 2 ELSE 0 END AS score FROM customer c CROSS JOIN a WHERE c.c_custkey <> 7)
SELECT c_custkey, CAST(score AS INTEGER) AS score FROM s WHERE score > 0 ORDER BY score DESC, c_acctbal DESC, c_custkey LIMIT 20""")
def related_topk(spark, d):
    people = table(spark, d, "customer")
    anchor = people.where("c_custkey = 7").first().asDict()
    return r.related(people, anchor, {"c_mktsegment": 3, "c_nationkey": 2}, 20, key="c_custkey", then="c_acctbal").select("c_custkey", "score")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_per_key(spark, d):
    return r.latest_per_key(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT c_custkey, c_name || '*', c_acctbal + 1 FROM customer WHERE c_nationkey = 3""")
def upsert(spark, d):
    base = table(spark, d, "customer")
    changed = base.where("c_nationkey = 3").select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return r.upsert(base.select("c_custkey", "c_name", "c_acctbal"), changed, "c_custkey")


@query("SELECT source, lang, count(*) AS n FROM documents WHERE lang = 'en' OR source NOT IN (SELECT source FROM documents WHERE lang = 'en') GROUP BY 1, 2")
def anti_new_rows(spark, d):
    docs = documents(spark, d)
    return docs.where("lang = 'en'").unionByName(docs.where("lang <> 'en'").join(docs.where("lang = 'en'").select("source").distinct(), "source", "left_anti").select(*docs.columns)).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS lang, source FROM documents WHERE doc_id % 2 = 0 OR doc_id % 5 = 0), r AS (SELECT doc_id, lang, 'r' || source AS source FROM documents WHERE doc_id % 2 = 1 OR doc_id % 3 = 0)
SELECT doc_id, coalesce(nullif(l.lang, ''), r.lang) AS lang, coalesce(nullif(l.source, ''), r.source) AS source FROM l FULL JOIN r USING (doc_id)""")
def merge_coalesce(spark, d):
    docs = documents(spark, d)
    left = docs.where("doc_id % 2 = 0 OR doc_id % 5 = 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("lang"), "source")
    right = docs.where("doc_id % 2 = 1 OR doc_id % 3 = 0").select("doc_id", "lang", F.concat(F.lit("r"), "source").alias("source"))
    return r.merge_coalesce(left, right, "doc_id")


@query("SELECT CASE WHEN r.k IS NULL THEN 'left' WHEN l.k IS NULL THEN 'right' ELSE 'both' END AS side, count(*) AS n FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') l FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') r ON l.k = r.k GROUP BY 1")
def key_sets(spark, d):
    orders = table(spark, d, "orders")
    return r.key_sets(orders.where("o_orderstatus = 'F'"), orders.where("o_orderpriority = '1-URGENT'"), "o_custkey")


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedup_keep_first(spark, d):
    return r.latest_per_key(documents(spark, d), ["text"], [F.asc("doc_id")]).select("doc_id", "lang", "source")


@query("SELECT lang, field, filled, total FROM (SELECT lang, count(*) AS total, count(*) FILTER (trim(source) <> '') AS source, count(*) FILTER (trim(text) <> '') AS text FROM documents GROUP BY 1) UNPIVOT (filled FOR field IN (source, text))")
def fill_rates(spark, d):
    return r.fill_rates(documents(spark, d), ["source", "text"], "lang")


@query("""SELECT lang, count(*) AS total, count(*) FILTER (length(text) < 40) AS short, count(*) FILTER (regexp_matches(text, '[*#$%&]{3}')) AS marks, count(*) FILTER (regexp_matches(text, '[0-9]{6,}')) AS numbers FROM documents GROUP BY 1""")
def quality_flags(spark, d):
    t = F.col("text")
    return documents(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.length(t) < 40).alias("short"), F.count_if(t.rlike("[*#$%&]{3}")).alias("marks"), F.count_if(t.rlike("[0-9]{6,}")).alias("numbers"))


@query("""SELECT doc_id, regexp_extract(text, 'token = "([0-9a-f]+)"', 1) AS token, regexp_extract(text, '([0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3})', 1) AS address, len(regexp_extract_all(text, '[0-9]{4,}')) AS numbers FROM documents""")
def regex_extract_fields(spark, d):
    t = F.col("text")
    return documents(spark, d).select("doc_id", F.regexp_extract(t, 'token = "([0-9a-f]+)"', 1).alias("token"), F.regexp_extract(t, "([0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3})", 1).alias("address"), F.size(F.regexp_extract_all(t, F.lit("([0-9]{4,})"), F.lit(1))).cast("long").alias("numbers"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang, len(regexp_extract_all(html, '<a href=')) AS links FROM pages")
def html_fields(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, 'lang="([a-z]+)"', 1).alias("lang"), F.size(F.regexp_extract_all(h, F.lit("(<a href=)"), F.lit(1))).cast("long").alias("links"))


@query("SELECT page_id, pos - 1 AS pos, x[1] AS href, x[2] AS title FROM (SELECT page_id, generate_subscripts(m, 1) AS pos, unnest(m) AS a FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>') AS m FROM pages)), LATERAL (SELECT [regexp_extract(a, 'href=\"([^\"]*)\"', 1), regexp_extract(a, '>([^<]*)<', 1)] AS x)")
def html_links(spark, d):
    found = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('(<a href="[^"]*">[^<]*</a>)'), F.lit(1))).alias("pos", "a"))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), F.regexp_extract("a", 'href="([^"]*)"', 1).alias("href"), F.regexp_extract("a", ">([^<]*)<", 1).alias("title"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_path_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type", (F.get_json_object("props", "$.k").cast("long") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id) AS turns, CAST(sum(length(text)) OVER (PARTITION BY conv_id) AS BIGINT) AS characters FROM conversations")
def parent_children(spark, d):
    """Parents' sums beside each child, in long form: a parent of any number of children is never one row."""
    turns = table(spark, d, "conversations")
    return r.with_parent_sums(turns, "conv_id", {"turns": F.count(F.lit(1)), "characters": F.sum(F.length("text").cast("long"))}).select("conv_id", "turn", "role", "turns", "characters")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
def event_tumbling_counts(spark, d):
    return windowed_counts(table(spark, d, "events"))


@query("SELECT doc_id, substr(sha256(coalesce(nullif(source, ''), nullif(lang, ''), text)), 1, 12) AS case_id, CAST(greatest(1, ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM documents")
def derived_keys(spark, d):
    return documents(spark, d).select("doc_id", c.case_id(F.col("source"), F.col("lang"), F.col("text")).alias("case_id"), F.greatest(F.lit(1), F.ceil(F.length("text") / 4.0)).cast("long").alias("tokens"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INTEGER) AS date_sort, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def parsed_dates(spark, d):
    said = c.case_date(F.date_format("o_orderdate", "d MMMM yyyy"))
    return table(spark, d, "orders").select("o_orderkey", c.date_sort(said).alias("date_sort"), c.month_key(said).alias("month"))


@query("""WITH t AS (SELECT DISTINCT p_brand, unnest(string_split(p_name, ' ')) AS tag FROM part UNION SELECT DISTINCT p_brand, 'extra' FROM part) SELECT p_brand, string_agg(tag, ', ' ORDER BY tag) AS tags FROM t GROUP BY 1""")
def batch_tags(spark, d):
    # tags are told apart before they are put together, so a brand's row grows with its tags, not with its rows
    each = table(spark, d, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("tag")).distinct()
    joined = each.groupBy("p_brand").agg(F.array_join(F.collect_set("tag"), ",").alias("tags"))
    return joined.select("p_brand", r.add_tag(F.col("tags"), "<extra>,").alias("tags"))


@query("SELECT c_mktsegment, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS urgent, count(DISTINCT o_custkey) AS people, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 8) GROUP BY 1")
def support_filter(spark, d):
    orders = table(spark, d, "orders")
    busy = orders.groupBy("o_custkey").count().where("count >= 8").select("o_custkey")
    kept = orders.join(busy, "o_custkey", "left_semi").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return kept.groupBy("c_mktsegment").agg(F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("urgent"), F.countDistinct("o_custkey").alias("people"), F.count(F.lit(1)).alias("orders"))
