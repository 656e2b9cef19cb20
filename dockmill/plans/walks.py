"""Queries of tables of contents and repaired JSON, over pages and answers that are put together from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockmill.functions.json_repair import repaired_json
from dockmill.operators import legislation
from dockmill.sources.cases import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


#: An order is a section of its customer's act; some have a heading before them.
ITEM = """CASE WHEN o_orderkey % 7 = 0 THEN '<h3>Part ' || o_orderpriority || '</h3>' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN '<p><b>Division ' || o_orderkey || '</b>' ELSE '' END
 || '<li><a href="s' || o_orderkey || '.html">' || o_orderkey || ' Order of ' || o_orderstatus || '</a></li>'"""


def acts(spark, d) -> DataFrame:
    """(page_id, url, html): a table of contents for every customer with orders."""
    items = table(spark, d, "orders").selectExpr("o_custkey AS page_id", f"struct(o_orderkey, {ITEM} AS item) AS x")
    html = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]), "")
    pages = items.groupBy("page_id").agg(html.alias("html"))  # as long as an act is
    return pages.select("page_id", F.concat(F.lit("http://example.org/act/"), "page_id", F.lit("/")).alias("url"), F.concat(F.lit("<html><body><div class='body'>"), "html", F.lit("</div></body></html>")).alias("html"))


TOLD_SQL = """o AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 'Part ' || o_orderpriority END AS p, CASE WHEN o_orderkey % 3 = 0 THEN 'Division ' || o_orderkey END AS v FROM orders),
n AS (SELECT *, count(p) OVER w AS part_no, coalesce(last_value(p IGNORE NULLS) OVER w, '') AS part FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT o_custkey AS page_id, o_orderkey, 's' || o_orderkey AS section_id, 'http://example.org/act/' || o_custkey || '/s' || o_orderkey || '.html' AS url, CAST(o_orderkey AS VARCHAR) AS number, 'Order of ' || o_orderstatus AS title, part,
 coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY o_custkey, part_no ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS division FROM n)"""


@query(f"WITH {TOLD_SQL} SELECT page_id, section_id, url, number, title, part, division FROM s")
def act_sections(spark, d):
    return legislation.sections(acts(spark, d)).drop("pos")


@query(f"""WITH {TOLD_SQL}, v AS (SELECT page_id, part, division, min(o_orderkey) AS seen, string_agg(section_id, ',' ORDER BY o_orderkey) AS ids FROM s GROUP BY 1, 2, 3),
p AS (SELECT page_id, part, min(seen) AS seen, string_agg(division || '=' || ids, ';' ORDER BY v.seen) AS divisions FROM v GROUP BY 1, 2) SELECT page_id, string_agg(part || ':' || divisions, '|' ORDER BY seen) AS contents FROM p GROUP BY 1""")
def act_contents(spark, d):
    nested = legislation.nested(legislation.sections(acts(spark, d)))

    def told(x):
        ids = F.array_join(F.transform(x["sections"], lambda s: s["section_id"]), ",")
        return F.concat(x["division"], F.lit("="), ids)

    parts = F.transform("parts", lambda p: F.concat(p["part"], F.lit(":"), F.array_join(F.transform(p["divisions"], told), ";")))
    return nested.select("page_id", F.array_join(parts, "|").alias("contents"))


#: What a model answered about an event: its properties bare, fenced, within prose, or cut off after the second field.
ANSWER = """CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'Here it is: ' || props || ' Anything else? }'
 ELSE '{"id": ' || event_id || ', "kind": "' || event_type || '", "more": ["cut {off' END"""


@query("""SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(props AS JSON)->>'$.k' END AS k, CASE WHEN event_id % 4 = 3 THEN event_id END AS id, CASE WHEN event_id % 4 = 3 THEN event_type END AS kind FROM events""")
def repaired_answers(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id", f"{ANSWER} AS said").select("event_id", repaired_json(F.col("said")).alias("j"))
    return rows.select("event_id", F.get_json_object("j", "$.k").alias("k"), F.get_json_object("j", "$.id").cast("long").alias("id"), F.get_json_object("j", "$.kind").alias("kind"))
