"""Queries of field cleaning and selections over the given tables, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from dockmill.functions import fields as f
from dockmill.operators import selection as s
from dockmill.sources import scans
from dockmill.sources.cases import CASES_SQL, analogue_cases, table
from dockmill.streaming.backfill import must_embed

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(g):
        QUERIES[g.__name__], ORACLE_SQL[g.__name__] = g, sql
        return g

    return add


#: What a part's row says in a field, in several spellings.
SAID = {
    "concept": "'the ' || p_name || '  OF a-' || lower(p_type)",
    "ballot": "CASE p_partkey % 5 WHEN 0 THEN ' Support' WHEN 1 THEN 'REJECT ' WHEN 2 THEN 'mixed' WHEN 3 THEN 'approve' ELSE 'abstain' END",
    "law": "CASE p_partkey % 3 WHEN 0 THEN 'Sections ' WHEN 1 THEN 'ss  ' ELSE 'Regulation ' END || p_partkey || '(' || p_size || ');'",
    "party": "CASE p_partkey % 4 WHEN 0 THEN 'MINISTER for home affairs' WHEN 1 THEN 'The Minister for Immigration & Citizenship & ' || p_name WHEN 2 THEN 'Minister for Immigration and Multicultural and Indigenous Affairs' ELSE ' ' || p_brand END",
    "land": "CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN p_type || ' MEMBER : x' WHEN 2 THEN p_name || ':' ELSE repeat(p_type, 12) END",
    "digits": "CASE p_partkey % 4 WHEN 0 THEN ' ' || p_size || ' ' WHEN 1 THEN '-' || p_size WHEN 2 THEN p_name ELSE p_size || '.5' END",
}
WORDS_SQL = "regexp_extract_all(concept, '\\S+')"
WORD_SQL = """CASE WHEN contains(w, '-') THEN array_to_string([upper(left(p, 1)) || lower(p[2:]) FOR p IN string_split(w, '-')], '-') WHEN i > 1 AND lower(w) IN ('the', 'of', 'a') THEN lower(w) ELSE upper(left(w, 1)) || lower(w[2:]) END"""


@query(f"""WITH p AS (SELECT p_partkey, {', '.join(f'{sql} AS {name}' for name, sql in SAID.items())} FROM part),
l AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(law, '(?i)\\bsections?\\b', 's', 'g'), '\\bss\\b', 's', 'g'), '(?i)\\bregulation\\b', 'reg', 'g'), '\\s+', ' ', 'g'), ' ;,.') AS section FROM p)
SELECT p_partkey, array_to_string([{WORD_SQL} FOR w, i IN {WORDS_SQL}], ' ') AS title, CASE WHEN p_partkey % 5 IN (0, 3) THEN 'support' WHEN p_partkey % 5 = 1 THEN 'oppose' ELSE 'neutral' END AS vote,
section, regexp_replace(lower(section), '[^a-z0-9]+', '', 'g') AS section_key, CASE WHEN lower(party) = 'minister for home affairs' THEN 'MHA' WHEN contains(lower(party), 'immigration & citizenship') THEN 'MIC' WHEN contains(party, 'Indigenous') THEN 'MIMIA' ELSE trim(party) END AS respondent,
regexp_matches(land, '(?i)MEMBER\\s*:|:\\s*$') OR length(land) > 60 AS garbage, least(greatest(coalesce(CASE WHEN regexp_full_match(digits, '\\s*[+-]?\\d+\\s*') THEN CAST(trim(digits) AS BIGINT) END, 7), 0), 40) AS number FROM l""")
def cleaned_fields(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey", *(f"{sql} AS {name}" for name, sql in SAID.items()))
    return rows.select(
        "p_partkey", f.concept_title(F.col("concept")).alias("title"), f.vote(F.col("ballot")).alias("vote"), f.law_section(F.col("law")).alias("section"), f.law_section_key(F.col("law")).alias("section_key"),
        f.respondent(F.col("party")).alias("respondent"), f.is_garbage_country(F.col("land")).alias("garbage"), f.whole_number(F.col("digits"), 7, 0, 40).alias("number"),
    )


@query(f"""WITH {CASES_SQL}, p AS (SELECT case_id, court, CASE WHEN case_id % 3 = 0 THEN '' ELSE outcome END AS outcome, lower(nature) AS words FROM cases)
SELECT case_id, court FROM p WHERE outcome = '' AND court = 'ASIA' AND (contains(words, 'auto') OR contains(words, 'machine'))""")
def pending_cases(spark, d):
    cases = analogue_cases(spark, d).select("case_id", "court", F.when(F.col("case_id") % 3 == 0, "").otherwise(F.col("outcome")).alias("outcome"), F.col("nature").alias("catchwords"))
    return s.pending_work(cases, "outcome", "case_id", court="ASIA", words=["AUTO", "machine"]).select("case_id", "court")


@query("""SELECT trim(name) AS name, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(p_name || '; the, ' || p_brand || ',' || p_size, '[;,]')) AS name FROM part) WHERE length(trim(name)) >= 3 AND lower(trim(name)) <> 'the' AND NOT regexp_full_match(trim(name), '\\d+') GROUP BY 1 ORDER BY n DESC, name LIMIT 20""")
def raw_name_counts(spark, d):
    rows = table(spark, d, "part").select(F.concat_ws(",", F.concat("p_name", F.lit("; the, "), "p_brand"), F.col("p_size").cast("string")).alias("judges"))
    return s.raw_judges(rows, 20)


@query("""SELECT doc_id FROM (SELECT doc_id, sha256(trim(coalesce(text, ''))) AS now, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN sha256('old') ELSE sha256(trim(coalesce(text, ''))) END AS kept, CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE 'm' END AS model, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 2 END AS dims FROM documents)
WHERE kept IS NULL OR kept <> now OR model <> 'm' OR dims <= 0""")
def embedding_backlog(spark, d):
    now = F.sha2(F.trim(F.coalesce("text", F.lit(""))), 256)
    k = F.col("doc_id")
    ledger = {
        "content_hash": F.when(k % 5 == 0, None).when(k % 5 == 1, F.sha2(F.lit("old"), 256)).otherwise(now), "provider": F.lit("p"), "model": F.when(k % 7 == 0, "other").otherwise("m"),
        "dims": F.when(k % 11 == 0, 0).otherwise(2), "vector": F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"),
    }
    return table(spark, d, "documents").withColumns(ledger).where(must_embed(now, "p", "m")).select("doc_id")


#: A page of results of every customer: blocks for odd customers, plain links for even ones.
HIT = """CASE WHEN o_custkey % 2 = 1 THEN '<li class="search-result"><a href="/au/cases/cth/AATA/' || year(o_orderdate) || '/' || o_orderkey || '.html">No ' || o_orderkey || ' [' || year(o_orderdate) || '] AATA ' || o_orderkey || '</a><p class="abstract">' || o_orderpriority || '</p></li>'
 ELSE '<p><a href="/au/cases/cth/' || CASE WHEN o_orderkey % 3 = 0 THEN 'FCA' ELSE 'AATA' END || '/' || year(o_orderdate) || '/' || o_orderkey || '.html">No ' || o_orderkey || '</a>' END"""


@query("""SELECT o_custkey AS page_id, 'No ' || o_orderkey || CASE WHEN o_custkey % 2 = 1 THEN ' [' || year(o_orderdate) || '] AATA ' || o_orderkey ELSE '' END AS title, 'http://www.example.org/au/cases/cth/AATA/' || year(o_orderdate) || '/' || o_orderkey || '.html' AS url, CAST(year(o_orderdate) AS INTEGER) AS year,
CASE WHEN o_custkey % 2 = 1 THEN o_orderpriority ELSE '' END AS snippet, CASE WHEN o_custkey % 2 = 1 THEN '[' || year(o_orderdate) || '] AATA ' || o_orderkey ELSE '' END AS citation FROM orders WHERE o_custkey % 2 = 1 OR o_orderkey % 3 <> 0""")
def search_result_hits(spark, d):
    items = table(spark, d, "orders").selectExpr("o_custkey AS page_id", f"struct(o_orderkey, {HIT} AS item) AS x")
    pages = items.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]), "\n").alias("html"))  # as long as a page is
    return scans.search_hits(pages, "AATA", "http://www.example.org").drop("pos")
