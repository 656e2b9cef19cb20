"""Retrieval queries, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from dockmill.operators import retrieval as s
from dockmill.sources.cases import table

QUERIES, ORACLE_SQL = {}, {}
EVERY = "vec_id % 20 = 0"  # searches that grow with the table
KNN_SQL = """knn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM (
  SELECT q.vec_id AS query, v.vec_id AS doc, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))), 6) AS score
  FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id))"""
BM25_SQL = """words AS (SELECT doc_id AS doc, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS t FROM documents), w AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM words),
asked AS (SELECT item_id AS query, unnest(list_distinct_in_order) AS term FROM (SELECT item_id, [x FOR x, i IN ts IF list_position(ts, x) = i] AS list_distinct_in_order FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS ts FROM benchmark))),
p AS (SELECT doc, len, term, count(*) AS tf FROM (SELECT doc, len(t) AS len, unnest(t) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
bm AS (SELECT query, doc, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score FROM asked JOIN p USING (term) JOIN df USING (term) CROSS JOIN w GROUP BY 1, 2),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm)"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def knn(spark, d, k):
    vectors = table(spark, d, "embeddings")
    return s.exact_neighbours(vectors, vectors.where(EVERY), k)


@query(f"WITH {KNN_SQL} SELECT query, doc, score, CAST(rank AS INTEGER) AS rank FROM knn WHERE rank <= 10")
def knn_cosine(spark, d):
    return knn(spark, d, 10)


@query(f"WITH {KNN_SQL.replace("q.vec_id % 20 = 0", "q.vec_id = 3")} SELECT query, doc, round(score, 4) AS score, label FROM knn JOIN embeddings ON doc = vec_id WHERE rank <= 5")
def similar_to_anchor(spark, d):
    vectors = table(spark, d, "embeddings")
    found = s.exact_neighbours(vectors, vectors.where("vec_id = 3"), 5)
    return found.join(vectors, F.col("doc") == F.col("vec_id")).select("query", "doc", F.round("score", 4).alias("score"), "label")


@query(f"WITH {BM25_SQL} SELECT query, doc, score, CAST(rank AS INTEGER) AS rank FROM bm25 WHERE rank <= 5")
def bm25_search(spark, d):
    return s.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), 5, id_col="doc_id", text_col="text", query_id="item_id", query_text="text")


@query(f"""WITH {KNN_SQL}, a AS (SELECT query, doc, rank FROM knn WHERE rank <= 30), b AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY doc) AS rank FROM a WHERE doc % 2 = 0),
f AS (SELECT query, doc, round(coalesce(0.65 / (60 + a.rank), 0) + coalesce(0.35 / (60 + b.rank), 0), 8) AS score FROM a FULL JOIN b USING (query, doc)), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM f)
SELECT query, doc, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def rrf_full_outer(spark, d):
    a = knn(spark, d, 30)
    b = s.ranked(a.where("doc % 2 = 0").select("query", "doc", (-F.col("doc")).alias("score")), 30)
    return s.fuse_two(a, b, 10)


@query(f"""WITH {KNN_SQL}, a AS (SELECT query, doc, rank FROM knn WHERE rank <= 30), b AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY doc) AS rank FROM a WHERE doc % 2 = 0),
f AS (SELECT query, doc, round(sum(x), 8) AS score FROM (SELECT query, doc, CAST(0.5 AS DOUBLE) / (60 + rank) AS x FROM a UNION ALL SELECT query, doc, CAST(0.5 AS DOUBLE) / (60 + rank) FROM b) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM f)
SELECT query, doc, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def rrf_fusion(spark, d):
    a = knn(spark, d, 30)
    b = s.ranked(a.where("doc % 2 = 0").select("query", "doc", (-F.col("doc")).alias("score")), 30)
    return s.fuse([(a, 0.5), (b, 0.5)], 10)


@query(f"""WITH {KNN_SQL}, rel AS (SELECT q.vec_id AS query, v.vec_id AS doc FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
h AS (SELECT query, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first FROM knn JOIN rel USING (query, doc) WHERE rank <= 10 GROUP BY 1), n AS (SELECT query, count(*) AS relevant FROM rel GROUP BY 1)
SELECT query, relevant, coalesce(hits, 0) AS hits, round(coalesce(hits, 0) / relevant, 6) AS recall, round(coalesce(hits, 0) / 10, 6) AS precision, round(coalesce(dcg, 0.0) / (SELECT sum(1 / log2(i + 1)) FROM generate_series(1, least(relevant, 10)) t(i)), 6) AS ndcg, round(coalesce(1 / first, 0.0), 6) AS rr FROM n LEFT JOIN h USING (query)""")
def retrieval_metrics(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label")
    relevant = v.where(EVERY).select(F.col("vec_id").alias("query"), "label").join(v, "label").where("query <> vec_id").select("query", F.col("vec_id").alias("doc"))
    return s.retrieval_measures(knn(spark, d, 10), relevant, 10)


#: Of a document that asks, the first ``TERMS`` distinct words are its query.
TERMS = 16
BM25_EVERY_SQL = BM25_SQL.replace("FROM benchmark", "FROM (SELECT doc_id AS item_id, text FROM documents WHERE doc_id % 20 = 0)").replace("unnest(list_distinct_in_order)", f"unnest(list_slice(list_distinct_in_order, 1, {TERMS}))")
#: The semantic list of rows and the lexical list of the documents of the same ids, without the row that asks.
LISTS_SQL = f"""WITH {KNN_SQL}, {BM25_EVERY_SQL}, a AS (SELECT query, doc, rank FROM knn WHERE rank <= 30),
b AS (SELECT * FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm WHERE query <> doc) WHERE rank <= 30)"""


def lexical_every(spark, d, k):
    docs = table(spark, d, "documents")
    return s.bm25(docs, docs.where("doc_id % 20 = 0"), k, id_col="doc_id", text_col="text", query_id="doc_id", query_text="text", terms=TERMS, exclude_self=True)


@query(f"""{LISTS_SQL}, f AS (SELECT query, doc, round(coalesce(0.65 / (60 + a.rank), 0) + coalesce(0.35 / (60 + b.rank), 0), 8) AS score FROM a FULL JOIN b USING (query, doc)),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM f) SELECT query, doc, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def hybrid_full_outer(spark, d):
    return s.fuse_two(knn(spark, d, 30), lexical_every(spark, d, 30), 10)


@query(f"""{LISTS_SQL}, f AS (SELECT query, doc, round(sum(x), 8) AS score FROM (SELECT query, doc, CAST(0.5 AS DOUBLE) / (60 + rank) AS x FROM a UNION ALL SELECT query, doc, CAST(0.5 AS DOUBLE) / (60 + rank) FROM b) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM f) SELECT query, doc, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def hybrid_fusion(spark, d):
    return s.fuse([(knn(spark, d, 30), 0.5), (lexical_every(spark, d, 30), 0.5)], 10)
