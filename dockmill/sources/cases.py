"""Where cases come from: files in the usual formats, and the TPC-H-like tables that stand for them in tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockmill.functions.cases import case_id, is_win, normalise_outcome

TEXT_FIELDS = "citation title court court_code date url judges catchwords outcome visa_type legislation text_snippet full_text_path source user_notes tags visa_subclass visa_class_code case_nature legal_concepts applicant_name respondent country_of_origin visa_subclass_number hearing_date is_represented representative visa_outcome_reason legal_test_applied".split()
FIELDS = ["case_id", *TEXT_FIELDS[:4], "date", "year", *TEXT_FIELDS[5:]]
SCHEMA = T.StructType([T.StructField(f, T.IntegerType() if f == "year" else T.StringType()) for f in FIELDS])


def complete(df: DataFrame) -> DataFrame:
    """All fields in order; missing ones are empty (year 0), and missing ids are derived."""
    have = {*df.columns}
    cols = {f: F.coalesce(F.col(f).cast("string"), F.lit("")) if f in have else F.lit("") for f in FIELDS if f != "year"}
    cols["year"] = F.coalesce(F.expr("try_cast(year AS int)"), F.lit(0)) if "year" in have else F.lit(0)
    out = df.select(*(cols[f].alias(f) for f in FIELDS))
    return out.withColumn("case_id", F.when(F.col("case_id") != "", F.col("case_id")).otherwise(case_id(F.col("citation"), F.col("url"), F.col("title"))))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Cases of CSV files with a header in any order; a byte-order mark is dropped."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return complete(raw.toDF(*(c.lstrip("﻿") for c in raw.columns)))


def read_json(spark: SparkSession, path: str, wrapper: str = "cases") -> DataFrame:
    """Cases of JSON files that hold an array, or an object with one."""
    raw = spark.read.option("multiLine", True).json(path)
    return complete(raw.select(F.explode(wrapper).alias("c")).select("c.*") if wrapper in raw.columns else raw)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return complete(spark.read.parquet(path))


def read_full_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and body of text files; a header that ends in a run of ``=`` is dropped."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.btrim(F.regexp_replace("value", r"(?s)^.*?\n={10,}\n", ""), F.lit(" \t\n\x0b\x0c\r")).alias("body"))


def read_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int = 32) -> DataFrame:
    """A table of another database, read in ranges of ``key`` by as many tasks."""
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ANALOGUE_TRIBUNALS, ANALOGUE_COURTS = ["AFRICA", "ASIA"], ["AMERICA", "EUROPE", "MIDDLE EAST"]
ANALOGUE_OUTCOMES = {"F": "The matter is remitted", "O": "Appeal allowed", "P": "Application dismissed"}
ANALOGUE_CONCEPTS = {"economy": "Economy", "large": "Size", "medium": "Size", "promo": "Promotion", "standard": "Standard"}  # "small" is unknown


def analogue_outcome(status: Column) -> Column:
    return F.when(status == "F", ANALOGUE_OUTCOMES["F"]).when(status == "O", ANALOGUE_OUTCOMES["O"]).when(status == "P", ANALOGUE_OUTCOMES["P"]).otherwise("")


def analogue_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases: court is the customer's region, nature its segment, subclass the priority.

    Nations and regions are 25 and 5 rows by definition, so they are broadcast.
    """
    places = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    people = table(spark, sf_dir, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    cases = table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    outcome = normalise_outcome(analogue_outcome(F.col("o_orderstatus")))
    return cases.select(
        F.col("o_orderkey").alias("case_id"), F.col("r_name").alias("court"), F.year("o_orderdate").alias("year"), F.to_date("o_orderdate").alias("decided"), outcome.alias("outcome"),
        is_win(outcome, F.col("r_name"), ANALOGUE_TRIBUNALS, ANALOGUE_COURTS).alias("won"), F.col("c_mktsegment").alias("nature"), F.col("o_orderpriority").alias("subclass"), F.col("n_name").alias("country"),
    )


def analogue_concept_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, concepts_raw): the part types of an order as delimited text."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.array_join(F.sort_array(F.collect_set("p_type")), "; ").alias("concepts_raw"))


LINES_OF_A_TASK = 1_000_000  # decides only how many tasks there are, so that one task's memory doesn't grow with the table


def analogue_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, judge): the suppliers of an order, each once; dealt by case, as joins with the cases need them, in tasks of bounded size."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), "l_suppkey")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES_OF_A_TASK))
    lines = lines.repartition(tasks, "case_id").distinct()
    return lines.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("case_id", F.col("s_name").alias("judge"))


#: The same in DuckDB, for the oracles.
CASES_SQL = """cases AS (
  SELECT o_orderkey AS case_id, r_name AS court, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_orderdate AS DATE) AS decided,
         CASE o_orderstatus WHEN 'F' THEN 'Remitted' WHEN 'O' THEN 'Allowed' WHEN 'P' THEN 'Dismissed' ELSE 'Other' END AS outcome,
         CASE WHEN r_name IN ('AFRICA', 'ASIA') THEN o_orderstatus = 'F' ELSE o_orderstatus = 'O' END AS won,
         c_mktsegment AS nature, o_orderpriority AS subclass, n_name AS country
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
CONCEPTS_SQL = """concepts AS (
  SELECT DISTINCT l_orderkey AS case_id, CASE p_type WHEN 'ECONOMY' THEN 'Economy' WHEN 'LARGE' THEN 'Size' WHEN 'MEDIUM' THEN 'Size' WHEN 'PROMO' THEN 'Promotion' WHEN 'STANDARD' THEN 'Standard' END AS concept
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type <> 'SMALL')"""
JUDGES_SQL = """judges AS (SELECT DISTINCT l_orderkey AS case_id, s_name AS judge FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
