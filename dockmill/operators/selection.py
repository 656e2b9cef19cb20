"""Selections of cases: by id, by time, of work that is left, and searches in registries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockmill.functions.cases import case_id, text

# Fixed values.
LIST_COLUMNS = "case_id citation title court_code date year judges outcome visa_type source tags case_nature visa_subclass visa_class_code applicant_name respondent country_of_origin visa_subclass_number hearing_date is_represented representative".split()
ID_FORM = "^[0-9a-f]{12}$"
NOT_COUNTED = ["date", "the", "and", "court", "tribunal", "member", "judge", "justice", "honour", "federal", "migration", "review", "applicant", "respondent", "minister", "decision"]
MANUAL = "Manual Entry"
# End of fixed values.


def projected(df: DataFrame, wanted: list[str], allowed: list[str] | None = None) -> DataFrame:
    """The wanted columns that exist (and are allowed), in the order wanted; all columns where none is."""
    known = [c for c in dict.fromkeys(wanted) if c in df.columns and (allowed is None or c in allowed)]
    return df.select(*known) if known else df


def by_ids(df: DataFrame, ids: list[str], key: str = "case_id") -> DataFrame:
    """The rows of the ids that have the form of one."""
    return df.where(F.col(key).isin([*dict.fromkeys(ids)]) & F.col(key).rlike(ID_FORM))


def before(df: DataFrame, time_col: str, until: Column | None, limit: int, key: str) -> DataFrame:
    """The latest ``limit`` rows before a time (of all, without one), the latest first; the next page starts before the last of them."""
    some = df if until is None else df.where(F.col(time_col) < until)
    return some.orderBy(F.desc(time_col), F.asc(key)).limit(limit)


def pending_work(df: DataFrame, field: str, key: str, *, court: str | None = None, court_col: str = "court", words: list[str] | None = None, words_col: str = "catchwords", limit: int | None = None) -> DataFrame:
    """Rows whose field is empty, of a court and with one of the words if asked, by court and id."""
    rows = df.where(text(F.col(field)) == "")
    if court:
        rows = rows.where(F.col(court_col) == court)
    if words:
        said = F.lower(text(F.col(words_col)))
        rows = rows.where(reduce(lambda a, b: a | b, [F.contains(said, F.lit(w.lower())) for w in words]))
    rows = rows.orderBy(court_col, key)
    return rows if limit is None else rows.limit(limit)


def without_vector(df: DataFrame, vector_col: str, key: str, after, limit: int) -> DataFrame:
    """The next ``limit`` rows without a vector by key, behind the last one seen (None: from the first)."""
    rows = df.where(F.col(vector_col).isNull())
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(limit)


def expired(df: DataFrame, time_col: str, until: Column) -> DataFrame:
    """What stays when rows stored before a time go; rows without a time stay."""
    return df.where(F.coalesce(F.col(time_col) >= until, F.lit(True)))


def concepts_named(registry: DataFrame, asked: str) -> DataFrame:
    """Entries (name, description, keywords) that hold ``asked`` in any of these, capitals aside; all, for an empty one."""
    want = F.lit(asked.lower().strip())
    held = F.contains(F.lower(text(F.col("name"))), want) | F.contains(F.lower(text(F.col("description"))), want) | F.exists(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.contains(F.lower(k), want))
    return registry.where(held) if asked.strip() else registry


def raw_judges(cases: DataFrame, limit: int, col: str = "judges") -> DataFrame:
    """name, n of the commonest entries of the judges' field as they are written, but for bare titles, numbers and what has under three signs."""
    each = cases.select(F.explode(F.split(text(F.col(col)), "[;,]")).alias("name")).select(F.trim("name").alias("name"))
    kept = each.where((F.length("name") >= 3) & ~F.lower("name").isin(NOT_COUNTED) & ~F.col("name").rlike(r"^\d+$"))
    return kept.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(limit)


def added(cases: DataFrame, entry: DataFrame) -> DataFrame:
    """``cases`` with entries by hand: their source is named so unless it is given, an id is made where there is none, and missing fields are empty."""
    full = entry
    for f in cases.schema.fields:
        if f.name not in entry.columns:
            full = full.withColumn(f.name, F.lit(0 if f.name == "year" else "").cast(f.dataType))
    full = full.withColumn("source", F.when(F.trim(text(F.col("source"))) == "", MANUAL).otherwise(F.col("source")))
    made = case_id(F.col("citation"), F.col("url"), F.col("title"))
    return cases.unionByName(full.withColumn("case_id", F.when(text(F.col("case_id")) == "", made).otherwise(F.col("case_id"))).select(*cases.columns))


def dictionary(df: DataFrame) -> DataFrame:
    """name, type, filled and example of every column: the least value that says something, from one pass."""
    parts = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f.name).cast("string").alias("value")) for k, f in enumerate(df.schema.fields)))
    rows = df.select(F.explode(parts).alias("x")).select("x.*").withColumn("said", F.when(F.trim(text(F.col("value"))) != "", F.col("value")))
    return rows.groupBy("place", "name", "type").agg(F.count("said").alias("filled"), F.min("said").alias("example")).orderBy("place").drop("place")

