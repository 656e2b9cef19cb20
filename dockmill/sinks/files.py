"""Case records to files. Spark commits a folder of part files as a whole, so readers never see half an export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How many rows the exports and the printed report give: features of these, fixed values.
EXPORT_ROWS, STREAM_ROWS, REPORT_ROWS = 5_000, 50_000, 200


BYTE_ORDER_MARK = "\ufeff"


def write_csv(cases: DataFrame, path: str, columns: list[str]) -> None:
    """CSV in a fixed order of columns, with quotes doubled as spreadsheets read them; every part begins with a byte-order mark and the header."""
    marked = [F.col(c).alias(BYTE_ORDER_MARK + c if k == 0 else c) for k, c in enumerate(columns)]
    cases.select(*marked).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_header(cases: DataFrame) -> DataFrame:
    """One row: total_cases, the distinct courts, and the least and greatest year that isn't 0."""
    year = F.when(F.col("year") != 0, F.col("year"))
    return cases.agg(
        F.count(F.lit(1)).alias("total_cases"), F.array_sort(F.collect_set(F.nullif("court", F.lit("")))).alias("courts"),
        F.coalesce(F.min(year), F.lit(0)).alias("min_year"), F.coalesce(F.max(year), F.lit(0)).alias("max_year"),
    )


def write_json(cases: DataFrame, path: str, key: str = "case_id") -> None:
    """One JSON object: total_cases, courts, year_range and cases, in the order of ``key``, which is unique.

    It is written by all tasks: the parts in the order of their names, one behind the other, are the
    object. Every line but the first and the last is a case.
    """
    head = json_header(cases).select(
        F.lit(0).alias("at"), F.lit(None).cast(cases.schema[key].dataType).alias("key"),
        F.concat(F.regexp_replace(F.to_json(F.struct("total_cases", "courts", F.struct(F.col("min_year").alias("min"), F.col("max_year").alias("max")).alias("year_range"))), r"\}$", ""), F.lit(',"cases":[')).alias("value"),
    )
    first = cases.agg(F.min(key).alias("first"))
    said = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    rows = cases.select(F.col(key).alias("key"), said.alias("said")).crossJoin(F.broadcast(first))  # one row
    rows = rows.select(F.lit(1).alias("at"), "key", F.concat(F.when(F.col("key") == F.col("first"), "").otherwise(","), "said").alias("value"))
    foot = head.select(F.lit(2).alias("at"), "key", F.lit("]}").alias("value"))
    head.unionByName(rows).unionByName(foot).orderBy("at", "key").select("value").write.mode("overwrite").text(path)


def export_rows(cases: DataFrame, key: str = "case_id", limit: int = EXPORT_ROWS) -> DataFrame:
    """The rows of a filtered download, the first by ``key``, so that every run gives the same."""
    return cases.orderBy(key).limit(limit)


def report(cases: DataFrame, notes: DataFrame, key: str = "case_id", limit: int = REPORT_ROWS) -> DataFrame:
    """(place, html): the cells of a printed report of chosen cases with their notes, in the order of the year; text is escaped."""

    def cell(c: str):
        said = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
            said = F.replace(said, F.lit(sign), F.lit(name))
        return said

    rows = cases.orderBy(F.desc_nulls_last("year"), F.asc(key)).limit(limit).join(notes.select(key, "note"), key, "left")
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("year"), F.asc(key)))  # at most ``limit`` rows
    parts = [F.lit("<article><h2>"), cell("title"), F.lit("</h2><p>"), F.concat_ws(" · ", *(F.nullif(cell(c), F.lit("")) for c in ("citation", "court", "year", "outcome"))), F.lit("</p>")]
    parts += [F.when(F.trim(cell("note")) != "", F.concat(F.lit("<blockquote>"), cell("note"), F.lit("</blockquote>"))).otherwise(""), F.lit("</article>")]
    return rows.select(place.alias("place"), F.concat(*parts).alias("html"))


def stream_rows(cases: DataFrame, key: str = "case_id", limit: int = STREAM_ROWS) -> DataFrame:
    """The rows of the long download: latest year first, unknown years last."""
    return cases.orderBy(F.desc_nulls_last("year"), F.asc(key)).limit(limit)


def summary(cases: DataFrame) -> DataFrame:
    """(section, key, n): rows in all, by court, by year other than 0, and distinct natures."""
    every = F.struct(F.lit("total").alias("section"), F.lit("").alias("key"))
    parts = F.array(every, F.struct(F.lit("court").alias("section"), F.coalesce("court", F.lit("")).alias("key")), F.when(F.col("year") != 0, F.struct(F.lit("year").alias("section"), F.col("year").cast("string").alias("key"))))
    counts = cases.select(F.explode(F.array_compact(parts)).alias("x")).groupBy("x.section", "x.key").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(cases.agg(F.lit("natures").alias("section"), F.lit("").alias("key"), F.countDistinct("nature").alias("n")))
