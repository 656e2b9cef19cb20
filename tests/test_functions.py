"""Scalar rules, name cleaning, row operators, readers and streams on small literal rows."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from dockmill.functions import cases as c
from dockmill.functions import names
from dockmill.functions.vocabulary import CONCEPTS, FAMILIES
from dockmill.operators import rows as r
from dockmill.plans.analytics import lift_sql
from dockmill.sources import cases as s
from dockmill.streaming.events import EVENTS, ingest_once, read_events, windowed_counts


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], f"k int, x {kind}")
    return [row.y for row in df.select("k", column(F.col("x")).alias("y")).orderBy("k").collect()]


def test_outcomes(spark):
    said = ["Decision under review AFFIRMED", "set aside and remitted", "No jurisdiction to grant", "application discontinued", "", None, "odd"]
    assert values(spark, c.normalise_outcome, said) == ["Affirmed", "Set Aside", "No Jurisdiction", "Withdrawn", "Other", "Other", "Other"]
    wins = spark.createDataFrame([("Remitted", "AATA", True), ("Remitted", "FCA", False), ("Allowed", "HCA", True), ("Allowed", "RRTA", False), ("Allowed", "XX", True)], "o string, court string, want boolean")
    assert wins.where(c.is_win(F.col("o"), F.col("court")) != F.col("want")).count() == 0


def test_concepts_and_subclasses(spark):
    assert values(spark, c.split_concepts, ["Refugee; asylum, S.36.; noise", None]) == [["Refugee Status", "Protection Obligations"], []]
    assert values(spark, c.clean_subclass, ["866.0", " 50 ", "nan", "12345", None]) == ["866", "50", "", "", ""]
    assert values(spark, c.family, ["408", "866.0", "999"]) == ["Visitor", "Protection", "Other"]
    assert len({*CONCEPTS.values()}) == 30 and len({*FAMILIES.values()}) == 9


def test_dates_and_keys(spark):
    days = values(spark, c.case_date, ["15 March 2024", "5  mar 2024", "2024-03-15", "", None])
    assert days == [datetime.date(2024, 3, 15), datetime.date(2024, 3, 5), None, None, None]
    assert values(spark, lambda x: c.case_id(x, F.lit("u"), F.lit("t")), ["[2024] AATA 100"])[0].startswith("96ebc92e9afa")
    assert values(spark, lambda x: c.cursor(F.lit(2024), x), ["abc"]) == ["eyJ5ZWFyIjoyMDI0LCJjYXNlX2lkIjoiYWJjIn0"]
    assert values(spark, c.representation, ["YES", "self", "x"]) == ["represented", "self_represented", "unknown"]


@pytest.mark.parametrize(("raw", "want"), [("The Hon Justice SMITH J", "Smith"), ("Senior Member o'brien", "O'Brien"), ("mr john mcdonald SC", "John McDonald"), ("(Jane) 'Sandy' Macleod", "Jane Sandy MacLeod"), ("", "")])
def test_display_name(raw, want):
    assert names.display_name(raw) == want


def test_judges(spark):
    assert names.judges_of("Justice Smith; Member Jones, the tribunal; SMITH J; 123") == ["Smith", "Jones"]
    assert [names.surname_key(x) for x in ("Justice Smith", "SMITH J", "O'Brien", "Müller", "Smith-Jones", None, " ")] == ["smith", "smith", "obrien", "muller", "smithjones", "", ""]
    df = spark.createDataFrame([(1, "Justice Smith"), (2, None)], "case_id int, judges string")
    assert {x.case_id: x.judge_names for x in names.with_judges(df).collect()} == {1: ["Smith"], 2: []}


def test_row_changes(spark):
    base = spark.createDataFrame([(1, "a", ""), (2, "", "x")], "k int, url string, v string")
    more = spark.createDataFrame([(3, "a", "n"), (4, "b", "n"), (5, "b", "m"), (6, "", "n")], "k int, url string, v string")
    assert r.insert_new(base, more, "url").count() == 4
    assert {x.k: x.v for x in r.fill_empty(base, spark.createDataFrame([(1, "new"), (2, "new")], "k int, v string"), "k", ["v"]).collect()} == {1: "new", 2: "x"}
    assert r.delete_rows(base, "k", [1]).count() == 1
    assert r.update_rows(base, "k", 1, {"v": "z", "k": 9}, {"v"}).where("k = 1 and v = 'z'").count() == 1
    assert values(spark, lambda x: r.add_tag(x, "b<,>"), ["c, a", None, "b"]) == ["a, b, c", "b", "b"]


def test_pages_join_to_the_whole(spark):
    df = spark.createDataFrame([(2000 + k % 4, k) for k in range(23)], "year int, case_id int")
    seen, year, key = [], None, None
    while page := r.seek_page(df, year, key, 5).collect():
        seen += [(x.year, x.case_id) for x in page]
        year, key = seen[-1]
    assert seen == sorted(((x.year, x.case_id) for x in df.collect()), reverse=True)


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿title,citation,year,url\n\"A, B\",[2024] AATA 100,2024,\n", encoding="utf-8")
    (tmp_path / "b.json").write_text('{"cases": [{"title": "t", "url": "u", "year": "x"}]}')
    (tmp_path / "c.txt").write_text("Title: t\n==============\nBody text\n")
    row = s.read_csv(spark, str(tmp_path / "a.csv")).first()
    assert (row.title, row.year, row.case_id) == ("A, B", 2024, "96ebc92e9afa") and len(row) == 31
    assert s.read_json(spark, str(tmp_path / "b.json")).select("title", "year").collect() == [("t", 0)]
    assert s.read_full_texts(spark, str(tmp_path / "c.txt")).first().body == "Body text"


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for part in (events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1 or event_id < 50")):
        part.coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        ingest_once(read_events(spark, source), str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == events.count() == got.select("event_id").distinct().count()
    stream = windowed_counts(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "out")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, windowed_counts(events).collect()))


def test_hearing_date_rules_in_order(spark):
    from dockmill.functions.extraction import hearing_date

    late = "x" * 6000
    cases = {
        "Delivered on 1 May 2020. Date of hearing: 2 May 2020": "2 May 2020",
        "Decision on 1 May 2020. It was heard at Perth on 3 June 2019": "3 June 2019",
        f"{late} Date of hearing and decision: 4 July 2018": "4 July 2018",
        f"{late} handed down on 4 July 2018": "",
        "Date heard: 5 August 2017": "5 August 2017",
        "DATE:\n\n6 March 2016": "6 March 2016",
        "no date": "",
        None: "",
    }
    assert values(spark, hearing_date, [*cases]) == [*cases.values()]


def test_lift_rounds_halves_up_on_both_sides(spark):
    pairs = [(a, b) for b in range(1, 1001, 3) for a in range(0, 1001, 5)] + [(328, 320), (369, 360)]
    want = [(200 * a + b) // (2 * b) / 100 for a, b in pairs]
    rows = spark.createDataFrame([(k, a / 10, b / 10) for k, (a, b) in enumerate(pairs)], "k int, win_rate double, own_rate double")
    assert [r.x for r in rows.orderBy("k").select(c.lift(F.col("win_rate"), F.col("own_rate")).alias("x")).collect()] == want
    frame = rows.toPandas()  # noqa: F841
    assert [x for (x,) in duckdb.sql(f"SELECT {lift_sql('win_rate', 'own_rate')} FROM frame ORDER BY k").fetchall()] == want
