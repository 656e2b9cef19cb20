"""Single fields and selections on literal rows."""

import datetime

from pyspark.sql import functions as F

from dockmill.functions import fields as f
from dockmill.operators import selection as s
from dockmill.sources.cases import complete


def told(spark, column, *texts):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    return [r.y for r in rows.select("k", column(F.col("x")).alias("y")).orderBy("k").collect()]


def test_numbers(spark):
    assert told(spark, lambda c: f.whole_number(c, 5, 0, 100), "7", " -3 ", "1000", "x", "1.5", "", None, "9" * 30) == [7, 0, 100, 5, 5, 5, 5, 5]
    assert told(spark, lambda c: f.decimal_number(c, 0.5, 0.0, 2.0), "1.5", "-1", "9", "x", None) == [1.5, 0.0, 2.0, 0.5, 0.5]


def test_concept_titles(spark):
    assert told(spark, f.concept_title, "refugee status", "the rule of law", "natural  justice IN proceedings", "well-founded fear", "a-b of THE-state", " ", None, "of") == [
        "Refugee Status", "The Rule of Law", "Natural Justice in Proceedings", "Well-Founded Fear", "A-B of The-State", "", "", "Of",
    ]


def test_votes_and_sections(spark):
    assert told(spark, f.vote, " Approve", "REJECT", "mixed", "?", None) == ["support", "oppose", "neutral", "neutral", "neutral"]
    assert told(spark, f.law_section, "Sections  36(2)(a);", "ss 5, 6.", "Regulation 1.03", "regs 2", None) == ["s 36(2)(a)", "s 5, 6", "reg 1.03", "reg 2", ""]
    assert told(spark, f.law_section_key, "Section 36 (2)", "s.36(2)") == ["s362", "s362"]


def test_respondents_countries_classes(spark):
    assert told(spark, f.respondent, "minister for home affairs", "The Minister for Immigration and Multicultural and Indigenous Affairs & Anor", "Minister for Immigration & Anor", " Roe ", "nan", None) == ["MHA", "MIMIA", "Minister for Immigration", "Roe", "", ""]
    assert told(spark, f.is_garbage_country, "China", "China MEMBER: Lee", "x:", "y" * 61, "", None) == [False, True, True, True, False, False]
    df = spark.createDataFrame([("XA", "class TU", "", "866"), ("", "see Class uc here", "class TU", "866"), ("nan", "classes", "", "866"), (None, None, None, "1")], "code string, words string, kind string, subclass string")
    assert [r[0] for r in df.select(f.class_code(F.col("code"), [F.col("words"), F.col("kind")], F.col("subclass"), {"866": "XA"})).collect()] == ["XA", "UC", "XA", ""]


def test_selections(spark):
    rows = [("0123456789ab", "FCA", "", "visa refused", datetime.datetime(2024, 1, 1), None), ("b", "AATA", None, "costs", datetime.datetime(2024, 1, 2), [1.0]), ("c", "AATA", "x", "", None, None), ("d", "AATA", "", "VISA", datetime.datetime(2024, 1, 3), None)]
    df = spark.createDataFrame(rows, "case_id string, court string, outcome string, catchwords string, at timestamp, vector array<double>")

    def ids(found):
        return [r.case_id for r in found.collect()]

    assert s.projected(df, ["court", "nothing", "case_id", "court"]).columns == ["court", "case_id"] and s.projected(df, ["nothing"]).columns == df.columns and s.projected(df, ["court", "at"], ["at"]).columns == ["at"]
    assert ids(s.by_ids(df, ["0123456789ab", "b", "zz"])) == ["0123456789ab"]
    assert ids(s.before(df, "at", None, 2, "case_id")) == ["d", "b"] and ids(s.before(df, "at", F.lit("2024-01-02").cast("timestamp"), 5, "case_id")) == ["0123456789ab"]
    assert ids(s.pending_work(df, "outcome", "case_id")) == ["b", "d", "0123456789ab"] and ids(s.pending_work(df, "outcome", "case_id", court="AATA", words=["visa", "x"], limit=3)) == ["d"]
    assert ids(s.without_vector(df, "vector", "case_id", None, 2)) == ["0123456789ab", "c"] and ids(s.without_vector(df, "vector", "case_id", "c", 2)) == ["d"]
    assert sorted(ids(s.expired(df, "at", F.lit("2024-01-02").cast("timestamp")))) == ["b", "c", "d"]
    told_of = {r.name: (r.type, r.filled, r.example) for r in s.dictionary(df.drop("vector")).collect()}
    assert told_of["outcome"] == ("string", 1, "x") and told_of["court"] == ("string", 4, "AATA") and len(told_of) == 5


def test_registry_and_judges(spark):
    registry = spark.createDataFrame([("Character Test", "s 501", ["conduct"]), ("Costs", None, None), ("Bias", "apprehended", ["FAIR character"])], "name string, description string, keywords array<string>")
    assert [r.name for r in s.concepts_named(registry, " CHARACTER ").collect()] == ["Character Test", "Bias"] and s.concepts_named(registry, " ").count() == 3
    df = spark.createDataFrame([("Lee; Roe, the",), ("Roe;12;ab",), ("Roe, Justice, 1234",), (None,)], "judges string")
    assert [tuple(r) for r in s.raw_judges(df, 5).collect()] == [("Roe", 3), ("Lee", 1)]


def test_entries_by_hand(spark):
    cases = complete(spark.createDataFrame([("[2024] FCA 1", "A", "u1")], "citation string, title string, url string"))
    entry = spark.createDataFrame([("[2024] FCA 2", "B", "")], "citation string, title string, source string")
    got = {r.title: r for r in s.added(cases, entry.withColumns({"url": F.lit(""), "case_id": F.lit("")})).collect()}
    assert got["B"].source == "Manual Entry" and len(got["B"].case_id) == 12 and got["B"].year == 0 and got["A"].source == "" and len(got) == 2
