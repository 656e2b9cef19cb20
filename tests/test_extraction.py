"""Fields of decisions on single texts: literal rows, white space, and texts that are hostile to patterns."""

import time

import pytest
from pyspark.sql import functions as F

from dockmill.functions import extraction as e


def told(spark, column, *texts):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    return [r.y for r in rows.select("k", column(F.col("x")).alias("y")).orderBy("k").collect()]


def test_titles(spark):
    titles = ["Smith v Minister for Immigration [2020] FCA 12", "Jones and Minister for Home Affairs", "1606474 (Refugee) [2018] AATA 3", "Lee (Migration) [2019] AATA 2398", "Brown; Secretary, Department of Home Affairs", "", None]
    got = [tuple(x) for x in told(spark, e.parties, *titles)]
    assert got == [("Smith", "Minister for Immigration"), ("Jones", "Minister for Home Affairs"), ("", ""), ("Lee", ""), ("Brown", "Secretary, Department of Home Affairs"), ("", ""), ("", "")]


def test_dates(spark):
    bodies = ["DATE OF JUDGMENT: 3 March 2020\nrest", "Decided on 14 May 2019 under the Act", "Statement made on 9 June 2018 at Sydney", "DATE\x00OF DECISION 1 May 2001", ""]
    assert told(spark, e.decision_date, *bodies) == ["3 March 2020", "14 May 2019", "9 June 2018", "1 May 2001", ""]
    assert told(spark, e.hearing_date, *bodies[:3]) == ["3 March 2020", "14 May 2019", "9 June 2018"]


def test_outcome_text(spark):
    said = ["ORDER: appeal dismissed\n\nmore", "x ORDERS\nOne.\nTwo.\t\n \nrest", "DECISION:\n\nthe last words", "DECISION:\n\nfoo\n\nbar", "The Court  dismisses it.\nno", "THE COURT ORDERS that\n\n", "ORDER without an end. The Tribunal affirms it", "", None, "order: " + "y" * 400 + "\n\n"]
    assert told(spark, e.outcome_text, *said) == [
        "ORDER: appeal dismissed", "ORDERS\nOne.\nTwo.", "DECISION:", "DECISION:\n\nfoo", "The Court  dismisses it.", "THE COURT ORDERS that", "The Tribunal affirms it", "", "", "order: " + "y" * 293,
    ]


def test_catchwords_and_judges(spark):
    said = ["CATCHWORDS: Visa - refusal\t\n\nrest", "x catchwords\n\nVisa\n - one\nLEGISLATION", "CATCHWORDS visa", "Catchwords: a\nCASES CITED b", None, "CATCHWORDS: " + "z" * 600 + "\nORDER"]
    assert told(spark, e.catchwords, *said) == ["Visa - refusal", "Visa\n - one", "", "a", "", "z" * 500]
    assert told(spark, e.judges, "x\nJUDGE: Mary Smith J \nBefore: other", "the matter before: Lee", "Coram\nRoe", "") == ["Mary Smith J", "Lee", "Roe", ""]


def test_standard_names(spark):
    visas = ["Subclass 866 (Protection)", "STUDENT  visa", "subclass 5001", "Subclass 299 x", "class of visa", "Character test cancellation", " Odd Entry ", "nan", "", None]
    assert told(spark, e.standard_visa, *visas) == ["Protection visa", "Student visa", "Subclass 5001 visa", "Subclass 299 visa", "Migration (general)", "Character cancellation (s.501)", "Odd Entry", "nan", "", ""]
    natures = ["Judicial  Review of it", "visa refused", "s 501", "migration", "o'neil's oDD-case élan", ""]
    assert told(spark, e.standard_nature, *natures) == ["Judicial review", "Visa refusal", "Character test (s.501)", "Migration (general)", "O'Neil'S Odd-Case Élan", ""]
    outcomes = ["Appeal DISMISSED with costs", "Decision set\naside", "writ of mandamus to issue", "appeal incompetent", "Orders as below", "Something else", ""]
    assert told(spark, e.standard_outcome, *outcomes) == ["Dismissed", "Set aside", "Allowed", "Dismissed", "Unknown", "Something else", ""]


def test_years(spark):
    rows = [(0, "[2020] FCA 1", "/1999/"), (0, "", "http://a/au/2021/3.html"), (0, "no year", "/2021/"), (0, None, "/20/"), (2018, "[2020] x", "/2021/"), (None, "[2011] y", None)]
    df = spark.createDataFrame(rows, "year int, cited string, url string")
    assert [r[0] for r in df.select(e.repaired_year(F.col("year"), F.col("cited"), F.col("url"))).collect()] == [2020, 2021, 0, 0, 2018, 2011]


HOSTILE = ["CATCHWORDS x ", "CATCHWORDS\n", "CATCHWORDS: \n ", "ORDER x ", "ORDER\n ", "DECISION:", "\n", " ", "JUDGE: ", "DATE OF ORDER ", "Date 1 May ", "heard ", "The Court ", "subclass ", "Migration Act 1958"]


@pytest.mark.parametrize("part", HOSTILE)
def test_hostile_texts(spark, part):
    df = spark.createDataFrame([(part * 100_000,)], "x string")
    began = time.perf_counter()
    x = F.col("x")
    df.select(e.catchwords(x), e.outcome_text(x), e.judges(x), e.decision_date(x), e.hearing_date(x), e.citation(x), e.visa_type(x), e.legislation(x), e.subclass_number(F.lit(""), F.lit(""), x)).collect()
    assert time.perf_counter() - began < 8
