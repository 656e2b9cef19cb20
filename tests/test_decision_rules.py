"""Country, representation and bench: a row for each rule, and texts that are hostile to patterns."""

import random
import time

import pytest
from pyspark.sql import functions as F

from dockmill.functions import origin, places, rules
from dockmill.plans import decisions

LONG = "word " * 120

COUNTRY = [
    ("Country of Reference: People's Republic of China MEMBER: Lee\nrest", "China"),
    ("Country of Origin:\n\nRepublic of Korea\n", "Korea"),
    ("Country of Citizenship: Utopia.", "Utopia"),
    ("Nationality: Sri Lankan.\nborn in Chad", "Sri Lanka"),
    ("Citizenship:\nfiji,\n", "Fiji"),
    ("(Name, DOB, Sex, Nationality) A B, 01/02/70, male, Nepal\n", "Nepal"),
    ("a national of Peru lived in the P.R.C. until then", "China"),
    ("INTERPRETER: Hazaragi (Dari)\nborn in Iran", "Afghanistan"),
    ("INTERPRETER: Klingon\nborn in Iran", "Iran"),
    ("she is a citizen of sri lanka and was born in Iran", "sri lanka"),
    ("claims to be a passport holder of Mali; an Indian citizen", "Mali"),
    ("an Indian citizen, born in Oman", "India"),
    ("a South Sudanese born man from Chad", "South Sudan"),
    ("born in Guinea-Bissau, fled from Togo", "Guinea-Bissau"),
    ("came in Australia from East Timor", "East Timor"),
    ("the applicant is from North Korea", "North Korea"),
    ("the applicant, a farmer, left from Nigerland and from Niger.", "Niger"),
    ("he has a Kenya  passport", "Kenya"),
    (LONG + "fear of harm in Haiti, not Cuba", "Haiti"),
    (LONG + "harm in New Zealand is not feared; Cuban law, Cuba", "Cuba"),
    (LONG + "MaliX and xMali and Malian and Laos", "Laos"),
    ("=" * 40 + " nothing " + "Laos", ""),
    ("x" + "=" * 20 + "y" * 80 + " then Laos", "Laos"),
    ("He likes Laos", ""),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize(("said", "want"), COUNTRY)
def test_country(said, want):
    assert origin.country_in(said) == want


@pytest.mark.parametrize(("value", "want"), [("IRAN", "Iran"), ("Iraqi", "Iraq"), ("the Republic of Korea", "Korea"), ("PRC", "PRC"), ("P.R.C.", "China"), ("China DATE: 1 May", "China"), ("Papua New Guinea", "Papua New Guinea"), ("of South Sudan now", "South Sudan"), ("", ""), (" .,", ""), ("Stateless;", "Stateless")])
def test_named_country(value, want):
    assert origin.country_named(value) == want


def test_every_name_is_found():
    for c in places.COUNTRIES:
        assert origin.country_in(f"a citizen of {c}") == c
    for people, c in places.PEOPLES.items():
        assert origin.country_in(f"a {people} national") == c


REPRESENTED = [
    ("REPRESENTATIVE:\n\nMs Jane Roe (MARN: 0101) CASE NUMBER: 12", ("Yes", "Ms Jane Roe")),
    ("REPRESENTATIVE:\nNil\n\nrest", ("No", "")),
    ("The applicant was self-represented.", ("No", "")),
    ("Self-represented. Later represented by Mr Doe, instructed by Roe", ("Yes", "Mr Doe")),
    ("self represented; represented by self-represented", ("No", "")),
    ("The applicant was never legally represented", ("No", "")),
    ("The appellant appeared before the Tribunal without legal representation", ("No", "")),
    ("was represented in relation to the review by his solicitor, Mr John Smith.", ("Yes", "Mr John Smith")),
    ("was represented in relation to the review by a lawyer. The hearing of Anna Maria Bell", ("Yes", "Anna Maria Bell")),
    ("The applicants were represented", ("Yes", "")),
    ("Applicant's Representative: None", ("No", "")),
    ("Applicant Representative:\nRoe & Co\n", ("Yes", "Roe & Co")),
    ("represented by: Doe Lawyers\n", ("Yes", "Doe Lawyers")),
    ("Counsel for the Appellant:\nMr X Ample Solicitor for the Appellant:\nY", ("Yes", "Mr X Ample")),
    ("Solicitor for the Appellants:\nNil\nMigration Agent: A B\n", ("Yes", "A B")),
    ("text\nFor the Appellant: Mr Z Edd\n", ("Yes", "Mr Z Edd")),
    ("Migration Agent: none\nMr Q appeared for the applicant: Quentin Q\n", ("Yes", "Quentin Q")),
    ("REPRESENTATIVE FOR THE APPLICANT: \n Law Firm DECISION", ("Yes", "Law Firm")),
    ("nothing", ("", "")),
    (None, ("", "")),
]


@pytest.mark.parametrize(("said", "want"), REPRESENTED)
def test_representation(said, want):
    assert rules.representation(said) == want


BENCHES = [
    ("JUDGE: the applicant was heard\nJUDGE: Mary Smith J\n", "Mary Smith J"),
    ("JUDGES: Date\nCoram: Brown", "Brown"),
    ("Before: ALL THE EVIDENCE\nTRIBUNAL  MEMBER: Lee\n", "Lee"),
    ("Justice - O'Neil-Roe", "O'Neil-Roe"),
    ("Before: members", ""),
    ("judge: smith", ""),
    (None, ""),
]


@pytest.mark.parametrize(("said", "want"), BENCHES)
def test_bench(said, want):
    assert rules.judge_in(said) == want


HOSTILE = ["from ", "applicant ", "a citizen of ", "Nationality:" + " " * 50, "REPRESENTATIVE:\n", "JUDGE: x ", "represented by ", "REPRESENTATIVE: \n ", "Counsel for the Applicant:\n", "TRIBUNAL ", "(Name, DOB, Sex, Nationality) male, ", " ", "\n", "INTERPRETER:\n", "Indian ", "self-represented "]


@pytest.mark.parametrize("part", HOSTILE)
def test_hostile_texts(part):
    began = time.perf_counter()
    said = part * 100_000
    origin.country_in(said), rules.representation(said), rules.judge_in(said)
    assert time.perf_counter() - began < 4


def test_columns(spark):
    df = spark.createDataFrame([(1, COUNTRY[0][0], REPRESENTED[0][0], BENCHES[0][0]), (2, None, None, None)], "id int, a string, b string, c string")
    got = df.select("id", origin.country_of_origin(F.col("a")).alias("country"), origin.normal_country(F.col("a")).alias("named"), rules.represented_by(F.col("b")).alias("r"), rules.sitting_judge(F.col("c")).alias("judge")).orderBy("id").collect()
    assert (got[0].country, tuple(got[0].r), got[0].judge) == ("China", ("Yes", "Ms Jane Roe"), "Mary Smith J")
    assert (got[1].country, got[1].named, tuple(got[1].r), got[1].judge) == ("", "", ("", ""), "")


def test_countries_by_their_last_words_alone(monkeypatch):
    """Rules that no country can follow are left out; all rules asked say the same."""
    rng = random.Random(15)
    parts = ["citizen of", "national  of", "born in", "fled from", "the applicant is from", "harm in", "return to", "applicant", "passport", "Iran", "\u0130ran", "fiji", "Chad.", "Peru", "New Zealand", "of\n", "\u0131n", "FROM\t", "o\u017f", "word", " ", " " * 70, ":", "x" * 600]
    said = [rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(4000)] + [t for t, _ in COUNTRY]
    got = [origin.country_in(t) for t in said]
    monkeypatch.setattr(origin.Names, "_tails", lambda self, start: origin.TAILS)
    assert got == [origin.country_in(t) for t in said] and len(set(got)) > 5


def test_decisions_are_dealt_by_case(spark):
    """Few bytes of Parquet are one task's share of a scan; texts are made and read behind a shuffle of narrow rows."""
    rows = decisions.analogue_decisions(spark, "/root/testdata/sf0.001", "told")
    spread = spark.sparkContext._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "simple")
    assert "hashpartitioning(case_id" in spread
