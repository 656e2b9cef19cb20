"""Outcome, visa, catchwords, reason and legal test: a row for each rule, and hostile texts."""

import time

import pytest
from pyspark.sql import functions as F

from dockmill.functions import cascades as c

OUTCOMES = [
    ("DECISION:\n\nThe Tribunal remits it.\nTwo\nThree\nFour\nFive", "DECISION:\n\nThe Tribunal remits it.\nTwo\nThree\nFour"),
    ("x. The decision under review is affirmed today\nmore", "The decision under review is affirmed today"),
    ("so the Decision \n affirmed here\nno", "Decision \n affirmed here"),
    ("I set aside the decision now\nno", "set aside the decision now"),
    ("ORDERS\n(1) One\n(2) Two\nrest", "ORDERS\n(1) One\n(2) Two"),
    ("ORDERS:\n\nThe first thing\n\nrest", "ORDERS:\n\nThe first thing"),
    ("ORDER:\n\nno end. The Tribunal affirms all of it\nx", "The Tribunal affirms all of it"),
    ("The Court  dismisses it all\nx", "The Court  dismisses it all"),
    ("so the appeal be allowed\nx", "the appeal be allowed"),
    ("An application here\nThe application by A must be dismissed and is refused with costs\nx", "The application by A must be dismissed and is refused with costs"),
    ("The application is\n dismissed at last\nx", "The application is\n dismissed at last"),
    ("accordingly, dismissed\nx", "accordingly, dismissed"),
    ("I would allow x\ny", "I would allow x"),
    ("I refuse the thing\ny", "I refuse the thing"),
    ("a\nall of this must be granted so\nb", "all of this must be granted so"),
    ("writs of certiorari issue\nb", "writs of certiorari issue"),
    ("review is hereby upheld\nb", "review is hereby upheld"),
    ("nothing", ""),
    (None, ""),
]


@pytest.mark.parametrize(("said", "want"), OUTCOMES)
def test_outcome(said, want):
    assert c.outcome_in(said) == want


def test_long_outcomes_are_cut():
    assert len(c.outcome_in("I would allow " + "x" * 900)) == 300
    assert c.outcome_in("x" * 5000 + " review is affirmed.") == "review is affirmed." and c.outcome_in("review is affirmed" + "x " * 5000) == ""


VISAS = [
    ("a Protection  (Class XA) visa", "", "Protection  (Class XA) visa"),
    ("student (never closed visa", "", ""),
    ("partner (x) no; skilled visa", "", "skilled visa"),
    ("subclass 866 visa", "", "subclass 866 visa"),
    ("Subclass 457 (Temporary Work", "", "Subclass 457 (T)"),
    ("the\nBusiness Entry (Class UC) visas", "", "Business Entry (Class UC)"),
    ("x", "Lee (Citizenship)", "Citizenship"),
    ("section 501 applies", "", "Character cancellation (s.501)"),
    ("to refuse to grant a Class TU thing", "", "Class TU thing"),
    ("x", "Lee (Migration)", "Migration (general)"),
    ("x", "Lee (Refugee)", "Refugee/Protection"),
    ("complementary protection", "", "Refugee/Protection"),
    ("judicial review", "", "Judicial review (migration)"),
    (None, None, ""),
]


@pytest.mark.parametrize(("said", "title", "want"), VISAS)
def test_visa(said, title, want):
    assert c.visa_in(said, title) == want


CATCHWORDS = [
    ("Catchwords:\nNo Catchwords", "No Catchwords"),
    ("CATCHWORDS: visa refused\t\nAPPLICANT x", "visa refused"),
    ("CATCHWORDS: tiny\n\nKEY WORDS\nlonger words\n\n", "longer words"),
    ("DIVISION:\n Migration & Refugee\nx", "Migration & Refugee"),
    ("catchwords never end", ""),
    (None, ""),
]


@pytest.mark.parametrize(("said", "want"), CATCHWORDS)
def test_catchwords(said, want):
    assert c.catchwords_in(said) == want


def test_reason():
    assert c.reason_in("CATCHWORDS\n\nMIGRATION – visa  refused\n - costs\nLEGISLATION\nx") == "visa refused - costs"
    told = c.reason_in("Catchword: " + "word " * 100 + "\nSTATEMENT OF REASONS")
    assert len(told) <= 303 and told.endswith("word...")
    assert c.reason_in("CATCHWORDS: no end") == c.reason_in("") == c.reason_in(None) == ""


def test_legal_test():
    assert [c.legal_test_in(x) for x in ("under s. 36 of", "S 501 and s36", "section 12. s.48a", "s 24 of the Citizenship Act", "a risk of serious harm", "protection\nobligations")] == [
        "s.36 refugee test", "s.36 refugee test", "s.48A bar on re-application", "s.24 citizenship refusal", "complementary protection", "refugee/protection obligations",
    ]
    assert c.legal_test_in("LEGISLATION\n\nMigration Act s 5 s 359(2) section 65, s 65\nSTATEMENT OF x") == "s.65"
    assert c.legal_test_in("x" * 6000 + "s 36") == c.legal_test_in(None) == ""


HOSTILE = ["ORDER ", "ORDERS\n", "ORDERS: ", "application is ", "application ", "must be ", "DECISION: \n ", "protection (", "protection ", "a (Class XX) ", "CATCHWORDS\n", "CATCHWORDS: x ", "word ", "\n", " ", "writ of x ", "(1) ", "The Tribunal ", "Subclass 1 ", "grant ", "DIVISION:\n", "be granted ", "_"]


@pytest.mark.parametrize("part", HOSTILE)
def test_hostile_texts(part):
    said = part * 100_000
    for read in (c.outcome_in, c.visa_in, c.catchwords_in, c.reason_in, c.legal_test_in):
        began = time.perf_counter()
        read(said)
        assert time.perf_counter() - began < 4, read.__name__


def test_columns(spark):
    df = spark.createDataFrame([("I would allow x\n", "t"), (None, None)], "said string, title string")
    x = F.col("said")
    got = df.select(c.outcome_of(x), c.visa_of(x, F.col("title")), c.catchwords_of(x), c.reason_of(x), c.legal_test_of(x)).collect()
    assert [tuple(r) for r in got] == [("I would allow x", "", "", "", ""), ("",) * 5]
