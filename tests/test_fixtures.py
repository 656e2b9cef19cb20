"""The pinned totals of the small case collections."""

import pytest
from pyspark.sql import functions as F

from dockmill.functions import cases as c
from dockmill.functions import names
from dockmill.functions.vocabulary import CONCEPTS
from dockmill.operators import analytics as a
from dockmill.operators import identity, profiles, retrieval, rows

TWELVE = [
    ("[2020] AATA 100", "AATA", 2020, "Remitted", "Member Alpha", "866", "Protection", "Complementary Protection; Non-refoulement"),
    ("[2021] AATA 101", "AATA", 2021, "Set Aside", "Member Alpha", "866", "Protection", "Well-founded Fear; Complementary Protection"),
    ("[2021] AATA 102", "AATA", 2021, "Affirmed", "Member Alpha", "500", "Protection", "Well-founded Fear"),
    ("[2022] AATA 103", "AATA", 2022, "Dismissed", "Member Beta", "790", "Cancellation", "Procedural Fairness"),
    ("[2023] ARTA 110", "ARTA", 2023, "Remitted", "Member Alpha", "866", "Protection", "Complementary Protection; Non-refoulement"),
    ("[2020] FCA 200", "FCA", 2020, "Allowed", "Justice Gamma", "500", "Judicial Review", "Jurisdictional Error; Procedural Fairness"),
    ("[2021] FCA 201", "FCA", 2021, "Set Aside", "Justice Gamma", "500", "Judicial Review", "Procedural Fairness"),
    ("[2022] FCA 202", "FCA", 2022, "Dismissed", "Justice Delta", "189", "Appeal", "Merits Review"),
    ("[2024] FCA 203", "FCA", 2024, "Allowed", "Justice Delta", "866", "Judicial Review", "Complementary Protection"),
    ("[2023] FedCFamC2G 300", "FedCFamC2G", 2023, "Allowed", "Judge Epsilon", "500", "Judicial Review", "Jurisdictional Error"),
    ("[2024] HCA 10", "HCA", 2024, "Dismissed", "Chief Justice Zeta", "", "Constitutional", "Constitutional Law"),
    ("[2024] RRTA 40", "RRTA", 2024, "Remitted", "Member Beta", "866", "Protection", "Non-refoulement; Well-founded Fear"),
]


def with_outcomes(df):
    """Raw cases with a normalised outcome, whether won, and judges' names."""
    df = df.withColumn("outcome", c.normalise_outcome(F.col("outcome")))
    return names.with_judges(df.withColumn("won", c.is_win(F.col("outcome"), F.col("court"))))


@pytest.fixture(scope="module")
def cases(spark):
    df = spark.createDataFrame(TWELVE, "citation string, court string, year int, outcome string, judges string, subclass string, nature string, concepts_raw string")
    return with_outcomes(df.withColumn("case_id", F.col("citation"))).cache()


@pytest.fixture(scope="module")
def tagged(cases):
    return a.with_concepts(cases, cases.select("case_id", "concepts_raw"), CONCEPTS).cache()


def told(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: (r.total, r.wins, r.win_rate) for r in df.collect()}


def test_overall_and_groups(cases):
    assert told(a.success(cases, F.lit("all").alias("k")), "k") == {"all": (12, 8, 66.7)}
    assert {k: x[:2] for k, x in told(a.success(cases, "court"), "court").items()} == {"AATA": (4, 2), "ARTA": (1, 1), "FCA": (4, 3), "FedCFamC2G": (1, 1), "HCA": (1, 0), "RRTA": (1, 1)}
    assert {k: x[:2] for k, x in told(a.success(cases, "year"), "year").items()} == {2020: (2, 2), 2021: (3, 2), 2022: (2, 0), 2023: (2, 2), 2024: (3, 2)}
    family = c.family(F.col("subclass"))
    got = told(a.success(cases.where("subclass <> ''"), family.alias("family")), "family")
    assert (got["Protection"], got["Student"], got["Skilled"]) == ((6, 5, 83.3), (4, 3, 75.0), (1, 0, 0.0))
    assert a.filter_cases(cases, subclasses=["999"]).count() == 0


def test_concepts(cases, tagged):
    got = {r.concept: (r.total, r.wins, r.win_rate, r.lift) for r in a.concept_effect(cases, tagged).collect()}
    assert got == {
        "Complementary Protection": (4, 4, 100.0, 1.5), "Well-Founded Fear": (3, 2, 66.7, 1.0), "Procedural Fairness": (3, 2, 66.7, 1.0),
        "Jurisdictional Error": (2, 2, 100.0, 1.5), "Judicial Review": (1, 0, 0.0, 0.0),
    }
    pairs = {(r.concept_a, r.concept_b): r.total for r in a.concept_combinations(tagged, 2, least=1).collect()}
    assert pairs == {("Complementary Protection", "Well-Founded Fear"): 1, ("Jurisdictional Error", "Procedural Fairness"): 1}
    assert a.concept_combinations(tagged, 2, least=999).count() == 0
    growth = {r.concept: r.growth for r in a.concept_growth(tagged, 2024).collect()}
    assert growth == {"Complementary Protection": 100.0, "Jurisdictional Error": 100.0, "Well-Founded Fear": -50.0, "Procedural Fairness": -100.0, "Judicial Review": -100.0}


def judged_of(cases):
    judged = cases.withColumn("judge", F.explode("judge_names")).withColumn("concepts", c.split_concepts(F.col("concepts_raw")))
    return judged.withColumns({"represented": F.lit("Yes"), "country": F.lit(" Iran "), "decided": F.lit(None).cast("date")})


def test_judges(cases):
    board = {r.judge: r for r in profiles.summaries(judged_of(cases)).collect()}
    assert {k: (r.total, r.wins) for k, r in board.items()} == {"Alpha": (4, 3), "Beta": (2, 1), "Gamma": (2, 2), "Delta": (2, 1), "Epsilon": (1, 1), "Zeta": (1, 0)}
    alpha = board["Alpha"]
    assert (alpha.approval_rate, alpha.courts, alpha.court_type, alpha.first_year, alpha.last_year, alpha.primary_court) == (75.0, ["AATA", "ARTA"], "tribunal", 2020, 2023, "AATA")
    assert alpha.outcomes == {"Affirmed": 1, "Remitted": 2, "Set Aside": 1} and [tuple(x) for x in alpha.top_subclasses] == [("866", 3), ("500", 1)]
    assert board["Gamma"].court_type == "court" and board["Zeta"].top_subclasses == []


@pytest.fixture(scope="module")
def two_judges(spark):
    """Seven cases of one judge with four wins, five of another with three."""
    one = [(f"[{2020 + k % 4}] AATA {k}", "AATA", 2020 + k % 4, "Remitted" if k < 4 else "Affirmed", "Member Alpha", "866", "Protection", "Complementary Protection") for k in range(7)]
    two = [(f"[{2020 + k}] FCA {k}", "FCA", 2020 + k, "Allowed" if k < 3 else "Dismissed", "Justice Beta", "500", "Judicial Review", "Procedural Fairness") for k in range(5)]
    df = spark.createDataFrame(one + two, "citation string, court string, year int, outcome string, judges string, subclass string, nature string, concepts_raw string")
    return judged_of(with_outcomes(df.withColumn("case_id", F.col("citation")))).cache()


def test_profiles(two_judges):
    rates = two_judges.sparkSession.createDataFrame([("AATA", 50.0), ("HCA", 10.0)], "court string, rate double")
    got = {(r.judge, r.section, r.key): r for r in profiles.profiles(two_judges, rates).collect()}
    assert (got["Alpha", "all", "all"].total, got["Alpha", "all", "all"].win_rate, got["Beta", "all", "all"].win_rate) == (7, 57.1, 60.0)
    court = got["Alpha", "court", "AATA"]
    assert (court.win_rate, court.baseline, court.delta) == (57.1, 50.0, 7.1) and got["Beta", "court", "FCA"].delta is None
    concept = got["Beta", "concept", "Procedural Fairness"]
    assert (concept.total, concept.baseline, concept.lift) == (5, 60.0, 1.0)
    assert sorted(k for j, s, k in got if (j, s) == ("Beta", "recent")) == ["2022", "2023", "2024"] and [got["Beta", "year", str(y)]["rank"] for y in range(2020, 2025)] == [1, 2, 3, 4, 5]
    assert got["Alpha", "representation", "represented"].total == 7 and got["Alpha", "country", "Iran"].total == 7
    assert {s for _, s, _ in got} == {*profiles.SECTIONS, "recent"}


def test_leaderboard(two_judges):
    def order(**options):
        return [(r.judge, r.total_judges) for r in profiles.leaderboard(two_judges, **options).collect()]

    assert order() == [("Alpha", 2), ("Beta", 2)] and order(by="approval_rate") == [("Beta", 2), ("Alpha", 2)] and order(by="name", limit=1) == [("Alpha", 2)]
    assert order(min_cases=6) == [("Alpha", 1)] and order(name=" BET ") == [("Beta", 1)] and order(name="nobody") == []
    with pytest.raises(ValueError):
        order(by="court")


def test_leaderboard_needs_no_concepts(two_judges):
    """A board is told from a judge's cases alone, so concepts need not be joined to them."""
    narrow = two_judges.drop("concepts", "nature", "country")
    assert sorted(map(str, profiles.leaderboard(narrow).collect())) == sorted(map(str, profiles.leaderboard(two_judges).collect()))


def test_comparison(two_judges):
    got = profiles.compared(two_judges, ["beta", "Alpha ", "BETA", "Nobody"]).where("section = 'all'").orderBy("place").collect()
    assert [(r.place, r.judge, r.total, r.win_rate) for r in got] == [(1, "Beta", 5, 60.0), (2, "Alpha", 7, 57.1), (3, "nobody", 0, 0.0)]
    for some in (["Alpha"], ["a", "b", "c", "d", "e"], ["Alpha", " alpha"]):
        with pytest.raises(ValueError):
            profiles.compared(two_judges, some)


def test_recent_cases(two_judges):
    got = [(r.judge, r.case_id) for r in profiles.recent_cases(two_judges, 2).orderBy("judge", "rank").collect()]
    assert got == [("Alpha", "[2023] AATA 3"), ("Alpha", "[2022] AATA 6"), ("Beta", "[2024] FCA 4"), ("Beta", "[2023] FCA 3")]


def test_odd_profiles(spark):
    schema = "judge string, case_id string, court string, year int, decided date, outcome string, won boolean, subclass string, nature string, concepts array<string>, represented string, country string"
    odd = spark.createDataFrame([("X", "1", None, 0, None, None, None, "", None, None, None, None)], schema)
    assert [(r.section, r.total, r.wins, r.win_rate) for r in profiles.profiles(odd).collect()] == [("all", 1, 0, 0.0)]
    r = profiles.summaries(odd).first()
    assert (r.courts, r.court_type, r.first_year, r.outcomes, r.unknown_representation) == ([], "unknown", None, {}, 1)
    none = odd.where("false")
    assert profiles.profiles(none).count() == profiles.summaries(none).count() == profiles.leaderboard(none).count() == profiles.recent_cases(none).count() == 0


def test_conformance_pair(spark):
    pair = [("1", "[2024] AATA 100", "AATA", 2024, "Affirmed", "Character Test; Section 501"), ("2", "[2023] FCA 200", "FCA", 2023, "Allowed", "Procedural Fairness; Natural Justice")]
    df = spark.createDataFrame(pair, "case_id string, title string, court string, year int, outcome string, concepts string")
    assert [r.case_id for r in rows.keyword_filter(df, "natural", ["title", "concepts"]).collect()] == ["2"]
    assert [r.case_id for r in a.filter_cases(df, courts=["AATA"]).collect()] == ["1"]
    changed = spark.createDataFrame([("2", "[2023] FCA 200", "FCA", 2023, "Dismissed", ""), ("3", "n", "HCA", 2022, "", "")], df.schema)
    assert {r.case_id: r.outcome for r in rows.upsert(df, changed, "case_id").collect()} == {"1": "Affirmed", "2": "Dismissed", "3": ""}


def test_taxonomy(spark):
    df = spark.createDataFrame([("866", "China", "Smith"), ("866", "India", "Smith"), ("500", "China", "Jones"), ("785", "", "")], "subclass string, country string, judge string")
    assert {r.subclass: r["count"] for r in df.groupBy("subclass").count().collect()}["866"] == 2
    registry = spark.createDataFrame([("866", "Protection"), ("785", "Temporary Protection"), ("050", "Bridging")], "number string, name string")
    counts = df.groupBy(F.col("subclass").alias("number")).agg(F.count(F.lit(1)).alias("n"))
    filed = a.with_registry(counts, registry, "number")
    assert [(r.number, r.n, r.exact) for r in identity.registry_search(filed, "866").collect()] == [("866", 2, True)]
    assert [r.number for r in identity.registry_search(filed, "PROTECTION").collect()] == ["866", "785"]


def test_retrieval(spark):
    found = spark.createDataFrame([("q1", d, k + 1) for k, d in enumerate(["d3", "d1", "d2"])] + [("q2", d, k + 1) for k, d in enumerate(["d4", "d5", "d6"])], "query string, doc string, rank int")
    relevant = spark.createDataFrame([("q1", "d1"), ("q1", "d2"), ("q2", "d4")], "query string, doc string")
    at_one, at_three = (retrieval.retrieval_measures(found, relevant, k).agg(F.avg("recall"), F.avg("rr")).first() for k in (1, 3))
    assert at_one[0] == 0.5 and at_three[1] == 0.75
    lists = [spark.createDataFrame([("q", d, k + 1) for k, d in enumerate(x)], "query string, doc string, rank int") for x in (["d1", "d2", "d3"], ["d3", "d1", "d4"])]
    best = retrieval.fuse([(lists[0], 0.5), (lists[1], 0.5)], 2).collect()
    assert "d1" in {r.doc for r in best}
    vectors = spark.createDataFrame([("d1", [1.0, 0.0]), ("d2", [0.0, 1.0]), ("d3", [0.0, 0.0])], "id string, vector array<double>")
    ask = spark.createDataFrame([("q", [0.0, 2.0])], "id string, vector array<double>")
    assert [r.doc for r in retrieval.rerank(lists[0], vectors, ask, 3).orderBy("rank").collect()] == ["d2", "d1", "d3"]


def test_merged_names(spark):
    df = spark.createDataFrame([("Smith", "Smith J", 100, 75), ("Smith", "SMITH", 50, 40), ("Roe", "Roe", 0, 0)], "surname string, name string, case_count long, wins long")
    got = {r.surname: r for r in identity.merged_records(df, "surname").collect()}
    assert (got["Smith"].canonical_name, got["Smith"].case_count, got["Smith"].wins, got["Roe"].success_rate) == ("Smith J", 150, 115, 0.0)


def test_name_columns(spark):
    df = spark.createDataFrame([(1, "Justice John SMITH J"), (2, None), (3, "Justice John SMITH J")], "k int, raw string")
    got = {r.k: r for r in names.with_surname_key(names.with_display_name(names.with_aliases(df, "raw"), "raw"), "raw").collect()}
    assert got[1].display_name == "John Smith" and got[1].surname == "smith" and got[3].aliases == got[1].aliases and "j. smith" in got[1].aliases and got[2].surname == ""
