"""Groups of alike names against a reader with a list, and judges told apart by context."""

import random

import pytest
from pyspark.sql import functions as F

from dockmill.functions import names
from dockmill.functions import vocabulary as v
from dockmill.operators import likeness as li


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for k, y in enumerate(b):
            row[k + 1] = before[k] + 1 if x == y else max(row[k], before[k + 1])
    return row[-1]


def greedy(keys, share=li.ALIKE):
    """The leader of each key, by reading the list from the top."""
    leaders, out = [], {}
    for k in keys:
        if k not in out:
            out[k] = next((x for x in leaders if 2 * plain_common(x, k) >= share * (len(x) + len(k)) - 1e-9), k)
            if out[k] == k:
                leaders.append(k)
    return out


def near_names(rng, n):
    """Names in chains, each made from an earlier one by small changes."""
    made = ["aaaaaaaaaa", "aaaaaaaaab", "aaaaaaaabb", "aaaaaaabbb", "ab", "abc", "a", "b", "ba"]
    while len(made) < n:
        if rng.random() < 0.3:
            made.append("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(1, 15))))
            continue
        x = list(rng.choice(made))
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(x) + 1)
            if rng.random() < 0.5:
                x.insert(at, rng.choice("abcdé"))
            elif at < len(x):
                x[at] = rng.choice(["", "z", "q"])
        made.append("".join(x) or "a")
    return made


def test_common_length():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choices("abcé", k=rng.randrange(12))) for _ in range(2))
        assert li.common_length(a, b) == plain_common(a, b)


@pytest.mark.parametrize("share", [0.85, 0.9, 0.6])
def test_alike_names_share_as_many_grams_as_promised(share):
    rng, met = random.Random(2), 0
    made, size = near_names(rng, 700), li.gram_size(share)
    for a in made:
        for b in rng.sample(made, 60):
            if a != b and li.alike(a, b, share):
                met += 1
                both = len(set(li.grams(a, size)) & set(li.grams(b, size)))
                assert both >= max(1, li.least_shared(len(a), share, size), li.least_shared(len(b), share, size)), (a, b)
    assert met > 20


@pytest.mark.parametrize(("share", "n"), [(0.85, 5000), (0.7, 400)])
def test_groups_equal_the_reader(spark, share, n):
    keys = near_names(random.Random(n), n)
    rows = [(k, key) for k, key in enumerate(keys)] + [(n, ""), (n + 1, None)]
    got = {r.key: r.leader for r in li.alike_groups(spark.createDataFrame(rows, "place long, key string"), "key", "place", share).collect()}
    want = greedy(keys, share)
    assert {k: x for k, x in got.items() if k} == want
    assert got[""] is None and got[None] is None and len(set(want.values())) < len(want)


def test_no_names(spark):
    df = spark.createDataFrame([], "place long, key string")
    assert li.alike_groups(df, "key", "place").collect() == []
    one = spark.createDataFrame([(2, "lee"), (1, "lee"), (3, "smith")], "place long, key string")
    assert {(r.place, r.leader) for r in li.alike_groups(one, "key", "place").collect()} == {(1, "lee"), (2, "lee"), (3, "smith")}


def plain_context(raw, court, year):
    """The rules as they are told: who a surname is, by court and year."""
    words = [w.lower() for w in names.display_name(raw).replace(".", " ").split()]
    at_court, at_tribunal = court in v.COURTS, court in v.TRIBUNALS
    if not words:
        return None
    last, initial = words[-1], words[0] if len(words) > 1 else ""
    if {"graham", "friedman"} <= set(words):
        return "Graham Friedman"
    if last == "graham":
        if at_court:
            return "Peter Ross Graham KC"
        if "ann" in words:
            return "Ann Graham"
        if court == "MRTA" and len(words) == 1 and year:
            return "Graham Friedman" if year <= 2001 else "Ann Graham"
    if last == "murphy":
        if at_court:
            return "Bernard Michael Murphy"
        for first in ("alison", "jade", "peter"):
            if first in words or initial == first[0]:
                return f"Member {first.title()} Murphy"
    if last == "downes":
        if "tegen" in words or initial == "t":
            return "Tegen Downes"
        if at_court and year >= 2021:
            return "Kylie Elizabeth Downes"
        if at_tribunal and year >= 2022:
            return "Tegen Downes"
        if (at_court or at_tribunal) and 0 < year <= 2012:
            return "Garry Keith Downes AM KC"
    return None


def test_judges_of_one_surname(spark):
    rng = random.Random(4)
    raws = ["Graham", "Justice Graham", "Ann Graham", "Graham Friedman", "Friedman", "A Murphy", "Jade Murphy", "Member Peter Murphy", "Murphy", "Downes", "T Downes", "Tegen Downes", "Smith", "", None, "P. Murphy", "Justice Downes"]
    rows = [(k, rng.choice(raws), rng.choice(["MRTA", "RRTA", "AATA", "FCA", "HCA", "", None]), rng.choice([0, None, 2001, 2002, 2012, 2013, 2021, 2022])) for k in range(600)]
    people = spark.createDataFrame(rows, "id long, raw string, court string, year int")
    people = names.with_parts(names.with_surname_key(people, "raw"), "raw")
    group = F.when(F.col("court").isin(v.COURTS), "court").when(F.col("court").isin(v.TRIBUNALS), "tribunal")
    rules = spark.createDataFrame(v.CONTEXT_RULES, "surname string, part string, court string, court_group string, year_from int, year_to int, priority int, person string")
    got = {r.id: r.resolved for r in li.in_context(people.withColumn("court_group", group), rules).collect()}
    assert got == {k: plain_context(raw, court, year or 0) for k, raw, court, year in rows}
    assert None in got.values() and len(set(got.values())) > 8
