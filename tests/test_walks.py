"""Carrying forward in pieces, tables of contents, repaired JSON and merged names against plain versions."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from dockmill.functions.json_repair import balanced, closed, first_object, repaired_json
from dockmill.operators import legislation as law
from dockmill.operators.carry import carried
from dockmill.operators.identity import merged_aliases


@pytest.mark.parametrize("pieces", [1, 7, 40])
def test_carried_in_pieces(spark, pieces):
    rng = random.Random(pieces)
    rows = [(rng.choice(["long", "long", "long", "b", None]), k, f"h{k}" if rng.random() < 0.02 else None) for k in range(1500)]
    df = spark.createDataFrame(rows, "grp string, pos int, heading string")
    got = {r.pos: r.out for r in carried(df.repartition(3), "grp", "pos", "heading", "out", pieces).collect()}
    last, want = {}, {}
    for g, k, h in rows:
        last[g] = h or last.get(g)
        want[k] = last[g]
    assert got == want
    assert carried(df.where("false"), "grp", "pos", "heading", "out", pieces).collect() == []


ACT = """<html><body><nav><a href="s9.html">9 Not this</a></nav><div class="x body"><a href="s0.html">0 Before</a>
<h2>Part 1 <i>General</i></h2><a href="s1.html"> 1  Short &lt; title</a><b>Division  1</b><A HREF='S2a.html'>2A Names</a>
<div><strong>Subdivision B</strong><a href="s1.03.html">Unnumbered</a></div><h3>PART 2</h3><a href=s3.html>3 <b>Bold</b> one</a><a href="sch1.html">Schedule</a>
<a href="s1.html">1 Again</a><h4>Party</h4><b>Division 9</b><a href="http://x.org/s4.html">4 Elsewhere</a><a href="s5.html"></a></div><a href="s8.html">8 Behind</a></body></html>"""


def test_sections(spark):
    df = spark.createDataFrame([(1, "http://a.org/act/", ACT), (2, None, None), (3, "", '<a href="s7.html">7 All</a>')], "page_id long, url string, html string")
    got = [tuple(r)[2:] for r in law.sections(df, 5).where("page_id = 1").orderBy("pos").collect()]
    assert got == [
        ("s0", "http://a.org/act/s0.html", "0", "Before", "", ""),
        ("s1", "http://a.org/act/s1.html", "1", "Short &lt; title", "Part 1 General", ""),
        ("S2a", "http://a.org/act/S2a.html", "2A", "Names", "Part 1 General", "Division 1"),
        ("s1.03", "http://a.org/act/s1.03.html", "Unnumbered", "", "Part 1 General", "Subdivision B"),
        ("s3", "http://a.org/act/s3.html", "3", "Bold one", "PART 2", ""),
        ("s5", "http://a.org/act/s5.html", "", "", "PART 2", "Division 9"),
    ]
    assert [r.section_id for r in law.sections(df).where("page_id = 3").collect()] == ["s7"]
    tree = law.nested(law.sections(df)).where("page_id = 1").first().parts
    assert [(p.part, [(d.division, [s.section_id for s in d.sections]) for d in p.divisions]) for p in tree] == [
        ("", [("", ["s0"])]), ("Part 1 General", [("", ["s1"]), ("Division 1", ["S2a"]), ("Subdivision B", ["s1.03"])]), ("PART 2", [("", ["s3"]), ("Division 9", ["s5"])]),
    ]


def test_headings_of_a_page_stay_in_its_row(spark):
    """Rows of one page are read one by one, so a heading of one isn't carried to a link of another."""
    said = [(1, "http://a.org/x/", '<h2>Part 1</h2><b>Division 1</b><a href="s1.html">1 One</a>'), (1, "http://a.org/y/", '<p><p><p><p><p><a href="s2.html">2 Two</a>'), (None, "u", '<a href="s3.html">3 Three</a>')]
    df = spark.createDataFrame(said, "page_id long, url string, html string")
    got = sorted((r.section_id, r.url, r.part, r.division) for r in law.sections(df).collect())
    assert got == [("s1", "http://a.org/x/s1.html", "Part 1", "Division 1"), ("s2", "http://a.org/y/s2.html", "", "")]
    assert law.sections(df.where("false")).collect() == []


def test_containers():
    pages = ['<div id="content"><a href="s1.html">1</a></div><div class="body"><a href="s2.html">2</a></div>', '<div id="textofelements"><div></div><a href="s3.html">3</a></div><a href="s4.html">4</a>', '<script><a href="s5.html">5</a></script><!-- <a href="s6.html"> --><a href="s7.html">7']
    assert [[e[3] for e in law.Page(p).events()] for p in pages] == [["s2.html"], ["s3.html"], ["s7.html"]]


@pytest.mark.parametrize("part", ["<b>", "<h2>Part 1", "<a href='s1.html'>", "<", "<!--", "<div>", "<div class=body>", "<script>", '<a href="', "<b>Part 2</b>", "</b>", "x", "<a href=", "Part "])
def test_hostile_pages(part):
    began = time.perf_counter()
    law.Page(part * 50_000).events()
    assert time.perf_counter() - began < 4


def test_amended_and_search(spark):
    df = spark.createDataFrame([("Series as amended to: 1 December 2025",), ("Authoritative version as at 15 November 2025",), ("as at  2 May 2020",), (None,)], "html string")
    assert [r[0] for r in df.select(law.last_amended(F.col("html"))).collect()] == ["1 December 2025", "15 November 2025", "2 May 2020", ""]
    acts = spark.createDataFrame([("a1", "Migration Act", "visas", "ma", 1), ("a2", "Citizenship", "and migration", "ca", 2), ("a3", None, None, "x", 3)], "id string, title string, description string, shortcode string, sections int")
    assert [r.id for r in law.search(acts, " MIGRATION ").collect()] == ["a1", "a2"] and law.search(acts, "A3").columns == ["id", "title", "description", "shortcode"]


JSON_CASES = [
    ('{"a": 1}', {"a": 1}),
    ('  ```json\n{"a": [1, 2]}\n``` and prose', {"a": [1, 2]}),
    ('Sure! {"a": "b } c", "d": "\\""} Hope it helps {', {"a": "b } c", "d": '"'}),
    ('{"a":1, "b":["x", "incomp', {"a": 1, "b": ["x"]}),
    ('{"a": {"b": 1, "c": {"d": 2}, "e": "f', {"a": {"b": 1, "c": {"d": 2}}}),
    ('{"a": 1, "b": ', {"a": 1}),
    ('{"a": [1, 2], "b": {"c": [3, ', {"a": [1, 2], "b": {"c": [3]}}),
    ('{"a": "never en', None),
    ('{"a": tru', None),
    ("[1, 2]", None),
    ("no json", None),
    ("", None),
    (None, None),
    ('{"a": 1]} {"b": 2}', None),
]


@pytest.mark.parametrize(("said", "want"), JSON_CASES)
def test_first_object(said, want):
    assert first_object(said) == want


def test_every_cut_of_an_object_can_be_read():
    rng = random.Random(2)

    def value(depth):
        kind = rng.randrange(6 if depth < 4 else 4)
        if kind == 4:
            return {f"k{k}": value(depth + 1) for k in range(rng.randrange(4))}
        if kind == 5:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return [rng.randrange(100), 'x"{[,]}\\', True, None][kind]

    def within(part, whole):
        """Whether ``part`` is ``whole`` with ends left off."""
        if isinstance(whole, dict) and isinstance(part, dict):
            return all(k in whole and within(part[k], whole[k]) for k in part)
        if isinstance(whole, list) and isinstance(part, list):
            return len(part) <= len(whole) and all(map(within, part, whole))
        return part == whole

    for _ in range(200):
        whole = {"first": 1, "second": value(0), "third": value(0)}
        said = json.dumps(whole)
        assert balanced("prose " + said + " }") == said == closed(said + " prose")
        for end in range(said.index(",") + 1, len(said)):
            found = first_object(said[:end])
            assert found is not None and found["first"] == 1 and within(found, whole), said[:end]


@pytest.mark.parametrize("part", ["{", "[", '{"a":[', '"', '\\"', '{"a":"', "}", ",", "```json "])
def test_hostile_json(part):
    began = time.perf_counter()
    first_object("{" + part * 100_000)
    assert time.perf_counter() - began < 4


def test_repaired_column(spark):
    df = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(JSON_CASES)], "k int, s string")
    got = {r.k: r.j for r in df.select("k", repaired_json(F.col("s")).alias("j")).collect()}
    assert got == {k: None if w is None else json.dumps(w, separators=(",", ":")) for k, (_, w) in enumerate(JSON_CASES)}


def test_merged_aliases(spark):
    rows = [(1, "Justice Smith"), (2, "Mr John Smith"), (3, "John Smith AM"), (4, "Jane Smith"), (5, "John Smith"), (6, ""), (7, None), (8, "Ann Roe")]
    merged, conflicts = merged_aliases(spark.createDataFrame(rows, "place int, name string"))
    owners = {r.alias: r.canonical for r in merged.collect()}
    assert owners["smith"] == "Justice Smith" and owners["john smith"] == "John Smith AM" and owners["ann roe"] == owners["roe"] == "Ann Roe"
    told = {r.alias: (r.canonical, r.other) for r in conflicts.collect()}
    assert told["smith"] == ("Justice Smith", "John Smith AM") and told["j smith"] == ("John Smith AM", "Jane Smith") and "john smith" not in told and "roe" not in told
