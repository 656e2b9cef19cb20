"""Search results, batches of answers, files and reports."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from dockmill.operators import rows as r
from dockmill.sinks import files
from dockmill.sources import cases as s
from dockmill.sources import scans

RESULTS = """<html><ul><li class="search-result"><a href="/au/cases/cth/AATA/2024/5.html">Lee <b>v</b> Roe [2024] AATA 5</a> <span class="my-abstract">A <i>short</i> one</span></li>
<li class="hit"><a href="/au/cases/cth/FCA/2024/6.html">Other court</a></li><li class="other"><a href="/au/cases/cth/AATA/2024/7.html">No result</a></li>
<tr class="result"><td><a name="x">no link</a><a href='http://x.org/au/cases/cth/AATA/n.html'>Second</a></td></tr><div class=hit>no link</div></ul><a href="/au/cases/cth/AATA/2023/9.html">Behind</a></html>"""
PLAIN = '<a href="/au/cases/cth/AATA/2021/3.html">Third</a><a href="/au/cases/cth/AATA/">Index</a><a href="/au/cases/cth/HCA/2021/3.html">HCA</a><a>none</a><a href="/au/cases/cth/AATA/2021/4.html">'


def test_hits(spark):
    df = spark.createDataFrame([(1, RESULTS), (2, PLAIN), (3, None), (4, "")], "page_id long, html string")
    got = [tuple(x)[0:1] + tuple(x)[2:] for x in scans.search_hits(df, "AATA", "http://www.a.org").orderBy("page_id", "pos").collect()]
    assert got == [
        (1, "LeevRoe [2024] AATA 5", "http://www.a.org/au/cases/cth/AATA/2024/5.html", 2024, "Ashortone", "[2024] AATA 5"),
        (1, "Second", "http://x.org/au/cases/cth/AATA/n.html", 0, "", ""),
        (2, "Third", "http://www.a.org/au/cases/cth/AATA/2021/3.html", 2021, "", ""),
        (2, "", "http://www.a.org/au/cases/cth/AATA/2021/4.html", 2021, "", ""),
    ]


@pytest.mark.parametrize("part", ["<div class=result>", "<li class='hit'><a href='/au/cases/cth/AATA/1.html'>", "<a href='/au/cases/cth/AATA/1.html'>x", "</div>", "<div class='hit snippet'>", "<"])
def test_hostile_results(part):
    began = time.perf_counter()
    scans.hits_of(part * 30_000, "AATA", "http://a.org")
    assert time.perf_counter() - began < 4


def test_later_batches_count(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value))

    put("batch_001_results.json", [{"case_id": "a", "v": 1}, {"case_id": "b", "v": 1}, {"case_id": "", "v": 9}, {"v": 9}])
    put("batch_010_results.json", [{"case_id": "a", "v": 3}, {"case_id": "c", "v": 1}, {"case_id": "c", "v": 2}])
    put("batch_002_results.json", [{"case_id": "a", "v": 2}, {"case_id": "b", "v": 2}])
    put("batch_011_results.json", "{broken")
    got = scans.read_batches(spark, f"{tmp_path}/batch_*_results.json", "case_id string, v int", "case_id")
    assert sorted(map(tuple, got.collect())) == [("a", 3), ("b", 2), ("c", 2)]
    assert [x.file for x in scans.broken_batches(spark, f"{tmp_path}/*.json", "case_id string, v int").collect()] == ["batch_011_results.json"]


def cases(spark):
    rows = [("3", "C \"x\", <y>", "AATA", 2020, None), ("1", "A\nb", "FCA", 0, "x"), ("2", "B", "", 2022, "Ü")]
    return spark.createDataFrame(rows, "case_id string, title string, court string, year int, outcome string")


def parts(path):
    return [p.read_text(encoding="utf-8") for p in sorted(Path(path).glob("part-*"))]


def test_csv_has_a_mark_and_comes_back(spark, tmp_path):
    path = str(tmp_path / "csv")
    files.write_csv(cases(spark).coalesce(1), path, ["title", "case_id", "court", "year"])
    assert parts(path)[0].startswith("﻿title,case_id,court,year\n")
    back = s.read_csv(spark, path)
    assert sorted((x.case_id, x.title, x.year) for x in back.collect()) == [("1", "A\nb", 0), ("2", "B", 2022), ("3", 'C "x", <y>', 2020)]


@pytest.mark.parametrize("n", [3, 0])
def test_json_is_one_object(spark, tmp_path, n):
    path = str(tmp_path / "json")
    files.write_json(cases(spark).limit(n) if n else cases(spark).where("false"), path)
    told = json.loads("".join(parts(path)))
    assert [c["case_id"] for c in told["cases"]] == ["1", "2", "3"][:n] and told["total_cases"] == n
    if n:
        assert (told["courts"], told["year_range"]) == (["AATA", "FCA"], {"min": 2020, "max": 2022}) and told["cases"][2]["outcome"] is None
        assert s.read_json(spark, path).count() == 3 or len(parts(path)) > 1


def test_exports(spark):
    assert [x.case_id for x in files.export_rows(cases(spark).repartition(3), limit=2).collect()] == ["1", "2"]
    assert [x.case_id for x in files.stream_rows(cases(spark)).collect()] == ["2", "3", "1"]
    notes = spark.createDataFrame([("3", "look <here>"), ("2", " ")], "case_id string, note string")
    got = [x.html for x in files.report(cases(spark).withColumn("citation", F.lit("[1] x")), notes).orderBy("place").collect()]
    assert got[0] == "<article><h2>B</h2><p>[1] x · 2022 · Ü</p></article>"
    assert got[1] == "<article><h2>C &quot;x&quot;, &lt;y&gt;</h2><p>[1] x · AATA · 2020</p><blockquote>look &lt;here&gt;</blockquote></article>"


def test_sample_in_blocks(spark):
    df = spark.createDataFrame([(k, "big" if k < 900 else "small") for k in range(905)], "k long, court string")
    got = r.stratified_blocks(df, "court", "k", 5, 10).collect()
    assert {c: sum(x.court == c for x in got) for c in ("big", "small")} == {"big": 45, "small": 1}
    assert {x.block for x in got if x.court == "big"} == {0, 1, 2, 3, 4} and len({x.k for x in got}) == 46


def test_full_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Title: x\nCourt: y\n==========\n\n  Body\ttext \n")
    (tmp_path / "b.txt").write_text(" no header ")
    assert sorted(x.body for x in s.read_full_texts(spark, f"{tmp_path}/*.txt").collect()) == ["Body\ttext", "no header"]
