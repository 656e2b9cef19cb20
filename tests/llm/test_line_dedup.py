"""Repeated lines against a plain version, and the runs' levels."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from dockmill.llm import line_dedup
from dockmill.llm.common import table
from dockmill.llm.line_dedup import LineRuns
from tests.oracle import compare, connect

BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute(rows, min_chars=40, min_docs=5):
    docs = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            docs[ascii_lower(line.strip(BLANKS))].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            key = ascii_lower(line.strip(BLANKS))
            owner = max((d for d in docs[key] if d is not None), default=None)
            if len(key) < min_chars or len(docs[key]) < min_docs or doc_id == owner:
                kept.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def odd_rows(seed, n):
    rng = random.Random(seed)
    lines = ["a line that many documents repeat, number %d, is this" % k for k in range(12)]
    lines += [s.upper() for s in lines[:4]] + [f"  \t{s}\r" for s in lines[:4]] + ["É" * 39, "É" * 40, "é" * 40, " " * 60, "", "x" * 39, "x" * 40, "\x0bA short line", "Ǆ" + "y" * 41, "ǆ" + "y" * 41, " " + "z" * 45, "z" * 45, "İ" * 41]
    rows = [(rng.choice([k, k, k, 7, -k]), "\n".join(rng.choices(lines, k=rng.randrange(9)))) for k in range(n)]
    return [*rows, (n + 1, None), (n + 2, ""), (n + 3, "\n\n"), (None, "\n".join(lines)), (None, lines[2]), rows[5], rows[5], (n + 4, "\n".join(f"{k % 13} own and long line of a very long document {k}" for k in range(30_000)) + "\n" + lines[0])]


@pytest.mark.parametrize("batches", [1, 5])
def test_rows(spark, batches):
    rows = odd_rows(batches, 120)
    df = spark.createDataFrame([(*r, 1, 2, 3, "x", [1]) for r in rows], "doc_id long, text string, h1 long, pos int, batch int, kept string, lines array<int>")
    got = line_dedup.drop_repeated_lines(df.repartition(5), batches=batches, fanout=2).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    assert sum(r.n_dropped for r in got) > 100


def test_empty_tables_and_texts(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.drop_repeated_lines(df).collect() == []
    nulls = spark.createDataFrame([(None, None)] * 7, "doc_id long, text string")
    assert [tuple(r) for r in line_dedup.drop_repeated_lines(nulls).collect()] == [(None, 1, 0, "")] * 7


def test_beyond_the_broadcast_bounds(spark, monkeypatch):
    rows = odd_rows(11, 150)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("BROADCAST_KEYS", "BROADCAST_ROWS"):
        monkeypatch.setattr(line_dedup, name, 0)
    found = line_dedup.drop_repeated_lines(df)
    assert "ShuffledHashJoin" in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_runs_count_and_own_as_if_added_at_once(spark):
    rng = random.Random(3)
    batches = [[(1000 - 100 * b - k, rng.randrange(40), 5) for k in range(60) for _ in range(2)] for b in range(5)]
    runs, seen = LineRuns(spark, fanout=3, buckets=4), set()
    for rows in batches:
        df = spark.createDataFrame(rows, "doc_id long, h1 long, h2 long")
        assert {r.h1 for r in runs.new_keys(df).collect()} == {h for _, h, _ in rows} - seen
        seen |= {h for _, h, _ in rows}
        runs.add(df)
        assert all(len(level) < 3 for level in runs.levels)
    assert [len(level) for level in runs.levels] == [2, 1]  # five batches by threes
    want = defaultdict(set)
    for rows in batches:
        for d, h, _ in rows:
            want[h].add(d)
    assert {(r.h1, r.docs, r.owner) for r in runs.totals().collect()} == {(h, len(d), max(d)) for h, d in want.items()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = runs.anti_joined(df)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == plan.count("Bucketed: true") == 3  # runs are joined where they lie
    runs.clear()
    assert runs.totals().count() == 0


def test_line_key_is_ascii_lower(spark):
    lines = ["ABCxyz", " É A ", "İI", "", "ß Z", "Ω K"]
    got = spark.createDataFrame([(x,) for x in lines], "x string").select(line_dedup.line_key(F.col("x"))).collect()
    assert [r[0] for r in got] == [ascii_lower(x.strip(BLANKS)) for x in lines]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(line_dedup.op11_line_dedup(spark, sf), connect(sf), line_dedup.ORACLE_SQL) == ""
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    want = [(a, n, d, hashlib.sha256(t.encode()).hexdigest()) for a, n, d, t in brute(rows)]
    assert sorted(map(tuple, line_dedup.op11_line_dedup(spark, sf).collect())) == sorted(want)
