"""Collocations against a plain version, over phrases of any length."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from dockmill.llm import collocations as C
from tests.oracle import compare, connect


def brute(rows, words=3, min_count=10, top=2000, covered=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, words + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    candidates = {x: c for x, c in f.items() if len(x[1]) > 1 and c >= min_count}
    found = {}
    for (lang, p), a in candidates.items():
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(g == lang and len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), b in candidates.items())
        if not inside:
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r + 1, p.decode(), -a, le, ri, n[lang], -s) for lang, rows in found.items() for r, (s, a, p, le, ri) in enumerate(sorted(rows)[:top]))


def odd_rows(seed, n):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "b", "new", "york", "City", "é", "É", "\x00", "x\x0by", "q,", "z.", "\xa0", "w", "𝒳", "a\tb", "end!"]
    weights = [9, 5, 5, 8, 8, 6, 2, 2, 1, 1, 2, 2, 1, 3, 2, 2, 1]
    rows = [(rng.choice(["en", "en", "en", "de", None, "und", ""]), " ".join(rng.choices(vocabulary, weights, k=rng.randrange(30)))) for _ in range(n)]
    return [*rows, ("en", None), (None, ""), ("fr", "new york city " * 12), rows[3], rows[3], ("en", "a\nb\r\nc  \t d;;new york")]


@pytest.mark.parametrize(("words", "min_count", "top"), [(3, 10, 2000), (2, 3, 5), (4, 4, 50)])
def test_rows(spark, words, min_count, top):
    rows = odd_rows(words, 150)
    df = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], "lang string, text string, f long, phrase string, rank int")
    got = C.collocations(df.repartition(3), words=words, min_count=min_count, top=top).collect()
    assert sorted(map(tuple, got)) == brute(rows, words, min_count, top)
    assert len({r.lang for r in got}) > 2


def test_flushes_and_full_bit_sets_change_nothing(spark, monkeypatch):
    rows = odd_rows(8, 200)
    monkeypatch.setattr(C, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(C, "MOST_BITS", 64)
    monkeypatch.setattr(C, "BUCKET_WORDS", 100)
    known = np.full(1 << 10, np.uint64(2**64 - 1))  # everything seems frequent
    monkeypatch.setattr(C, "bit_set", lambda level: known)
    got = C.collocations(spark.createDataFrame(rows, "lang string, text string"), top=None).collect()
    assert sorted(map(tuple, got)) == brute(rows, top=10**9)


def test_small_flushes():
    rows, counts = [("en" if k % 3 else "de", t or "") for k, (_, t) in enumerate(odd_rows(9, 300))], {}
    for limit in (10**9, 50):
        counter, total = C.Counter(1, None), Counter()
        for lang, text in rows:
            counter.add(lang, text.encode())
            if counter.size >= limit:
                for b in counter.rows():
                    total.update({(r["lang"], r["phrase"]): r["f"] for r in b.to_pylist()} if limit > 50 else Counter({(r["lang"], r["phrase"]): r["f"] for r in b.to_pylist()}))
        for b in counter.rows():
            total.update(Counter({(r["lang"], r["phrase"]): r["f"] for r in b.to_pylist()}))
        counts[limit] = total
    assert counts[50] == counts[10**9]


def test_distinct_phrases_of_few_and_of_many_words():
    rng = np.random.default_rng(2)
    for words in (3, 50, 3_000_000):
        used = np.sort(rng.choice(10 * words, words, replace=False))
        columns = list(rng.choice(rng.integers(0, words, 7), (3, 500)))
        parts, counts = C._distinct(columns, used)
        want = Counter(zip(*(used[c].tolist() for c in columns)))
        assert dict(zip(zip(*(p.tolist() for p in parts)), counts.tolist())) == want
    assert [len(p) for p in C._distinct([np.empty(0, np.int64)] * 2, np.empty(0, np.int64))[0]] == [0, 0]


def test_only_phrases_of_frequent_parts_are_emitted(spark):
    level = spark.createDataFrame([("en", "a"), ("en", "b"), ("de", "c")], "lang string, phrase string")
    rows = spark.createDataFrame([("en", "a b c a, b a b"), ("de", "a b c c")], "lang string, text string")
    got = {(r.lang, r.phrase, r.f) for r in C.count_phrases(rows, 2, C.bit_set(level), 1, 20).collect()}
    assert got == {("en", "a b", 2), ("en", "b a", 1), ("de", "c c", 1)}


def test_large_counts_stay_exact(spark):
    big = 9_000_000_000_000_001
    one = spark.createDataFrame([("x", "a", big), ("x", "b", big - 2)], "lang string, phrase string, f long")
    two = spark.createDataFrame([("x", "a b", big - 4)], "lang string, phrase string, f long")
    got = C.score_cuts(C.with_parts(two, C.with_parts(one, None, 1), 2), 2).first()
    assert (got.l, got.r, got.score) == (big, big - 2, 1000000 * (big - 4) ** 2 // (big * (big - 2)))


def test_a_very_long_text_and_no_text(spark):
    text = "one two three four " * 60_000 + "x" * 100_000
    got = C.collocations(spark.createDataFrame([("en", text)], "lang string, text string")).collect()
    assert sorted(map(tuple, got)) == brute([("en", text)])
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(C.op12_collocations(spark, sf), connect(sf), C.ORACLE_SQL) == ""
