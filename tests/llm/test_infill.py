"""Fill-in-middle against a plain version that lists every unit."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from dockmill.llm import infill
from dockmill.llm.common import table

PATTERN = {infill.CODE_POINTS: r"(?s).", infill.WORDS: r"[^ \t-\r]+|[ \t-\r]", infill.LINES: r"[^\n]*\n|[^\n]+"}


def brute(doc_id, text, units=infill.CODE_POINTS):
    """The contract, word for word; also the output."""
    text = text or ""
    parts = re.findall(PATTERN[units], text)
    n = len(parts)
    said = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(said[k : k + 8], 16) for k in (0, 8, 16, 24))
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(parts[:one]), "".join(parts[one:two]), "".join(parts[two:])
    if text == "" or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        form, output, sizes = "plain", text, (None, None)
    elif h4 % 100 < 20:
        form, output, sizes = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", (len(prefix), len(middle))
    else:
        form, output, sizes = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", (len(prefix), len(middle))
    return (doc_id, n, form, *sizes, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), output)


def odd_texts(rng, n):
    alphabet = ["<", ">", "P", "S", "M", "a", "é", "𝒳", "́", " ", "\n", "\r\n", "\t", "\x00", " ", "<P", "S>", "word"]
    return ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("units", PATTERN)
def test_parts_of_every_kind_of_unit(units):
    rng = random.Random(5)
    for k, text in enumerate(odd_texts(rng, 4000)):
        found, want = infill.transform(text, k, units), brute(k, text, units)
        assert (found.n, found.form, found.output) == (want[1], want[2], want[7]), text
        assert infill.restore(found.output, found.form) == text


@pytest.mark.parametrize("units", PATTERN)
def test_place_of_every_rank(units):
    for text in odd_texts(random.Random(6), 400):
        parts, events = re.findall(PATTERN[units], text), infill.Events(text, units)
        assert events.total == len(parts)
        assert [events.place(k) for k in range(len(parts) + 1)] == [len("".join(parts[:k])) for k in range(len(parts) + 1)], text


def test_only_events_are_kept():
    events = infill.Events("x" * 3_000_000 + "<S>" + "é" * 10)
    assert len(events.at) == 1 and events.sentinels == [(3_000_000, 1)] and events.total == 3_000_013


def test_rows(spark):
    rng = random.Random(7)
    texts = [*odd_texts(rng, 300), None, "", "a", "é" * 400_000, "<P>", "a<S>b", "<<P", "퟿" * 5]
    rows = [(k, t, "x", 9, "psm") for k, t in enumerate(texts)] + [(3, texts[3], "x", 9, "psm"), (None, "no id", None, None, None), (-4, "negative", "", 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, n long, form string")
    got = infill.fill_in_middle(df, with_texts=True).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute(r[0], r[1]) for r in rows), key=repr)
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    empty = infill.fill_in_middle(df.where("false"))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    assert sorted(map(tuple, infill.op13_infill(spark, sf).collect()), key=repr) == sorted((brute(*r)[:7] for r in docs), key=repr)
    assert infill.op13_infill(spark, sf).where(F.col("form") != "plain").count() > 0
