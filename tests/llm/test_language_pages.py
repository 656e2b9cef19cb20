"""Pages of the language operator: long and broken markup, and the query against its own scores row by row."""

import random
import re
import time

import numpy as np
import pytest

from dockmill.llm import html_blocks, language
from dockmill.llm.common import table

PLAIN_TAG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", re.I)


@pytest.mark.parametrize("part", ["<", "<!--", "<html ", "<html lang", "<html lang=", "<script>", "<p ", "<a href='", "&", "&#", "<!", "</", '<html "', "x", "1", " ", "<html lang  ", "<style></styl"])
def test_hostile_pages(part):
    began = time.perf_counter()
    page = part * 100_000
    html_blocks.declared_language(page)
    text = "\n".join(t for _, t, _ in html_blocks.leaf_blocks(page))
    language.trigram_codes(text), language.trigram_codes(page)
    assert time.perf_counter() - began < 4


def test_declared_language_equals_the_plain_pattern():
    rng = random.Random(3)
    parts = ["<html", " ", "lang", "=", '"en"', "'de", "fr", ">", "<", "xml:lang=", "hreflang=it", "HTML", "\n", "<html>", "x"]
    found = set()
    for _ in range(20_000):
        page = "".join(rng.choices(parts, k=rng.randrange(14)))
        want = PLAIN_TAG.search(page)
        assert html_blocks.declared_language(page) == (want[1] if want else ""), page
        found.add(bool(want))
    assert found == {True, False}


def test_words_with_digits_go():
    for said in ["a1b c", "1", "", "abc", "x9 9x é1é y", "a" * 50 + "1"]:
        plain = re.sub(rb"[^\x20\x09-\x0d]*[0-9][^\x20\x09-\x0d]*", b" ", said.encode())
        assert language.DIGITS.sub(b" ", said.encode()) == plain


def test_page_texts(spark):
    rows = [(1, '<html lang="fr"><p>Bon <b>jour</b></p><script>x</script><p>A&amp;B</p>', "h", "fr"), (2, None, "", ""), (3, "", None, None)]
    got = language.page_texts(spark.createDataFrame(rows, "page_id long, html string, host string, address string")).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(1, "Bon jour\nA&B", "fr", "h", "fr"), (2, "", "", "", ""), (3, "", "", None, None)]


def test_query_covers_both_tables(spark):
    sf = "/root/testdata/sf0.001"
    got = language.op3_language_id(spark, sf).collect()
    docs, pages = (table(spark, sf, t).count() for t in ("documents", "pages"))
    assert sum(r.doc_id is not None for r in got) == docs and sum(r.page_id is not None for r in got) == pages == len({r.page_id for r in got} - {None})
    truth = {r.doc_id: r.lang for r in table(spark, sf, "documents").where("length(text) > 200").collect()}
    right = [r.language == truth[r.doc_id] for r in got if r.doc_id in truth and truth[r.doc_id]]
    assert np.mean(right) > 0.97
    declared = [r.language == r.declared for r in got if r.page_id is not None and r.declared]
    assert np.mean(declared) > 0.9


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "the house and the garden of the man are old " * 40_000, "en", "a.org"), (2, "das haus und der garten sind alt und gut " * 30, "de", "a.org"), (3, "x" * 2_000_000, None, "a.org")], "doc_id long, text string, lang string, source string")
    kept = language.keep_known_language(docs)
    assert {1, 2} <= {r.doc_id for r in kept.select("doc_id").collect()}
