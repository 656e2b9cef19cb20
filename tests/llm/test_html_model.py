"""The splitter on broken markup and long pages, and what the labeller owes to words and to context."""

import copy
import time

import numpy as np
import pytest

from dockmill.llm import html_extract
from dockmill.llm.html_blocks import leaf_blocks

PREFIXES = ["<script ", "<script>", "</script", "<style>x</style", "<a ", '<a b="', "<a b='", '<a b="\'', '<a b=">', "<div>", "<div>x", "</div>", "<div></p>", "<p>x", "<li>", "<svg>", "<svg><p>", "<noscript>x", "<!--", "<!", "</", "<", "&#", "&#0", "&"]


@pytest.fixture(scope="module")
def model():
    return html_extract.trained()


@pytest.mark.parametrize("prefix", PREFIXES)
def test_broken_markup_takes_linear_time(prefix):
    for tail in ("", ">", '">'):
        began = time.process_time()
        leaf_blocks(prefix * 100_000 + tail)
        assert time.process_time() - began < 4  # below 2 s on a free core


def test_long_numbers_and_quotes():
    assert [t for _, t, _ in leaf_blocks("<p>&#" + "1" * 10_000 + ";x&#" + "0" * 9000 + "65;</p>")] == ["�xA"]
    assert [t for _, t, _ in leaf_blocks('<a title="a > b">x</a><a title="open>y</a><p>z')] == ["xy", "z"]
    assert [t for _, t, _ in leaf_blocks("<div>a<svg></div>b 1 < 2 <3")] == ["a", "b 1 < 2 <3"]


def accuracy(model, pages):
    said = model.predict([leaf_blocks(p) for p, _ in pages])
    return np.mean(np.concatenate([(s >= 0.5) == np.array(y) for s, (_, y) in zip(said, pages, strict=True)]))


def test_words_and_context_decide(model):
    """Without the word vectors or the recurrent part, blocks of pages unseen in training are lost."""
    held = html_extract.training_pages(300, 77)
    plain = [p for p in held if p[0].startswith("<html>")]
    whole = accuracy(model, held), accuracy(model, plain)
    assert whole[0] > 0.985 and whole[1] > 0.97
    for names in (["word"], ["fh", "bh"]):
        less = copy.deepcopy(model)
        for name in names:
            less.p[name][:] = 0
        assert accuracy(less, held) < whole[0] - 0.02 and accuracy(less, plain) < whole[1] - 0.1


def test_clashing_columns_and_repeats(spark, model):
    rows = [(1, "u", "<article><p>" + "long text " * 50_000 + "</p></article>", "x", 5), (1, "u", "<article><p>same words stand here</p></article>", "y", None), (1, "u", "<article><p>same words stand here</p></article>", "y", None)]
    got = html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"), model).collect()
    assert sorted(r.n_chars for r in got) == [21, 21, 499_999] and all(r.n_chars == len(r.text) for r in got)
