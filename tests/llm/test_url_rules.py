"""Rules on any part of a URL, at one support, against brute force."""

import random
from itertools import combinations

from dockmill.llm import url_filter


def verdicts(spark, urls, bad, **mining):
    pages = spark.createDataFrame([*enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([*enumerate(bad)], "page_id long, block boolean")
    return {r.page_id: r.verdict for r in url_filter.filter_urls(pages, labels, **mining).collect()}


def test_late_segments_keys_and_labels(spark):
    bases = ["http://x{}.biz/a/b/c/{}", "http://y{}.biz/?a=1&b=1&c=1&{}=1", "http://{}.v.w.z{}.u.biz/"]
    urls, bad = [], []
    for k in range(90):
        for word, is_bad in (("spam", True), ("fine", False)):
            base = bases[k % 3]
            urls.append(base.format(word, k) if k % 3 == 2 else base.format(k, word))
            bad.append(is_bad if k < 75 else None)
    said = verdicts(spark, urls, bad)
    assert said == {k: "block" if "spam" in u else "allow" for k, u in enumerate(urls)}


def test_rules_of_five_tokens(spark):
    keys = "abcdef"
    urls, bad = [], []
    for _ in range(25):
        for size in (4, 5):
            for some in combinations("abcde", size):
                urls.append("http://h.biz/?" + "&".join(some))
                bad.append(size == 5)
        urls += ["http://h.biz/?" + "&".join(keys)]
        bad.append(True)
    said = verdicts(spark, urls, bad)
    assert said == {k: "block" if x else "allow" for k, x in enumerate(bad)}


def test_support_does_not_grow_with_the_table(spark):
    rng = random.Random(3)
    urls = [f"http://good.biz/p{rng.randrange(9)}" for _ in range(40_000)] + ["http://evil.biz/q"] * 30
    said = verdicts(spark, urls, ["evil" in u for u in urls])
    assert [k for k, v in said.items() if v == "block"] == [k for k, u in enumerate(urls) if "evil" in u]


def test_many_tokens_that_go_together(spark):
    path = "/".join(f"{c}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMN")
    urls = [f"http://h.biz/{path}/?{k}" for k in ("k1", "k2") * 40]
    said = verdicts(spark, urls + ["http://o.biz/x/n"], [u.endswith("k1") for u in urls])
    assert said == {k: "block" if u.endswith("k1") else "allow" for k, u in enumerate(urls)} | {80: "allow"}


def test_listed_rules_by_their_words(spark):
    want = {
        "http://com/en/": ("com/en/", "block"), "http://a.example.com/en/71": ("example.com/en/7", "allow"), "http://x.net/de/1": ("net/de/", "allow"),
        "http://a.EXAMPLE.net/de/81": ("example.net/de/8", "block"), "http://example.net/de/7": ("net/de/", "allow"), "http://b.org/es/?q": ("org/es/", "block"),
        "http://planet/de/1": (None, "allow"), "http://x.net/en/": (None, "allow"),
    }
    pages, labels = spark.createDataFrame([*enumerate(want)], "page_id long, url string"), spark.createDataFrame([], "page_id long, block boolean")
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, labels).collect()} == dict(enumerate(want.values()))
