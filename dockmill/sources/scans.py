"""Cases from pages of search results, and from many files of answers of which the later one counts."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockmill.operators.legislation import Page

# What marks a result, its abstract and a case's page.
RESULT, ABSTRACT, BLOCKS = re.compile("result|hit"), re.compile("snippet|abstract|context"), {"li", "tr", "div"}
CASE_PAGE, YEAR = re.compile(r"\d+\.html"), re.compile(r"/(\d{4})/")
# End of fixed values.
HITS = "page_id long, pos int, title string, url string, year int, snippet string, citation string"


def hits_of(html: str, code: str, base: str) -> list[tuple[int, str, str, int, str, str]]:
    """(place, title, url, year, snippet, citation) of a page's results in order; without any, of its plain links to cases.

    A block's link is the first in it. Every sign is looked at once: where blocks end and which link
    comes next is known beforehand.
    """
    items = Page(html).items
    texts, before = [], [0]  # stripped texts, and how many come before each item
    closes: dict[int, int] = {}
    stacks: dict[str, list[int]] = {}
    for k, (kind, name, said) in enumerate(items):
        if kind == "text":
            if told := said.strip():
                texts.append(told)
        elif kind == "open":
            stacks.setdefault(name, []).append(k)
        elif stacks.get(name):
            closes[stacks[name].pop()] = k
        before.append(len(texts))
    end = len(items)
    next_link, next_abstract = [end] * (end + 1), [end] * (end + 1)
    for k in range(end - 1, -1, -1):
        kind, name, found = items[k]
        next_link[k], next_abstract[k] = next_link[k + 1], next_abstract[k + 1]
        if kind == "open":
            if name == "a" and found.get("href"):
                next_link[k] = k
            if ABSTRACT.search(found.get("class", "")):
                next_abstract[k] = k

    def told(start: int) -> str:
        return "".join(texts[before[start] : before[closes.get(start, start)]])

    def hit(link: int, snippet: str) -> tuple[int, str, str, int, str, str]:
        href, title = items[link][2]["href"], told(link)
        year, cited = YEAR.search(href), re.search(rf"\[\d{{4}}\]\s+{re.escape(code)}\s+\d+", title)
        return link, title, urljoin(base, href), int(year[1]) if year else 0, snippet, cited[0] if cited else ""

    def ours(link: int) -> bool:
        return link < end and f"/au/cases/cth/{code}/" in items[link][2]["href"]

    out = []
    for k, (kind, name, found) in enumerate(items):
        if kind == "open" and name in BLOCKS and RESULT.search(found.get("class", "")):
            link, last = next_link[k], closes.get(k, end)
            if link < last and ours(link):
                abstract = next_abstract[k + 1]
                out.append(hit(link, told(abstract) if abstract < last else ""))
    if out:
        return out
    return [hit(k, "") for k in range(end) if next_link[k] == k and ours(k) and CASE_PAGE.search(items[k][2]["href"])]


def search_hits(pages: DataFrame, code: str, base: str) -> DataFrame:
    """The results in pages (page_id, html) of a court's search, in page order; a null page has none."""

    def run(batches):
        for batch in batches:
            rows = [(i, *h) for i, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for h in hits_of(html.as_py() or "", code, base)]
            columns = [*zip(*rows, strict=True)] if rows else [[]] * 7
            types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["page_id", "pos", "title", "url", "year", "snippet", "citation"])

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, HITS)


def read_batches(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The items of many JSON files, each an array of objects of ``schema``: one for each key, that of the last file by name, within a file the last.

    Items with an empty key are left out, and so is a file that isn't an array; ``broken_batches`` tells which.
    """
    items = _batches(spark, path, schema).select("file", F.posexplode("items").alias("pos", "item")).where(F.col(f"item.{key}") != "")
    last = items.groupBy(f"item.{key}").agg(F.max_by("item", F.struct("file", "pos")).alias("item"))
    return last.select("item.*")


def _batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return raw.withColumn("items", F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{schema}>>")))


def broken_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file) of those that couldn't be read."""
    return _batches(spark, path, schema).where("items is null").select("file")
