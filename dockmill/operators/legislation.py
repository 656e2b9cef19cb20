"""Tables of contents of acts: sections with the part and division they stand under, flat and nested, and search.

A page becomes its events in document order, headings and links; headings are carried forward to
the links behind them as it is read, the division within its part alone.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockmill.functions.cases import text
from dockmill.sources.shared import small_batches

# What counts as a heading, a section's page, its number, and a date of amendment.
HEADINGS = {"h1", "h2", "h3", "h4", "b", "strong"}
PART, DIVISION = re.compile(r"Part\s+", re.I), re.compile(r"(?:Division|Subdivision)\s+", re.I)
SECTION_PAGE = re.compile(r"(s\d[\d.a-zA-Z]*\.html)$", re.I)
NUMBER = re.compile(r"([\d]+[A-Za-z]?)\s+(.*)")
AMENDED = [r"(?i)as amended to[:\s]+(\d{1,2}\s+\w+\s+\d{4})", r"(?i)amended to[:\s]+(\d{1,2}\s+\w+\s+\d{4})", r"(?i)authoritative version as at[:\s]+(\d{1,2}\s+\w+\s+\d{4})", r"(?i)as at[:\s]+(\d{1,2}\s+\w+\s+\d{4})"]
# End of fixed values.
#: A heading is a line; what is longer is no heading.
LONGEST_HEADING = 1000
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b([^<>]*)>|<!--|<(?=[!?])[^<>]*>")
ATTRIBUTE = re.compile(r"""\b(href|class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW_END = {name: re.compile(rf"</{name}\b", re.I) for name in ("script", "style")}
SCHEMA = "page_id long, pos int, href string, url string, text string, part string, division string"


class Page:
    """A page's tags and texts in order; every sign is looked at once."""

    def __init__(self, html: str):
        self.items: list[tuple[str, str, dict[str, str] | str]] = []  # (open, name, attributes), (close, name, ""), (text, "", text)
        at, position = 0, 0
        while m := TAG.search(html, position):
            if m.start() > at:
                self.items.append(("text", "", html[at : m.start()]))
            at = position = m.end()
            if m[0] == "<!--":
                end = html.find("-->", at)
                at = position = len(html) if end < 0 else end + 3
            elif m[2] and m[1]:
                self.items.append(("close", m[2].lower(), ""))
            elif m[2]:
                found = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in reversed([*ATTRIBUTE.finditer(m[3])])} if "=" in m[3] else {}
                name = m[2].lower()
                self.items.append(("open", name, found))
                if name in RAW_END:
                    end = RAW_END[name].search(html, at)
                    at = position = end.start() if end else len(html)
        if at < len(html):
            self.items.append(("text", "", html[at:]))

    def container(self) -> tuple[int, int]:
        """The items of the part that holds the contents, else all."""
        wanted = [("class", "body"), ("id", "content"), ("id", "textofelements")]
        for key, value in wanted:
            for k, (kind, name, found) in enumerate(self.items):
                if kind == "open" and name == "div" and value in (found.get(key, "").split() if key == "class" else [found.get(key)]):
                    return k, self._end(k)
        return 0, len(self.items)

    def _end(self, start: int) -> int:
        depth = 0
        for k in range(start, len(self.items)):
            kind, name, _ = self.items[k]
            if name == "div":
                depth += 1 if kind == "open" else -1
                if depth == 0:
                    return k
        return len(self.items)

    def events(self) -> list[tuple[int, str, str, str]]:
        """(place, part | division | link, text, href) in document order."""
        start, end = self.container()
        out, pieces, sizes = [], [], [0]
        headings: dict[str, list[tuple[int, int]]] = {}
        link: tuple[int, int, str] | None = None

        def told(since: int) -> str:
            return " ".join(" ".join(pieces[since:]).split())

        def end_link() -> None:
            nonlocal link
            if link is not None:
                out.append((link[0], "link", told(link[1]), link[2]))
                link = None

        for k in range(start, end):
            kind, name, found = self.items[k]
            if kind == "text":
                if said := found.strip():
                    pieces.append(said)
                    sizes.append(sizes[-1] + len(said))
            elif name == "a":
                end_link()
                if kind == "open" and (m := SECTION_PAGE.match(found.get("href", ""))):
                    link = (k, len(pieces), m[1])
            elif name in HEADINGS:
                if kind == "open":
                    headings.setdefault(name, []).append((k, len(pieces)))
                elif headings.get(name):
                    place, since = headings[name].pop()
                    if sizes[-1] - sizes[since] <= LONGEST_HEADING:
                        heading = told(since)
                        if PART.match(heading):
                            out.append((place, "part", heading, ""))
                        elif DIVISION.match(heading):
                            out.append((place, "division", heading, ""))
        end_link()
        return sorted(out)


def page_sections(html: str, url: str) -> list[tuple[int, str, str, str, str | None, str | None]]:
    """(pos, href, url, text, part, division) of a page's links to sections, each section once, where it stands first."""
    found, part, division, folder = {}, None, None, None
    for place, kind, said, href in Page(html).events():
        if kind == "part":
            part, division = said, None
        elif kind == "division":
            division = said
        elif href not in found:
            if folder is None:  # a section's page is a plain name, so every link leads to one folder
                folder = urljoin(url, "s0.html").removesuffix("s0.html")
            found[href] = (place, href, folder + href, said, part, division)
    return [*found.values()]


def contents(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, url, text, part, division) of (page_id, url, html); a null page has none."""
    names, kinds = ["page_id", "pos", "href", "url", "text", "part", "division"], [pa.int64(), pa.int32(), *[pa.string()] * 5]

    def run(batches):
        for batch in batches:
            rows = [(i, *x) for i, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True) for x in page_sections(html.as_py() or "", url)]
            columns = [*zip(*rows, strict=True)] if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    wanted = pages.select(F.col("page_id").cast("long"), text(F.col("url")).cast("string"), F.col("html").cast("string")).where("page_id IS NOT NULL")
    return small_batches(wanted).mapInArrow(run, SCHEMA)


def sections(pages: DataFrame, pieces: int | None = None) -> DataFrame:
    """page_id, pos, section_id, url, number, title, part, division of (page_id, url, html), each section once a page, where it stands first.

    A part ends the division before it. A section before any heading has an empty part and
    division. A heading without a closing tag, or over 1,000 signs long, is none. A page is one row
    and its headings are carried forward as it is read; rows of one page are told apart, and
    ``pieces`` deals the sections to that many tasks.
    """
    found = contents(pages).withColumn("section_id", F.replace("href", F.lit(".html"), F.lit("")))
    if pieces:
        found = found.repartition(pieces, "page_id", "section_id")
    rest = F.struct("pos", "url", "text", "part", "division")
    first = found.groupBy("page_id", "section_id").agg(F.min(rest).alias("x")).select("page_id", "section_id", "x.*")
    numbered = F.col("text").rlike(r"^\d+[A-Za-z]?\s+")
    number = F.when(numbered, F.regexp_extract("text", r"^(\d+[A-Za-z]?)\s+", 1)).otherwise(F.col("text"))
    title = F.when(numbered, F.trim(F.regexp_extract("text", r"^\d+[A-Za-z]?\s+(.*)", 1))).otherwise("")
    return first.select("page_id", "pos", "section_id", "url", number.alias("number"), title.alias("title"), F.coalesce("part", F.lit("")).alias("part"), F.coalesce("division", F.lit("")).alias("division"))


def nested(flat: DataFrame) -> DataFrame:
    """page_id and parts: an array of part, its divisions, each with its sections, all in the order in which they are seen first; an act's sections are one row, as they were one page."""
    section = F.struct("pos", "section_id", "number", "title")
    divisions = flat.groupBy("page_id", "part", "division").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(section)).alias("sections"))
    parts = divisions.groupBy("page_id", "part").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "division", "sections"))).alias("divisions"))
    return parts.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "part", "divisions"))).alias("parts"))


def last_amended(html: Column) -> Column:
    """The date up to which a page says that the act is amended, empty if it says none."""
    said = text(html)
    return F.coalesce(*(F.when(said.rlike(p), F.regexp_extract(said, p, 1)) for p in AMENDED), F.lit(""))


def search(acts: DataFrame, asked: str, limit: int = 50) -> DataFrame:
    """Acts (id, title, description, shortcode, ...) that hold ``asked`` in one of these, capitals aside, without their sections; the title counts first."""
    want = F.lit(asked.strip().lower())
    hits = [F.contains(F.lower(text(F.col(c))), want) for c in ("title", "description", "shortcode", "id")]
    rank = F.when(hits[0], 0).when(hits[1], 1).when(hits[2], 2).when(hits[3], 3)
    return acts.withColumn("__rank", rank).where(F.col("__rank").isNotNull()).orderBy("__rank", "title", "id").limit(limit).drop("__rank", "sections")
