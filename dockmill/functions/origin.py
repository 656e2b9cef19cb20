"""The country a person comes from, as a decision tells it: eighteen rules over one search for names.

One automaton finds every name of a country or people in the text, once. A rule is then a short
pattern that ends where a name begins ("citizen of", "born in") or begins where one ends
("passport", "national"); rules are asked in their order, and the first place that fits one decides.
Texts are read in Arrow batches, in time that grows with the part of the text that the rules look at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dockmill.functions import places
from dockmill.functions.cases import text

# Patterns, and how many characters from the beginning the rules look at.
HEAD, BODY, NEAR, NAMED = 4000, 15000, 10000, 6000
LABELS_AFTER = r"(?:MEMBER|CASE\s+NUMBER|HOME\s+AFFAIRS|APPLICANTS?|TRIBUNAL\s+MEMBER|DATE|DECISION|CATCHWORDS|DIVISION|PLACE|LEGISLATION|STATEMENT\s+OF|MRT|RRT|DIAC|DIBP|DIMA)\s*:"
LABELS = [rf"{label}\s*:\s*\n{{0,2}}\s*(.+?)(?:\s+{LABELS_AFTER}|[\n]|$)" for label in (r"Country\s+of\s+(?:Reference|Origin|Citizenship)", "Nationality", "Citizenship")]
LABELS.append(r"\(Name,\s*DOB,\s*Sex,\s*Nationality\)\s+[^\n]+?(?:male|female|M\b|F\b)[^\n]*?,\s*((?:People'?s?\s+Republic\s+of\s+)?[A-Z][^\n,]{1,40}?)(?:\s*\n|\s*$)")
PEOPLES_REPUBLIC = r"(?:People'?s?\s+Republic\s+of\s+China|P\.R\.C\.?)"
INTERPRETER = r"INTERPRETER\s*:\s*\n?\s*(.+?)(?:\n|$)"
BEFORE_COUNTRY = [r"(?:citizen|national|resident)\s+of\s+", r"claims?\s+to\s+be\s+(?:a\s+)?(?:citizen|national|passport\s+holder)\s+of\s+", r"(?:a\s+)?national\s+of\s+"]
AFTER_PEOPLE = [r"\s+(?:citizen|national)", r"\s+(?:national|citizen|born)"]
THEN_BEFORE_COUNTRY = [r"born\s+in\s+", r"(?:arrived|came|fled|travelled|traveled)\s+(?:in\s+Australia\s+)?from\s+", r"(?:the\s+)?applicant\s+(?:is\s+)?(?:a\s+)?(?:from|of)\s+"]
FEARED = r"(?:persecution|harm|return(?:ed)?|refoul)\s+(?:in|to)\s+"
NOT_FEARED = {"Australia", "New Zealand"}
RULER, AFTER_RULER, WITHOUT_RULER = "=" * 20, 80, 500
# End of fixed values.

FLAGS = re.IGNORECASE
LABELS, BEFORE_COUNTRY, AFTER_PEOPLE, THEN_BEFORE_COUNTRY = ([re.compile(p, FLAGS) for p in ps] for ps in (LABELS, BEFORE_COUNTRY, AFTER_PEOPLE, THEN_BEFORE_COUNTRY))
INTERPRETER, FEARED, APPLICANT, FROM = (re.compile(p, FLAGS) for p in (INTERPRETER, FEARED, "applicant", r"from\s+"))
#: The words that a pattern before a country ends with, white space behind them.
ENDS = dict.fromkeys(BEFORE_COUNTRY, ("of",)) | dict(zip(THEN_BEFORE_COUNTRY, (("in",), ("from",), ("from", "of")), strict=True)) | {FROM: ("from",), FEARED: ("in", "to")}
TAILS = ("of", "in", "from", "to")
CHINA, CHINA_IN_TEXT = re.compile(PEOPLES_REPUBLIC, FLAGS), re.compile(PEOPLES_REPUBLIC + r"\b", FLAGS)
PASSPORT, NEXT_LABEL, WORD = re.compile(r"\s+passport", FLAGS), re.compile(r"\s[A-Z][A-Z0-9\s]*:"), re.compile(r"\w")
COUNTRY_OF = {c.lower(): c for c in reversed(places.COUNTRIES)}
PEOPLE_OF = {p.lower(): c for p, c in reversed(places.PEOPLES.items())}
_LOWER = {a: a + 32 for a in range(65, 91)}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for name in {*COUNTRY_OF, *PEOPLE_OF}:
        found.add_word(name, name)
    found.make_automaton()
    return found


class Names:
    """Names of countries and peoples in a text, by the place where they begin, the longest first."""

    def __init__(self, said: str):
        self.said = said
        self.countries: dict[int, list[int]] = {}
        self.peoples: dict[int, list[int]] = {}
        for last, name in _automaton().iter(said.translate(_LOWER)):
            start = last + 1 - len(name)
            for known, at in ((COUNTRY_OF, self.countries), (PEOPLE_OF, self.peoples)):
                if name in known:
                    at.setdefault(start, []).append(last + 1)
        for at in (self.countries, self.peoples):
            for ends in at.values():
                ends.sort(reverse=True)
        self.before = {tail for start in self.countries for tail in self._tails(start)}

    def _tails(self, start: int) -> tuple[str, ...]:
        """Those of ``TAILS`` that may be the word before a place; all where that takes a closer look."""
        near = self.said[max(0, start - 64) : start]
        word = near.rstrip()
        if len(word) == len(near):
            return ()
        last = word[-4:]
        return tuple(t for t in TAILS if last.lower().endswith(t)) if len(last) == 4 and last.isascii() else TAILS

    def country_at(self, start: int, most: int, *, whole: bool = False) -> str | None:
        """The country that begins there and ends before ``most``, as written; with a word's end behind it if ``whole``."""
        for end in self.countries.get(start, ()):
            if end <= most and not (whole and end < most and WORD.match(self.said, end)):
                return self.said[start:end]
        return None

    def after(self, before: re.Pattern, first: int, most: int, *, whole: bool = False) -> str | None:
        """The first country that directly follows the pattern, which is looked for only if a country follows one of its last words."""
        if not self.before.intersection(ENDS[before]):
            return None
        for m in before.finditer(self.said, first, most):
            if (found := self.country_at(m.end(), most, whole=whole)) is not None:
                return found
        return None

    def followed(self, at: dict[int, list[int]], behind: re.Pattern, most: int) -> str | None:
        """The first of the names that the pattern follows, as written."""
        for start in sorted(at):
            for end in at[start]:
                if end <= most and behind.match(self.said, end, most):
                    return self.said[start:end]
        return None


def country_named(value: str) -> str:
    """The country that a field's value means: exactly, by the longest name in it, or by its people; else the value itself."""
    if m := NEXT_LABEL.search(value):  # a label may stand behind it on the same line
        rest = value[: m.start()]
        value = rest if "\n" not in value[m.start() :].strip() else value
    value = value.strip().rstrip(".,;:").strip()
    if not value:
        return ""
    if CHINA.search(value):
        return "China"
    low = value.lower()
    if low in COUNTRY_OF:
        return COUNTRY_OF[low]
    inside = {name for _, name in _automaton().iter(low) if name in COUNTRY_OF}
    if inside:
        longest = max(map(len, inside))
        return next(c for c in places.COUNTRIES if len(c) == longest and c.lower() in inside)
    return PEOPLE_OF.get(low, value)


def _labelled(head: str) -> Iterator[str]:
    for k, label in enumerate(LABELS):
        if ("(" if k == 3 else ":") in head and (m := label.search(head)):
            yield country_named(m[1].strip().rstrip(".,") if k in (1, 2) else m[1])


def _answers(said: str) -> Iterator[str | None]:
    """What each rule says, in order; nothing where it doesn't fit."""
    head, body = said[:HEAD], said[:BODY]
    yield from _labelled(head)
    if CHINA_IN_TEXT.search(body):
        yield "China"
    if ":" in head and (m := INTERPRETER.search(head)):
        language = m[1].strip().split("(")[0].lower()
        yield next((c for name, c in places.LANGUAGES.items() if name.lower() in language), None)
    names, n, near = Names(body), len(body), min(len(body), NEAR)
    for before in BEFORE_COUNTRY:
        yield names.after(before, 0, n)
    for behind in AFTER_PEOPLE:
        people = names.followed(names.peoples, behind, n)
        yield PEOPLE_OF[people.lower()] if people else None
    for before in THEN_BEFORE_COUNTRY:
        yield names.after(before, 0, n)
    for m in APPLICANT.finditer(body, 0, near) if "from" in names.before else ():
        yield names.after(FROM, m.start(), min(m.start() + 200, n), whole=True)
    yield names.followed(names.countries, PASSPORT, near)
    ruler = said.find(RULER)
    told = said[ruler + AFTER_RULER :] if ruler > 0 else said[WITHOUT_RULER:]
    names = Names(told[:NEAR])
    feared = names.after(FEARED, 0, len(names.said))
    yield feared if feared not in NOT_FEARED else None
    for start in sorted(names.countries):
        if start < NAMED and not (start and WORD.match(names.said, start - 1)):
            found = names.country_at(start, min(NAMED, len(names.said)), whole=True)
            if found and found not in NOT_FEARED:
                yield found
                return


def country_in(said: str | None) -> str:
    """The country of origin that a decision tells, empty if it tells none. Names found in running text stay as written."""
    return next((c for c in _answers(said or "") if c), "")


@F.pandas_udf(StringType())
def _countries(said: pd.Series) -> pd.Series:
    return said.map(country_in)


def country_of_origin(c: Column) -> Column:
    """``country_in`` of a column of texts; null counts as empty."""
    return _countries(text(c))


@F.pandas_udf(StringType())
def _named(values: pd.Series) -> pd.Series:
    return values.map(country_named)


def normal_country(c: Column) -> Column:
    """``country_named`` of a column of field values."""
    return _named(text(c))
