"""Outcome, kind of visa, catchwords, reason and legal test of a decision, by cascades over its whole text.

Rules are asked in order and only a rule's first place counts; a place whose text is too short
passes the turn on. What could be looked for in vain from many places, the end of a block, a closing
bracket, a word further on in the line, is looked for once, so time grows with the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dockmill.functions.cases import text

# What decides, in order; {...} of one line each.
LONGEST_OUTCOME, SHORTEST_OUTCOME, LAST_SIGNS = 300, 10, 1500
FIRST_OUTCOMES = [
    r"DECISION:\s*+The Tribunal[^\n]*(?:\n[^\n]*){0,3}",
    r"The decision under review is \w+[^\n]*",
    r"decision\s++(?:affirmed|set aside|remitted|varied)[^\n]*",
    r"(?:affirm|set aside|remit|vary)\s++the\s++decision[^\n]*",
    r"ORDERS?\s*+(?<=\n)(?:\(\d+\)[^\n]*\n?){1,6}",
]
BLOCK = r"ORDERS?|THE COURT ORDERS"
THEN_OUTCOMES = [
    r"The Tribunal\s++(?:affirms|remits|sets aside|does not have jurisdiction)[^\n]*",
    r"The (?:Tribunal|Court)\s++(?:dismisses|allows|refuses|grants)[^\n]*",
    r"(?:The )?appeal\s++(?:is|be)\s++(?:dismissed|allowed)[^\n]*",
]
APPLICATION, APPLICATION_ENDS = r"(?:The )?application", r"(?:is|be|must be)\s++(?:dismissed|refused|allowed|granted)"
LAST_OUTCOMES = [
    r"accordingly[,.]?\s*+(?:dismissed|refused|allowed|granted|remitted)[^\n]*",
    r"I would (?:dismiss|allow|grant|refuse)[^\n]*",
    r"I (?:dismiss|allow|grant|refuse) the[^\n]*",
]
MUST_BE = r"must be (?:dismissed|refused|allowed|granted)"
WRITS = r"(?:writs?|relief)\s++(?:of\s++)?\w++\s++(?:issue|refused|granted)[^\n]*"
AT_THE_END = r"(?:review|appeal|application)\s++(?:should be|is hereby|is|be)\s++(?:affirmed|dismissed|allowed|refused|remitted|set aside|upheld)[^\n]*"
VISA_BEGINS = r"(?:protection|skilled|partner|student|visitor|bridging|temporary|permanent|subclass\s++\d++|class\s++[A-Z]{2})\s*+"
SUBCLASS = r"[Ss]ubclass\s+(\d+)\s*\(?([A-Za-z][A-Za-z ]*?)\)?"
CLASS = r"\(Class\s++([A-Z]{2})\)\s*+visas?"
CHARACTER = r"(?:s\.?\s*+501|section\s*+501|character (?:test|cancellation|ground))"
REFUSED_CLASS = r"(?:grant|refuse)[^\n]{0,60}(Class\s++[A-Z]{2}[^\n]{0,30})"
REFUGEE, REVIEW = r"refug|protection claim|complementary protection", r"judicial review|migration review tribunal|refugee review tribunal"
NO_CATCHWORDS = r"(?:Category|Catchwords)[:\s]*+No Catchwords"
CATCHWORD_RULES = [("CATCHWORDS", r"\n\s*\n|\nLEGISLATION|\nCASES|\nORDER|\nAPPLICANT"), ("Catchwords", r"\n\s*\n|\nLegislation|\nCases|\nOrder"), ("KEY WORDS?", r"\n\s*\n")]
DIVISION = r"DIVISION:\s*+(Migration[^\n]*)"
LONGEST_CATCHWORDS, SHORTEST_CATCHWORDS = 500, 5
REASON_FIRST, LONGEST_REASON = 8000, 300
REASON_BEGINS, REASON_ENDS = r"CATCHWORDS?\s*[:\n]+\s*", r"\n\s*(?:LEGISLATION|STATEMENT\s+OF|DECISION\s+AND\s+REASONS|$)"
REASON_LABEL = r"^(?:MIGRATION|IMMIGRATION)\s*[–\-]\s*"
TEST_FIRST = 6000
TESTS = [
    (r"\bs\.?\s*36\b", "s.36 refugee test"),
    (r"\bs\.?\s*501\b", "s.501 character test"),
    (r"\bs\.?\s*499\b", "s.499 ministerial direction"),
    (r"\bs\.?\s*48A\b", "s.48A bar on re-application"),
    (r"\bs\.?\s*417\b", "s.417 ministerial intervention"),
    (r"\bs\.?\s*351\b", "s.351 ministerial intervention (MRTA)"),
    (r"\bs\.?\s*195A\b", "s.195A ministerial intervention"),
    (r"\bs\.?\s*48B\b", "s.48B ministerial direction"),
    (r"\bs\.?\s*101\b\s+character", "s.101 character (citizenship)"),
    (r"\bs\.?\s*24\b.*citizenship", "s.24 citizenship refusal"),
    (r"\brisk\s+(?:of|to)\s+(?:significant|serious)\s+harm\b", "complementary protection"),
    (r"\bcharacter\s+test\b", "character test"),
    (r"\bgenuine\s+temporary\s+entrant\b", "genuine temporary entrant test"),
    (r"\bgenuine\s+applicant\s+for\s+entry\b", "genuine student test"),
    (r"\bbalance\s+of\s+family\s+test\b", "balance of family test"),
    (r"\bprotection\s+obligations\b", "refugee/protection obligations"),
]
ACTS_BEGIN, ACTS_END = r"LEGISLATION\s*\n+", r"\n\s*(?:STATEMENT\s+OF|CATCHWORDS|$)"
SECTION, ACTS_SIGNS, TRIVIAL = r"\bs(?:ection)?\s*\.?\s*(\d+[A-Z]?(?:\([^\)]{1,20}\))?)\b", 500, 30
# End of fixed values.

_I = re.IGNORECASE


def _compiled(patterns: list[str]) -> list[re.Pattern]:
    return [re.compile(p, _I) for p in patterns]


FIRST_OUTCOMES, THEN_OUTCOMES, LAST_OUTCOMES = map(_compiled, (FIRST_OUTCOMES, THEN_OUTCOMES, LAST_OUTCOMES))
BLOCK, APPLICATION, APPLICATION_ENDS, MUST_BE, WRITS, AT_THE_END, VISA_BEGINS, CLASS, CHARACTER, REFUSED_CLASS, REFUGEE, REVIEW, NO_CATCHWORDS, DIVISION, REASON_LABEL, SECTION = _compiled(
    [BLOCK, APPLICATION, APPLICATION_ENDS, MUST_BE, WRITS, AT_THE_END, VISA_BEGINS, CLASS, CHARACTER, REFUSED_CLASS, REFUGEE, REVIEW, NO_CATCHWORDS, DIVISION, REASON_LABEL, SECTION]
)
SUBCLASS, BLANK_LINE, SIGNS = re.compile(SUBCLASS), re.compile(r"\n\s*\n"), re.compile(r"[:\s]*")
CATCHWORD_RULES = [(re.compile(a, _I), re.compile(b, _I)) for a, b in CATCHWORD_RULES]
REASON_BEGINS, REASON_ENDS, ACTS_BEGIN, ACTS_END = _compiled([REASON_BEGINS, REASON_ENDS, ACTS_BEGIN, ACTS_END])
TESTS = [(re.compile(p, _I), label) for p, label in TESTS]


def line_end(said: str, at: int) -> int:
    end = said.find("\n", at)
    return len(said) if end < 0 else end


def block(said: str, heading: re.Pattern, ends: re.Pattern) -> tuple[int, int, int] | None:
    """(heading's begin, begin, end) of what follows the first heading up to the first end behind it; if none comes, up to the last end within the blanks right behind the heading."""
    m = heading.search(said)
    if m is None:
        return None
    begin = SIGNS.match(said, m.end()).end()
    if end := ends.search(said, begin):
        return m.start(), begin, end.end()
    inside = [*ends.finditer(said, m.end(), begin)]
    return (m.start(), begin, max(x.end() for x in inside)) if inside else None


def _first(said: str, patterns: list[re.Pattern]) -> Iterator[str]:
    for p in patterns:
        if m := p.search(said):
            yield m[0]


def _application(said: str) -> str | None:
    """From the first application whose line goes on to say what becomes of it, to the end of the line in which that ends; the last saying of the line counts."""
    at = 0
    while m := APPLICATION.search(said, at):
        last = line_end(said, m.end())
        ends = None
        for ends in APPLICATION_ENDS.finditer(said, m.end()):
            if ends.start() >= last:
                break
            found = ends
            for later in APPLICATION_ENDS.finditer(said, ends.end()):
                if later.start() >= last:
                    break
                found = later
            return said[m.start() : line_end(said, found.end())]
        if ends is None:
            return None
        at = last
    return None


def _outcomes(said: str) -> Iterator[str]:
    yield from _first(said, FIRST_OUTCOMES)
    if found := block(said, BLOCK, BLANK_LINE):
        yield said[found[0] : found[2]]
    yield from _first(said, THEN_OUTCOMES)
    if found := _application(said):
        yield found
    yield from _first(said, LAST_OUTCOMES)
    if m := MUST_BE.search(said):
        yield said[said.rfind("\n", 0, m.start()) + 1 : line_end(said, m.end())]
    yield from _first(said, [WRITS])


def outcome_in(said: str | None) -> str:
    """The first saying of over ten signs, else what the last 1,500 signs say of the review; cut to 300 signs."""
    said = said or ""
    for found in _outcomes(said):
        if len(told := found.strip()[:LONGEST_OUTCOME]) > SHORTEST_OUTCOME:
            return told
    m = AT_THE_END.search(said[-LAST_SIGNS:])
    return m[0].strip()[:LONGEST_OUTCOME] if m else ""


def _visa(said: str) -> str | None:
    """A kind, a bracket perhaps, and the word visa; where the next bracket closes is looked for once."""
    close = -1
    for m in VISA_BEGINS.finditer(said):
        at = m.end()
        if said.startswith("(", at):
            if close < at:
                close = said.find(")", at)
                close = len(said) if close < 0 else close
            at = close + 1
            while at < len(said) and said[at].isspace() and at - close < 200:
                at += 1
        if said[at : at + 4].lower() == "visa":
            return said[m.start() : at + 4].strip()
    return None


def _class(said: str) -> str | None:
    """The words of one line before ``(Class XX) visa``, with the class."""
    for m in CLASS.finditer(said):
        end = m.start()
        while end > 0 and said[end - 1].isspace():
            end -= 1
        begin = end
        while begin > 0 and (said[begin - 1] == " " or said[begin - 1] == "_" or said[begin - 1].isalnum()):
            begin -= 1
        name = said[begin:end].lstrip()
        if len(name) > 1 or (name and end < m.start() and said[end] == " "):
            return f"{name} (Class {m[1]})"
    return None


def visa_in(said: str | None, title: str | None = None) -> str:
    """The kind of visa by ten rules over the text and the title."""
    said, title = said or "", title or ""
    if (found := _visa(said)) is not None:
        return found
    if m := SUBCLASS.search(said):
        return f"Subclass {m[1]} ({m[2].strip()})"
    if (found := _class(said)) is not None:
        return found
    if "(Citizenship)" in title:
        return "Citizenship"
    if CHARACTER.search(said):
        return "Character cancellation (s.501)"
    if m := REFUSED_CLASS.search(said):
        return m[1].strip()[:80]
    rules: list[tuple[Callable, str]] = [
        (lambda: "(Migration)" in title, "Migration (general)"), (lambda: "(Refugee)" in title, "Refugee/Protection"), (lambda: REFUGEE.search(said), "Refugee/Protection"), (lambda: REVIEW.search(said), "Judicial review (migration)"),
    ]
    return next((label for holds, label in rules if holds()), "")


def catchwords_in(said: str | None) -> str:
    """The block of over five signs behind the first heading that has one, cut to 500; ``No Catchwords`` where the text says so."""
    said = said or ""
    if NO_CATCHWORDS.search(said):
        return "No Catchwords"
    for heading, ends in CATCHWORD_RULES:
        m = heading.search(said)
        if m is None:
            continue
        begin = SIGNS.match(said, m.end()).end()
        if end := ends.search(said, begin):
            words = said[begin : end.start()].strip()
            if len(words) > SHORTEST_CATCHWORDS:
                return words[:LONGEST_CATCHWORDS]
    m = DIVISION.search(said)
    return m[1].strip()[:LONGEST_CATCHWORDS] if m and len(m[1].strip()) > SHORTEST_CATCHWORDS else ""


def _section(said: str, begins: re.Pattern, ends: re.Pattern) -> str | None:
    """What lies between a heading and the next of the named ones or the end of a line of blanks, one sign at least."""
    m = begins.search(said)
    if m is None or m.end() >= len(said):
        return None
    end = ends.search(said, m.end() + 1)
    return said[m.end() : end.start()] if end else None


def reason_in(said: str | None) -> str:
    """The catchwords in one line without their label, cut at a word to 300 signs."""
    words = _section((said or "")[:REASON_FIRST], REASON_BEGINS, REASON_ENDS)
    words = REASON_LABEL.sub("", " ".join((words or "").split())).strip()
    return words if len(words) <= LONGEST_REASON else words[:LONGEST_REASON].rsplit(" ", 1)[0] + "..."


def most_cited(said: str) -> str:
    """The section above 30 that is cited most, of equals the first; empty without one."""
    cited = Counter(s for s in SECTION.findall(said) if int(re.search(r"\d+", s)[0]) > TRIVIAL)
    return f"s.{cited.most_common(1)[0][0]}" if cited else ""


def legal_test_in(said: str | None) -> str:
    """The first known test that the beginning names, else the section most cited under its legislation."""
    head = (said or "")[:TEST_FIRST]
    for pattern, label in TESTS:
        if pattern.search(head):
            return label
    return most_cited((_section(head, ACTS_BEGIN, ACTS_END) or "")[:ACTS_SIGNS])


def _column(read: Callable) -> Callable:
    @F.pandas_udf(StringType())
    def told(said: pd.Series) -> pd.Series:
        return said.map(read)

    return lambda c: told(text(c))


outcome_of, catchwords_of, reason_of, legal_test_of = (_column(f) for f in (outcome_in, catchwords_in, reason_in, legal_test_in))


@F.pandas_udf(StringType())
def _visas(said: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([visa_in(s, t) for s, t in zip(said, title, strict=True)], dtype=object)


def visa_of(c: Column, title: Column) -> Column:
    return _visas(text(c), text(title))
