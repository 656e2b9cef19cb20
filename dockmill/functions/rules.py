"""Rules with rejection: ordered patterns whose matches must pass a test of their own before they decide.

A match that fails its test passes the turn to the pattern's next match and then to the next rule.
What appeared for whom, and who sat, is told in many ways; both are read so. Texts go through in
Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from dockmill.functions.cases import text
from dockmill.functions.origin import LABELS_AFTER


class Rule(NamedTuple):
    """``read`` turns a match and the text into an answer, or None if it is no good; ``first`` characters are looked at, ``tries`` matches at most."""

    pattern: re.Pattern
    read: Callable
    first: int | None = None
    tries: int | None = None


def decide(said: str, rules: list[Rule]):
    """The answer of the first match of the first rule that has one, else None."""
    for rule in rules:
        for k, m in enumerate(rule.pattern.finditer(said if rule.first is None else said[: rule.first])):
            if rule.tries is not None and k >= rule.tries:
                break
            if (answer := rule.read(m, said)) is not None:
                return answer
    return None


# Patterns and words of the rules on representation.
APPEARANCES, RECORD = 15000, 5000
REPRESENTATIVE = r"REPRESENTATIVE\s*:\s*\n{1,3}\s*(.+?)(?:\s+" + LABELS_AFTER + r"|\n{2,})"
ALONE = r"(?:self[- ]represented|appeared?\s+(?:in\s+person|on\s+(?:his|her|their)\s+own\s+behalf)|unrepresented|without\s+representation)"
NOT_REPRESENTED = r"(?:was\s+(?:not|never)\s+(?:legally\s+)?represented|no\s+(?:legal\s+)?representative|applicant\s+(?:was\s+)?unrepresented|did\s+not\s+have\s+(?:a\s+)?(?:legal\s+)?representative)"
CAME_ALONE = r"(?:applicant|review\s+applicant|appellant)\s+appeared\s+(?:at|before)\s+the\s+tribunal\s+(?:in\s+person|unrepresented|without\s+(?:legal\s+)?representation|on\s+(?:his|her|their)\s+own\s+behalf)"
IN_REVIEW = r"represented\s+in\s+relation\s+to\s+the\s+review\s+by\s+(?:his|her|their|a)\s+(?:registered\s+)?(?:migration\s+agent|solicitor|barrister|counsel|adviser|advisor|lawyer)(?:,?\s+([A-Z][^\n,\.]{2,60}?))?(?:\.|,|\n)"
SOMEONE_IN_REVIEW = r"(?:applicants?\s+were\s+represented|represented\s+in\s+relation\s+to\s+the\s+review)"
APPLICANTS = r"Applicant(?:'s)?\s+Representative\s*:?\s*\n?\s*(.+?)(?:\n|$)"
REPRESENTED_BY = r"(?:represented\s+by|Counsel\s+for\s+the\s+Applicant)\s*:?\s*(.+?)(?:\n|,\s*instructed|$)"
COUNSEL = r"(?:Counsel|Solicitor)\s+for\s+(?:the\s+)?(?:Appellant|Applicant)s?:?\s*\n\s*([^\n]{3,80}?)(?:\s+(?:Solicitor|Counsel|Appearing)\s+for\s+the\s+|\s*\n|$)"
FOR_APPELLANT = r"^For\s+(?:the\s+)?(?:Appellant|Applicant)s?:?\s+(.{3,80}?)(?:\n|$)"
AGENT = r"(?:Migration\s+Agent|Registered\s+Migration\s+Agent)\s*:\s*\n?\s*(.+?)(?:\n|$)"
APPEARED = r"(?:appeared?|appearing)\s+(?:on\s+behalf\s+of|for)\s+(?:the\s+)?(?:appellant|applicant)s?[:\s]+([A-Z][^\n]{2,60}?)(?:\n|$)"
OLD_FIELD = r"(?:APPLICANT(?:'?S)?\s+REPRESENTATIVE|REPRESENTATIVE\s+FOR\s+(?:THE\s+)?APPLICANT)\s*:\s*\n\s*\n?\s*(.+?)(?:\s*\n\s*\n|\s*DECISION|\s*DATE)"
NOBODY_RECORDED = r"nil|none|n/a|not\s+applicable"
NOBODY = r"self[- ]represented|nil|none|n/a"
NOBODY_AGENT = r"nil|none|n/a|unrepresented"
NO_NAMES = {"the applicant is self-represented", "self-represented", ""}
NO_PERSONS = {"The", "In", "His", "Her", "Their", "The Tribunal", "A Migration"}
PERSON = r"(?:by\s+)?([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})"
#: Rules on who sat.
BENCH = [
    r"(?:Judge\(s\)|JUDGES?|JUSTICE|TRIBUNAL\s+MEMBERS?)\b[ \t]*[:\-][ \t]*([A-Z][A-Za-z'\-]+(?:[ \t]+[A-Z][A-Za-z'\-]+){0,4}(?:[ \t]+J)?)\b",
    r"(?:Before|Coram)\b[ \t]*[:\-][ \t]*([A-Z][A-Za-z'\-]+(?:[ \t]+[A-Z][A-Za-z'\-]+){0,4}(?:[ \t]+J)?)\b",
]
PROSE = [" the ", " that ", " which ", " of the ", " was ", " were ", " when ", " where ", " applicant ", " tribunal ", " department ", " decision ", " hearing ", " evidence ", " visa ", " review "]
NO_JUDGES = {"date", "judge", "judges", "member", "members", "justice", "tribunal"}
LONGEST_JUDGE, SIGNS = 60, "([–—\n\r\t"
# End of fixed values.

_I = re.IGNORECASE
NOBODY_RECORDED, NOBODY, NOBODY_AGENT, REPRESENTED_BY = (re.compile(p, _I) for p in (NOBODY_RECORDED, NOBODY, NOBODY_AGENT, REPRESENTED_BY))
NUMBER, LABEL_BEHIND, PERSON = re.compile(r"\s*\(MARN\s*:.*?\)", _I | re.DOTALL), re.compile(r"\s[A-Z][A-Z\s]*:"), re.compile(PERSON)
ROLE_BEHIND = re.compile(r"\s(?:Solicitor|Counsel|Appearing)\s", _I)

YES, NO = "Yes", "No"


def _nobody(m: re.Match, said: str) -> tuple[str, str]:
    return NO, ""


def _recorded(m: re.Match, said: str) -> tuple[str, str] | None:
    name = NUMBER.sub("", m[1].strip()).strip()
    if behind := LABEL_BEHIND.search(name):
        name = name[: behind.start()].strip()
    name = name.replace("\n", " ").rstrip(".,;:")
    if NOBODY_RECORDED.search(name):
        return NO, ""
    return (YES, name) if name else None


def _named_by(said: str) -> tuple[str, str] | None:
    m = REPRESENTED_BY.search(said[:APPEARANCES])
    return (YES, m[1].strip()) if m and m[1].strip().lower() not in NO_NAMES else None


def _alone(m: re.Match, said: str) -> tuple[str, str]:
    """Someone may be named in spite of it."""
    return _named_by(said) or (NO, "")


def _in_review(m: re.Match, said: str) -> tuple[str, str]:
    name = (m[1] or "").strip()
    if not name and (near := PERSON.search(said[:APPEARANCES], max(0, m.start() - 10), m.end() + 150)) and near[1] not in NO_PERSONS:
        name = near[1]
    return YES, name


def _named(least: int = 1, nobody: re.Pattern | None = None, *, says_no: bool = False) -> Callable:
    """A reader of group 1: a name of ``least`` characters; what ``nobody`` finds in it is a no, or no answer."""

    def read(m: re.Match, said: str) -> tuple[str, str] | None:
        name = m[1].strip()
        if nobody is not None and nobody.search(name):
            return (NO, "") if says_no else None
        return (YES, name) if len(name) >= least else None

    return read


def _counsel(m: re.Match, said: str) -> tuple[str, str] | None:
    name = m[1].strip()
    if behind := ROLE_BEHIND.search(name):
        name = name[: behind.start()].strip()
    return (YES, name) if len(name) > 2 and not NOBODY.search(name) else None


REPRESENTATION = [
    Rule(re.compile(REPRESENTATIVE, _I | re.DOTALL), _recorded, RECORD, 1),
    Rule(re.compile(ALONE, _I), _alone, APPEARANCES, 1),
    Rule(re.compile(NOT_REPRESENTED, _I), _nobody, APPEARANCES, 1),
    Rule(re.compile(CAME_ALONE, _I), _nobody, APPEARANCES, 1),
    Rule(re.compile(IN_REVIEW, _I), _in_review, APPEARANCES, 1),
    Rule(re.compile(SOMEONE_IN_REVIEW, _I), lambda m, said: (YES, ""), APPEARANCES, 1),
    Rule(re.compile(APPLICANTS, _I), _named(0, NOBODY, says_no=True), APPEARANCES, 1),
    Rule(REPRESENTED_BY, lambda m, said: _named_by(said), APPEARANCES, 1),
    Rule(re.compile(COUNSEL, _I), _counsel, APPEARANCES, 1),
    Rule(re.compile(FOR_APPELLANT, _I | re.MULTILINE), _named(3), APPEARANCES, 1),
    Rule(re.compile(AGENT, _I), _named(1, NOBODY_AGENT), APPEARANCES, 1),
    Rule(re.compile(APPEARED, _I), _named(3), APPEARANCES, 1),
    Rule(re.compile(OLD_FIELD, _I), _named(1, NOBODY, says_no=True), RECORD, 1),
]


def representation(said: str | None) -> tuple[str, str]:
    """(Yes, No or empty; name) of who appeared for the applicant."""
    return decide(said or "", REPRESENTATION) or ("", "")


def is_judge(name: str) -> bool:
    """Whether a captured name may be a judge's: short, with a capital, one line, no prose and no bare title."""
    if not name or len(name) > LONGEST_JUDGE or not name[0].isupper() or any(c in name for c in SIGNS):
        return False
    low = f" {name.lower()} "
    return low.strip(" .,;:") not in NO_JUDGES and not any(w in low for w in PROSE)


def _judge(m: re.Match, said: str) -> str | None:
    name = m[1].strip()
    return name if is_judge(name) else None


JUDGES = [Rule(re.compile(p, _I), _judge) for p in BENCH]


def judge_in(said: str | None) -> str:
    """The first name after a bench's label that may be a judge's; empty if none is."""
    return decide(said or "", JUDGES) or ""


@F.pandas_udf(StructType().add("represented", "string").add("representative", "string"))
def _represented(said: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([representation(x) for x in said], columns=["represented", "representative"])


@F.pandas_udf(StringType())
def _judges(said: pd.Series) -> pd.Series:
    return said.map(judge_in)


def represented_by(c: Column) -> Column:
    """A struct of represented and representative; null text counts as empty."""
    return _represented(text(c))


def sitting_judge(c: Column) -> Column:
    return _judges(text(c))
