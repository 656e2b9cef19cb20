"""The first JSON object in a text that may be fenced, followed by prose, or cut off in the middle."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dockmill.functions.cases import text

FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL | re.IGNORECASE)
#: A string, whole or open to the end, or a sign of structure.
SIGN = re.compile(r'"(?:[^"\\]|\\.)*+"?|[{}\[\],]', re.DOTALL)
CLOSES = {"}": "{", "]": "["}
LOOSE = ",:\n\r\t "


def _object(said: str) -> dict | None:
    try:
        found = json.loads(said)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def balanced(said: str) -> str | None:
    """From the first brace to the one that closes it; brackets are not looked at."""
    start, depth = said.find("{"), 0
    if start < 0:
        return None
    for m in SIGN.finditer(said, start):
        depth += (m[0] == "{") - (m[0] == "}")
        if depth == 0 and m[0] == "}":
            return said[start : m.end()]
    return None


def closed(said: str) -> str | None:
    """From the first brace on, cut behind the last complete value and closed from there; None without a brace.

    What was opened behind that place is cut off with it, so what is open there is a beginning of
    what is open at the end, and its depth is all there is to remember.
    """
    start = said.find("{")
    if start < 0:
        return None
    open_, safe, depth = [], start, 0
    for m in SIGN.finditer(said, start):
        sign = m[0]
        if sign in "{[":
            open_.append(sign)
        elif sign == ",":
            safe, depth = m.start(), len(open_)
        elif sign in CLOSES and open_ and open_[-1] == CLOSES[sign]:
            open_.pop()
            safe, depth = m.end(), len(open_)
            if not open_:
                return said[start:safe]
    body = said[start:safe] if safe > start else said[start:]
    return body.rstrip(LOOSE) + "".join("}" if c == "{" else "]" for c in reversed(open_[:depth]))


def first_object(said: str | None) -> dict | None:
    """The first object: the whole text, what a fence holds, the first balanced braces, the same cut off and closed, or all between the first and the last brace."""
    said = (said or "").strip()
    if m := FENCE.match(said):
        said = m[1].strip()
    outer = said[said.find("{") : said.rfind("}") + 1] if "{" in said else ""
    return next((found for part in (said, balanced(said), closed(said), outer) if part and (found := _object(part)) is not None), None)


@F.pandas_udf(StringType())
def _repaired(said: pd.Series) -> pd.Series:
    def write(x: str) -> str | None:
        found = first_object(x)
        return None if found is None else json.dumps(found, ensure_ascii=False, separators=(",", ":"))

    return said.map(write)


def repaired_json(c: Column) -> Column:
    """Compact JSON of the first object of a text, null if there is none; keys keep their order, of equal ones the last value counts."""
    return _repaired(text(c))
