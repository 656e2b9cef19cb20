"""Cleaning of single fields: numbers within bounds, titles of concepts, votes, sections, respondents, countries, class codes. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dockmill.functions.cases import literal_map, text

# Words and names that have to be these for equal results.
SMALL_WORDS = ["the", "a", "an", "and", "or", "but", "in", "of", "at", "by", "for", "from", "to", "with", "as", "is", "on"]
SUPPORT, OPPOSE = ["support", "approve", "accept"], ["oppose", "reject"]
RESPONDENTS = {
    "Minister for Immigration and Border Protection": "MIBP",
    "Minister for Immigration and Citizenship": "MIC",
    "Minister for Immigration and Multicultural Affairs": "MIMA",
    "Minister for Immigration and Multicultural and Indigenous Affairs": "MIMIA",
    "Minister for Immigration, Citizenship, Migrant Services and Multicultural Affairs": "MICMSMA",
    "Minister for Immigration, Citizenship and Multicultural Affairs": "MICMA",
    "Minister for Home Affairs": "MHA",
    "Minister for Immigration and Ethnic Affairs": "MIEA",
    "Minister for Immigration & Multicultural & Indigenous Affairs": "MIMIA",
    "Minister for Immigration & Multicultural Affairs": "MIMA",
    "Minister for Immigration & Anor": "Minister for Immigration",
    "Minister for Immigration & Citizenship": "MIC",
    "Minister for Immigration & Border Protection": "MIBP",
}
NO_COUNTRY, LONGEST_COUNTRY = r"(?i)MEMBER\s*:|CASE\s+NUMBER\s*:|HOME\s+AFFAIRS\s*:|TRIBUNAL\s+MEMBER\s*:|:\s*$", 60
# End of fixed values.


def _within(number: Column, least, most) -> Column:
    low = number if least is None else F.greatest(number, F.lit(least))
    return low if most is None else F.least(low, F.lit(most))


def whole_number(c: Column, default: int = 0, least: int | None = None, most: int | None = None) -> Column:
    """A whole number in text, else the default; within bounds. White space around it and a sign are allowed, a fraction is not."""
    said = F.regexp_extract(text(c.cast("string")), r"^\s*([+-]?\d+)\s*$", 1)
    return _within(F.coalesce(F.when(said != "", said.try_cast("long")), F.lit(default)), least, most)


def decimal_number(c: Column, default: float = 0.0, least: float | None = None, most: float | None = None) -> Column:
    """The same for any decimal number."""
    return _within(F.coalesce(F.trim(text(c.cast("string"))).try_cast("double"), F.lit(default)), least, most)


def concept_title(c: Column) -> Column:
    """A concept in title case: small words stay small but for the first, parts of a word with hyphens are words of their own."""
    words = F.filter(F.split(F.trim(text(c)), r"\s+"), lambda w: w != "")

    def capital(w: Column) -> Column:
        return F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1 << 30)))

    def told(w: Column, k: Column) -> Column:
        parts = F.array_join(F.transform(F.split(w, "-", -1), capital), "-")
        return F.when(F.contains(w, F.lit("-")), parts).when((k > 0) & F.lower(w).isin(SMALL_WORDS), F.lower(w)).otherwise(capital(w))

    return F.array_join(F.transform(words, told), " ")


def vote(c: Column) -> Column:
    """support, oppose or neutral."""
    said = F.lower(F.trim(text(c)))
    return F.when(said.isin(SUPPORT), "support").when(said.isin(OPPOSE), "oppose").otherwise("neutral")


def law_section(c: Column) -> Column:
    """A section with short names, single blanks and no signs at its ends."""
    steps = [(r"(?i)\bsections?\b", "s"), (r"(?i)\bss\b", "s"), (r"(?i)\bregs?\b", "reg"), (r"(?i)\bregulation\b", "reg"), (r"\s+", " ")]
    return F.btrim(reduce(lambda said, s: F.regexp_replace(said, s[0], s[1]), steps, F.trim(text(c))), F.lit(" \t\r\n;,."))


def law_section_key(c: Column) -> Column:
    """What equal sections share: letters and digits."""
    return F.regexp_replace(F.lower(law_section(c)), "[^a-z0-9]+", "")


def respondent(c: Column) -> Column:
    """The short name of a minister: of the longest name that it is, else of the longest that it holds, else the text."""
    said = F.trim(text(c))
    low, names = F.lower(said), sorted(RESPONDENTS.items(), key=lambda x: -len(x[0]))
    whole = [F.when(low == name.lower(), short) for name, short in names]
    held = [F.when(F.contains(low, F.lit(name.lower())), short) for name, short in names]
    return F.when(text(c).isin("", "nan"), "").otherwise(F.coalesce(*whole, *held, said))


def is_garbage_country(c: Column) -> Column:
    """Whether a field of countries holds a label or is too long to name one; empty ones do not."""
    said = text(c)
    return (said != "") & (said.rlike(NO_COUNTRY) | (F.length(said) > LONGEST_COUNTRY))


def class_code(existing: Column, fields: list[Column], subclass: Column, classes: dict[str, str]) -> Column:
    """Two letters behind the word class in the first field that has them, else those of the subclass; what is there already stays."""
    have = F.trim(text(existing))
    found = [F.nullif(F.upper(F.regexp_extract(text(f), r"(?i)\bclass\s+([A-Z]{2})\b", 1)), F.lit("")) for f in fields]
    return F.when(~have.isin("", "nan"), have).otherwise(F.coalesce(*found, literal_map(classes)[F.trim(text(subclass))], F.lit("")))
