"""Column functions of the case domain; all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from dockmill.functions import vocabulary as v


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(pairs.items())))


def normalise_outcome(c: Column) -> Column:
    """The label of the first known stem in the text, else Other."""
    said = F.lower(F.trim(text(c)))
    return reduce(lambda rest, rule: F.when(said.contains(rule[0]), rule[1]).otherwise(rest), reversed(v.OUTCOMES), F.lit(v.OTHER))


def is_win(outcome: Column, court: Column, tribunals: list[str] = v.TRIBUNALS, courts: list[str] = v.COURTS) -> Column:
    """Whether a normalised outcome is a success before that body."""
    return F.when(court.isin(tribunals), outcome.isin(v.TRIBUNAL_WINS)).when(court.isin(courts), outcome.isin(v.COURT_WINS)).otherwise(outcome.isin(v.ANY_WINS))


def rate(wins: Column, total: Column) -> Column:
    """Percent to one decimal, 0 of nothing."""
    return F.when(total > 0, F.round(F.lit(100.0) * wins / total, 1)).otherwise(0.0)


def lift(share: Column, overall: Column) -> Column:
    """The quotient of two rates of one decimal to two decimals, halves up, computed in whole numbers; 0 over nothing."""
    a, b = F.round(share * 10).cast("long"), F.round(overall * 10).cast("long")
    return F.when(overall > 0, F.floor((a * 200 + b) / (b * 2)) / 100).otherwise(0.0)


def confidence(total: Column) -> Column:
    return F.when(total > 100, "high").when(total >= 20, "medium").otherwise("low")


def court_type(has_tribunal: Column, has_court: Column) -> Column:
    return F.when(has_tribunal & ~has_court, "tribunal").when(has_court & ~has_tribunal, "court").when(has_court, "mixed").otherwise("unknown")


def split_list(c: Column, pattern: str = "[;,]") -> Column:
    """Trimmed non-empty parts, in order, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(text(c), pattern), lambda x: F.trim(x)), lambda x: x != ""))


def split_concepts(c: Column, known: dict[str, str] | None = None) -> Column:
    """Canonical concepts of a delimited text, in order, each once; unknown ones are dropped."""
    forms = literal_map(known if known is not None else v.CONCEPTS)
    named = F.transform(F.split(text(c), "[;,]"), lambda x: forms[F.lower(F.regexp_replace(F.trim(x), "[.,;:]+$", ""))])
    return F.array_distinct(F.array_compact(named))


def clean_subclass(c: Column) -> Column:
    """One to four digits, without a trailing ``.0``; else empty."""
    return F.regexp_extract(F.trim(text(c)), r"^(\d{1,4})(\.0)?$", 1)


def family(c: Column, families: dict[str, str] | None = None) -> Column:
    return F.coalesce(literal_map(families if families is not None else v.FAMILIES)[clean_subclass(c)], F.lit(v.OTHER))


def case_id(citation: Column, url: Column, title: Column) -> Column:
    key = F.coalesce(F.nullif(citation, F.lit("")), F.nullif(url, F.lit("")), title, F.lit(""))
    return F.substring(F.sha2(key, 256), 1, 12)


def case_date(c: Column) -> Column:
    """Date of ``DD Month YYYY`` (full or short month), else null."""
    said = F.trim(F.regexp_replace(text(c), r"\s+", " "))
    return F.coalesce(F.try_to_timestamp(said, F.lit("d MMMM yyyy")), F.try_to_timestamp(said, F.lit("d MMM yyyy"))).cast("date")


def date_sort(d: Column) -> Column:
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def representation(c: Column) -> Column:
    said = F.lower(F.trim(text(c)))
    return F.when(said.isin("yes", "true", "1", "represented"), "represented").when(said.isin("no", "false", "0", "unrepresented", "self"), "self_represented").otherwise("unknown")


def file_name(citation: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(text(citation), r"[^A-Za-z0-9\-_\[\] ]", "_")), 1, 100)


def semantic_text(*cols: Column) -> Column:
    return F.concat_ws(" | ", *(F.nullif(F.trim(text(c)), F.lit("")) for c in cols))


def tokens(c: Column) -> Column:
    """Lower-case runs of two or more ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit("([a-z0-9]{2,})"), F.lit(1))


def cursor(year: Column, key: Column) -> Column:
    """Page cursor: unpadded base64url of the JSON of the sort keys."""
    encoded = F.regexp_replace(F.base64(F.encode(F.to_json(F.struct(year.alias("year"), key.alias("case_id"))), "UTF-8")), "[\r\n]", "")
    return F.regexp_replace(F.translate(encoded, "+/", "-_"), "=+$", "")


def vector_literal(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.format_string("%.9f", x)), ","), F.lit("]"))


def mentions_domain(c: Column, extra: list[str] | None = None) -> Column:
    said = F.lower(text(c))
    return reduce(lambda a, b: a | b, [said.contains(w.lower()) for w in [*v.DOMAIN_TERMS, *(extra or [])]])


def contains_ci(c: Column, wanted: str) -> Column:
    return F.contains(F.lower(text(c)), F.lit(wanted.lower()))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(c: Column) -> Column:
    norm = F.sqrt(dot(c, c))
    return F.transform(c, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))
