"""Persons and registries: aliases, surnames, duplicates, completion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockmill.functions.names import with_aliases, with_person_words


def by_alias(people: DataFrame, registry: DataFrame, key: str, alias_col: str = "aliases") -> DataFrame:
    """``people`` with ``full_name`` from ``registry`` (alias, full_name, source): sources in order, longest alias first; null if no alias is filed."""
    forms = people.select(key, F.explode(alias_col).alias("alias")).join(registry, "alias")
    best = forms.groupBy(key).agg(F.min_by("full_name", F.struct("source", -F.length("alias"), "alias", "full_name")).alias("full_name"))
    return people.join(best, key, "left")


def unique_surnames(names: DataFrame, priority: str = "priority") -> DataFrame:
    """(surname, name) of surnames that a single distinct name has, taken from its source of highest priority."""
    counted = names.groupBy("surname").agg(F.countDistinct("name").alias("n"), F.max_by("name", priority).alias("name"))
    return counted.where((F.col("n") == 1) & (F.col("surname") != "")).select("surname", "name")


def merged_records(records: DataFrame, group: str) -> DataFrame:
    """One record for each group: sums, the name of most cases, success rate, and all names."""
    best = F.min_by("name", F.struct(-F.col("case_count"), "name"))
    out = records.groupBy(group).agg(best.alias("canonical_name"), F.sum("case_count").alias("case_count"), F.sum("wins").alias("wins"), F.array_sort(F.collect_set("name")).alias("variants"))
    return out.withColumn("success_rate", F.when(F.col("case_count") > 0, F.round(F.col("wins") / F.col("case_count"), 6)).otherwise(0.0))


def completions(counts: DataFrame, asked: str, limit: int = 20, *, name: str = "name", n: str = "n") -> DataFrame:
    """Names that hold ``asked``: whole names and words first, then beginnings, then the rest; of each the commonest first."""
    said, want = F.lower(F.col(name)), asked.strip().lower()
    words = F.regexp_extract_all(said, F.lit("([a-z0-9']+)"), F.lit(1))
    rank = F.when((said == want) | F.array_contains(words, want), 3).when(F.exists(words, lambda w: w.startswith(want)) | said.startswith(want), 2).otherwise(1)
    return counts.where(F.contains(said, F.lit(want))).withColumn("match", rank).orderBy(F.desc("match"), F.desc(n), F.lower(F.col(name))).limit(limit)


def all_words(rows: DataFrame, asked: str, name: str) -> DataFrame:
    """The row whose name holds every word of ``asked``, the shortest name of several."""
    words = [w for w in asked.lower().split() if w]
    tests = [F.contains(F.lower(F.col(name)), F.lit(w)) for w in words]
    return rows.where(reduce(lambda a, b: a & b, tests, F.lit(True))).orderBy(F.length(name), name).limit(1)


def registry_search(registry: DataFrame, asked: str, number: str = "number", name: str = "name", limit: int = 20) -> DataFrame:
    """Entries whose number starts with ``asked`` (equal ones flagged and first) or whose name holds it."""
    want = asked.strip().lower()
    exact = F.col(number) == want
    hit = F.col(number).startswith(want) if want.isdigit() else F.contains(F.lower(F.col(name)), F.lit(want))
    return registry.where(hit).withColumn("exact", exact).orderBy(F.desc("exact"), F.desc("n"), number).limit(limit)


def merged_aliases(names: DataFrame, name: str = "name", place: str = "place") -> tuple[DataFrame, DataFrame]:
    """(alias, canonical) of a list of full names, and (alias, canonical, other): forms that a second person has too.

    Names are taken in the order of ``place``. Names with the same words, titles and letters aside,
    are one person, under the name of most words, of equals the first. A form belongs to the person
    who comes first with it; others with that form are conflicts, told with the first of them, and
    not merged.
    """
    rows = with_person_words(with_aliases(names.select(F.col(name).alias("full"), F.col(place).alias("at")), "full"), "full")
    rows = rows.where(F.size("words") > 0).withColumn("words", F.array_join("words", " "))
    persons = rows.groupBy("words").agg(F.min_by("full", F.struct((-F.col("n_words")).alias("less"), "at", "full")).alias("canonical"))
    forms = rows.select("words", "at", F.explode("aliases").alias("alias")).groupBy("alias", "words").agg(F.min("at").alias("at"))
    order = F.struct("at", "words")
    owners = forms.groupBy("alias").agg(F.min_by("words", order).alias("words"))
    seconds = forms.join(owners.withColumnRenamed("words", "owner"), "alias").where("words <> owner").groupBy("alias", "owner").agg(F.min_by("words", order).alias("other"))
    merged = owners.join(persons, "words").select("alias", "canonical")
    named = persons.select(F.col("words").alias("other"), F.col("canonical").alias("other_name"))
    conflicts = seconds.join(persons.withColumnRenamed("words", "owner"), "owner").join(named, "other")
    return merged, conflicts.select("alias", "canonical", F.col("other_name").alias("other"))
