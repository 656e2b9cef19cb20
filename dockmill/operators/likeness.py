"""Groups of names that are alike, and persons told apart by where and when they sat."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockmill.sources.shared import cut

ALIKE = 0.85
#: Rows of a table of grams or rules that may be broadcast; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 200_000


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, all of ``a``'s places at once as the bits of a number."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    open_ = full
    for c in b:
        hit = open_ & places.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


def alike(a: str, b: str, share: float = ALIKE) -> bool:
    """Whether insertions and deletions leave at least ``share`` of both names: twice the common part over both lengths."""
    return 2 * common_length(a, b) >= share * (len(a) + len(b)) - 1e-9


@lru_cache(maxsize=4096)
def least_shared(n: int, share: float, size: int) -> int:
    """How many grams of ``size`` a name of ``n`` letters shares at least with any name alike to it.

    An insertion or deletion takes part in ``size`` grams of the longer name. Below 1 nothing is promised.
    """
    least = n
    m = max(1, int(n * share / (2 - share)) - 1)
    while m <= n * (2 - share) / share + 1:
        edits = int((1 - share) * (n + m) + 1e-9)
        edits -= (edits - abs(n - m)) % 2  # edits and the difference in length are even together
        if edits >= abs(n - m):
            least = min(least, max(n, m) - size + 1 - size * edits)
        m += 1
    return least


def gram_size(share: float) -> int:
    """Pairs of letters from 0.85 on; below, they would miss short names, and letters are taken."""
    return 2 if share >= ALIKE else 1


def grams(name: str, size: int) -> list[str]:
    """Runs of ``size`` letters, numbered where they repeat."""
    seen: dict[str, int] = {}
    out = []
    for k in range(len(name) - size + 1):
        g = name[k : k + size]
        seen[g] = seen.get(g, 0) + 1
        out.append(f"{g}{seen[g]}")
    return out


def alike_pairs(keys: DataFrame, share: float = ALIKE) -> DataFrame:
    """(a, b) with place(a) < place(b) of the alike among the distinct ``keys`` (key, place).

    Two alike names share a gram among the rarest of each, as many as leave fewer than the number
    they must share: only those grams are joined. What meets is verified.
    """
    size = gram_size(share)

    @F.pandas_udf("array<string>")
    def cut_up(names: pd.Series) -> pd.Series:
        return names.map(lambda n: grams(n, size))

    @F.pandas_udf("int")
    def needed(lengths: pd.Series) -> pd.Series:
        return lengths.map(lambda n: max(1, least_shared(int(n), share, size)))

    rows = keys.select("key", "place", F.length("key").alias("n"), cut_up("key").alias("grams"))
    rows = rows.select("key", "place", "n", (F.size("grams") - needed("n") + 1).alias("most"), F.explode("grams").alias("gram"))
    rows = cut(rows)
    often = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    often = cut(often)
    often = F.broadcast(often) if often.count() <= BROADCAST_ROWS else often
    ranked = rows.join(often, "gram").withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("often", "gram")))
    kept = cut(ranked.where(F.col("rank") <= F.col("most")).select("key", "place", "n", "gram"))
    a, b = (kept.select("gram", F.col("key").alias(x), F.col("place").alias(f"place_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    close = F.abs(F.col("n_a") - F.col("n_b")) <= (1 - share) * (F.col("n_a") + F.col("n_b")) + 1e-9
    met = a.join(b, (a["gram"] == b["gram"]) & (F.col("place_a") < F.col("place_b")) & close).select("a", "b").distinct()

    def verify(batches):
        for batch in batches:
            one, two = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield batch.filter(pa.array(np.array([alike(x, y, share) for x, y in zip(one, two, strict=True)], bool)))

    return met.mapInArrow(verify, "a string, b string")


def leaders_of(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, leader) of distinct ``keys`` (key, place): going by place, a key that is alike to no earlier leader leads, others follow the first such leader.

    ``pairs`` are (a, b) of alike keys, a the earlier. In each round every key leads whose earlier
    alike keys all follow others, and what is alike to a leader follows. There are as many rounds as
    the longest chain of such decisions has links.
    """
    pairs = cut(pairs)
    left, leads = pairs, None
    while not left.isEmpty():
        early, late = left.select(F.col("a").alias("key")).distinct(), left.select(F.col("b").alias("key")).distinct()
        first = cut(early.join(late, "key", "left_anti"))
        leads = first if leads is None else leads.unionByName(first)
        follow = left.join(first, left["a"] == first["key"], "left_semi").select(F.col("b").alias("key")).distinct()
        gone = cut(first.unionByName(follow))
        rest = left.join(gone.withColumnRenamed("key", "a"), "a", "left_anti").join(gone.withColumnRenamed("key", "b"), "b", "left_anti")
        # a key none of whose earlier ones is left leads in the next round; it may have no later one
        alone = follow_candidates(left, rest, gone)
        leads = leads.unionByName(alone)
        left = cut(rest)
    if leads is None:
        return keys.select("key", F.col("key").alias("leader"))
    leads = cut(leads.distinct())
    places = keys.select(F.col("key").alias("a"), "place")
    own = pairs.join(leads.withColumnRenamed("key", "a"), "a", "left_semi").join(places, "a").groupBy(F.col("b").alias("key")).agg(F.min_by("a", "place").alias("first"))
    own = own.join(leads, "key", "left_anti")
    return keys.join(own, "key", "left").select("key", F.coalesce("first", "key").alias("leader"))


def follow_candidates(left: DataFrame, rest: DataFrame, gone: DataFrame) -> DataFrame:
    """Keys of ``left`` that are undecided but have no pair in ``rest``: all they are alike to follow others, so they lead."""
    every = left.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    still = rest.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    return every.join(gone, "key", "left_anti").join(still, "key", "left_anti")


def alike_groups(names: DataFrame, key_col: str, order_col: str, share: float = ALIKE) -> DataFrame:
    """``names`` with ``leader``, the key of the group: greedy in the order of ``order_col``, as a reader with a list would do it.

    Names of equal key are one group; a null or empty key stays without leader. Equal to taking the
    names one after the other, each joining the first group whose leader is alike.
    """
    keys = names.where(F.col(key_col) != "").groupBy(F.col(key_col).alias("key")).agg(F.min(order_col).alias("place"))
    keys = cut(keys)
    found = leaders_of(keys, alike_pairs(keys, share)).withColumnRenamed("key", "__key")
    return names.join(found, names[key_col] == found["__key"], "left").drop("__key")


def in_context(people: DataFrame, rules: DataFrame) -> DataFrame:
    """``people`` with ``resolved``: the person that the rules tell a surname to be in its court, group of courts and year.

    People have surname, court, court_group, year and parts (``names.parts_of``); rules have
    surname, part (what the name must have), court, court_group, year_from, year_to
    (null where any will do), priority and person. The first rule by priority that fits decides, of
    equals the first person by name; a year of 0 or null fits no rule that asks for years. Who fits
    no rule stays, without a person.
    """
    fields = F.struct("priority", "person", "part", "court", "court_group", "year_from", "year_to")
    by_name = rules.groupBy(F.col("surname").alias("__surname")).agg(F.array_sort(F.collect_list(fields)).alias("__rules"))
    few = F.broadcast(by_name) if rules.count() <= BROADCAST_ROWS else by_name
    year = F.coalesce(F.col("year"), F.lit(0))

    def fits(rule):
        asks = rule["year_from"].isNotNull() | rule["year_to"].isNotNull()
        within = ~asks | ((year > 0) & (year >= F.coalesce(rule["year_from"], F.lit(0))) & (year <= F.coalesce(rule["year_to"], F.lit(9999))))
        named = rule["part"].isNull() | F.array_contains(F.coalesce(F.col("parts"), F.array().cast("array<string>")), rule["part"])
        place = [rule[c].isNull() | F.coalesce(rule[c] == F.col(c), F.lit(False)) for c in ("court", "court_group")]
        return within & named & place[0] & place[1]

    first = F.get(F.filter("__rules", fits), F.lit(0))
    return people.join(few, F.col("surname") == F.col("__surname"), "left").withColumn("resolved", first["person"]).drop("__surname", "__rules")
