"""Row-level operators: paging, related rows, upserts, merges, deduplication, quality, tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockmill.functions.cases import contains_ci, split_list


def offset_page(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def seek_page(df: DataFrame, year: int | None, key, size: int, *, year_col: str = "year", key_col: str = "case_id", backwards: bool = False) -> DataFrame:
    """The page after (or before) a place in the order (year, key) descending; the bound reaches the scan."""
    y, k = F.col(year_col), F.col(key_col)
    if year is not None:
        df = df.where((y > year) | ((y == year) & (k > key)) if backwards else (y < year) | ((y == year) & (k < key)))
    page = df.orderBy(*((y.asc(), k.asc()) if backwards else (y.desc(), k.desc()))).limit(size)
    return page.orderBy(y.desc(), k.desc()) if backwards else page


def keyword_filter(df: DataFrame, words: str, cols: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [contains_ci(F.col(c), words) for c in cols]))


def related(df: DataFrame, anchor: dict, weights: dict[str, int], limit: int, *, key: str, then: str) -> DataFrame:
    """Rows that share non-empty values with ``anchor``, by weighted score, then ``then`` descending, then key."""
    parts = [F.when(F.col(c) == anchor[c], w).otherwise(0) for c, w in weights.items() if anchor.get(c) not in (None, "")]
    score = reduce(lambda a, b: a + b, parts, F.lit(0))
    return df.where(F.col(key) != anchor[key]).withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.desc(then), key).limit(limit)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last write wins: the first row of each key in ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``base`` with the rows of ``changes`` in place of those of equal key; one row per key in each."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes.select(*base.columns))


def insert_new(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``changes`` whose key is new, one for each; an empty key is always new."""
    blank = F.coalesce(F.col(key), F.lit("")) == ""
    fresh = changes.where(~blank).join(base.select(key).where(~blank), key, "left_anti").dropDuplicates([key])
    return base.unionByName(fresh.select(*base.columns)).unionByName(changes.where(blank).select(*base.columns))


def update_rows(df: DataFrame, key: str, value, changes: dict, allowed: set[str]) -> DataFrame:
    """Point update of allow-listed columns; unknown ones are ignored."""
    return df.withColumns({c: F.when(F.col(key) == value, F.lit(x)).otherwise(F.col(c)) for c, x in changes.items() if c in allowed and c in df.columns})


def delete_rows(df: DataFrame, key: str, values: list) -> DataFrame:
    return df.where(~F.col(key).isin(values) | F.col(key).isNull())


def merge_coalesce(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer merge; a column keeps the left value unless that is empty."""
    cols = [c for c in left.columns if c != key]
    joined = left.alias("l").join(right.alias("r"), key, "full_outer")
    return joined.select(key, *(F.coalesce(F.nullif(F.col(f"l.{c}"), F.lit("")), F.col(f"r.{c}")).alias(c) for c in cols))


def fill_empty(base: DataFrame, values: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Empty columns take the value of the row of equal key."""
    joined = base.alias("b").join(values.select(key, *cols).alias("v"), key, "left")
    return joined.select(*(F.coalesce(F.nullif(F.trim(F.col(f"b.{c}")), F.lit("")), F.col(f"v.{c}"), F.col(f"b.{c}")).alias(c) if c in cols else F.col(key) if c == key else F.col(f"b.{c}") for c in base.columns))


def with_parent_sums(children: DataFrame, parent: str, sums: dict[str, Column]) -> DataFrame:
    """``children`` with sums over all children of their parent; sums are combined before they are shuffled, and Spark splits the join of a parent of very many."""
    found = children.groupBy(F.col(parent).alias("__parent")).agg(*(c.alias(name) for name, c in sums.items()))
    return children.join(found, children[parent].eqNullSafe(found["__parent"]), "left").drop("__parent")


def key_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, n): how many keys are on the left only, the right only, in both."""
    a, b = (d.select(key).distinct().withColumn(n, F.lit(True)) for d, n in ((left, "l"), (right, "r")))
    side = F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("both")
    return a.join(b, key, "full_outer").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def add_tag(tags: Column, tag: str, longest: int = 50) -> Column:
    """A comma list with one more tag: sorted, each once; marks that would break the list go."""
    clean = tag.translate(str.maketrans("", "", ",<>")).strip()[:longest]
    return F.array_join(F.array_sort(F.array_union(split_list(tags, ","), F.array(F.lit(clean)))), ", ")


def fill_rates(df: DataFrame, cols: list[str], group: str) -> DataFrame:
    """(group, field, filled, total) in long form, from one pass."""
    sums = df.groupBy(group).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.trim(F.col(c).cast("string")) != "").alias(c) for c in cols))
    return sums.unpivot([group, "total"], cols, "field", "filled")


def stratified_blocks(df: DataFrame, stratum: str, key: str, percent: int, block: int, seed: int = 0) -> DataFrame:
    """A sample of max(1, percent) of each stratum in an order fixed by hash, in numbered blocks.

    The hash is cut at six standard deviations above the sample's share before rows are ranked, so
    that the ranking of a large stratum sees little more than the sample.
    """
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("__rows")).withColumn("wanted", F.greatest(F.lit(1), F.expr(f"__rows * {percent} div 100")))
    drawn = df.withColumn("__at", F.xxhash64(F.col(key), F.lit(seed)))
    share = F.least(F.lit(1.0), (F.col("wanted") + 6 * F.sqrt("wanted") + 20) / F.col("__rows"))
    low = drawn.join(F.broadcast(sizes), stratum).where(F.col("__at") / F.lit(2.0**64) + 0.5 <= share)  # strata are few: a value of a category
    w = Window.partitionBy(stratum).orderBy("__at", key)
    return low.withColumn("place", F.row_number().over(w)).where("place <= wanted").withColumn("block", F.expr(f"(place - 1) div {block}")).drop("__at", "__rows")


def visible_rows(df: DataFrame, tenant: str | None, col: str = "tenant_id") -> DataFrame:
    """Rows of everyone and of the tenant who asks."""
    return df.where(F.col(col).isNull() | (F.col(col) == F.lit(tenant)))
