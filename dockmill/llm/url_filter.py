"""URL filtering: listed rules first, then association rules mined from labels (DataFrame functions only).

A URL is the set of all its tokens: host labels, path segments, file ending and query keys. A rule
is kept if at least ``MIN_PAGES`` labelled pages hold its tokens and the label ``block``, and at
least ``MIN_CONFIDENCE`` of those with its tokens have the label, unless a shorter rule implies it.
Three steps that lose no such rule bound Spark's FP-growth: tokens of fewer blocked pages go;
tokens that are rules alone are filed at once, as they imply every larger set; and tokens of
exactly the same labelled pages are one item, so that any of them stands for the others. Kept rules
are filed under their rarest item; a page meets the rules of its items and is blocked by any whose
items it holds.
"""

from __future__ import annotations

from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockmill.llm.common import cut, table, url_host, url_path

#: (verdict, host, path): fixed values.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
MIN_PAGES, MIN_CONFIDENCE = 20, 0.9
BLOCK = "label=block"
BROADCAST_RULES = 20_000  # rules of some 200 bytes


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL; none for null or without ``://``."""
    host, path = url_host(url), url_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    full = F.array_compact(F.transform(F.split(path, "/"), lambda s: F.when(s != "", s)))
    tokens = F.concat(
        F.transform(F.split(host, r"\."), lambda s: F.concat(F.lit("host="), s)),
        F.transform(full, lambda s: F.concat(F.lit("path="), F.regexp_replace(s, r"[0-9]+", "0"))),
        F.array(F.concat(F.lit("end="), F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1))),
        F.transform(F.split(query, "&"), lambda s: F.concat(F.lit("key="), F.split(s, "=")[0])),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(tokens, lambda s: ~s.rlike("=$"))))


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls; ``rules`` is a short list."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def mine_rules(labelled: DataFrame, min_support: float = 0.0, min_pages: int = MIN_PAGES, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(tokens, confidence, support) of the rules for blocking, over items, and (token, item) of their tokens.

    ``labelled`` has url and block (boolean). No labelled rows give no rules. ``min_support`` is a
    share of the labelled rows; by default only ``min_pages`` counts, at every size of the table.
    """
    rows = labelled.where("block is not null").select("block", url_tokens(F.col("url")).alias("tokens")).where(F.size("tokens") > 0)
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    least = max(min_pages, ceil(min_support * n))
    held = rows.select("row", "block", F.explode("tokens").alias("token"))
    same = [F.sum(F.xxhash64(F.lit(k), "row").cast("decimal(38,0)")).alias(f"rows{k}") for k in (1, 2)]
    often = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("block").cast("long")).alias("bad"), *same).where(F.col("bad") >= least)
    alike = ["n", "bad", "rows1", "rows2"]
    items = cut(often.join(often.groupBy(*alike).agg(F.min("token").alias("item")), alike).select("token", "item", "n", "bad"))
    alone = F.col("bad") / F.col("n") >= min_confidence
    singles = items.where(alone & (F.col("token") == F.col("item"))).select(F.array("item").alias("tokens"), (F.col("bad") / F.col("n")).alias("confidence"), (F.col("bad") / F.lit(max(n, 1))).alias("support"))
    open_items = items.where(~alone & (F.col("token") == F.col("item"))).select("item")
    named = items.select("token", "item")
    if open_items.isEmpty():
        return singles, named
    some = held.join(open_items, held["token"] == open_items["item"]).groupBy("row", "block").agg(F.collect_list("item").alias("found"))
    baskets = cut(some.select(F.when(F.col("block"), F.concat("found", F.array(F.lit(BLOCK)))).otherwise(F.col("found")).alias("items")))
    # half a page less than ``least``, which rounding up then gives back
    growth = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / baskets.count(), minConfidence=min_confidence)
    rules = growth.fit(baskets).associationRules
    mined = cut(rules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK)).select(F.array_sort("antecedent").alias("tokens"), "confidence", (F.col("support") * baskets.count() / n).alias("support")))
    shorter = mined.select(F.col("tokens").alias("part"), F.col("tokens")[0].alias("token"))
    met = mined.select("tokens", F.explode("tokens").alias("token")).join(shorter, "token")
    implied = met.where((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0)).select("tokens").distinct()
    return singles.unionByName(mined.join(implied, "tokens", "left_anti")), named


def held_items(pages: DataFrame, rules: DataFrame, named: DataFrame) -> DataFrame:
    """``pages`` (rid, tokens) that hold a token of some rule, with the items that stand for them as tokens."""
    used = named.join(rules.select(F.explode("tokens").alias("item")).distinct(), "item", "left_semi")
    met = pages.select("rid", F.explode("tokens").alias("token")).join(used, "token")
    return met.groupBy("rid").agg(F.collect_set("item").alias("tokens"))


def blocked_by_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """rid of the rows of ``pages`` (rid, tokens) that hold all tokens of some rule, each once."""
    rules = cut(rules.select(F.monotonically_increasing_id().alias("rule_id"), F.col("tokens").alias("rule_tokens")))
    number = rules.count()
    tokens = pages.select(F.explode("tokens").alias("token"))
    wanted = rules.select(F.explode("rule_tokens").alias("token")).distinct()
    wanted = F.broadcast(wanted) if number <= BROADCAST_RULES else wanted
    often = tokens.join(wanted, "token", "left_semi").groupBy("token").count()
    filed = rules.select("rule_id", "rule_tokens", F.explode("rule_tokens").alias("token")).join(often, "token", "left")
    rarest = filed.groupBy("rule_id").agg(F.min_by(F.struct("token", "rule_tokens"), F.struct(F.coalesce("count", F.lit(0)), "token")).alias("x"))
    index = rarest.select("x.token", "x.rule_tokens")
    index = F.broadcast(index) if number <= BROADCAST_RULES else index
    met = pages.select("rid", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return met.where(F.size(F.array_except("rule_tokens", "tokens")) == 0).select("rid").distinct()


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", **mining) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``.

    ``labels`` has page_id and block; labels of unknown pages are ignored. A null URL, or one
    without ``://``, has an empty host and path, fits no rule and is allowed. Repeated rows
    repeat; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    url = F.col("url")
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = cut(rows.select("rid", "page_id", "url", url_host(url).alias("host"), url_path(url).alias("path"), url_tokens(url).alias("tokens")))
    known = labels.select(F.col("page_id"), F.col("block")).groupBy("page_id").agg(F.max("block").alias("block"))
    mined, named = mine_rules(rows.join(known, "page_id").select("url", "block"), **mining)
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    judged = rows.select("rid", "page_id", "host", "path", "tokens", rule.alias("rule"), verdict.alias("verdict"))
    mined = cut(mined)
    hit = blocked_by_rules(held_items(judged.where("verdict is null").select("rid", "tokens"), mined, named), mined).select("rid", F.lit("block").alias("mined"))
    return judged.join(hit, "rid", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", "mined", F.lit("allow")).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` speaks of pages by their number: a page is to be blocked if it is toxic or of low quality."""
    labels = table(spark, sf_dir, "labels")
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    return filter_urls(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("block")))
