"""Exact duplicates by deterministic block naming (DataFrame functions only).

A text is cut into fixed-size blocks. Equal blocks get the same integer name, different
blocks different ones: rows are shuffled and sorted by block, and the smallest row number of
a run of equal blocks is its name. Adjacent names are then paired and the pairs named in the
same way until each document has a single name. Names come from comparing whole blocks, never
from a digest, so two documents share (number of blocks, final name) only if they are equal.

Skew: the text is shuffled once. Blocks of more than ``HOT_ROWS`` rows (known by a hash, whose
counts are combined before they are shuffled) are named beforehand, each once; the names are joined
by broadcast, or beyond ``BROADCAST_BLOCKS`` of them by salted keys, so no task gathers a hot
block's rows. Pairs and groups are named by aggregates with map-side combining, and hot ones are
joined back by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockmill.llm.common import BROADCAST_KEYS, HOT_ROWS, ascii_lower, cut, hot_rows, join_counted, keep_rows, table

BLOCK = 1024
BROADCAST_BLOCKS, SALTS = 8_192, 16


def _blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    cut_up = F.when(F.length("text") == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % BLOCK), F.lit(0)))
    rows = df.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2("text", 256).alias("sha"), cut_up.alias("blocks"))
    rows = rows.select("rid", "doc_id", "sha", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("pos", "block"))
    first = F.col("pos") == 0
    return rows.select("rid", "n_blocks", "pos", "block", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("sha")).alias("sha"))


def _named_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` of _blocks with the name of each block in its place."""
    keyed = rows.withColumn("h", F.xxhash64("block"))
    counts = cut(keyed.groupBy("h").count().where(F.col("count") > HOT_ROWS))
    often_rows = hot_rows(keyed.count()) if counts.count() > BROADCAST_KEYS else HOT_ROWS
    hot = cut(counts.where(F.col("count") > often_rows).select("h"))
    kept = ["rid", "n_blocks", "pos", "doc_id", "sha"]
    numbered = rows.withColumn("bid", F.monotonically_increasing_id())
    if hot.isEmpty():
        return numbered.select(*kept, F.min("bid").over(Window.partitionBy("block")).alias("name"))
    often = keyed.join(F.broadcast(hot), "h", "left_semi").select("block").distinct()
    often = cut(often.select("block", (-1 - F.monotonically_increasing_id()).alias("hot_name")))
    if often.count() <= BROADCAST_BLOCKS:  # at most 1,024 characters each
        numbered = numbered.join(F.broadcast(often), "block", "left")
        cold = F.col("hot_name").isNull()  # a hot block's rows are named already; they go where their number leads
        numbered = numbered.select(*kept, "bid", "hot_name", F.when(cold, F.col("block")).alias("block"), F.when(~cold, F.col("bid")).alias("spread"))
        return numbered.select(*kept, F.coalesce("hot_name", F.min("bid").over(Window.partitionBy("block", "spread"))).alias("name"))
    numbered = numbered.withColumn("h", F.xxhash64("block"))
    cold = numbered.join(F.broadcast(hot), "h", "left_anti").select(*kept, F.min("bid").over(Window.partitionBy("block")).alias("name"))
    salted = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    warm = numbered.join(F.broadcast(hot), "h", "left_semi").withColumn("salt", F.pmod(F.xxhash64("rid", "pos"), F.lit(SALTS)).cast("int"))
    return cold.unionByName(warm.join(salted, ["block", "salt"]).select(*kept, F.col("hot_name").alias("name")))


def name_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, sha, n_blocks, name): one row per input row; equal texts share n_blocks and name."""
    named = cut(_named_blocks(_blocks(df, id_col, text_col)))
    meta = named.where("pos = 0").select("rid", "doc_id", "sha", "n_blocks")
    done = named.where("n_blocks = 1").select("rid", "name")
    level, left = named.where("n_blocks > 1").select("rid", "pos", F.col("n_blocks").alias("n"), "name"), True
    while left:
        even = F.col("pos") % 2 == 0
        pairs = level.groupBy("rid", F.expr("pos div 2").cast("int").alias("pos"), F.expr("(n + 1) div 2").cast("int").alias("n")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.max(F.when(~even, F.col("name"))).alias("b"),
        )
        pairs = cut(pairs.select("rid", "pos", "n", "a", F.coalesce("b", F.lit(-(2**62))).alias("b"), F.monotonically_increasing_id().alias("bid")))
        names = pairs.groupBy("a", "b").agg(F.min("bid").alias("name"), F.count(F.lit(1)).alias("rows"))
        level = cut(join_counted(pairs, names, ["a", "b"], "rows").select("rid", "pos", "n", "name"))
        done = done.unionByName(level.where("n = 1").select("rid", "name"))
        level = level.where("n > 1")
        left = not level.isEmpty()
    return meta.join(done, "rid").select("rid", "doc_id", "sha", "n_blocks", "name")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of equal texts: doc_id, keep_id, group_size, kept, text_sha256, one row per input row.

    Texts are equal when identical after lower-casing A-Z. A null text counts as empty; an empty
    text is a text like any other. The row with the largest id stays (null ids are the smallest);
    of repeated rows with that id exactly one stays. Very long texts are compared whole. An empty
    table gives no rows. Other columns of ``df`` are ignored, whatever their names.
    """
    docs = cut(name_documents(df, id_col, text_col))
    groups = docs.groupBy("n_blocks", "name").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    joined = join_counted(docs, groups, ["n_blocks", "name"], "group_size")
    return joined.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("keep.rid") == F.col("rid")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of equal texts, all its columns kept."""
    found = exact_duplicates(df, id_col, text_col).select("doc_id", F.xxhash64("text_sha256").alias("key"), "kept")
    return keep_rows(df, found, id_col, F.xxhash64(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)))


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all ``documents``; odd rows as in ``exact_duplicates``."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
