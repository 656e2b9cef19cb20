"""Lines that many documents repeat, by levelled sorted runs of line hashes (DataFrame functions only).

Documents come in batches. A batch's line keys, as hashes of 128 bits with the number of documents
that hold them, are merge-anti-joined with the runs written so far: keys that no run has are new and
belong to the batch's largest document, the others add to the count alone. The batch is then written
as a run of its own, in buckets of the hash and sorted within each. ``fanout`` runs of a level are
merged into one of the next, so there are few runs at any time and a key is rewritten once a level.
Batches and runs are dealt by the same buckets, so after a batch's own aggregate the anti-joins
shuffle and sort no run; a merge shuffles hashes and counts.

Batches of ``drop_repeated_lines`` are ranges of ids, the largest first, so the owner of a key is
the largest document that holds it. Only hashes and places of long lines are ever shuffled; texts
stay where they are, unless more than ``BROADCAST_ROWS`` documents or ``BROADCAST_PLACES`` lines
are affected, when each text is shuffled once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockmill.llm.common import BROADCAST_KEYS, LOWER, UPPER, cut, ensure_checkpoint_dir, join_counted, remove_folder, table

MIN_CHARS, MIN_DOCS = 40, 5
BATCHES, FANOUT = 6, 3
BROADCAST_ROWS, BROADCAST_PLACES = 500_000, 4_000_000
BLANKS = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z lower-cased; lines of ASCII alone take the shorter way."""
    line = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


class LineRuns:
    """Sorted runs of (h1, h2, docs, owner) in levels; ``docs`` counts documents, ``owner`` is null in runs that met the key before."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        ensure_checkpoint_dir(spark)
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.folder = f"{spark.sparkContext.getCheckpointDir()}/{self.name}"
        self.levels: list[list[str]] = []
        self.written = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"{self.name}_{self.written}"
        self.written += 1
        rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.folder}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_folder(self.spark, f"{self.folder}/{name}")

    def _merged(self, names: list[str]) -> DataFrame:
        """One row a key. Runs are read as plain files: a union of bucketed scans is taken to be dealt by bucket, but its batches aren't."""
        rows = self.spark.read.schema("h1 long, h2 long, docs long, owner long").parquet(*(f"{self.folder}/{n}" for n in names))
        return rows.groupBy(*HASH).agg(F.sum("docs").alias("docs"), F.max("owner").alias("owner"))

    def runs(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def totals(self) -> DataFrame:
        """(h1, h2, docs, owner) over all batches so far."""
        if not self.runs():
            return self.spark.createDataFrame([], "h1 long, h2 long, docs long, owner long")
        return self._merged(self.runs())

    def anti_joined(self, lines: DataFrame) -> DataFrame:
        """(h1, h2, docs, owner) of a batch of (doc_id, h1, h2), where repeats don't count; owner is null if a run has the key."""
        batch = lines.select("doc_id", *HASH).distinct().groupBy(*HASH).agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("owner"))
        batch = batch.repartition(self.buckets, *HASH)
        known = []
        for k, name in enumerate(self.runs()):
            known.append(F.col(f"known{k}"))
            batch = batch.join(self.spark.table(name).select(*HASH, F.lit(True).alias(f"known{k}")), HASH, "left")
        owner = F.when(F.coalesce(*known).isNull(), F.col("owner")) if known else F.col("owner")
        return batch.select(*HASH, "docs", owner.alias("owner"))

    def new_keys(self, lines: DataFrame) -> DataFrame:
        """(h1, h2) of a batch that no run has: what an incremental user keeps."""
        keys = lines.select(*HASH).distinct().repartition(self.buckets, *HASH)
        for name in self.runs():
            keys = keys.join(self.spark.table(name).select(*HASH), HASH, "left_anti")
        return keys

    def add(self, lines: DataFrame) -> None:
        """Write a batch of (doc_id, h1, h2) as a run, and merge levels that are full. A document is added with one batch."""
        self._write(self.anti_joined(lines), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(full), level + 1)
            for name in full:
                self._drop(name)
            level += 1

    def clear(self) -> None:
        """Remove all runs."""
        for name in self.runs():
            self._drop(name)
        remove_folder(self.spark, self.folder)
        self.levels = []


def long_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_key, pos, h1, h2) of every line whose key has at least ``min_chars`` code points."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    rows = rows.where(F.length("line") >= min_chars).select("doc_id", "text_key", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return rows.select("doc_id", "text_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def batch_of(doc_id: Column, bounds: list[int]) -> Column:
    """The number of the batch of ids: those of at least the first bound come first, missing ones last."""
    return sum((F.when(doc_id >= b, 0).otherwise(1) for b in bounds), F.lit(0)).cast("int")


def id_bounds(docs: DataFrame, id_col: str, batches: int) -> list[int]:
    """``batches`` - 1 ids, falling, that cut the documents into ranges of about equal size."""
    if batches < 2:
        return []
    shares = F.array(*(F.lit(k / batches) for k in range(batches - 1, 0, -1)))
    return docs.agg(F.percentile_approx(F.col(id_col).cast("long"), shares, F.lit(1000)).alias("b")).first()["b"] or []


def repeated_keys(spark: SparkSession, folder: str, batches: int, min_docs: int = MIN_DOCS, fanout: int = FANOUT) -> DataFrame:
    """(h1, h2, docs, owner) of keys in at least ``min_docs`` documents, of the lines that lie in ``folder`` by batch."""
    runs = LineRuns(spark, fanout)
    lines = spark.read.schema("doc_id long, text_key long, pos int, h1 long, h2 long, batch int").parquet(folder)
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k))
    found = cut(runs.totals().where(F.col("docs") >= min_docs))
    runs.clear()
    return found


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT,
) -> DataFrame:
    """doc_id, n_lines (before), n_dropped and kept (the text that stays), one row per input row.

    Lines end at line feeds; a null or empty text is one empty line. Lines whose key has at least
    ``min_chars`` code points and is found in at least ``min_docs`` documents go, but for those of
    the largest id that holds it (all of them, if it repeats there). Rows of one id are one document
    and each give a row; a missing id is one document, the smallest. An empty table gives no rows.
    Very long texts and lines are read whole. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/lines_{uuid.uuid4().hex}"
    bounds = id_bounds(docs, id_col, batches)
    long_lines(docs, id_col, text_col, min_chars).withColumn("batch", batch_of(F.col("doc_id"), bounds)).write.partitionBy("batch").parquet(folder)
    repeated = repeated_keys(spark, folder, len(bounds) + 1, min_docs, fanout)

    lines = spark.read.schema("doc_id long, text_key long, pos int, h1 long, h2 long").parquet(folder)
    if repeated.count() <= BROADCAST_KEYS:
        met = lines.join(F.broadcast(repeated), HASH)
    else:
        met = join_counted(lines, repeated, HASH, "docs")
    gone = met.where(~F.col("doc_id").eqNullSafe(F.col("owner"))).groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("gone"))
    gone = cut(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"), "gone"))
    remove_folder(spark, folder)
    size = gone.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("gone")).alias("places")).first()
    small = size.n <= BROADCAST_ROWS and (size.places or 0) <= BROADCAST_PLACES
    gone = F.broadcast(gone) if small else gone.hint("shuffle_hash")

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.split(text, "\n", -1).alias("lines"))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(left, lambda k: F.get("lines", k)))
    n_lines, n_dropped = F.size("lines").cast("long"), F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long")
    return rows.select("doc_id", n_lines.alias("n_lines"), n_dropped.alias("n_dropped"), F.array_join(kept, "\n").alias("kept"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines of all ``documents`` dropped; odd rows as in ``drop_repeated_lines``."""
    found = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT rid, doc_id, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS pos FROM rows),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM each),
often AS (SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT e.*, o.k IS NOT NULL AND e.doc_id <> o.owner AS gone FROM keyed e LEFT JOIN often o ON e.k = o.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""
