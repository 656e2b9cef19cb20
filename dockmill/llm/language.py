"""Language identification by Bayesian fusion of several kinds of evidence.

For every row and language the log-probabilities of these are added: the whole text, under a model
of hashed byte trigrams; the language its markup declares; the language code in its address; and
its host's prior. Host priors are smoothed down a hierarchy (all rows, address suffix, domain,
host) whose counts are grouped sums of what the first three say of each row, without the row's own
share. One more class, ``und``, stands for text of no modelled language; such a text keeps the
language that its markup or address declares.

Every labelled language has a model. It is fitted on at most ``SAMPLE`` distinct texts of each
language, those with the smallest hashes, whose trigrams Spark counts; all other statistics cover
every row. Texts are never shuffled to be judged: a row's evidence is computed once, where it is
read, and priors are joined to it by host.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockmill.llm.common import BROADCAST_KEYS, cut, guarded, small_batches, table, url_host, url_path
from dockmill.llm.html_blocks import declared_language, leaf_blocks

SAMPLE = 300  # distinct labelled texts of each language that fit the text model
BUCKETS = 1 << 16
#: A word with a digit, tried only where a word begins, so that a word of any length is read once.
DIGITS = re.compile(rb"(?<![^\x20\x09-\x0d])[^\x20\x09-\x0d0-9]*+[0-9][^\x20\x09-\x0d]*+")
UNKNOWN = "und"
#: Log-likelihood counts in full for short texts and at most as this many trigrams for long ones.
TEXT_WEIGHT = 256.0
DECLARED_RIGHT, ADDRESS_RIGHT, UNKNOWN_PRIOR, STRENGTH = 0.9, 0.8, 0.001, 10.0
ACCEPT = 0.5
SALTS = 16
BROADCAST_HOSTS = 200_000  # rows of some 150 bytes; beyond it Spark joins by shuffle


def trigram_codes(text: str) -> np.ndarray:
    """Hash buckets of the byte trigrams of a text, A-Z lower-cased, without words that hold digits."""
    b = np.frombuffer(b" " + DIGITS.sub(b" ", text.encode("utf-8", "replace")).lower() + b" ", np.uint8).astype(np.uint32)
    return ((b[:-2] * 40503) ^ (b[1:-1] * 2654435) ^ (b[2:] * 97)) & (BUCKETS - 1)


class TextModel:
    """Log-probabilities of trigram buckets by language, the last column for no language."""

    def __init__(self, texts: dict[str, list[str]]):
        self._fill({name: sum((np.bincount(trigram_codes(t), minlength=BUCKETS) for t in texts[name]), np.zeros(BUCKETS)) for name in texts})

    @classmethod
    def from_counts(cls, counts: dict[str, np.ndarray]) -> TextModel:
        """A model from how often each bucket occurs in each language."""
        model = cls.__new__(cls)
        model._fill(counts)
        return model

    def _fill(self, counts: dict[str, np.ndarray]) -> None:
        self.languages = sorted(counts)
        self.table = np.empty((BUCKETS, len(self.languages) + 1), np.float32)
        for k, name in enumerate(self.languages):
            smooth = counts[name] + 0.02
            self.table[:, k] = np.log(smooth / smooth.sum())
        self.table[:, -1] = -np.log(BUCKETS)

    def score(self, text: str | None) -> list[float]:
        """Tempered log-likelihood of each language and of none; a text without words has no language."""
        if not text or not text.strip():
            return [-50.0] * len(self.languages) + [0.0]  # far below any text
        codes = trigram_codes(text)
        return (self.table[codes].mean(0, dtype=np.float64) * (len(codes) / (1 + len(codes) / TEXT_WEIGHT))).tolist()


def _language(c: Column) -> Column:
    """The lower-case language code that a tag starts with, or an empty string."""
    return F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), "^[A-Za-z]{2,3}", 0))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> TextModel:
    """A text model of every label, from at most ``sample`` distinct texts of each; null or empty labels are no labels."""
    rows = small_batches(labelled).select(_language(F.col(lang_col)).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).where("lang <> '' and trim(text) <> ''")
    place = Window.partitionBy("lang").orderBy("h")  # each task keeps its own first ``sample`` rows before they are dealt
    drawn = rows.select("lang", "h").distinct().withColumn("place", F.row_number().over(place)).where(F.col("place") <= sample)
    drawn = F.broadcast(cut(drawn.select("lang", "h")))  # a bounded number of hashes for each language
    texts = rows.join(drawn, ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text")

    def count(batches):
        by: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = np.bincount(trigram_codes(text), minlength=BUCKETS)
                by[name] = by[name] + codes if name in by else codes
        for name, n in by.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    texts = texts.repartition("lang")  # at most ``sample`` texts of each
    sums = texts.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = cut(sums.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("n")))  # at most ``BUCKETS`` numbers
    counts = {}
    for r in sums.toLocalIterator():
        counts[r.lang] = np.zeros(BUCKETS)
        counts[r.lang][r.buckets] = r.n
    return TextModel.from_counts(counts)


def _said(codes: pd.Series, languages: list[str], right: float) -> np.ndarray:
    """Log-probability of what evidence says under each language and under none; zero where it says nothing.

    A code that no model has speaks for a language beyond the modelled ones.
    """
    n, place = len(languages), {name: k for k, name in enumerate(languages)}
    wrong = np.log((1 - right) / max(1, n - 1))
    rows = np.full((n + 2, n + 1), wrong)
    rows[np.arange(n), np.arange(n)] = np.log(right)
    rows[:, n] = np.log(1 / max(1, n))
    rows[n] = 0
    rows[n + 1] = np.log((1 - right) / max(1, n))
    rows[n + 1, n] = np.log(right)
    return rows[[place.get(c, n + 1 if c else n) for c in codes]]


def evidence(model: TextModel, texts: pd.Series, declared: pd.Series, address: pd.Series) -> np.ndarray:
    """Log-scores of each row under each language and under none, without its host."""
    n = len(model.languages)
    prior = np.log(np.array([(1 - UNKNOWN_PRIOR) / max(1, n)] * n + [UNKNOWN_PRIOR]))
    return np.array([model.score(t) for t in texts]).reshape(-1, n + 1) + prior + _said(declared, model.languages, DECLARED_RIGHT) + _said(address, model.languages, ADDRESS_RIGHT)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def posterior(scores: np.ndarray, levels: list[np.ndarray], every: np.ndarray) -> np.ndarray:
    """Shares of the classes, with priors smoothed from all rows down ``levels``; a row's own share is left out of its counts."""
    own = softmax(scores)
    prior = np.tile((every + 1) / (every.sum() + len(every)), (len(scores), 1))
    for counts in levels:
        rest = np.maximum(counts - own, 0)
        prior = (rest + STRENGTH * prior) / (rest.sum(1, keepdims=True) + STRENGTH)
    return softmax(scores + np.log(np.maximum(prior, 1e-9)))


def _scored(df: DataFrame, model: TextModel, *, text: Column, declared: Column, host: Column, address: Column, carry: list[str]) -> DataFrame:
    """The ``carry`` columns of ``df`` with __rid, __score, __host and __other; every text is scored once."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(texts: pd.Series, declared: pd.Series, address: pd.Series) -> pd.Series:
        return pd.Series([*evidence(shared.value, texts, declared, address)])

    said = [F.when((c != "") & ~c.isin(model.languages) & (c != UNKNOWN), c) for c in (_language(declared), _language(address))]
    other = F.when(F.coalesce(text, F.lit("")).rlike(r"\S"), F.coalesce(*said))
    scores = score(text, _language(declared), _language(address))
    return cut(small_batches(df).select(*(F.col(f"`{c}`") for c in carry), F.monotonically_increasing_id().alias("__rid"), scores.alias("__score"), F.coalesce(host, F.lit("")).alias("__host"), other.alias("__other")))


def _decided(rows: DataFrame, languages: list[str]) -> tuple[DataFrame, bool]:
    """``rows`` with __language and __confidence, and whether all their columns are there: beyond ``BROADCAST_HOSTS`` hosts only __rid is, as more would be shuffled."""
    classes = [*languages, UNKNOWN]
    width = range(len(classes))

    def stacked(rows: pd.Series) -> np.ndarray:
        return np.array(rows.to_list(), np.float64).reshape(-1, len(classes))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def share(scores: pd.Series) -> pd.Series:
        return pd.Series([*softmax(stacked(scores))])

    shares = rows.select("__host", share("__score").alias("p"))
    hosts = cut(shares.groupBy("__host").agg(*(F.sum(F.col("p")[k]).alias(f"p{k}") for k in width)))
    hosts = hosts.select("__host", F.array(*(f"p{k}" for k in width)).alias("h"), F.regexp_extract("__host", r"([^.]*\.)?[^.]*$", 0).alias("domain"), F.regexp_extract("__host", r"[^.]*$", 0).alias("suffix"))

    def level(key: str, name: str) -> DataFrame:
        return hosts.groupBy(key).agg(F.array(*(F.sum(F.col("h")[k]) for k in width)).alias(name))

    sums = hosts.agg(*(F.sum(F.col("h")[k]) for k in width)).first()
    every = np.array([x or 0.0 for x in sums])
    tree = hosts.join(level("domain", "d"), "domain").join(level("suffix", "t"), "suffix").select("__host", F.struct("t", "d", "h").alias("__levels"))

    @F.pandas_udf("language string, confidence double")
    def decide(scores: pd.Series, levels: pd.DataFrame) -> pd.DataFrame:
        p = posterior(stacked(scores), [stacked(levels[c]) for c in "tdh"], every)
        best = p.argmax(1)
        return pd.DataFrame({"language": [classes[k] for k in best], "confidence": p[np.arange(len(p)), best]})

    few = hosts.count() <= BROADCAST_HOSTS
    if few:
        found = rows.join(F.broadcast(tree), "__host")
    else:  # a common host's rows are split by salt
        salt = F.pmod(F.xxhash64("__rid"), F.lit(SALTS)).cast("int")
        found = rows.select("__rid", "__score", "__host", "__other", salt.alias("__salt")).join(tree.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["__host", "__salt"])
    found = found.withColumn("__found", decide("__score", "__levels"))
    language = F.when(F.col("__found.language") == UNKNOWN, F.coalesce("__other", F.lit(UNKNOWN))).otherwise(F.col("__found.language"))
    return found.withColumns({"__language": language, "__confidence": F.col("__found.confidence")}), few


def identify(df: DataFrame, model: TextModel, *, text: Column, declared: Column, host: Column, address: Column, carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns of ``df`` (all by default) with ``__language`` and ``__confidence``, one row per input row.

    Null evidence says nothing. A null, empty or blank text is ``und``. A text of no modelled
    language has the language that its markup, or else its address, declares. Very long texts are
    read whole; of equal shares the class first by name wins. Repeated rows get equal answers; an
    empty table stays empty; columns of ``df`` keep their values whatever their names.
    """
    carry = df.columns if carry is None else carry
    rows = _scored(df, model, text=text, declared=declared, host=host, address=address, carry=carry)
    found, whole = _decided(rows, model.languages)
    if not whole:
        found = rows.join(found.select("__rid", "__language", "__confidence"), "__rid")
    return found.select(*(F.col(f"`{c}`") for c in carry), "__language", "__confidence")


def accepted() -> Column:
    """Whether a row that ``identify`` has seen has a language."""
    return (F.col("__language") != UNKNOWN) & (F.col("__confidence") >= ACCEPT)


def keep_known_language(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` whose text has a language, all their columns kept.

    ``lang_col`` only labels the text model's sample; what it says of a row is no evidence for that
    row, unless the text has no modelled language. Without any labelled text nothing tells languages
    apart, and every text with a letter is kept. A null or blank text has no language. Repeated rows
    are judged alike; an empty table stays empty. Whole rows are shuffled only if more than
    ``BROADCAST_KEYS`` rows go and there are more than ``BROADCAST_HOSTS`` hosts.
    """
    columns = docs.columns
    docs, names = guarded(docs)
    text_col, lang_col, host_col = names[text_col], names[lang_col], names[host_col]
    model = fit(docs, text_col, lang_col)
    if not model.languages:
        return docs.where(F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}")).toDF(*columns)
    none = F.lit(None).cast("string")
    rows = _scored(docs, model, text=F.col(text_col), declared=none, host=F.col(host_col), address=none, carry=docs.columns)
    found, whole = _decided(rows, model.languages)
    if whole:
        return found.where(accepted()).select(*docs.columns).toDF(*columns)
    gone = cut(found.where(~accepted()).select("__rid"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    return rows.join(gone, "__rid", "left_anti").select(*docs.columns).toDF(*columns)


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, text (that of all blocks), declared (what the markup says), host and address of (page_id, html, host, address); null html counts as empty."""

    def run(batches):
        for batch in batches:
            pages_in = [x.as_py() or "" for x in batch.column(1)]
            texts = pa.array(["\n".join(text for _, text, _ in leaf_blocks(x)) for x in pages_in], pa.string())
            declared = pa.array([declared_language(x) for x in pages_in], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, declared, batch.column(2), batch.column(3)], names=["page_id", "text", "declared", "host", "address"])

    return small_batches(pages).select("page_id", "html", "host", "address").mapInArrow(run, "page_id long, text string, declared string, host string, address string")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` (doc_id) and of ``pages`` (page_id): its language, confidence and whether it is accepted.

    ``lang`` of ``documents`` fits the text model and is no evidence; pages declare by their markup.
    Odd rows as in ``identify``; pages of any length and however broken are read in linear time.
    """
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none = F.lit(None)
    rows = docs.select("doc_id", none.cast("long").alias("page_id"), "text", none.cast("string").alias("declared"), F.col("source").alias("host"), none.cast("string").alias("address"))
    address = F.regexp_extract(url_path(F.col("url")), r"^/([A-Za-z]{2})(/|$)", 1)
    read = page_texts(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"), url_host(F.col("url")).alias("host"), address.alias("address")))
    rows = rows.unionByName(read.withColumn("doc_id", none.cast("long")))
    carry = ["doc_id", "page_id", "declared", "host"]
    found = identify(rows, fit(docs), text=F.col("text"), declared=F.col("declared"), host=F.col("host"), address=F.col("address"), carry=carry)
    return found.select("doc_id", "page_id", F.col("__language").alias("language"), F.round("__confidence", 6).alias("confidence"), accepted().alias("accepted"), "declared", "host")
