"""Collocations: frequent phrases level by level (Apriori), scored by the weakest cut.

Pass k counts phrases of k words. From the second pass on, a phrase is emitted only where both of
its overlapping parts of k-1 words are frequent: what the pass before found is broadcast as a bit
set of hashes. The set has at most ``MOST_BITS`` bits at any size of the input; a chance meeting of
hashes lets a phrase through that is then counted exactly like others and dropped for its count, so
it costs a row and changes nothing. Tasks count in numpy and emit each phrase once for every
``FLUSH_WORDS`` words, so a word that is everywhere reaches the shuffle as a few rows. Phrases of
two words and more are many; they are shuffled in packed bundles, one for each bucket of a hash, and
a bucket's bundles are added up in Arrow. There are so many buckets that each has at most about
``BUCKET_WORDS`` phrases.

The cuts of a candidate are scored from the tables of the levels: every part of a frequent phrase
is frequent, so its count is there, and a level's rows carry the counts of their beginnings and ends.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dockmill.llm.common import BROADCAST_KEYS, cut, join_counted, partitions_for, small_batches, table

WORDS, MIN_COUNT, TOP = 3, 10, 2000
#: A shorter phrase goes if a longer candidate around it has at least so many hundredths of its count.
COVERED = 50
UNKNOWN_LANG = "und"
FLUSH_WORDS, FLUSH_DISTINCT, BUCKET_WORDS = 1 << 22, 1 << 20, 1 << 22
#: Bits for a frequent phrase, and the most bits of the set that is broadcast (64 MB).
BITS_EACH, MOST_BITS = 16, 1 << 29
SALTS = 64

#: Marks the end of a piece; no byte of UTF-8 has this value.
END = b"\xff"
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32
_BYTES[list(b".,;:!?\n\x0b\x0c\r")] = END[0]
_BYTES[9] = 32
PLAIN_BYTES = _BYTES.tobytes()
SCHEMA = "lang string, phrase string, f long"


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words, with END between pieces."""
    return text.translate(PLAIN_BYTES).replace(END, b" " + END + b" ").split()


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray, more: np.ndarray | np.uint64) -> np.ndarray:
    """A hash of a phrase and what follows it."""
    h = (h ^ (h >> np.uint64(32))) * _ODD + more
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(35)) & np.uint64(bits - 1)).astype(np.int64)


def _has(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    one, two = _places(h, len(known) * 64)
    found = (known[one >> 6] >> (one & 63).astype(np.uint64)) & (known[two >> 6] >> (two & 63).astype(np.uint64))
    return (found & np.uint64(1)).astype(bool)


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, seed=42)


class Counter:
    """Counts of phrases of ``k`` words in the texts given so far, by language."""

    def __init__(self, k: int, known: np.ndarray | None = None):
        self.k, self.known = k, known
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ids[END]
        self.texts: dict[str, list[np.ndarray]] = defaultdict(list)
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        words = words_of(text)
        words.append(END)
        self.texts[lang].append(np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words)))
        self.size += len(words)

    def full(self) -> bool:
        return self.size >= FLUSH_WORDS or len(self.ids) >= FLUSH_DISTINCT

    def counted(self):
        """What was counted: language, phrases and their counts, and a hash of each (from the second pass on)."""
        words = pa.array(list(self.ids), pa.binary())
        hashes = np.fromiter(map(word_hash, self.ids), np.uint64, len(self.ids)) if self.k > 1 else None
        for lang, texts in self.texts.items():
            parts, counts = self._counted(lang, np.concatenate(texts), hashes)
            phrase = [pc.take(words, pa.array(p)) for p in parts]
            if self.k == 1:
                yield lang, phrase[0], counts, None
                continue
            whole = hashes[parts[0]]
            for p in parts[1:]:
                whole = _mixed(whole, hashes[p])
            yield lang, pc.binary_join_element_wise(*phrase, pa.scalar(b" ", pa.binary())), counts, whole
        self.clear()

    def rows(self):
        """Record batches of ``SCHEMA``; a row without phrase counts all words of a language."""
        for lang, phrase, counts, _ in self.counted():
            phrase = pa.concat_arrays([phrase.cast(pa.string()), pa.nulls(1, pa.string())])
            counts = np.append(counts, counts.sum())
            for at in range(0, len(counts), 100_000):
                n = min(100_000, len(counts) - at)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), phrase.slice(at, n), pa.array(counts[at : at + n])], names=["lang", "phrase", "f"])

    def bundles(self, buckets: int):
        """Record batches of bucket, lang and bundle."""
        for lang, phrase, counts, whole in self.counted():
            bucket = (whole >> np.uint64(7)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            found, starts = np.unique(bucket[order], return_index=True)
            ends = np.append(starts[1:], len(order))
            phrase, counts = pc.take(phrase, pa.array(order)), counts[order]
            for some in range(0, len(found), 64):
                packed = [pack(phrase.slice(a, b - a), counts[a:b]) for a, b in zip(starts[some : some + 64], ends[some : some + 64], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(found[some : some + 64].astype(np.int64)), pa.array([lang] * len(packed), pa.string()), pa.array(packed, pa.binary())], names=["bucket", "lang", "bundle"])

    def _counted(self, lang: str, ids: np.ndarray, hashes: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
        """The word numbers of the distinct phrases, a list for each of their places, and their counts."""
        if self.k == 1:
            counts = np.bincount(ids, minlength=1)
            counts[0] = 0
            found = np.flatnonzero(counts)
            return [found], counts[found]
        h = _mixed(hashes, np.uint64(word_hash(lang.encode("utf-8"))))  # by word, not by place
        if self.k == 2:
            frequent = _has(self.known, h)
            frequent[0] = False
            begins = frequent[ids]
        else:  # whether a frequent phrase of k - 1 words begins at each place
            begins, at = np.zeros(len(ids), bool), np.flatnonzero(ids > 0)
            whole = h[ids[at]]
            for j in range(1, self.k - 1):
                keep = (at + j < len(ids)) & (ids[np.minimum(at + j, len(ids) - 1)] > 0)
                at, whole = at[keep], whole[keep]
                whole = _mixed(whole, hashes[ids[at + j]])
            begins[at[_has(self.known, whole)]] = True
        at = np.flatnonzero(begins[:-1] & begins[1:])
        # words of these phrases, numbered anew from 0: few, so that a phrase fits in a number
        places = np.zeros(len(hashes), np.int64)
        for j in range(self.k):
            places[ids[at + j]] = 1
        used = np.flatnonzero(places)
        places[used] = np.arange(len(used))
        return _distinct([places[ids[at + j]] for j in range(self.k)], used)


def _distinct(columns: list[np.ndarray], used: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of ``columns`` (places in ``used``), as the words that ``used`` has there, and how often each occurs."""
    base, keys = max(1, len(used)), columns[0]
    if base ** len(columns) < 1 << 62:  # a whole phrase is one number
        for column in columns[1:]:
            keys = keys * base + column
        keys, counts = np.unique(keys, return_counts=True)
        out = []
        for _ in columns:
            out.append(used[keys % base])
            keys = keys // base
        return out[::-1], counts
    for column in columns[1:]:
        _, keys = np.unique(keys, return_inverse=True)
        keys = keys * base + column
    _, first, counts = np.unique(keys, return_index=True, return_counts=True)
    return [used[column[first]] for column in columns], counts


def pack(phrases: pa.Array, counts: np.ndarray) -> bytes:
    """Phrases (bytes) and counts, compressed."""
    lengths = pc.binary_length(phrases).to_numpy()
    offsets = np.frombuffer(phrases.buffers()[1], np.int32)[phrases.offset : phrases.offset + len(phrases) + 1]
    data = memoryview(phrases.buffers()[2])[offsets[0] : offsets[-1]] if len(phrases) else b""
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.int64(len(counts)).tobytes(), counts.astype(np.int64).tobytes(), lengths.astype(np.int32).tobytes(), data]))


def unpack(bundle: bytes) -> tuple[pa.Array, np.ndarray]:
    said = zstandard.ZstdDecompressor().decompress(bundle)
    n = int(np.frombuffer(said, np.int64, 1)[0])
    counts, lengths = np.frombuffer(said, np.int64, n, 8), np.frombuffer(said, np.int32, n, 8 + 8 * n)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(said[8 + 12 * n :])]), counts


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, phrase, f) of the words of (lang, text); a null phrase counts all words of a language."""

    def run(batches):
        counter = Counter(1, None)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                counter.add(lang, text.as_py())
                if counter.full():
                    yield from counter.rows()
        yield from counter.rows()

    return docs.mapInArrow(run, SCHEMA).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def count_phrases(docs: DataFrame, k: int, known: np.ndarray, min_count: int, words: int) -> DataFrame:
    """(lang, phrase, f) of phrases of ``k`` words of (lang, text) that occur ``min_count`` times; there are ``words`` words in all."""
    held = docs.sparkSession.sparkContext.broadcast(known)
    buckets = partitions_for(words, BUCKET_WORDS)

    def emit(batches):
        counter = Counter(k, held.value)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                counter.add(lang, text.as_py())
                if counter.full():
                    yield from counter.bundles(buckets)
        yield from counter.bundles(buckets)

    def summed(bundles: dict[str, list]):
        for lang, packed in bundles.items():
            parts = [unpack(b) for b in packed]
            rows = pa.table({"phrase": pa.chunked_array([p for p, _ in parts]), "f": np.concatenate([c for _, c in parts])})
            rows = rows.group_by("phrase").aggregate([("f", "sum")])
            rows = rows.filter(pc.greater_equal(rows["f_sum"], min_count))
            langs = pa.array([lang] * len(rows), pa.string())
            yield from pa.table({"lang": langs, "phrase": rows["phrase"].cast(pa.string()), "f": rows["f_sum"].cast(pa.int64())}).to_batches(100_000)

    def add_up(batches):
        now, bundles = None, defaultdict(list)
        for batch in batches:
            for bucket, lang, bundle in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if bucket != now:
                    yield from summed(bundles)
                    now, bundles = bucket, defaultdict(list)
                bundles[lang].append(bundle)
        yield from summed(bundles)

    packed = docs.mapInArrow(emit, "bucket long, lang string, bundle binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return packed.mapInArrow(add_up, SCHEMA)


def bit_set(level: DataFrame) -> np.ndarray:
    """The phrases of a level as bits; at most ``MOST_BITS`` of them come to the driver."""
    n = level.count()
    bits = 1 << 16
    while bits < min(MOST_BITS, n * BITS_EACH):
        bits *= 2

    def run(batches):
        for batch in batches:
            h = np.empty(batch.num_rows, np.uint64)
            for r, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)):
                first, *rest = (np.uint64(word_hash(w)) for w in phrase.split(b" "))
                whole = _mixed(np.array([first]), np.uint64(word_hash(lang.encode("utf-8"))))
                for w in rest:
                    whole = _mixed(whole, w)
                h[r] = whole[0]
            places = np.unique(np.concatenate(_places(h, bits)))
            words, starts = np.unique(places >> 6, return_index=True)
            values = np.bitwise_or.reduceat(np.uint64(1) << (places & 63).astype(np.uint64), starts) if len(words) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(values.view(np.int64))], names=["word", "bits"])

    found = level.select("lang", "phrase").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def part(first: int, last: int) -> Column:
    """Words ``first`` to ``last`` (from 1) of a phrase."""
    return F.array_join(F.slice("words", first, last - first + 1), " ")


def _with_parts(rows: DataFrame, shorter: DataFrame, end: str, counts: str) -> DataFrame:
    """``rows`` with ``counts`` of the phrase in column ``end``, from the level below."""
    shorter = shorter.select("lang", F.col("phrase").alias(end), counts)
    if shorter.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(shorter), ["lang", end])
    fan = rows.groupBy("lang", end).agg(F.count(F.lit(1)).alias("fan"))
    return join_counted(rows, shorter.join(fan, ["lang", end]), ["lang", end], "fan").drop("fan")


def with_parts(counts: DataFrame, shorter: DataFrame | None, k: int) -> DataFrame:
    """A level's (lang, phrase, f) with ``starts`` and ``ends``: the counts of its first and last 1 to ``k`` words.

    Its overlapping parts of k-1 words have them already, so two joins with the level ``shorter``
    are enough for any number of cuts.
    """
    own = F.array("f")
    if shorter is None:
        return counts.select("lang", "phrase", "f", own.alias("starts"), own.alias("ends"))
    rows = counts.withColumn("words", F.split("phrase", " ", -1)).withColumns({"head": part(1, k - 1), "tail": part(2, k)}).drop("words")
    rows = _with_parts(_with_parts(rows, shorter, "head", "starts"), shorter, "tail", "ends")
    return rows.select("lang", "phrase", "f", F.concat("starts", own).alias("starts"), F.concat("ends", own).alias("ends"))


def score_cuts(rows: DataFrame, k: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of ``rows`` of level ``k`` by the cut of the lowest score, the first of equals.

    Products are decimals of 38 digits, exact up to counts of 10^16.
    """

    def wide(c: str) -> str:
        return f"cast({c} as decimal(19, 0))"

    def cut_at(j: int) -> Column:
        left, right = f"starts[{j - 1}]", f"ends[{k - j - 1}]"
        score = F.expr(f"cast(1000000 as decimal(7, 0)) * ({wide('f')} * {wide('f')}) div ({wide(left)} * {wide(right)})").cast("long")
        return F.struct(score.alias("score"), F.lit(j).alias("k"), F.expr(left).alias("l"), F.expr(right).alias("r"))

    best = F.array_min(F.array(*(cut_at(j) for j in range(1, k))))
    return rows.select("lang", "phrase", F.col("f").alias("a"), best.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def _covered(levels: list[DataFrame], k: int, covered: int) -> DataFrame:
    """(lang, phrase) of level ``k`` that some longer candidate covers: it has at least ``covered`` hundredths of the count."""
    longer = []
    for m in range(k + 1, len(levels) + 1):
        rows = levels[m - 1].select("lang", "f", F.split("phrase", " ", -1).alias("words"))
        inside = F.array(*(part(j, j + k - 1) for j in range(1, m - k + 2)))
        longer.append(rows.select("lang", F.explode(inside).alias("phrase"), "f"))
    most = longer[0]
    for rows in longer[1:]:
        most = most.unionByName(rows)
    most = most.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return levels[k - 1].join(most, ["lang", "phrase"]).where(F.col("most") * 100 >= F.col("f") * covered).select("lang", "phrase")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", words: int = WORDS, min_count: int = MIN_COUNT, top: int | None = TOP, covered: int = COVERED,
) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score of each language's best phrases of 2 to ``words`` words.

    A is the phrase's count, l and r those of the parts at the cut of the lowest score, n all words of
    the language. Ranked by score, then a (both falling), then phrase in order of its bytes; ``top``
    None returns all. A null text is empty, a null language is ``und``; repeated rows count again.
    An empty table gives no rows. Texts are read whole, whatever their length. Columns other than the
    two are ignored.
    """
    rows = small_batches(docs).select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    first = cut(count_words(rows).where((F.col("f") >= min_count) | F.col("phrase").isNull()))
    totals = first.where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))
    every = totals.agg(F.sum("n")).first()[0] or 0
    levels = [with_parts(first.where(F.col("phrase").isNotNull()), None, 1)]
    for k in range(2, words + 1):
        counts = cut(count_phrases(rows, k, bit_set(levels[-1]), min_count, every))
        levels.append(cut(with_parts(counts, levels[-1], k)))
    found = None
    for k in range(2, words + 1):
        candidates = levels[k - 1]
        if k < words:
            candidates = candidates.join(_covered(levels, k, covered), ["lang", "phrase"], "left_anti")
        scored = score_cuts(candidates, k)
        found = scored if found is None else found.unionByName(scored)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    ranked = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    if top is not None:  # the best of each share of a language, then the best of these
        share = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
        found = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("at", share).where(F.col("at") <= top)
    found = found.withColumn("rank", ranked.cast("long")).where(F.lit(top is None) | (F.col("rank") <= (top or 0)))
    found = found.join(F.broadcast(totals) if totals.count() <= BROADCAST_KEYS else totals, "lang")
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of all ``documents`` by language; odd rows as in ``collocations``."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH pieces AS (
  SELECT row_number() OVER () AS pid, * FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
words AS (SELECT lang, pid, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS pos FROM (SELECT lang, pid, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces) WHERE len(ws) > 0),
runs AS (SELECT lang, w, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY pid ORDER BY pos)),
n AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
f1 AS (SELECT lang, w AS p, count(*) AS f FROM words GROUP BY ALL),
f2 AS (SELECT lang, w, w2, w || ' ' || w2 AS p, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w, w2, w3, w || ' ' || w2 || ' ' || w3 AS p, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT c.lang, c.p, c.f AS a, 1 AS k, x.f AS l, y.f AS r FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.p = c.w JOIN f1 y ON y.lang = c.lang AND y.p = c.w2
  WHERE NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = c.lang AND ((t.w = c.w AND t.w2 = c.w2) OR (t.w2 = c.w AND t.w3 = c.w2)) AND 100 * t.f >= 50 * c.f)
  UNION ALL SELECT c.lang, c.p, c.f, 1, x.f, y.f FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.p = c.w JOIN f2 y ON y.lang = c.lang AND y.w = c.w2 AND y.w2 = c.w3
  UNION ALL SELECT c.lang, c.p, c.f, 2, x.f, y.f FROM f3 c JOIN f2 x ON x.lang = c.lang AND x.w = c.w AND x.w2 = c.w2 JOIN f1 y ON y.lang = c.lang AND y.p = c.w3),
scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM best)
SELECT lang, rank, p AS phrase, a, l, r, n.n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
