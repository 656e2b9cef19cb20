"""Near-duplicates by SimHash fingerprints and a generalised pigeonhole search.

The 64 bits are grouped into partitions, correlated bits together. If partition i gets the
threshold t_i and the thresholds add up to radius - partitions + 1, two fingerprints within the
radius differ by at most t_i bits in some partition i. Thresholds are unequal: dynamic programming
picks those with the least expected work, from candidate counts estimated on all fingerprints.
Every distinct fingerprint probes partition i with its value and the values within t_i bits of it;
what it meets is verified on all 64 bits, and a pair counts at the first partition that finds it.
Copies share a fingerprint and are one row here, so their number does not matter. The probe is a
sort-merge join, whose large keys Spark splits; nothing is gathered by key.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockmill.llm.common import cut, join_counted, keep_rows, small_batches, table
from dockmill.llm.components import connected_components

BITS, RADIUS, WORDS = 64, 3, 3
PARTITIONS = (2, 3, 4)
#: Relative work of a probe and of a candidate that must be verified.
PROBE, VERIFY = 1.0, 8.0


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Bits set in over half the XXH64 values (seed 42) of the word shingles of a UTF-8 text, as unsigned."""
    import xxhash

    parts = text.lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not parts:
        return 0
    shingles = map(b" ".join, zip(*(parts[k:] for k in range(words)), strict=False)) if len(parts) >= words else [b" ".join(parts)]
    n = max(1, len(parts) - words + 1)
    return majority(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), shingles), "<u8", n))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes (of 64 bits, at least one) set, as unsigned."""
    counts = np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, fp (64 bits in a long) and text_key (a hash that tells rows of one id apart)."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "text_key"])

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("text_key"))
    return rows.mapInArrow(run, "doc_id long, fp long, text_key long")


def bit_counts(fps: DataFrame) -> np.ndarray:
    """How often two bits are set together, over all rows: a table of 64 by 64 whatever their number."""

    def run(batches):
        total = np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            bits = ((values[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel())], names=["pos", "n"])

    rows = fps.select("fp").mapInArrow(run, "pos long, n double").groupBy("pos").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS)
    for r in rows:
        out[r.pos] = r.n
    return out.reshape(BITS, BITS)


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size, each filled with what correlates with it most."""
    share = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    corr = np.abs(together / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        room = BITS // parts + (k < BITS % parts)
        first = max(left, key=lambda b: (max((corr[b, c] for c in left if c != b), default=0), -b))
        group = [first]
        left.remove(first)
        while len(group) < room:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def _within(agree: np.ndarray, most: int) -> list[float]:
    """Chance that two random rows differ by 0, 1, ... ``most`` bits at most, bit by bit independent."""
    chance = np.zeros(most + 1)
    chance[0] = 1
    for p in agree:
        chance[1:] = chance[1:] * p + chance[:-1] * (1 - p)
        chance[0] *= p
    return list(np.cumsum(chance))


def allocate(sizes: list[int], candidates: list[list[float]], radius: int = RADIUS) -> tuple[list[int], float]:
    """Thresholds (-1: not probed) adding up to radius - partitions + 1 of least work, and that work.

    ``candidates[i][t]`` is what a probe of partition i with threshold t is expected to find.
    """
    total = radius - len(sizes) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for size, found in zip(sizes, candidates, strict=True):
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (work, chosen) in best.items():
            for t in range(-1, radius + 1):
                more = 0.0 if t < 0 else PROBE * sum(comb(size, k) for k in range(t + 1)) + VERIFY * found[t]
                if s + t not in step or work + more < step[s + t][0]:
                    step[s + t] = (work + more, [*chosen, t])
        best = step
    work, chosen = best[total]
    return chosen, work


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masked(fp: Column, bits: list[int]) -> Column:
    return fp.bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))


def search_plan(fps: DataFrame, radius: int = RADIUS) -> tuple[list[list[int]], list[int]]:
    """Groups of bits and their thresholds for the distinct fingerprints ``fps``."""
    n = fps.count()
    together = bit_counts(fps)
    share = np.diag(together) / max(n, 1)
    agree = share**2 + (1 - share) ** 2
    plans = []
    for parts in PARTITIONS:
        groups = group_bits(together, n, parts)
        plans.append((allocate([*map(len, groups)], [[n * p for p in _within(agree[g], radius)] for g in groups], radius)[1], groups))
    groups = min(plans, key=lambda p: p[0])[1]
    # the exact number of pairs that agree in a group replaces the independent estimate
    keyed = fps.select(F.explode(F.array(*(F.struct(F.lit(k).alias("part"), _masked(F.col("fp"), g).alias("value")) for k, g in enumerate(groups)))).alias("x")).select("x.*")
    met = keyed.groupBy("part", "value").count().groupBy("part").agg(F.sum(F.col("count") * F.col("count")).alias("pairs")).collect()
    exact = {r.part: r.pairs / max(n, 1) for r in met}
    found = []
    for k, g in enumerate(groups):
        within = _within(agree[g], radius)
        found.append([exact.get(k, 0.0) * p / within[0] for p in within])
    return groups, allocate([*map(len, groups)], found, radius)[0]


def link_fingerprints(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): every pair of distinct fingerprints that differ by at most ``radius`` bits, once."""
    groups, limits = search_plan(fps, radius)
    fp, other = F.col("fp"), F.col("other")
    flips = [(k, _signed(sum(1 << b for b in bits))) for k, g in enumerate(groups) for t in range(limits[k] + 1) for bits in combinations(g, t)]
    probes = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("part"), F.lit(x).alias("flip")) for k, x in flips))).alias("x"))
    value = F.lit(None).cast("long")
    for k, g in enumerate(groups):
        value = F.when(F.col("x.part") == k, _masked(fp.bitwiseXOR(F.col("x.flip")), g)).otherwise(value)
    probes = probes.select("fp", F.col("x.part").alias("part"), value.alias("value"))
    index = fps.select(fp.alias("other"), F.explode(F.array(*(F.struct(F.lit(k).alias("part"), _masked(fp, g).alias("value")) for k, g in enumerate(groups) if limits[k] >= 0))).alias("x"))
    index = index.select("other", "x.*")
    differ = fp.bitwiseXOR(other)
    first = F.lit(True)  # no earlier partition finds the pair
    for k, g in enumerate(groups):
        if limits[k] >= 0:
            first = first & ((F.lit(k) >= probes["part"]) | (F.bit_count(_masked(differ, g)) > limits[k]))
    same = (probes["part"] == index["part"]) & (probes["value"] == index["value"])
    return probes.join(index, same & (fp < other) & (F.bit_count(differ) <= radius) & first).select(fp.alias("a"), other.alias("b"))


def _components(docs: DataFrame, radius: int) -> DataFrame:
    """``docs`` (doc_id, fp, text_key) with component_id."""
    reps = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")))
    roots = connected_components(link_fingerprints(reps.select("fp"), radius))
    linked = roots.join(reps, roots["node"] == reps["fp"]).select("fp", "root", "least")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(smallest, "root").select("fp", "component_id")
    every = reps.join(named, "fp", "left").select("fp", "rows", F.coalesce("component_id", "least").alias("component_id"))
    return join_counted(docs, every, ["fp"], "rows").drop("rows")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id that links reach), one row per input row.

    A null text counts as empty; texts without words have the fingerprint zero, which links like
    any other. Repeated rows repeat. Null ids are ignored when the smallest is taken. An empty
    table gives no rows. Very long texts are read whole. A bit that exactly half the hashes set is
    0. Other columns of ``docs`` are ignored, whatever their names.
    """
    found = _components(cut(fingerprints(docs, id_col, text_col, words)), radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id, all its columns kept."""
    found = cut(_components(cut(fingerprints(docs, id_col, text_col, words)), radius))
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    kept = found.join(first, found["component_id"].eqNullSafe(first["component_id"])).select("doc_id", F.col("text_key").alias("key"), (F.struct("doc_id", "text_key") == F.col("first")).alias("kept"))
    return keep_rows(docs, kept, id_col, F.xxhash64(text_col))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all ``documents``; odd rows as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"))
