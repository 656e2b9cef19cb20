"""Near copies by the Jaccard similarity of word shingles, each candidate verified on the whole sets.

A text is the set of its shingles of ``WORDS`` words. Rows of equal sets are one node. First come
the SimHash fingerprints of the sets: the generalised pigeonhole search of ``simhash`` finds those
within ``RADIUS`` bits, and what is verified joins nodes to parts. At a similarity of 0.8
fingerprints differ by some ten bits, so MinHash goes on from these parts: values in ``BANDS`` bands
of ``BAND`` find candidates, and a pair of similarity 0.8 shares no band with a chance of 3 in a
million, a closer one with less. In a bucket every node of another part is first compared with the
bucket's smallest, its pivot, which joins large groups by as many pairs as they have rows.

Buckets that this leaves in several parts go on by differences: where D = x ^ p is what tells x
from the pivot p, |x ^ y| = |Dx ^ Dy|, so the test stays exact while what all have in common no
longer travels. A bucket's nodes are dealt to groups of bounded number and size, each to the tiles
of its pairs of groups; a tile counts what its nodes share by products of 0/1 matrices, and only
links leave it: pairs are never rows. No bucket is cut and no node is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockmill.llm.common import BROADCAST_KEYS, cut, keep_rows, partitions_for, small_batches
from dockmill.llm.components import connected_components
from dockmill.llm.simhash import RADIUS, link_fingerprints, majority

WORDS, SIMILARITY = 5, 0.8
BANDS, BAND = 24, 4
BLOCK = 2048  # shingles whose hashes are permuted at once
_DRAW = np.random.default_rng(42)
FACTORS = _DRAW.integers(0, 1 << 63, BANDS * BAND, np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _DRAW.integers(0, 1 << 63, BANDS * BAND, np.uint64)


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 values (seed 42) of the word shingles of a UTF-8 text, as longs; a shorter text is one shingle."""
    import xxhash

    parts = text.lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not parts:
        return np.empty(0, np.int64)
    shingles = map(b" ".join, zip(*(parts[k:] for k in range(words)), strict=False)) if len(parts) >= words else [b" ".join(parts)]
    n = max(1, len(parts) - words + 1)
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), shingles), np.uint64, n)).view(np.int64)


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key for each band; equal keys of a band mean equal MinHash values but for chance."""
    import xxhash

    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    values = hashes.view(np.uint64)
    for at in range(0, len(values), BLOCK):
        least = np.minimum(least, (values[at : at + BLOCK, None] * FACTORS + ADDENDS).min(0))
    return [int(np.uint64(xxhash.xxh64_intdigest(b.tobytes(), seed=k)).astype(np.int64)) for k, b in enumerate(least.reshape(BANDS, BAND))]


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, text_key, node (a hash of the whole set), fp (the set's SimHash) and the band keys, which a text without words has none of."""
    import xxhash

    def run(batches):
        for batch in batches:
            nodes, fps, keys = [], [], []
            for t in batch.column(1).cast(pa.binary()):
                hashes = shingle_hashes(t.as_py() or b"", words)
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), seed=7))
                fps.append(majority(hashes) if len(hashes) else 0)
                keys.append(band_keys(hashes) if len(hashes) else [])
            nodes, fps = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), nodes, fps, pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_key", "node", "fp", "bands"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, text_key long, node long, fp long, bands array<long>")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("text_key"))


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """node and its whole set, of rows with node and text."""

    def run(batches):
        for batch in batches:
            sets = [shingle_hashes(t.as_py() or b"", words) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


#: Pairs and bytes of sets a tile is meant to hold; both only decide how many tiles there are.
TILE_PAIRS, TILE_BYTES = 20_000, 32 << 20


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    if len(x) < len(y):
        x, y = y, x
    return int(np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y)) if len(y) else 0


def _tiled(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(tile, a, b, shingles, and what else ``pairs`` have), sorted: a tile's sets, with b null, come before its pairs.

    Nodes are dealt to ``side`` groups by hash, pairs to the tiles of two groups. A set goes once to
    each tile that has a pair with it, so a node of many pairs travels at most 2 x ``side`` times and
    one of few pairs no more than these. Both tables are read twice and should be cut.
    """
    n = pairs.count()
    nodes, longs = sets.agg(F.count(F.lit(1)), F.sum(F.size("shingles"))).first()
    size = 8 * (longs or 0)
    side = max(1, round((n / TILE_PAIRS) ** 0.5), -(-size // TILE_BYTES))
    moved = min(2 * n, 2 * side * nodes) * size // max(1, nodes)
    tasks = max(1, min(side * side, -(-n // TILE_PAIRS)), -(-moved // (2 * TILE_BYTES)))

    def group(node: str):
        return F.pmod(F.xxhash64(node), F.lit(side))

    tiled = pairs.withColumn("tile", group("a") * side + group("b"))
    needs = tiled.select("tile", F.explode(F.array("a", "b")).alias("node")).distinct()
    owned = needs.join(sets, "node").select("tile", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "shingles")
    extra = [c for c in pairs.columns if c not in ("a", "b")]
    rows = owned.unionByName(tiled, allowMissingColumns=True).select("tile", "a", "b", "shingles", *extra)
    return rows.repartition(tasks, "tile").sortWithinPartitions("tile", F.col("b").isNotNull())


def _met(batches) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, np.ndarray, np.ndarray]]]]:
    """Each batch of ``_tiled`` with the places of its pairs and both sets, as sorted arrays; pairs of nodes without a set are left out."""
    now, held = None, {}
    for batch in batches:
        found = []
        lists = batch.column(3)
        values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        for k, (tile, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            if tile != now:
                now, held = tile, {}
            if b is None:
                held[a] = np.sort(values[at[k] : at[k + 1]])  # sets are sorted as unsigned values
            elif (x := held.get(a)) is not None and (y := held.get(b)) is not None:
                found.append((k, x, y))
        yield batch, found


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) whose ``sets`` (node, shingles) have at least ``similarity``."""

    def run(batches):
        for batch, found in _met(batches):
            keep = []
            for k, x, y in found:
                small, large = sorted((len(x), len(y)))  # sizes alone rule many pairs out
                if small >= similarity * large and (both := shared(x, y)) >= similarity * (small + large - both):
                    keep.append(k)
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(2)], names=["a", "b"])

    return _tiled(pairs, sets).select("tile", "a", "b", "shingles").mapInArrow(run, "a long, b long")


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, size, delta, buckets) of ``pairs`` (a: pivot, b: node, buckets): the node's set and the pivot's, without what they share."""
    kind = pairs.schema["buckets"].dataType

    def run(batches):
        for batch, found in _met(batches):
            rows = batch.take(pa.array([k for k, _, _ in found], pa.int64()))
            deltas = pa.array([np.setxor1d(x, y, assume_unique=True) for _, x, y in found], pa.list_(pa.int64()))
            sizes = pa.array([len(y) for _, _, y in found], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(2), sizes, deltas, rows.column(4)], names=["node", "size", "delta", "buckets"])

    schema = sets.select(F.col("node"), F.lit(0).cast("long").alias("size"), F.col("shingles").alias("delta")).schema.add("buckets", kind)
    return _tiled(pairs, sets).mapInArrow(run, schema)


#: Nodes and bytes of differences in a group of a bucket's nodes; both only decide how many groups there are.
GROUP_NODES, GROUP_BYTES = 2048, 32 << 20
#: Up to how many nodes of a tile an element is counted by its pairs, how many others are multiplied and how many nodes compared at once.
FEW_NODES, COLUMNS, ROWS = 12, 1024, 256


def shared_counts(deltas: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the arrays share, as a matrix of which the part above the diagonal counts."""
    n = len(deltas)
    owner = np.repeat(np.arange(n), [len(d) for d in deltas])
    values = np.concatenate(deltas) if n else np.empty(0, np.int64)
    order = np.lexsort((owner, values))
    owner, values = owner[order], values[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(values)))
    counts = np.zeros(n * n, np.float32)
    few = (sizes > 1) & (sizes <= FEW_NODES)
    for size in np.unique(sizes[few]):
        at = starts[sizes == size]
        for i in range(size):
            for j in range(i + 1, size):
                np.add.at(counts, owner[at + i] * n + owner[at + j], 1)
    counts = counts.reshape(n, n)
    many = np.flatnonzero(sizes > FEW_NODES)
    for at in range(0, len(many), COLUMNS):
        block = np.zeros((n, min(COLUMNS, len(many) - at)), np.float32)
        for c, k in enumerate(many[at : at + COLUMNS]):
            block[owner[starts[k] : starts[k] + sizes[k]], c] = 1
        counts += block @ block.T
    return counts


def links_within(sizes: np.ndarray, parts: np.ndarray, groups: np.ndarray, deltas: list[np.ndarray], two: bool, ratio: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a tile of at least the similarity ``ratio``, of different parts; of different groups if the tile has ``two``."""
    number, whole = ratio
    nothing = np.empty(0, np.int64)
    if not len(parts) or (parts == parts[0]).all() or (two and (groups == groups[0]).all()):
        return nothing, nothing
    counts = shared_counts(deltas)
    lengths = np.array([len(d) for d in deltas], np.int64)
    left, right = [nothing], [nothing]
    for at in range(0, len(parts), ROWS):
        some = slice(at, at + ROWS)
        different = np.triu(parts[some, None] != parts[None, :], at + 1)
        if two:
            different &= groups[some, None] != groups[None, :]
        apart = lengths[some, None] + lengths[None, :] - 2 * counts[some].astype(np.int64)
        both = sizes[some, None] + sizes[None, :]
        # common = (both - apart) / 2, union = (both + apart) / 2
        i, j = np.nonzero(different & ((both - apart) * whole >= (both + apart) * number))
        left.append(i + at)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def tile_links(rows: DataFrame, tasks: int, similarity: float) -> DataFrame:
    """(a, b) that link within the tiles of ``rows`` (bucket, first, one, two, group, node, part, size, delta)."""
    share = Fraction(similarity).limit_denominator(10**6)
    ratio = (share.numerator, share.denominator)

    def done(held):
        nodes, parts, sizes, groups, deltas, two = held
        order = sorted(range(len(nodes)), key=nodes.__getitem__)
        left, right = links_within(np.array(sizes)[order], np.array(parts)[order], np.array(groups)[order], [deltas[k] for k in order], two, ratio)
        ids = np.array(nodes, np.int64)[order]
        return pa.RecordBatch.from_arrays([pa.array(ids[left]), pa.array(ids[right])], names=["a", "b"])

    def run(batches):
        now, held = None, None
        for batch in batches:
            lists = batch.column(8)
            values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            for k, (bucket, first, one, two, group, node, part, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True)):
                if (bucket, first, one, two) != now:
                    if held is not None:
                        yield done(held)
                    now, held = (bucket, first, one, two), ([], [], [], [], [], one != two)
                for kept, value in zip(held, (node, part, size, group, values[at[k] : at[k + 1]].copy()), strict=False):
                    kept.append(value)
        if held is not None:
            yield done(held)

    tile = ["bucket", "first", "one", "two"]
    dealt = rows.select(*tile, "group", "node", "part", "size", "delta").repartition(tasks, *tile)
    return dealt.sortWithinPartitions(*tile).mapInArrow(run, "a long, b long")


def mixed_links(parts: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) between nodes of different parts that share a bucket; ``parts`` has band, key, first, node, part for the buckets of several parts."""
    keyed = parts.select(F.xxhash64("band", "key").alias("bucket"), "first", "node", "part")
    sizes = sets.select("node", F.size("shingles").alias("size"))
    sized = keyed.join(sizes, "node")
    # what a node tells apart from the pivot is at most both sets; nodes alike to it, as they are here, differ by far less
    wide = cut(sized.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("longs")))
    side = F.greatest(F.ceil(F.col("n") / GROUP_NODES), F.ceil(F.col("longs") * 8 / GROUP_BYTES)).cast("int")
    wide = cut(wide.select("bucket", side.alias("side")))
    tiles = wide.agg(F.sum(F.col("side") * (F.col("side") + 1) / 2)).first()[0] or 0
    if not tiles:
        return sets.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    few = F.broadcast(wide) if wide.count() <= BROADCAST_KEYS else wide
    asked = keyed.join(few, "bucket").groupBy(F.col("first").alias("a"), F.col("node").alias("b")).agg(F.collect_list(F.struct("bucket", "first", "side", "part")).alias("buckets"))
    asked = cut(asked)
    met = differences(asked, sets).select("node", "size", "delta", F.explode("buckets").alias("x")).select("node", "size", "delta", "x.*")
    met = met.withColumn("group", F.pmod(F.xxhash64("node"), F.col("side")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
    met = met.withColumn("one", F.least("group", "other")).withColumn("two", F.greatest("group", "other"))
    shuffles = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tile_links(met, max(1, min(int(tiles), 4 * shuffles), int(tiles) // 64), similarity)


#: Fingerprints that a task reads at once; it only decides how many tasks and files the search has.
FINGERPRINTS = 10_000


def simhash_pairs(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) of the nodes (node, fp) that SimHash takes for copies, each fingerprint as its smallest node, which is a pair with every other node of the fingerprint and with that of every fingerprint within ``radius`` bits."""
    least = cut(marked.groupBy("fp").agg(F.min("node").alias("least")).coalesce(partitions_for(marked.count(), FINGERPRINTS)))
    same = marked.join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    met = link_fingerprints(least.select("fp"), radius)
    near = met.join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    return same.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b")))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose nodes ``roots`` (node, root) don't join."""
    few = F.broadcast(roots) if roots.count() <= BROADCAST_KEYS else roots
    one, two = (few.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b"))
    return pairs.join(one, "a", "left").join(two, "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def near_links(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """(a, b) between nodes of ``rows`` whose sets have at least ``similarity``; together they link all such nodes that share a band, and those that SimHash finds."""
    nodes = rows.groupBy("node").agg(F.min(F.struct("doc_id", "text_key", "fp", "bands")).alias("x"))
    alike = cut(simhash_pairs(cut(nodes.where(F.size("x.bands") > 0).select("node", F.col("x.fp").alias("fp")))))
    members = nodes.select("node", F.posexplode("x.bands").alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = cut(members.join(buckets, ["band", "key"]))  # those that share a bucket
    named = alike.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.select("node"))
    wanted = named.distinct().join(nodes, "node").select("node", F.col("x.doc_id").alias("__id"), F.col("x.text_key").alias("__key"))
    wanted = cut(wanted)
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    texts = _texts(docs, id_col, text_col)
    found = texts.join(few, texts["doc_id"].eqNullSafe(few["__id"]) & (texts["text_key"] == few["__key"])).select("node", "text")
    sets = cut(shingle_sets(found, words).dropDuplicates(["node"]))

    copies = cut(verified(alike, sets, similarity))
    stars = members.select(F.col("first").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    stars = cut(apart(stars, cut(connected_components(copies))))
    links = cut(copies.unionByName(verified(stars, sets, similarity)))
    roots = connected_components(links)
    parts = members.join(roots, "node", "left").select("band", "key", "first", "node", F.coalesce("root", "node").alias("part"))
    mixed = parts.groupBy("band", "key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("n"))
    # a bucket of two nodes is settled by its star
    mixed = mixed.where((F.col("low") != F.col("high")) & (F.col("n") > 2)).select("band", "key")
    parts = cut(parts.join(mixed, ["band", "key"]))
    return links.unionByName(cut(mixed_links(parts, sets, similarity)))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group that similarity links, that of the smallest id, all its columns kept.

    A null text counts as empty; texts without words are one group. Null ids come last. An empty
    table gives no rows. Other columns of ``docs`` are only carried along.
    """
    rows = cut(signatures(docs, id_col, text_col, words))
    roots = cut(connected_components(near_links(docs, rows, id_col, text_col, words, similarity)))
    named = cut(rows.drop("fp", "bands").join(roots, "node", "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("root")))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"))
    kept = named.join(first, "root").select("doc_id", F.col("text_key").alias("key"), (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))).alias("kept"))
    return keep_rows(docs, kept, id_col, F.xxhash64(text_col))
