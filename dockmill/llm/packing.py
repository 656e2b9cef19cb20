"""Best-fit packing of token sequences, improved by swap-based local search.

Documents become pieces of at most ``capacity`` tokens where they are tokenised, and only piece
lengths are shuffled. Pieces are dealt by the hash of a row number to shards of about ``SHARD``
pieces, so copies spread like any other rows. A shard is packed best-fit, then a local search moves
a document, exchanges one for one or two for one between underfull bins whenever that raises the
squared fill, until bins run empty. Bins are found by room and item length, so a step looks at the
rooms that occur, not at all bins. A second round deals every sequence with any room anew, the
emptiest together, and goes on searching there.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockmill.llm.bpe import byte_alphabet
from dockmill.llm.common import Remembered, cut, gaps, partitions_for, small_batches, table

CAPACITY = 2048
SHARD = 16_384
#: Sequence ids from one shard to the next, more than any group that fits in memory has bins.
STRIDE = 1 << 32
CACHE_PIECES = 300_000
BATCH_CHARS = 2_000_000
#: Texts that ``PIECE`` splits as the pre-tokenizer does, once lower-cased.
PLAIN = re.compile("[\t-\r -&(-~\xa0-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\xff]*")
PIECE = re.compile("[a-z\xdf-\xf6\xf8-\xff]+|[^\t-\r \xa0a-z\xdf-\xf6\xf8-\xff]+")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """Ids as little-endian unsigned 32-bit bytes, by the tokenizers library, piece by piece.

    The vocabulary's normalizer lower-cases, and its pre-tokenizer drops white space and parts
    letters from other characters, so the ids of a text are those of its pieces in order. Ids of
    pieces are remembered. Texts with an apostrophe or a character beyond Latin-1 go whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        stand_in = {b: c for c, b in byte_alphabet().items()}
        self.spelled = {k: "".join(stand_in[b] for b in chr(k).encode()) for k in range(128, 256)}
        self.known = Remembered(CACHE_PIECES)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of lower-case pieces. Letters are one pre-token, so the bare model has them, spelled as bytes."""
        other = iter(self._encode([p for p in pieces if not p.isalpha()]))
        return [array("I", [t.id for t in self.model.tokenize(p if p.isascii() else p.translate(self.spelled))]).tobytes() if p.isalpha() else next(other) for p in pieces]

    def ids(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text, in order; new pieces of some texts are encoded together."""
        waiting, size = [], 0
        for text in texts:
            waiting.append(text)
            size += len(text)
            if size > BATCH_CHARS:
                yield from self._ids(waiting)
                waiting, size = [], 0
        yield from self._ids(waiting)

    def _ids(self, texts: list[str]) -> Iterator[bytes]:
        known, missing, new = self.known, [], set()
        split = [PIECE.findall(t.lower()) if PLAIN.fullmatch(t) and "<|" not in t else None for t in texts]
        found = [None if pieces is None else [*map(known.young.get, pieces)] for pieces in split]
        for ids, pieces in zip(found, split, strict=True):
            for j in gaps(ids or []):
                if (had := known.get(pieces[j])) is None:
                    new.add(pieces[j])
                    missing.append((ids, j, pieces[j]))
                else:
                    ids[j] = had
        order = [*new]
        added = dict(zip(order, self._pieces(order), strict=True))
        for ids, j, piece in missing:
            ids[j] = added[piece]
        for piece, ids in added.items():
            known.put(piece, ids)
        for text, ids in zip(texts, found, strict=True):
            yield self._encode([text])[0] if ids is None else b"".join(ids)


@lru_cache(maxsize=1)
def tokenizer_of(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker, which keeps what it remembers from task to task."""
    return WordTokenizer(path)


def tokenized_pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document.

    A null text counts as empty and has the end id alone; a very long one is cut into pieces and never
    shortened; repeated rows are packed as often as they occur; an empty table has no pieces; other
    columns are ignored, whatever their names.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = end_id.to_bytes(4, "little")

    def run(batches):
        tokenizer = tokenizer_of(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            texts = (x.as_py() or "" for x in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokenizer.ids(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 5, schema, strict=True)], schema=schema)

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def least_bins(lengths: Iterable[int], capacity: int = CAPACITY) -> int:
    """A number of bins that no packing goes below.

    For every threshold the items longer than ``capacity`` less the threshold stand alone, those
    over half a bin each need one, and what is between the threshold and half a bin fills what
    those leave; and of items longer than a k+1-th of a bin at most k share one.
    """
    count = np.bincount(np.fromiter(lengths, np.int64), minlength=capacity + 1)
    number, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    half = capacity // 2
    low = np.arange(half + 1)  # thresholds
    alone_or_large = number[-1] - number[half]
    large = number[capacity - low] - number[half]
    large_room = large * capacity - (total[capacity - low] - total[half])
    middle = total[half] - np.concatenate([[0], total[: half]])
    bounds = alone_or_large + np.maximum(0, -((large_room - middle) // capacity))
    few = np.arange(1, 33)
    return int(max(-(-int(total[-1]) // capacity), bounds.max(), (-((number[capacity // (few + 1)] - number[-1]) // few)).max()))


class Bins:
    """Bins of one shard, found by free room and, for the search, by room and the length of an item."""

    def __init__(self, capacity: int):
        self.capacity, self.fill = capacity, []
        self.items: list[dict[int, list[int]]] = []  # of each bin: the items of each length
        self.by_room: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.rooms = 0  # bit r is set if a bin has r tokens of room
        self.holding: dict[tuple[int, int], set[int]] | None = None  # bins by room and length, once the search begins
        self.lengths = [0] * (capacity + 1)  # bit n is set if a bin of that room holds an item of length n
        self.reach: list[int | None] = [None] * (capacity + 1)  # bit s is set if s may stand for such an item

    def open_bin(self, items: dict[int, list[int]]) -> int:
        self.items.append(items)
        self.fill.append(sum(n * len(k) for n, k in items.items()))
        self.file(len(self.fill) - 1)
        return len(self.fill) - 1

    def file(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        self.by_room[room].add(b)
        self.rooms |= 1 << room
        if self.holding is not None and room:
            for n in self.items[b]:
                self.holding.setdefault((room, n), set()).add(b)
                if not self.lengths[room] >> n & 1:
                    self.lengths[room] |= 1 << n
                    self.reach[room] = None

    def unfile(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        self.by_room[room].discard(b)
        if not self.by_room[room]:
            self.rooms &= ~(1 << room)
        if self.holding is not None and room:
            for n in self.items[b]:
                held = self.holding[room, n]
                held.discard(b)
                if not held:
                    self.lengths[room] &= ~(1 << n)
                    self.reach[room] = None

    def index(self) -> None:
        """Make ready for the search."""
        self.holding = {}
        for b, f in enumerate(self.fill):
            if 0 < f < self.capacity:
                self.file(b)

    def put(self, b: int, n: int, k: int) -> None:
        self.items[b].setdefault(n, []).append(k)
        self.fill[b] += n

    def take(self, b: int, n: int) -> int:
        own = self.items[b][n]
        k = own.pop()
        if not own:
            del self.items[b][n]
        self.fill[b] -= n
        return k

    def best_fit(self, n: int, k: int) -> None:
        fitting = self.rooms >> n
        if not fitting:
            self.open_bin({n: [k]})
            return
        b = min(self.by_room[n + (fitting & -fitting).bit_length() - 1])
        self.unfile(b)
        self.put(b, n, k)
        self.file(b)

    def reached(self, room: int) -> int:
        """Lengths that may take the place of an item in a bin of that room: longer by 1 to ``room``."""
        if (mask := self.reach[room]) is None:
            mask, wide = self.lengths[room] << 1, 1
            while wide < room:
                step = min(wide, room - wide)
                mask |= mask << step
                wide += step
            self.reach[room] = mask
        return mask


def local_search(bins: Bins) -> None:
    """Empty underfull bins; every step raises the sum of squared fills, so the search ends.

    A bin whose items the room of all others could not hold is never tried, and the search stops
    where no packing has fewer bins.
    """
    least = least_bins((n for items in bins.items for n, k in items.items() for _ in k), bins.capacity)
    used = sum(f > 0 for f in bins.fill)
    if used <= least:
        return
    bins.index()
    emptied = True
    while emptied:
        emptied = False
        room = sum(bins.capacity - f for f in bins.fill if f)
        for victim in sorted((b for b, f in enumerate(bins.fill) if 0 < f < bins.capacity), key=lambda b: (bins.fill[b], b)):
            fill = bins.fill[victim]
            if used <= least or fill > room - (bins.capacity - fill):
                break
            bins.unfile(victim)
            while bins.fill[victim] and _step(bins, victim):
                pass
            if bins.fill[victim]:
                bins.file(victim)
            else:
                used -= 1
                room -= bins.capacity
                emptied = True
        if used <= least:
            return


def _bits(mask: int) -> Iterator[int]:
    """Places of the set bits, lowest first."""
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def _step(bins: Bins, victim: int) -> bool:
    """Move length from ``victim`` (not filed) to a fuller bin: a move, else one for one, else two for one."""
    capacity, own = bins.capacity, bins.items[victim]
    for n in sorted(own, reverse=True):
        fitting = bins.rooms >> n
        if fitting:
            b = min(bins.by_room[n + (fitting & -fitting).bit_length() - 1])
            if bins.fill[b] + n > bins.fill[victim]:
                bins.unfile(b)
                bins.put(b, n, bins.take(victim, n))
                bins.file(b)
                return True
    ones = sum(1 << n for n in own)
    twos = 0
    for n, k in own.items():
        twos |= (ones if len(k) > 1 else ones & ~(1 << n)) << n
    fuller = bins.rooms & ((1 << (capacity - bins.fill[victim] + 1)) - 2)  # as full as the victim, and not full
    for wanted in (ones, twos):
        for room in _bits(fuller):
            if found := bins.reached(room) & wanted:
                out = found.bit_length() - 1
                least = max(1, out - room)
                back = least + _lowest(bins.lengths[room] >> least)
                b = min(bins.holding[room, back])
                bins.unfile(b)
                gone = bins.take(b, back)
                for n in [out] if wanted is ones else _halves(own, out):
                    bins.put(b, n, bins.take(victim, n))
                bins.put(victim, back, gone)
                bins.file(b)
                return True
    return False


def _lowest(mask: int) -> int:
    return (mask & -mask).bit_length() - 1


def _halves(own: dict[int, list[int]], total: int) -> list[int]:
    """Two lengths of ``own`` that make ``total``."""
    return next([n, total - n] for n in sorted(own) if total - n in own and (2 * n != total or len(own[n]) > 1))


def pack(lengths: list[int], capacity: int = CAPACITY, seeds: list[int] | None = None) -> tuple[list[int], list[int], list[int]]:
    """Bin, offset and bin's room for each length; bins are numbered from 0 without gaps.

    With ``seeds``, the bin of each length in a packing at hand, the search starts from that packing.
    """
    bins = Bins(capacity)
    if seeds is None:
        for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            bins.best_fit(lengths[k], k)
    else:
        held: dict[int, dict[int, list[int]]] = {}
        for k, (n, seed) in enumerate(zip(lengths, seeds, strict=True)):
            held.setdefault(seed, {}).setdefault(n, []).append(k)
        for items in held.values():
            bins.open_bin(items)
    local_search(bins)
    bin_of, offset, room = [0] * len(lengths), [0] * len(lengths), [0] * len(lengths)
    number = 0
    for items, fill in zip(bins.items, bins.fill, strict=True):
        at = 0
        for n, own in items.items():
            for k in own:
                bin_of[k], offset[k], room[k] = number, at, capacity - fill
                at += n
        number += bool(items)
    return bin_of, offset, room


PLACED = PIECES + ", row long, shard long, sequence_id long, offset long, room long"


def _packed(dealt: DataFrame, base: int, capacity: int) -> DataFrame:
    """Each ``shard`` packed by itself, from the sequences at hand if there are any."""
    seeded = "sequence_id" in dealt.columns

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "start", "ids_crc32", "row"], kind="stable")
        bin_of, offset, room = pack(rows["length"].tolist(), capacity, rows["sequence_id"].tolist() if seeded else None)
        return rows.assign(sequence_id=[base + int(key[0]) * STRIDE + b for b in bin_of], offset=offset, room=room)[PLACED_COLUMNS]

    return dealt.groupBy("shard").applyInPandas(run, PLACED)


PLACED_COLUMNS = [x.split()[0] for x in PLACED.split(", ")]


def _by_room(placed: DataFrame) -> DataFrame:
    """``placed`` dealt anew, sequences whole and the emptiest together, in shards of about ``SHARD`` pieces.

    The driver sees how many pieces lie in sequences of each room, at most as many numbers as a sequence has tokens.
    """
    sizes = {r.room: r["count"] for r in placed.groupBy("room").count().collect()}
    start, parts, at = {}, {}, 0
    for room in sorted(sizes, reverse=True):
        start[room], parts[room] = at // SHARD, partitions_for(sizes[room], SHARD)
        at += sizes[room]
    plan = placed.sparkSession.createDataFrame([(room, start[room], parts[room]) for room in start], "room long, first_shard long, parts long")
    dealt = placed.drop("shard").join(F.broadcast(plan), "room")  # one row for each room
    return dealt.withColumn("shard", F.col("first_shard") + F.pmod(F.xxhash64("sequence_id"), F.col("parts"))).drop("first_shard", "parts", "room", "offset")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset; every sequence is gapless from 0 and within ``capacity``.

    Pieces of equal length are told apart by id, piece and row number, so ties change no figure.
    """
    pieces = cut(pieces.withColumn("row", F.monotonically_increasing_id()))
    shards = partitions_for(pieces.count(), SHARD)
    first = _packed(pieces.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))), 0, capacity)
    if shards == 1:
        return first.drop("row", "shard", "room")
    first = cut(first)
    opened = first.where("room > 0")
    if opened.isEmpty():
        return first.drop("row", "shard", "room")
    second = _packed(_by_room(opened), 1 << 60, capacity)
    return first.where("room = 0").unionByName(second).drop("row", "shard", "room")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and pack: one row per piece with its place. Nulls, repeats and empty tables as in ``tokenized_pieces``."""
    return pack_pieces(tokenized_pieces(docs, vocabulary, end_id, capacity, id_col, text_col), capacity)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` packed; odd rows as in ``tokenized_pieces``."""
    return pack_documents(table(spark, sf_dir, "documents"), default_vocabulary())
