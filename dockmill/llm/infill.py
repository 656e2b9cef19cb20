"""Fill-in-middle: texts are cut in three and put together in another order, with sentinels between.

One Aho-Corasick automaton scans a text for its events: the sentinels, which make a text plain, and
the ASCII characters at which units change class. Between two events every character is of the same
kind, so the number of units in a gap follows by arithmetic from its length: each character is a
unit (``EACH``), or the whole gap is one (``RUN``). Only events are kept, with the units that end
before them; where the unit of a given rank ends is found by binary search among the events and
then by counting within one gap. A text's characters are never listed one by one.

Code points, the units of the query, have a single class: no character changes it, the automaton
finds sentinels alone, and a text without them is one gap.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockmill.llm.common import small_batches, table

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
EACH, RUN = "each", "run"
#: Of a hundred documents, from which number on they stay plain, and up to which number the suffix comes first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20


@dataclass(frozen=True)
class Units:
    """How a text is cut: ``breaks`` are the ASCII characters that change class, ``gap`` tells what lies between them.

    A break is a unit of its own, or ends the unit before it if ``closing`` (a line and its line feed).
    """

    gap: str = EACH
    breaks: str = ""
    closing: bool = False


CODE_POINTS = Units()
#: Runs of characters that are no blanks, and single blanks.
WORDS = Units(RUN, " \t\n\x0b\x0c\r")
LINES = Units(RUN, "\n", closing=True)


@lru_cache(maxsize=8)
def _automaton(breaks: str):
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, s in enumerate((*SENTINELS, *breaks)):
        found.add_word(s, (k, len(s)))
    found.make_automaton()
    return found


class Events:
    """The events of one text: where breaks lie, how many units end before and with them, and the sentinels."""

    def __init__(self, text: str, units: Units = CODE_POINTS):
        self.units, breaks = units, []
        self.sentinels: list[tuple[int, int]] = []  # place, which of the three
        for end, (k, size) in _automaton(units.breaks).iter(text):
            if k < len(SENTINELS):
                self.sentinels.append((end - size + 1, k))
            else:
                breaks.append(end)
        self.at = np.array([*breaks, len(text)], np.int64)  # the end closes the last gap
        starts = np.concatenate([[0], self.at[:-1] + 1])
        sizes = self.at - starts
        inside = sizes if units.gap == EACH else (sizes > 0).astype(np.int64)
        if units.closing:  # a break ends its gap's unit, and is one where the gap is empty
            own = np.where(inside > 0, 0, 1)
        else:
            own = np.ones(len(self.at), np.int64)
        own[-1] = 0
        self.ends = np.cumsum(inside + own)  # units that end with the event
        self.starts, self.inside = starts, inside
        self.total = int(self.ends[-1])

    def place(self, rank: int) -> int:
        """The character after the first ``rank`` units; ``rank`` lies between 0 and ``total``."""
        if rank <= 0:
            return 0
        k = int(np.searchsorted(self.ends, rank))
        left = rank - (int(self.ends[k - 1]) if k else 0)  # units wanted of this gap and its event
        last = k == len(self.at) - 1
        if left > self.inside[k] or (left == self.inside[k] and self.units.closing and not last):
            return int(self.at[k]) + 1
        return int(self.starts[k]) + (left if self.units.gap == EACH else int(self.at[k] - self.starts[k]))


@dataclass(frozen=True)
class Infill:
    """What becomes of one text; ``places`` are the ends of prefix and middle in characters, None if plain."""

    n: int
    form: str
    output: str
    places: tuple[int, int] | None


def draws(doc_id: int | None, seed: str = "1") -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that depend on the id alone; a missing id counts as an empty one."""
    said = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(said[k : k + 4], "big") for k in (0, 4, 8, 12))


def transform(text: str, doc_id: int | None, units: Units = CODE_POINTS, seed: str = "1") -> Infill:
    """``text`` with its middle last; texts that are empty or hold a sentinel stay plain."""
    events = Events(text, units)
    n = events.total
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or events.sentinels or h3 % 100 >= PLAIN_FROM:
        return Infill(n, "plain", text, None)
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = events.place(one), events.place(two)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return Infill(n, "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", (a, b))
    return Infill(n, "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", (a, b))


def restore(output: str, form: str) -> str:
    """The text that ``transform`` turned into ``output``.

    A sentinel can't arise where a part and a sentinel meet, as ``<`` stands only at its start, so
    the three that the automaton finds are the ones put in.
    """
    if form == "plain":
        return output
    found = Events(output).sentinels
    if [k for _, k in found] != ([1, 0, 2] if form == "spm" else [0, 1, 2]):
        raise ValueError(f"no output of the form {form}")
    ends = [at for at, _ in found[1:]] + [len(output)]
    part = {k: output[at + 3 : end] for (at, k), end in zip(found, ends, strict=True)}
    return part[0] + part[2] + part[1]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: Units = CODE_POINTS, seed: str = "1", *, with_texts: bool = False) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every whole text.

    ``with_texts`` adds output. A null text counts as empty and an empty one is plain; so is a text
    that holds a sentinel. The sizes of parts are code points, and null if plain. A null id draws
    like an empty one. Repeated rows repeat, an empty table gives no rows, very long texts are cut
    like others, and other columns are ignored, whatever their names.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *(["output"] if with_texts else [])]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8")).hexdigest()

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = transform(text.as_py() or "", doc_id, units, seed)
                a, b = found.places or (None, None)
                row = (doc_id, found.n, found.form, a, None if a is None else b - a, sha(found.output), sha(restore(found.output, found.form)))
                rows.append(row + ((found.output,) if with_texts else ()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in range(len(names))], names=names)

    ddl = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + (", output string" if with_texts else "")
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, ddl)


def op13_infill(spark, sf_dir: str) -> DataFrame:
    """Fill-in-middle over code points of all ``documents``; odd rows as in ``fill_in_middle``."""
    return fill_in_middle(table(spark, sf_dir, "documents"))
