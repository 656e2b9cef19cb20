"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton finds the tokens that start at each byte. The encoder takes the longest
one and keeps it if it may follow the last token: two adjacent tokens are compatible when no merge
across their border would have come before the merges that made them. Otherwise it takes the next
shorter token, and when none is left it drops the last token. Each byte position is given up at
most once, so the work is linear, and the result is that of applying the merges in order.
Decoding gathers the tokens' bytes from one array through a table of offsets.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockmill.llm.common import Remembered, gaps, small_batches, table

CACHE_WORDS = 400_000
CACHE_PAIRS = 500_000
#: Unicode's White_Space; the regex module's own class has four controls more.
SPACE = r"\t-\r \x85\xa0  -     　"
#: The vocabulary's pre-tokenizer: fixed values.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + "]+")
#: The same for texts of Latin-1 characters alone, which a plain pattern splits faster.
LATIN = re.compile("[\x00-\xff]*")
LETTER, DIGIT, BLANK = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{BLANK}{LETTER}{DIGIT}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in the vocabulary file, by the usual rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class BytePairCoder:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stand_in = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = {t: bytes(stand_in[c] for c in t) for t in vocab if t not in self.special}
        self.id_of = {raw[t]: vocab[t] for t in raw}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.made: dict[int, tuple[int, int, int]] = {}  # token: rank of its merge, left, right
        self.merged: dict[tuple[int, int], int] = {}  # adjacent tokens: rank of the merge
        for rank, (a, b) in enumerate(merges):
            pair = (vocab[a], vocab[b])
            self.merged.setdefault(pair, rank)
            self.made.setdefault(vocab[a + b], (rank, *pair))
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id_of.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.prefix: dict[int, int] = {}
        texts = {i: t for t, i in self.id_of.items()} | {i: s.encode() for s, i in self.special.items()}
        self.size = size = max(texts) + 1
        self.text_of = texts
        self.sizes = [len(texts.get(i, b"")) for i in range(size)]
        self.lengths = np.array(self.sizes, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(texts.get(i, b"") for i in range(size)), np.uint8)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = Remembered(CACHE_WORDS)

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the bytes of ``left`` and ``right`` in rank order leaves just these two."""
        key = left * self.size + right
        if (known := self.compatible.get(key)) is not None:
            return known
        a, b, ok = left, right, True
        end = float("inf")  # when the part at the border that was undone last had been merged away
        while True:
            if self.merged.get((a, b), end) < end:
                ok = False
                break
            made_a, made_b = self.made.get(a), self.made.get(b)
            if made_a is None and made_b is None:
                break
            # undo the later merge: before it, its inner part stood at the border
            if made_b is None or (made_a is not None and made_a[0] > made_b[0]):
                end, a = made_a[0], made_a[2]
            else:
                end, b = made_b[0] + 0.5, made_b[1]  # of equal merges the one further left comes first
        if len(self.compatible) > CACHE_PAIRS:
            self.compatible.clear()
        self.compatible[key] = ok
        return ok

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``, or -1."""
        if (known := self.prefix.get(token)) is None:
            text = self.text_of[token]
            known = next((i for k in range(len(text) - 1, 0, -1) if (i := self.id_of.get(text[:k])) is not None), -1)
            self.prefix[token] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        if (whole := self.id_of.get(piece)) is not None and self._whole(piece, whole):
            return [whole]
        n, sizes, pairs, width = len(piece), self.sizes, self.compatible, self.size
        longest = [0] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end - sizes[token] + 1] = token
        token = longest[0]
        out, at, dead = [token], sizes[token], set()
        while at < n:
            token = longest[at]
            while True:
                if at + sizes[token] not in dead:
                    if not out:
                        break
                    fits = pairs.get(out[-1] * width + token)
                    if fits or (fits is None and self.may_follow(out[-1], token)):
                        break
                if (token := self.shorter(token)) < 0:
                    dead.add(at)
                    token = out.pop()
                    at -= sizes[token]
            out.append(token)
            at += sizes[token]
        return out

    def _whole(self, piece: bytes, token: int) -> bool:
        """Tokens of the vocabulary are what their own bytes merge to, by its construction."""
        return token in self.made or len(piece) == 1

    def _plain(self, text: str) -> list[str]:
        parts = (LATIN_SPLIT if LATIN.fullmatch(text) else SPLIT).findall(text)
        pieces = self.pieces
        found = [*map(pieces.young.get, parts)]
        for k in gaps(found):
            if (said := pieces.get(parts[k])) is None:
                said = ",".join(map(str, self.encode_piece(parts[k].encode("utf-8"))))
                if len(parts[k]) < 200:
                    pieces.put(parts[k], said)
            found[k] = said
        return found

    def encode_text(self, text: str) -> str:
        """Decimal ids joined by commas."""
        if not text:
            return ""
        if not any(s in text for s in self.special):
            return ",".join(self._plain(text))
        out = []
        for part in self.special_split.split(text):
            if part in self.special:
                out.append(str(self.special[part]))
            elif part:
                out += self._plain(part)
        return ",".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become U+FFFD."""
        lengths = self.lengths[ids]
        total = int(lengths.sum())
        shift = self.offsets[ids] - np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(ids) else lengths
        return self.blob[np.repeat(shift, lengths) + np.arange(total)].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=1)
def coder_of(path: str) -> BytePairCoder:
    """One coder for each Python worker, which keeps what it remembers from task to task."""
    return BytePairCoder(path)


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", *, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded if asked) of every whole text.

    A null text counts as empty and has no tokens; repeated rows give repeated rows; an empty table
    gives none.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), *([pa.list_(pa.int32()), pa.string()] if with_ids else [])]
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches):
        coder = coder_of(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                said = coder.encode_text(text.as_py() or "")
                ids = np.fromstring(said, np.int64, sep=",") if said else np.zeros(0, np.int64)
                decoded = coder.decode(ids)
                row = (doc_id, len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append(row + ((ids.tolist(), decoded) if with_ids else ()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), default_vocabulary())
