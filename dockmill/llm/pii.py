"""Personal data: fixed patterns, and what a conditional random field adds to them.

The patterns find e-mail and IP addresses, card and phone numbers. A linear-chain conditional
random field over word shapes labels the words of each line and finds what the patterns can't: numbers
that run into one another, phone numbers without ``+``, spelled-out addresses, and secrets. Whether
a word is a secret is the field's decision alone: by shape a key and a checksum are alike, and the
words around them tell. It is trained from ``labelled_table``, some thousand short labelled lines
that are written here. A number it proposes is added if its digits pass the kind's test; no span
that overlaps a pattern's is added. A line without a digit, ``@``, ``[at]`` or a word for secrets
can hold no such span and is not decoded.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockmill.llm.common import small_batches, table
from dockmill.llm.crf import ChainModel

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "secret"]
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match starts where a run of digits does, so the look-behind changes nothing but the time.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY = re.compile("[0-9@]|[\\[({]at[\\])}]|[Pp]assw|PASSW|[Ss]ecret|SECRET")
DIGIT, NOT_DIGIT = re.compile("[0-9]"), re.compile("[^0-9]+")
WORD = re.compile(r"[^\s=\"'`]+")
LOCAL_PHONE = re.compile(r"[+(]?[0-9][ ().0-9-]*[0-9]")
SPELLED = re.compile(r"[A-Za-z0-9._%+-]+\s*(?:@|[\[({]at[\])}])\s*[A-Za-z0-9-]+(?:\s*(?:\.|[\[({]dot[\])}])\s*[A-Za-z0-9-]+)+")
EDGES = ".,;:!?()[]{}<>#*&%$|"
TABLE_ROWS = 1800


def luhn(digits: str) -> bool:
    """The usual check of card numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the patterns' matches, by start and then kind."""
    out = [(s, e, 0) for s, e in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def tokenised(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """(token, start, end) of the words between two places; a token's first sign tells what parts it from the word before."""
    out, last = [], start
    for m in WORD.finditer(text, start, end):
        gap = text[last : m.start()]
        out.append((("=" if "=" in gap else '"' if gap.strip() else " ") + m[0], m.start(), m.end()))
        last = m.end()
    return out


#: Words before secrets, and before values of like shape that are none: fixed values.
SECRET_NAMES = ["token", "key", "secret", "api_key", "apikey", "password", "passwd", "pwd", "auth", "credential", "access_key", "client_secret", "Bearer", "private_key", "SECRET_KEY", "pass"]
OTHER_NAMES = ["sha1", "sha256", "md5", "checksum", "commit", "digest", "etag", "revision", "uuid", "isbn", "id", "order", "invoice", "build", "version", "ref", "hash", "page", "no", "doi", "serial", "article"]
PHONE_NAMES = ["tel", "phone", "call", "fax", "mobile", "telephone", "Tel.", "Phone:"]


def labelled_table(rows: int = TABLE_ROWS, seed: int = 3) -> list[tuple[list[str], list[str]]]:
    """Short lines of invented words, numbers, personal data and what looks like it, as (tokens, labels)."""
    rng = np.random.default_rng(seed)
    letters = "aaeeiioourstnlmdchgübñé"
    hexed, mixed = "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def pick(items):
        return items[int(rng.integers(len(items)))]

    def signs(alphabet: str, n: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n).tolist())

    def word() -> str:
        w = signs(letters, int(rng.integers(1, 10)))
        return (w.capitalize() if rng.random() < 0.15 else w) + pick(["", "", "", "", ".", ",", "###", "***", "!"])

    def card() -> str:
        body = _digits(rng, int(pick([11, 12, 14, 15, 15, 15, 15, 18])))
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def secret() -> str:
        kind = int(rng.integers(6))
        if kind == 0:
            return signs(hexed, int(pick([20, 32, 40, 40, 64])))
        if kind == 1:
            return signs(mixed, int(rng.integers(16, 60)))
        if kind == 2:
            return signs(mixed + "+/", int(rng.integers(20, 50))) + pick(["", "=", "=="])
        if kind == 3:
            return pick(["sk-", "pk_", "ghp_", "xox-", "AK"]) + signs(mixed, int(rng.integers(16, 40)))
        if kind == 4:
            return signs(mixed, int(rng.integers(4, 9))) + pick(["!", "#", "$", "@", "_", "?"]) + _digits(rng, int(rng.integers(1, 5)))
        return signs(letters[:18], int(rng.integers(4, 9))).capitalize() + _digits(rng, int(rng.integers(1, 5))) + pick(["", "!", "$"])

    def said(name: str, value: str, label: str) -> list[tuple[str, str]]:
        form, quote = int(rng.integers(7)), pick(['"', '"', "'", ""])
        if form < 3:
            return [(f"{name} = {quote}", "O"), (value, label), (quote, "O")]
        return [(pick([f"{name}: ", f"{name}=", f"{name} is ", f"{quote or chr(34)}{name}{quote or chr(34)}: {quote}", f"{name} "]) if form < 6 else f"{name}={quote}", "O"), (value, label), (quote, "O")]

    def item() -> list[tuple[str, str]]:
        kind = pick(["email", "spelled", "ip", "card", "card", "phone", "phone", "local", "secret", "secret", "secret", "alike", "alike", "alike", "number", "plain"])
        if kind == "email":
            return [(word().strip(".,#*!") + pick(["", ".", "_"]) + _digits(rng, 2) + "@" + pick(["mail", "host", "post"]) + pick(["", "1", "7"]) + "." + pick(["example", "test"]) + "." + pick(["com", "org", "de"]), "email")]
        if kind == "spelled":
            at, dot = pick([("[at]", "[dot]"), ("(at)", "(dot)"), ("{at}", ".")])
            gap = pick([" ", " ", ""]) if dot != "." else ""
            return [(f"{word().strip('.,#*!') or 'a'}{gap}{at}{gap}{pick(['mail', 'host', 'post'])}{gap}{dot}{gap}{pick(['com', 'org', 'de'])}", "email")]
        if kind == "ip":
            return [(".".join(str(int(i)) for i in rng.integers(0, 256, 4)), "ip")]
        if kind == "card":
            number = card()
            if rng.random() < 0.3 and len(number) == 16:
                return [(" ".join(number[k : k + 4] for k in range(0, 16, 4)), "card")]
            return [(number, "card"), (pick(["", "", " " + _digits(rng, int(rng.integers(1, 5)))]), "O")]
        if kind == "phone":
            country = "+" + str(int(rng.integers(1, 99)))
            return [(pick([f"{country} ({_digits(rng, 3)}) {_digits(rng, 3)}-{_digits(rng, 4)}", "+" + _digits(rng, int(rng.integers(9, 13))), f"{country} {_digits(rng, 3)} {_digits(rng, 3)} {_digits(rng, 4)}"]), "phone")]
        if kind == "local":
            return [(pick(PHONE_NAMES) + pick([" ", ": ", " "]), "O"), (pick([f"({_digits(rng, 3)}) {_digits(rng, 3)}-{_digits(rng, 4)}", f"0{_digits(rng, 3)}-{_digits(rng, 6)}", f"{_digits(rng, 3)}-{_digits(rng, 4)}", f"0{_digits(rng, 2)} {_digits(rng, 4)} {_digits(rng, 4)}"]), "phone")]
        if kind == "secret":
            return said(pick(SECRET_NAMES), secret(), "secret")
        if kind == "alike":  # the shapes of secrets and numbers under names of what anybody may read
            value = pick([signs(hexed, int(pick([7, 12, 32, 40, 40, 64]))), signs(mixed, int(rng.integers(5, 40))), _digits(rng, int(rng.integers(3, 14))), "-".join(signs(hexed, n) for n in (8, 4, 4, 4, 12)), f"{_digits(rng, 3)}-{_digits(rng, 4)}"])
            return said(pick(OTHER_NAMES), value, "O")
        if kind == "plain":  # a name that no secret follows
            return [(pick(SECRET_NAMES) + " " + word() + " " + word(), "O")]
        return [(pick([_digits(rng, int(rng.integers(1, 9))), "19" + _digits(rng, 2), _digits(rng, 2) + "." + _digits(rng, 2), _digits(rng, 3) + "-" + _digits(rng, 2), _digits(rng, 2) + "%", "20" + _digits(rng, 2) + "-0" + _digits(rng, 1) + "-1" + _digits(rng, 1), signs(hexed, 12), "v1." + _digits(rng, 1)]), "O")]

    out = []
    for _ in range(rows):
        parts: list[tuple[str, str]] = []
        for _ in range(int(rng.integers(1, 5))):
            parts += [(word(), "O") for _ in range(int(rng.integers(0, 7)))]
            if rng.random() < 0.8:
                own = item()
                if rng.random() < 0.2:
                    own = [*own[:-1], (own[-1][0], own[-1][1]), (pick([".", ",", "###", "&&&"]), "glued")]
                parts.append((None, own))
        text, spans = "", []
        for piece, label in parts:
            text += " " if text else ""
            for said_text, kind in label if piece is None else [(piece, label)]:
                if kind not in ("O", "glued"):
                    spans.append((len(text), len(text) + len(said_text), kind))
                text += said_text
        tokens = tokenised(text, 0, len(text))
        labels, before = [], None
        for _, start, end in tokens:
            held = next((s for s in spans if start < s[1] and s[0] < end), None)
            labels.append("O" if held is None else ("I-" if held is before else "B-") + held[2])
            before = held
        if tokens:
            out.append(([t for t, _, _ in tokens], labels))
    return out


def train(rows: int = TABLE_ROWS) -> ChainModel:
    """The model of this module's labelled table; the same each time."""
    return ChainModel(LABELS).fit(labelled_table(rows))


@lru_cache(maxsize=1)
def trained() -> ChainModel:
    """``train`` once in a process."""
    return train()


def _passes(kind: str, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The part of a proposed span that is the kind's: of numbers and addresses what has the form, of a secret all but signs at its ends."""
    said = text[start:end]
    if kind == "secret":
        bare = said.strip(EDGES)
        at = start + len(said) - len(said.lstrip(EDGES))
        return (at, at + len(bare)) if bare else None
    if kind == "email":
        m = SPELLED.search(said)
    elif kind == "ip":
        m = IP.search(said)
        m = m if m and all(int(p.lstrip("0")[:4] or 0) < 256 for p in m[0].split(".")) else None
    elif kind == "card":
        m = CARD.search(said)
        m = m if m and 12 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d) else None
    else:
        m = LOCAL_PHONE.search(said)
        m = m if m and 7 <= len(NOT_DIGIT.sub("", m[0])) <= 15 else None
    return (start + m.start(), start + m.end()) if m else None


def find_spans(texts: list[str], model: ChainModel) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text the patterns' spans and all spans, as (start, end, kind number) by start and kind."""
    lines: list[tuple[int, list[tuple[str, int, int]]]] = []
    base = [base_spans(t) for t in texts]
    for k, text in enumerate(texts):
        at = 0
        while m := ANY.search(text, at):
            start = text.rfind("\n", 0, m.start()) + 1
            end = text.find("\n", m.start())
            end = len(text) if end < 0 else end
            lines.append((k, tokenised(text, start, end)))
            at = end
    extra: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (k, words), path in zip(lines, model.decode([[w[0] for w in words] for _, words in lines]), strict=True):
        j = 0
        while j < len(path):
            label = LABELS[path[j]]
            j += 1
            if label == "O":
                continue
            first, kind = j - 1, label[2:]
            while j < len(path) and LABELS[path[j]] == "I-" + kind:
                j += 1
            if part := _passes(kind, texts[k], words[first][1], words[j - 1][2]):
                extra[k].append((*part, KINDS.index(kind)))
    out = []
    for own, more in zip(base, extra, strict=True):
        every = [*own, *(m for m in more if not any(m[0] < e and s < m[1] for s, e, _ in own))]
        out.append((own, sorted(every, key=lambda s: (s[0], s[2], s[1]))))
    return out


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the longest decides."""
    out, at = [], 0
    for s, e, k in sorted(spans, key=lambda x: (x[0], -x[1], x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, model: ChainModel | None = None, id_col: str = "doc_id", text_col: str = "text", *, with_text: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (and the masked text if asked) of every row.

    A null text counts as empty and holds nothing; a very long one is read whole. Spans that start
    together stand in the order of their kinds. Repeated rows repeat; an empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())
    ddl = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + (", masked string" if with_text else "")
    types = [pa.int64()] * 5 + [pa.string()] * (3 if with_text else 2)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 500):
                texts = [t.as_py() or "" for t in batch.column(1)[at : at + 500]]
                rows = []
                for doc_id, text, (own, every) in zip(ids[at : at + 500], texts, find_spans(texts, shared.value), strict=True):
                    counts = [sum(k == j for _, _, k in own) for j in range(4)]
                    row = (doc_id, *counts, hashlib.sha256(_said(own).encode()).hexdigest(), _said(every))
                    rows.append((*row, masked(text, every)) if with_text else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in ddl.split(", ")])

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl)


def mask_documents(docs: DataFrame, model: ChainModel | None = None, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with personal data and secrets replaced by their kind in brackets; every row stays.

    A null text stays null. ``size_col``, if there is one, is the new text's number of characters.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())

    @F.pandas_udf("string")
    def mask(texts):
        import pandas as pd

        said = [t or "" for t in texts]
        found = find_spans(said, shared.value)
        return pd.Series([None if t is None else masked(s, every) for t, s, (_, every) in zip(texts, said, found, strict=True)], dtype=object)

    out = small_batches(docs).withColumn(text_col, mask(F.col(text_col)))
    return out.withColumn(size_col, F.length(text_col).cast(dict(docs.dtypes)[size_col])) if size_col in docs.columns else out


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every row of ``documents``; odd rows as in ``find_personal_data``."""
    return find_personal_data(table(spark, sf_dir, "documents"))
