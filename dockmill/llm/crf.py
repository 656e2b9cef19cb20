"""A linear-chain conditional random field over hashed word features, in numpy batches."""

from __future__ import annotations

import re
import zlib

import numpy as np

FEATURES = 1 << 13
SLOTS = 8  # features of a word, for itself and for its two neighbours
RUNS = ((re.compile("[A-Z]+"), "X"), (re.compile("[^\\W\\d_A-Z]+"), "x"))
DIGITS = re.compile("[0-9]+")
EDGE = re.compile(r"^\W+|\W+$")


def shape(word: str) -> str:
    """Runs of capitals, other letters and digits as X, x and d; a run of digits keeps its length up to four."""
    for pattern, sign in RUNS:
        word = pattern.sub(sign, word)
    return DIGITS.sub(lambda m: "d" * min(4, len(m[0])), word)


def word_features(token: str) -> list[int]:
    """Hashed features of a word and of the sign before it (the token's first): that sign, shape, bare shape, size, share of digits, kind of characters, first and last sign."""
    sign, word = token[:1], token[1:]
    bare = EDGE.sub("", word)
    digits = sum(c.isdigit() for c in bare)
    hexed = bool(bare) and all(c in "0123456789abcdefABCDEF" for c in bare)
    n = len(bare)
    said = (
        "g" + sign,
        "s" + shape(word)[:40],
        "b" + shape(bare)[:40],
        "n" + str(min(n, 12) if n < 16 else 16 if n < 24 else 24),
        f"d{digits}" if digits < 20 else "d20",
        f"k{hexed and digits > 0 and digits < n}{'@' in bare}{bare.count('.')}{min(9, n // 4)}",
        "w" + bare.lower() if not digits and n < 12 else "w",
        "e" + word[:1] + word[-1:] if word[:1] + word[-1:] != bare[:1] + bare[-1:] else "e",
    )
    return [zlib.crc32(s.encode("utf-8", "replace")) % FEATURES for s in said]


class ChainModel:
    """Labels, emission weights for a word, the one before and the one after, and transitions."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        k = len(labels)
        self.emit = np.zeros((3, FEATURES, k), np.float32)
        self.move = np.zeros((k + 1, k), np.float32)  # the last row starts a sequence

    def scores(self, sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(steps, rows, labels) of emission scores and the mask of words."""
        words = {w: i for i, w in enumerate({w for s in sentences for w in s})}
        features = np.array([word_features(w) for w in words], np.int64).reshape(-1, SLOTS)
        own, before, after = (self.emit[j][features].sum(1) for j in range(3))
        steps = max(map(len, sentences))
        e = np.zeros((steps, len(sentences), len(self.labels)), np.float32)
        mask = np.zeros((steps, len(sentences)), bool)
        for r, s in enumerate(sentences):
            ids = [words[w] for w in s]
            e[: len(ids), r] = own[ids]
            e[1 : len(ids), r] += before[ids[:-1]]
            e[: len(ids) - 1, r] += after[ids[1:]]
            mask[: len(ids), r] = True
        return e, mask

    def decode(self, sentences: list[list[str]]) -> list[list[int]]:
        """The best label sequence of each sentence, by Viterbi over batches of like length."""
        out: list[list[int]] = [[] for _ in sentences]
        order = sorted((k for k, s in enumerate(sentences) if s), key=lambda k: len(sentences[k]))
        at = 0
        while at < len(order):
            group: list[int] = []
            while at < len(order) and (not group or (len(group) < 1024 and (len(group) + 1) * len(sentences[order[at]]) < 100_000)):
                group.append(order[at])
                at += 1
            e, mask = self.scores([sentences[k] for k in group])
            best = e[0] + self.move[-1]
            back = np.zeros(e.shape, np.int8)
            stay = np.arange(len(self.labels), dtype=np.int8)
            for t in range(1, len(e)):
                step = best[:, :, None] + self.move[:-1]
                came = step.argmax(1)
                now = np.take_along_axis(step, came[:, None], 1)[:, 0] + e[t]
                back[t] = np.where(mask[t][:, None], came, stay)
                best = np.where(mask[t][:, None], now, best)
            label = best.argmax(1)
            paths = np.zeros(mask.shape, np.int8)
            for t in range(len(e) - 1, -1, -1):
                paths[t] = label
                label = back[t][np.arange(len(label)), label]
            for r, k in enumerate(group):
                out[k] = paths[: len(sentences[k]), r].tolist()
        return out

    def fit(self, table: list[tuple[list[str], list[str]]], epochs: int = 8, batch: int = 32, rate: float = 0.2, decay: float = 1e-4, seed: int = 5) -> ChainModel:
        """Maximum likelihood by Adagrad on (words, labels) rows."""
        rng, number = np.random.default_rng(seed), {n: i for i, n in enumerate(self.labels)}
        grown = [np.full_like(self.emit, 1e-2), np.full_like(self.move, 1e-2)]
        rows = [(w, [number[x] for x in y]) for w, y in table if w]
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                part = [rows[i] for i in order[at : at + batch]]
                ge, gm = self._gradients([w for w, _ in part], [y for _, y in part])
                for weights, g, past in ((self.emit, ge, grown[0]), (self.move, gm, grown[1])):
                    g = g / len(part) + decay * weights
                    past += g * g
                    weights -= rate * g / np.sqrt(past)
        return self

    def _gradients(self, sentences: list[list[str]], gold: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        e, mask = self.scores(sentences)
        steps, rows, k = e.shape
        move, start = self.move[:-1], self.move[-1]

        def total(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis, keepdims=True)
            return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

        ahead = np.zeros_like(e)
        ahead[0] = start + e[0]
        for t in range(1, steps):
            ahead[t] = np.where(mask[t][:, None], total(ahead[t - 1][:, :, None] + move, 1) + e[t], ahead[t - 1])
        z = total(ahead[-1], 1)
        behind = np.zeros_like(e)
        gm = np.zeros_like(self.move)
        for t in range(steps - 1, 0, -1):
            nxt = e[t] + behind[t]
            behind[t - 1] = np.where(mask[t][:, None], total(move + nxt[:, None, :], 2), behind[t])
            pair = np.exp(ahead[t - 1][:, :, None] + move + nxt[:, None, :] - z[:, None, None])
            gm[:-1] += (pair * mask[t][:, None, None]).sum(0)
        chance = np.exp(ahead + behind - z[:, None]) * mask[:, :, None]
        gm[-1] += chance[0].sum(0)
        for r, y in enumerate(gold):
            chance[np.arange(len(y)), r, y] -= 1
            gm[-1, y[0]] -= 1
            np.add.at(gm, (y[:-1], y[1:]), -1)
        ge = np.zeros_like(self.emit)
        for r, s in enumerate(sentences):
            f = np.array([word_features(w) for w in s])
            c = chance[: len(s), r]
            for j in range(SLOTS):
                np.add.at(ge[0], f[:, j], c)
                np.add.at(ge[1], f[:-1, j], c[1:])
                np.add.at(ge[2], f[1:, j], c[:-1])
        return ge, gm
