"""Main text of web pages: a bidirectional LSTM labels every block of a page.

A page is a sequence of leaf blocks. A block's vector joins the sum of learned vectors of its
hashed tag path, that of its hashed distinct words (both divided by the root of their number), and a
few numbers. The network reads the
sequence both ways, so a block is judged by what stands before and after it in the whole page.
It is trained here on pages that ``training_pages`` writes: invented text in many layouts, with a
label for every block. In a third of them no element has a name and all blocks stand in equal
elements, so only their words, and headings such as "Comments" before them, tell what they are.
Training is seeded, the same each time, and done once in a Python process.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockmill.llm.common import small_batches, table
from dockmill.llm.html_blocks import leaf_blocks

PATHS, WORDS, PATH_DIM, WORD_DIM, NUMBERS, HIDDEN = 4096, 16384, 16, 8, 6, 24
TRAINING_PAGES, EPOCHS, BATCH, RATE, SEED = 3600, 5, 48, 0.015, 11
#: Buckets whose words stand on fewer training pages keep the zero vector: rare words say nothing.
SEEN_PAGES = 8
#: Share of training pages without names.
PLAIN_PAGES = 0.35

#: Names that layouts give to their parts: fixed values.
BODY = ["article", "content", "post", "entry", "story", "text", "body", "main", "page", "prose", "single", "blog"]
BOILERPLATE = {
    "menu": ["nav", "menu", "navigation", "navbar", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "topbar", "links"],
    "header": ["header", "masthead", "logo", "branding", "banner", "top", "site"],
    "footer": ["footer", "bottom", "copyright", "legal", "colophon", "imprint"],
    "sidebar": ["sidebar", "aside", "widget", "related", "recommended", "trending", "popular", "rail", "secondary", "teaser", "more"],
    "notice": ["cookie", "cookies", "notice", "consent", "gdpr", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "paywall", "message", "disclaimer"],
    "advert": ["ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "outbrain", "commercial"],
    "form": ["form", "search", "login", "signup", "register", "contact", "field", "input"],
    "comments": ["comment", "comments", "reply", "replies", "disqus", "discussion", "responses", "respond", "thread", "reader", "feedback"],
    "share": ["share", "social", "tags", "meta", "toolbar", "buttons", "follow"],
}
#: What such parts say, one phrase after the other: fixed values.
SAID = {
    "menu": ["Home", "About us", "News", "Contact", "Archive", "Next page", "Previous page", "Sitemap", "Categories", "Skip to content"],
    "header": ["Welcome to", "Daily", "Magazine", "Official website"],
    "footer": ["© 2024", "All rights reserved", "Privacy policy", "Terms of use", "Imprint", "Copyright", "Powered by"],
    "sidebar": ["Related articles", "Most read", "Popular posts", "See also", "Recommended for you", "Trending now", "Read more"],
    "notice": ["We use cookies", "Accept all", "Subscribe to our newsletter", "This site uses cookies", "Continue reading", "Sign in to continue"],
    "advert": ["Advertisement", "Sponsored", "Buy now", "Special offer", "Free shipping", "Limited discount"],
    "form": ["Name", "Email address", "Submit", "Search", "Password", "Log in", "Register"],
    "comments": ["Reply", "says:", "wrote:", "Leave a comment", "Report abuse", "Log in to comment"],
    "share": ["Share this", "Tweet", "Follow us", "Tags:", "Facebook", "Print this"],
}
#: Headings after which everything, prose too, belongs to no article.
AFTERWARDS = ["Comments", "Reader comments", "Discussion", "Related articles", "Most read", "Recommended for you", "More news", "Responses"]
SEMANTIC = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}


class _Writer:
    """Pages in random layouts, with the label of every block."""

    def __init__(self, rng: np.random.Generator):
        self.rng, self.signs = rng, []  # signs that this page puts after its words

    def pick(self, items):
        return items[int(self.rng.integers(len(items)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, low: int, high: int) -> str:
        n, letters = int(self.rng.integers(low, high + 1)), "abcdefghilmnoprstuvéüñç"
        ends = np.cumsum(self.rng.integers(1, 9, n)).tolist()
        drawn = "".join(letters[i] for i in self.rng.integers(0, len(letters), ends[-1] if n else 0).tolist())
        said = (drawn[i:j] for i, j in zip([0, *ends], ends, strict=False))
        return " ".join(w + (self.pick(self.signs) if self.signs else "") for w in said)

    def sentence(self, low: int = 1, high: int = 40) -> str:
        return self.words(low, high).capitalize() + "."

    def named(self, tag: str, names: list[str], p: float = 1.0) -> tuple[str, str]:
        if not self.chance(p):
            return f"<{tag}>", f"</{tag}>"
        name = self.pick(names)
        if self.chance(0.5):
            name += self.pick(["-", "_", " "]) + self.pick([*names, "box", "wrap", "inner", "container", "list", "item", "area", "block"])
        return f'<{tag} {self.pick(["class", "class", "id"])}="{name}">', f"</{tag}>"

    def block(self, tag: str, text: str, label: int, closed: float = 1.0) -> tuple[str, list[int]]:
        if self.chance(0.15):
            text = f'<{self.pick(["b", "em", "strong", "span", "i"])}>' + text + ("<br>" if self.chance(0.5) else "")
        if self.chance(0.1):
            text += f' <a href="/x">{self.words(1, 3)}</a>'
        return f"<{tag}>{text}" + (f"</{tag}>" if self.chance(closed) else ""), [label]

    def boilerplate(self, kind: str) -> tuple[str, list[int]]:
        tag = SEMANTIC[kind] if kind in SEMANTIC and self.chance(0.5) else self.pick(["div", "div", "section", "ul" if kind == "menu" else "aside"])
        start, end = self.named(tag, BOILERPLATE[kind], 0.25 if tag in ("nav", "footer", "form", "aside") or (tag == "header") else 1.0)
        if kind not in ("menu", "comments", "form") and self.chance(0.35):  # text right inside
            text = (self.phrase(kind) + " " if self.chance(0.5) else "") + self.sentence(1, 20)
            return start + text + end, [0]
        listed = tag != "ul" and self.chance({"menu": 0.7, "sidebar": 0.4, "share": 0.4, "footer": 0.3, "comments": 0.3}.get(kind, 0.0))
        if listed:
            start, end = start + self.pick(["<ul>", "<ul>", "<ol>"]), "</ul>" + end
        out, labels = [start], []
        prose = kind in ("comments", "advert", "sidebar", "notice", "footer", "header")
        for _ in range(int(self.rng.integers(1, 9 if kind in ("menu", "comments", "sidebar") else 4))):
            text = self.phrase(kind) if self.chance(0.35) else self.sentence(1, 30) if prose else self.words(1, 3)
            if self.chance(0.25):
                text = text.rstrip(".") + self.pick([".", ".", ",", "!"])
            if kind in ("menu", "share") or (kind in ("sidebar", "footer") and self.chance(0.4)):
                text = f'<a href="/y">{text}</a>'
            inner = "li" if tag == "ul" or listed or self.chance(0.2) else self.pick(["p", "div", "h3", "li", "section"])
            out.append(f"<{inner}>{text}</{inner}>")
            labels.append(0)
        return "".join(out) + end, labels

    def phrase(self, kind: str) -> str:
        return " ".join(x for x in (self.words(0, 2), self.pick(SAID[kind]), self.words(0, 3)) if x)

    def plain_page(self) -> tuple[str, list[int]]:
        """A page whose blocks all stand in equal elements without names."""
        tag, out, labels = self.pick(["p", "p", "div", "td"]), [f"<html><head><title>{self.sentence(1, 8)}</title></head><body>"], [0]
        out.append("".join(self.pick(["<div>", "<section>", "<center>", "<table><tr><td>"]) for _ in range(int(self.rng.integers(0, 4)))))

        def add(text: str, label: int) -> None:
            out.append(f"<{tag}>" + (f'<a href="/z">{text}</a>' if self.chance(0.5 if label == 0 else 0.03) else text) + f"</{tag}>")
            labels.append(label)

        kinds = [*SAID]
        for _ in range(int(self.rng.integers(0, 7))):
            add(self.phrase(self.pick(["menu", "header", "notice", "form", "advert"])), 0)
        for _ in range(int(self.rng.choice([1, 2, 3, 5, 8, 14]))):
            add(self.sentence(1, self.pick([3, 10, 60])), 1)
            if self.chance(0.12):
                add(self.phrase(self.pick(kinds)), 0)
        if self.chance(0.6):
            add(self.pick(AFTERWARDS), 0)
            for _ in range(int(self.rng.integers(1, 8))):
                add(self.sentence(1, self.pick([3, 10, 60])) if self.chance(0.8) else self.phrase("comments"), 0)
        for _ in range(int(self.rng.integers(0, 5))):
            add(self.phrase(self.pick(["footer", "footer", "share", "menu"])), 0)
        return "".join(out), labels

    def page(self) -> tuple[str, list[int]]:
        self.signs = self.pick([["###", "&&&", "***", "%"], [" |"], ["", "", "", ".", ","]]) if self.chance(0.3) else []
        if self.chance(PLAIN_PAGES):
            return self.plain_page()
        out, labels = [f"<!DOCTYPE html><html><head><title>{self.sentence(1, 8)}</title><style>p{{}}</style></head><body>"], [0]

        def add(piece: tuple[str, list[int]]) -> None:
            out.append(piece[0])
            labels.extend(piece[1])

        around = [*BOILERPLATE]
        if self.chance(0.3):
            out.append(self.named("div", ["page", "wrapper", "container", "site", "outer", "main"])[0])
        for kind in ("header", "menu", "notice", "advert", "form", "share", "sidebar"):
            if self.chance({"header": 0.5, "menu": 0.8}.get(kind, 0.35)):
                if kind != "header" and self.chance(0.1):
                    out.append("<br>")
                if kind == "advert" and self.chance(0.3):
                    add((f'<div class="ad">{self.sentence()}</div>', [0]))
                else:
                    add(self.boilerplate(kind))
        form = self.rng.random()
        if form < 0.5:
            start, end = self.named("article", BODY, 0.3)
        elif form < 0.7:
            start, end = self.named("main", BODY, 0.4)
        else:
            start, end = self.named(self.pick(["div", "section", "td"]), BODY)
        if self.chance(0.2):
            more, less = self.named("div", BODY)
            start, end = start + more, less + end
        out.append(start)
        if self.chance(0.85):
            heading = self.block(self.pick(["h1", "h1", "h2"]), self.sentence(1, 10), 1)
            add((f"<header>{heading[0]}</header>", heading[1]) if self.chance(0.15) else heading)
        for _ in range(int(self.rng.choice([1, 2, 3, 5, 8, 14]))):
            tag = self.pick(["p", "p", "p", "p", "p", "p", "h2", "h3", "li", "blockquote", "pre", "figcaption", "td", "div"])
            if tag == "li":
                items = [self.block("li", self.sentence(1, 15), 1) for _ in range(int(self.rng.integers(1, 5)))]
                add(("<ul>" + "".join(i[0] for i in items) + "</ul>", [1] * len(items)))
            elif tag == "td":
                cells = [self.block("td", self.words(1, 4), 1) for _ in range(int(self.rng.integers(1, 5)))]
                add(("<table><tr>" + "".join(c[0] for c in cells) + "</tr></table>", [1] * len(cells)))
            else:
                # what a named article says is its text, be it a phrase that elsewhere is none
                text = self.phrase(self.pick([*SAID])) if self.chance(0.08) else self.sentence(1, self.pick([2, 10, 60]))
                add(self.block(tag, text, 1, 0.85 if tag == "p" else 1.0))
            if self.chance(0.08):
                add(self.boilerplate(self.pick(["advert", "share", "sidebar", "notice", "form"])))
        if self.chance(0.15):
            add(self.boilerplate("comments"))
        out.append(end)
        for kind in ("share", "comments", "sidebar", "advert", "form", "menu", "footer"):
            if self.chance({"footer": 0.8, "comments": 0.4}.get(kind, 0.25)) and kind in around:
                add(self.boilerplate(kind))
        return "".join(out) + ("</body></html>" if self.chance(0.8) else ""), labels


def training_pages(number: int = TRAINING_PAGES, seed: int = SEED) -> list[tuple[str, list[int]]]:
    """(html, label of each block) of invented pages; a block is 1 if it belongs to the article."""
    writer = _Writer(np.random.default_rng(seed))
    return [writer.page() for _ in range(number)]


def _bucket(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % size


@lru_cache(maxsize=20_000)
def _path_bucket(token: str) -> int:
    return _bucket(token, PATHS)


def page_features(blocks: list[tuple[list[str], str, float]]) -> tuple[np.ndarray, ...]:
    """Path ids and how many each block has, word ids likewise, and numbers of the blocks of one page."""
    paths, words, numbers = [], [], []
    for k, (path, text, links) in enumerate(blocks):
        plain = [w for w in path if w[0] != "."]
        tokens = [*path, *("leaf:" + w for w in plain[-1:]), *("up:" + w for w in plain[-2:-1])]
        said = text.split()
        paths.append([_path_bucket(t) for t in tokens] or [0])
        words.append([_bucket(w, WORDS) for w in sorted({*said})])
        n = len(text)
        numbers.append((np.log1p(n) / 6, links, len(said) / (n + 1) * 4, text[-1:] in ".!?…", k / (len(blocks)), 1 / (1 + len(blocks) - k)))
    flat = [x for own in (paths, words) for x in (np.fromiter((i for ids in own for i in ids), np.int64), np.array([len(ids) for ids in own], np.int64))]
    return (*flat, np.array(numbers, np.float32).reshape(-1, NUMBERS))


class Features:
    """Blocks of some pages, joined from each page's features."""

    def __init__(self, pages: list[tuple[np.ndarray, ...]]):
        self.path, path_sizes, self.word, word_sizes, self.numbers = (np.concatenate(x) for x in zip(*pages, strict=True))
        self.path_at, self.word_at = (np.concatenate([[0], np.cumsum(x)]) for x in (path_sizes, word_sizes))
        self.sizes = [len(p[4]) for p in pages]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Weights of the network; all arithmetic is numpy."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = PATH_DIM + WORD_DIM + NUMBERS
        w = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"path": 0.3 * rng.standard_normal((PATHS, PATH_DIM)).astype(np.float32), "word": np.zeros((WORDS, WORD_DIM), np.float32)}
        for d in "fb":
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p |= {f"{d}x": w(size, 4 * HIDDEN), f"{d}h": w(HIDDEN, 4 * HIDDEN), f"{d}b": bias}
        self.p |= {"out": w(2 * HIDDEN, 1), "bias": np.zeros(1, np.float32)}

    def _inputs(self, f: Features) -> np.ndarray:
        path = np.add.reduceat(self.p["path"][f.path], f.path_at[:-1], axis=0) / np.sqrt(np.diff(f.path_at))[:, None]
        word = np.add.reduceat(self.p["word"][f.word], f.word_at[:-1], axis=0) / np.sqrt(np.diff(f.word_at))[:, None]
        return np.concatenate([path, word, f.numbers], 1).astype(np.float32)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps, rows, HIDDEN) of one direction, in the order of ``x``."""
        steps, rows, _ = x.shape
        gates_x = x @ self.p[d + "x"] + self.p[d + "b"]
        h, c = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32)
        out = np.zeros((steps, rows, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = gates_x[t] + h @ self.p[d + "h"]
            i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
            u = np.tanh(g[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c_new = f * c + i * u
            tc = np.tanh(c_new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, u, tc))
            h, c = np.where(m, o * tc, h), np.where(m, c_new, c)
            out[t] = h
        return out

    @staticmethod
    def _padded(x: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        steps = max(sizes)
        where = np.concatenate([np.arange(n) * len(sizes) + r for r, n in enumerate(sizes)])
        full = np.zeros((steps * len(sizes), x.shape[1]), np.float32)
        full[where] = x
        mask = np.zeros(steps * len(sizes), bool)
        mask[where] = True
        return full.reshape(steps, len(sizes), -1), mask.reshape(steps, len(sizes)), where

    def predict(self, pages: list[list]) -> list[np.ndarray]:
        """Probability of each block of each page that it belongs to the article."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            group, cells = [], 0
            while at < len(order) and (not group or (len(group) < 512 and (len(group) + 1) * len(pages[order[at]]) < 60_000)):
                group.append(order[at])
                at += 1
            f = Features([page_features(pages[k]) for k in group])
            x = self._inputs(f)
            padded, mask, where = self._padded(x, f.sizes)
            h = np.concatenate([self._run("f", padded, mask), self._run("b", padded, mask)], 2).reshape(-1, 2 * HIDDEN)[where]
            said = _sigmoid(h @ self.p["out"] + self.p["bias"])[:, 0]
            for k, part in zip(group, np.split(said, np.cumsum(f.sizes)[:-1]), strict=True):
                out[k] = part
        return out

    def _gradients(self, f: Features, y: np.ndarray) -> dict[str, np.ndarray]:
        x = self._inputs(f)
        padded, mask, where = self._padded(x, f.sizes)
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self._run(d, padded, mask, kept[d]) for d in "fb"], 2)
        flat = h.reshape(-1, 2 * HIDDEN)[where]
        err = ((_sigmoid(flat @ self.p["out"] + self.p["bias"])[:, 0] - y) / len(y))[:, None].astype(np.float32)
        g = {"out": flat.T @ err, "bias": err.sum(0)}
        dx = np.zeros_like(x)
        dh_all = np.zeros((h.shape[0] * h.shape[1], 2 * HIDDEN), np.float32)
        dh_all[where] = err @ self.p["out"].T
        dh_all = dh_all.reshape(h.shape)
        for n, d in enumerate("fb"):
            wh, wx = self.p[d + "h"], self.p[d + "x"]
            dgates = np.zeros((*padded.shape[:2], 4 * HIDDEN), np.float32)
            g[d + "h"] = np.zeros_like(wh)
            dh, dc = np.zeros_like(h[0][:, :HIDDEN]), np.zeros_like(h[0][:, :HIDDEN])
            for t, h0, c0, i, fg, o, u, tc in reversed(kept[d]):
                m = mask[t][:, None]
                dh = dh + dh_all[t][:, n * HIDDEN : (n + 1) * HIDDEN]
                dcn = dc + dh * o * (1 - tc * tc)
                gate = np.concatenate([dcn * u * i * (1 - i), dcn * c0 * fg * (1 - fg), dh * tc * o * (1 - o), dcn * i * (1 - u * u)], 1) * m
                dgates[t] = gate
                g[d + "h"] += h0.T @ gate
                dh, dc = np.where(m, gate @ wh.T, dh), np.where(m, dcn * fg, dc)
            g[d + "b"] = dgates.sum((0, 1))
            g[d + "x"] = padded.reshape(-1, padded.shape[2]).T @ dgates.reshape(-1, 4 * HIDDEN)
            dx = dx + (dgates @ wx.T).reshape(-1, padded.shape[2])[where]
        for name, ids, at, low, high in (("path", f.path, f.path_at, 0, PATH_DIM), ("word", f.word, f.word_at, PATH_DIM, PATH_DIM + WORD_DIM)):
            sizes = np.diff(at)
            shares = np.repeat(dx[:, low:high] / np.sqrt(sizes)[:, None], sizes, axis=0)
            g[name] = np.stack([np.bincount(ids, column, len(self.p[name])) for column in shares.T], 1).astype(np.float32)
        return g

    @classmethod
    def train(cls, pages: list[tuple[str, list[int]]] | None = None, epochs: int = EPOCHS, seed: int = SEED) -> BlockLabeller:
        """A labeller fitted by Adam; pages whose blocks and labels differ in number are an error."""
        model, rng = cls(seed), np.random.default_rng(seed)
        data = [(leaf_blocks(p), y) for p, y in (training_pages() if pages is None else pages)]
        for blocks, y in data:
            if len(blocks) != len(y):
                raise ValueError(f"{len(blocks)} blocks and {len(y)} labels")
        features, labels = [page_features(blocks) for blocks, _ in data], [np.array(y, np.float32) for _, y in data]
        seen = np.zeros(WORDS, np.int64)
        for f in features:
            seen[np.unique(f[2])] += 1
        rare = seen < SEEN_PAGES
        first = {k: np.zeros_like(v) for k, v in model.p.items()}
        second = {k: np.zeros_like(v) for k, v in model.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(data))
            # pages of like length together, in stretches, so that few steps are padding
            order = np.concatenate([part[np.argsort([len(labels[k]) for k in part], kind="stable")] for part in np.array_split(order, max(1, len(order) // (10 * BATCH)))])
            batches = [order[at : at + BATCH] for at in range(0, len(order), BATCH)]
            for n in rng.permutation(len(batches)):
                part = batches[n]
                g = model._gradients(Features([features[k] for k in part]), np.concatenate([labels[k] for k in part]))
                g["word"][rare] = 0
                step += 1
                rate = RATE * 0.5 * (1 + np.cos(np.pi * step * BATCH / (epochs * len(data))))
                for k, v in g.items():
                    v = np.clip(v, -1, 1)
                    first[k] += 0.1 * (v - first[k])
                    second[k] += 0.01 * (v * v - second[k])
                    model.p[k] -= np.float32(rate) * (first[k] / np.float32(1 - 0.9**step)) / (np.sqrt(second[k] / np.float32(1 - 0.99**step)) + 1e-6)
        return model


@lru_cache(maxsize=1)
def trained() -> BlockLabeller:
    """The labeller of this module's training pages, fitted once in a process."""
    return BlockLabeller.train()


def extract_text(pages: DataFrame, model: BlockLabeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Blocks of the article stand on lines of their own, in page order. Null or empty html, and a page
    without an article, have an empty text. Very long pages are read whole, in time that grows with
    their length. No result depends on another row, so there are no ties; repeated rows repeat; an
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches):
        model = shared.value
        for batch in batches:
            texts: list[str] = []
            source = batch.column(2)
            for at in range(0, len(source), 256):
                blocks = [leaf_blocks(p.as_py() or "") for p in source[at : at + 256]]
                texts += ["\n".join(t for (_, t, _), p in zip(b, said, strict=True) if p >= 0.5) for b, said in zip(blocks, model.predict(blocks), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``; odd rows as in ``extract_text``."""
    return extract_text(table(spark, sf_dir, "pages"))
