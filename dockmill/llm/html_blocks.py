"""Leaf blocks of a web page: text between block-level tags, with the path of open elements above it.

A page is read once from left to right. Whatever could be looked for in vain from many places (the
end of a tag with open quotes, a closing ``>``) is looked for once a page and remembered, so time
grows with the page's length, however broken its markup is.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter

NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: The rest of a tag, with ``>`` allowed inside quotes; it gives nothing back when it fails.
REST = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>")
SPECIAL = re.compile("[>\"']")
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "iframe")}
#: Images and fallbacks: without text they are a space in their line, with text they are judged as blocks.
FALLBACK = frozenset("svg object canvas noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NO_P = frozenset("article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
ZEROS, HUGE = re.compile("&#0+(?=[0-9])"), re.compile("&#[0-9]{8,};?")
#: A path names the ``OUTER`` outermost and the ``INNER`` innermost open elements, each with ``NAMES`` words: the model's view of a
#: block, whose text is never cut.
OUTER, INNER, NAMES = 6, 10, 8


HTML_TAG, LANG = re.compile(r"<html\b", re.I), re.compile(r"\blang\s*=\s*[\"']?([a-z]+)", re.I)


def declared_language(page: str) -> str:
    """What the first ``lang`` inside an html tag says, empty without one. A part of the page that held none is not read again."""
    at = 0
    while m := HTML_TAG.search(page, at):
        end = page.find(">", m.end())
        at = len(page) if end < 0 else end
        if found := LANG.search(page, m.end(), at):
            return found[1]
    return ""


def unescaped(text: str) -> str:
    """Character references decoded; numbers of any length do no harm."""
    return html.unescape(HUGE.sub("�", ZEROS.sub("&#", text)) if "&#" in text else text)


class _TagEnds:
    """Where tags end in a page in which some tag's quotes don't: all ends at once, from the last sign to the first."""

    def __init__(self, page: str):
        self.at = [m.start() for m in SPECIAL.finditer(page)]
        self.end = [-1] * (len(self.at) + 1)  # of a tag that goes on, outside quotes, at this sign
        later = {">": len(self.at), '"': len(self.at), "'": len(self.at)}
        for k in range(len(self.at) - 1, -1, -1):
            sign = page[self.at[k]]
            self.end[k] = self.at[k] + 1 if sign == ">" else self.end[later[sign] + 1] if later[sign] < len(self.at) else -1
            later[sign] = k

    def of(self, start: int) -> int:
        return self.end[bisect_left(self.at, start)]


def leaf_blocks(page: str) -> list[tuple[list[str], str, float]]:
    """(path, text, share of linked characters) of each block with text, in page order.

    The path has the names of the open elements and the words of their class, id and role. Character
    references are decoded; white space is one space. Unclosed and crossed tags do no harm: a
    closing tag ends the nearest element of its name, or nothing; a ``<`` that starts no tag is text.
    """
    out: list[tuple[list[str], str, float]] = []
    stack: list[tuple[str, list[str]]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    size = linked = in_link = 0
    mute = -1  # depth of the stack below a fallback element that has had no text so far
    ends: _TagEnds | None = None
    last_gt = page.rfind(">")

    def end_block(depth: int) -> None:
        nonlocal size, linked
        if parts:
            text = " ".join(unescaped("".join(parts)).split())
            if text:
                held = stack[:depth] if depth <= OUTER + INNER else [*stack[:OUTER], *stack[depth - INNER : depth]]
                out.append(([w for _, words in held for w in words], text, min(1.0, linked / max(1, size))))
            parts.clear()
        size = linked = 0

    def add(text: str) -> None:
        nonlocal size, linked, mute
        if mute >= 0:
            if not text.strip():
                return
            end_block(mute)
            mute = -1
        parts.append(text)
        size += len(text)
        if in_link:
            linked += len(text)

    def pop_to(depth: int) -> None:
        for name, _ in stack[depth:]:
            opened[name] -= 1
        del stack[depth:]

    def tag_end(start: int) -> int:
        """Past the end of a tag whose name ends at ``start``: by quotes, else at the first ``>``, else -1."""
        nonlocal ends
        if start > last_gt:
            return -1
        if ends is None:
            if m := REST.match(page, start):
                return m.end()
            ends = _TagEnds(page)
        end = ends.of(start)
        return end if end > 0 else page.find(">", start) + 1

    at = text_at = 0
    while (i := page.find("<", at)) >= 0:
        following = page[i + 1 : i + 2]
        m = NAME.match(page, i + 1)
        if m:
            end = tag_end(m.end())
        elif page.startswith("<!--", i):
            end = page.find("-->", i + 4) + 3
            end = len(page) if end < 3 else end
        elif following and following in "!?/":
            end = page.find(">", i) + 1 if i < last_gt else -1
        else:
            at = i + 1
            continue
        if end < 0:  # no tag ends any more: the last one is broken, the others are text
            if page.rfind("<") > i:
                at = i + 1
                continue
            end = len(page)
            m = None
        if i > text_at:
            add(page[text_at:i])
        at = text_at = end
        if not m:
            continue
        closing, name = m[1], m[2].lower()
        if name in RAW and not closing:
            close = RAW[name].search(page, end)
            at = text_at = (page.find(">", close.end()) + 1 or len(page)) if close else len(page)
            if mute < 0:
                parts.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            elif name == "br" and mute < 0:
                parts.append(" ")
            continue
        if name in FALLBACK and not closing and page[end - 2] == "/":
            if mute < 0:
                parts.append(" ")
            continue
        if mute < 0 and not (name in FALLBACK and not closing):
            end_block(len(stack))
        if closing:
            if opened[name] > 0:
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                if mute > depth:  # a fallback that never ended
                    end_block(mute)
                    mute = -1
                pop_to(depth)
                if mute == depth:  # the fallback had no text
                    mute = -1
                    parts.append(" ")
            continue
        if name in FALLBACK:
            mute = len(stack) if mute < 0 else mute
        elif len(stack) - 1 != mute and stack:
            if name in CLOSES and stack[-1][0] in CLOSES[name]:
                pop_to(len(stack) - 1)
            if name in NO_P and stack and stack[-1][0] == "p" and len(stack) - 1 != mute:
                pop_to(len(stack) - 1)
        if name not in VOID:
            attrs = page[m.end() : end - 1]
            words = [w.group().lower() for found in NAMED.finditer(attrs) for w in WORD.finditer(found[1] or found[2] or found[3] or "")] if "=" in attrs else []
            stack.append((name, [name, *("." + w for w in words[:NAMES])]))
            opened[name] += 1
    if text_at < len(page):
        add(page[text_at:])
    end_block(len(stack) if mute < 0 else mute)
    return out
