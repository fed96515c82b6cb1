"""Leaf text blocks of HTML in page order, with their tag paths."""

from __future__ import annotations

import html
import re

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
# Elements that hold elements of their own and no text of the page.
NESTED = frozenset("svg object template".split())
_NESTED = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|iframe)\b[^>]*>"
    r"|<(?P<end>/?)(?P<tag>svg|object|template)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

# Elements that only mark up words inside a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Opening one of these ends an open one of the same kind below the nearest container.
_SIBLINGS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDS_PARAGRAPH = frozenset("div section article main body td th li aside header footer nav form blockquote".split())


def _nested_ends(page: str) -> dict[int, int]:
    """Where every ``NESTED`` element of the page that has an end tag of its own begins and ends."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {tag: [] for tag in NESTED}
    unclosed: set[str] = set()  # raw elements without an end tag in the rest of the page
    at = 0
    while m := _NESTED.search(page, at):
        at = m.end()
        if m["raw"] and (raw := m["raw"].lower()) not in unclosed:
            if end := re.compile(rf"</{raw}\s*>", re.I).search(page, at):
                at = end.end()
            else:
                unclosed.add(raw)
        elif m["tag"]:
            starts = opened[m["tag"].lower()]
            if not m["end"]:
                if not m[0].endswith("/>"):
                    starts.append(m.start())
            elif starts:
                ends[starts.pop()] = at
    return ends


def blocks(page: str) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, tag path with whole class, id and role names, characters inside links) of every block with text.

    Character references are decoded, white space inside a block is one space. Scripts, styles,
    comments and other raw elements have no blocks; an svg, object or template that is not closed is only
    its tag. Markup may be cut off anywhere.
    """
    found: list[tuple[str, tuple[str, ...], int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = depth = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                found.append((text, tuple(word for _, names in stack for word in names), linked))
            parts.clear()
        linked = 0

    nested: dict[int, int] | None = None
    tokens = _TOKEN.finditer(page)
    while (m := next(tokens, None)) is not None:
        text = m["text"]
        if text is not None:
            parts.append(text)
            if depth:
                linked += len(text)
            continue
        tag = m["tag"]
        if tag is None:
            if m["raw"]:
                flush()
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                depth = max(0, depth + (-1 if m["end"] else 1))
            continue
        flush()
        if tag in VOID:
            continue
        if tag in NESTED:
            if not m["end"]:
                nested = _nested_ends(page) if nested is None else nested
                if m.start() in nested:
                    tokens = _TOKEN.finditer(page, nested[m.start()])
            continue
        if m["end"]:
            depth = 0
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == tag:
                    del stack[at:]
                    break
            continue
        if tag in _SIBLINGS:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] in _SIBLINGS[tag]:
                    del stack[at:]
                    break
                if stack[at][0] in _HOLDS_PARAGRAPH or stack[at][0] in ("ul", "ol", "table", "dl"):
                    break
        elif stack and stack[-1][0] == "p":  # a block element ends an open paragraph
            stack.pop()
        rest = m["rest"]
        names = [tag]
        if rest and "=" in rest:
            for pieces in _NAMES.findall(rest):
                names += [f"@{name}" for name in "".join(pieces).lower().split()]
        stack.append((tag, tuple(names)))
    flush()
    return found
