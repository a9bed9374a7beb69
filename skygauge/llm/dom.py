"""Leaf blocks of HTML pages: runs of text that share a block-level place, with their ancestors."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements whose text is never shown as part of a page.
HIDDEN = frozenset("script style template noscript svg math iframe object textarea select title canvas audio video datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the key ends an open element of the value, up to the nearest of ``_SCOPE``.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody"}, "tfoot": {"tbody"},
}
_SCOPE = frozenset("ul ol dl table body html article section nav aside div main header footer form".split())
#: Comment, declaration, tag with quoted attributes, tag with broken quotes.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-label|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, str], ...]  # (tag, class, id and role in lower case) from the root
    linked: int  # characters inside links


def leaf_blocks(page: str | None) -> list[Block]:
    """Blocks of a page in page order; character references decoded, white space single, empty blocks left out.

    Unclosed, crossed and unknown tags are taken as browsers mostly do: an end tag closes what is
    open inside its element, or nothing. A hidden element without an end hides the rest.
    """
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked, links, place = 0, 0, None
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal parts, linked, place
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, place, linked))
        parts, linked, place = [], 0, None

    while at < size:
        m = _MARKUP.search(page, at)
        end = m.start() if m else size
        if end > at:
            piece = page[at:end]
            if place is None and not piece.isspace():
                place = tuple(stack)
            parts.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] if m[2] else m[6]
        if closing:
            if tag in INLINE:
                if tag == "a":
                    links = max(0, links - 1)
            else:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag in HIDDEN:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = close.end() if close else size
            continue
        if tag == "br":
            parts.append(" ")
        if tag not in INLINE:
            flush()
            links = 0 if tag in _SCOPE else links
            while stack and stack[-1][0] in INLINE:  # formatting left open does not reach into other blocks
                stack.pop()
            if stack and stack[-1][0] == "p":
                stack.pop()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _ENDS.get(tag, ()):
                    del stack[k:]
                    break
                if stack[k][0] in _SCOPE:
                    break
        elif tag == "a":
            links = 1
        if tag not in VOID and not attributes.endswith("/"):
            stack.append((tag, _marks(attributes) if "=" in attributes or "hidden" in attributes else ""))
    flush()
    return out


def _marks(attributes: str) -> str:
    found = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = " ".join(filter(None, values)).lower()
        if name.lower() in ("hidden", "style"):
            if name.lower() == "hidden" or re.search(r"display\s*:\s*none", value):
                found.append("is-hidden")
        else:
            found.append(value)
    return " ".join(found)
