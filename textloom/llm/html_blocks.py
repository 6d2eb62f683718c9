"""Blocks of an HTML page with their tag paths, in one pass and without a tree library."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

#: Elements that end a block of text; the others are inline.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body button center caption dd details dialog div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav noscript ol option p pre section select summary table tbody td
    textarea tfoot th thead title tr ul""".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An open element of the first kind ends where one of the second begins.
_ENDED_BY = {
    "p": BLOCK_TAGS,
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
    "tr": {"tr"},
    "option": {"option"},
}
_SCOPE = {"li": {"ul", "ol", "menu"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}}

_DROPPED = re.compile(r"<!--.*?(?:-->|$)|<(script|style|template|svg|iframe|head)\b[^>]*>.*?(?:</\1\s*>|$)|<![^>]*>|<\?[^>]*>", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'<])*)/?>")
_NAME = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_SENTENCE = re.compile(r"[.!?…][\"“”«»')\]]*(?=\s|$)")
_WORDISH = re.compile(r"[^\W_]+")


class Block(NamedTuple):
    order: int
    path: str
    text: str
    link_chars: int


def block_key(text: str) -> str:
    """The text's letters and digits, cut to the first 48."""
    return "".join(_WORDISH.findall(text))[:48]


def sentence_ends(text: str) -> int:
    return len(_SENTENCE.findall(text))


def _signature(tag: str, attributes: str) -> str:
    """The tag with its first class, id or role."""
    named = {}
    for name, value in _NAME.findall(attributes):
        named.setdefault(name.lower(), value.strip("\"'").split(" ")[0])
    for name, mark in (("id", "#"), ("class", "."), ("role", "@")):
        if named.get(name):
            return f"{tag}{mark}{named[name]}"
    return tag


def blocks(page: str | None) -> list[Block]:
    """Non-empty blocks in order: text between block-level tags or ``<br>``, entities decoded.

    Comments, head, scripts and styles are left out. The path names the block-level ancestors
    from the root; cells carry their number in the row. Unclosed and stray tags are met by
    the usual rules (a new item ends the open one, an end tag closes what stands above it,
    unmatched end tags are passed over).
    """
    if not page:
        return []
    page = _DROPPED.sub(" ", page)
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    cells: list[int] = []
    parts: list[str] = []
    linked = 0
    in_link = 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = html.unescape("".join(parts)).strip()
            if text:
                out.append(Block(len(out), "/".join([s for _, s in stack]), text, linked))
            parts.clear()
        linked = 0

    at = 0
    for match in _TAG.finditer(page):
        start = match.start()
        if start > at:
            piece = page[at:start]
            parts.append(piece)
            if in_link:
                linked += len(piece)
        at = match.end()
        closing, tag, attributes = match.group(1), match.group(2).lower(), match.group(3)
        if tag == "br":
            end_block()
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag in BLOCK_TAGS:
            end_block()
            in_link = 0
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                    if stack[k][0] == "table" and tag not in ("table", "body", "html"):
                        break
            elif tag not in VOID_TAGS:
                for k in range(len(stack) - 1, -1, -1):
                    open_ = stack[k][0]
                    if tag in _ENDED_BY.get(open_, ()):
                        del stack[k:]
                        break
                    if open_ in _SCOPE.get(tag, ()) or tag not in ("li", "td", "th", "tr", "dt", "dd") and open_ != "p":
                        break
                if tag == "tr":
                    cells.append(0)
                signature = _signature(tag, attributes)
                if tag in ("td", "th"):
                    number = cells[-1] if cells else 0
                    if cells:
                        cells[-1] += 1
                    signature = f"{signature}:{number}"
                stack.append((tag, signature))
    if at < len(page):
        parts.append(page[at:])
    end_block()
    return out
