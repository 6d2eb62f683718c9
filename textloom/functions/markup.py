"""Values in HTML markup as columns, and the main text of a page."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_META = r"(?is)<meta\b[^>]*>"


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in a tag, quoted or bare; null if there is none."""
    double = F.regexp_extract(tag, rf'(?is)\s{name}\s*=\s*"([^"]*)"', 1)
    single = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*'([^']*)'", 1)
    bare = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*([^\s\"'>]+)", 1)
    return F.nullif(F.concat(double, F.when(double == "", single).otherwise(""), F.when((double == "") & (single == ""), bare).otherwise("")), F.lit(""))


def meta_map(markup: Column, labels: list[str] | None = None) -> Column:
    """Map of the page's meta elements: name, else property, to content; of equal names the last counts."""
    tags = F.regexp_extract_all(F.coalesce(markup, F.lit("")), F.lit(_META), F.lit(0))
    entries = F.transform(tags, lambda t: F.struct(F.coalesce(_attribute(t, "name"), _attribute(t, "property")).alias("key"), _attribute(t, "content").alias("value")))
    entries = F.filter(entries, lambda e: e["key"].isNotNull() & (e["key"].isin(labels) if labels is not None else F.lit(True)))

    def last_of_each(found: Column) -> Column:
        later = lambda i: F.slice(found, i + 2, F.greatest(F.size(found), F.lit(1)))
        return F.map_from_entries(F.filter(found, lambda e, i: ~F.exists(later(i), lambda x: x["key"] == e["key"])))

    # as the variable of a function the entries are found once, not once an entry
    return F.get(F.transform(F.array(entries), last_of_each), F.lit(0))


def first_element_text(markup: Column, name: str) -> Column:
    """Text of the first element of a name, tags removed, trimmed; null if there is none."""
    inner = F.regexp_extract(F.coalesce(markup, F.lit("")), rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>", 1)
    plain = F.trim(F.regexp_replace(F.regexp_replace(inner, "<[^>]*>", ""), r"(?U)^\s+|\s+$", ""))
    return F.nullif(plain, F.lit(""))


def image_links(markup: Column) -> Column:
    """Sources of the images of a page in order; images without source are left out."""
    tags = F.regexp_extract_all(F.coalesce(markup, F.lit("")), F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))
    return F.filter(F.transform(tags, lambda t: _attribute(t, "src")), lambda x: x.isNotNull())


def meta_keywords(markup: Column, name: str = "keywords") -> Column:
    """Items of ``meta[name=...]`` (``keywords`` or ``news_keywords``); no items where it is missing."""
    from .words import keyword_items

    content = F.try_element_at(meta_map(markup, [name]), F.lit(name))
    return F.coalesce(keyword_items(content), F.array().cast("array<string>"))


def tag_keywords(markup: Column) -> Column:
    """Contents of the ``article:tag`` properties without quotes around."""
    tags = F.regexp_extract_all(F.coalesce(markup, F.lit("")), F.lit(_META), F.lit(0))
    mine = F.filter(tags, lambda t: F.regexp_replace(F.coalesce(_attribute(t, "property"), F.lit("")), r'[\\"]|&quot;', "") == "article:tag")
    return F.filter(F.transform(mine, lambda t: F.regexp_replace(_attribute(t, "content"), r'^(?:\\?"|&quot;)+|(?:\\?"|&quot;)+$', "")), lambda x: x.isNotNull())


#: German names of the months.
MONTHS = ["januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"]


def page_date(markup: Column) -> Column:
    """Date of a page: from its metadata, structured data or ``time`` elements, else the first day
    that its text names (``dd.mm.yyyy`` or ``dd. Monat yyyy``); null without any."""
    named = meta_map(markup, ["date", "article:published_time", "dc.date", "og:published_time", "last-modified"])
    first = F.coalesce(*[F.try_element_at(named, F.lit(k)) for k in ("date", "article:published_time", "dc.date", "og:published_time", "last-modified")])
    timed = F.nullif(F.regexp_extract(F.coalesce(markup, F.lit("")), r"(?is)<time\b[^>]*datetime\s*=\s*[\"'](\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    content = F.coalesce(markup, F.lit(""))
    structured = F.nullif(F.regexp_extract(content, r'(?is)"date(?:Published|Modified|Created)"\s*:\s*"(\d{4}-\d{2}-\d{2})', 1), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(content, r"(?is)<(script|style|head)\b.*?</\1\s*>", " "), "<[^>]*>", " ")
    named_day = r"(?iU)\b(\d{1,2})\.\s*(?:(\d{1,2})\.|(" + "|".join(MONTHS) + r"))\s*(\d{4})\b"
    day, month, name, year = (F.regexp_extract(text, named_day, k) for k in (1, 2, 3, 4))
    number = F.when(name != "", F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(name)).cast("string")).otherwise(month)
    written = F.when(day != "", F.concat_ws("-", year, F.lpad(number, 2, "0"), F.lpad(day, 2, "0")))
    iso = F.regexp_extract(F.coalesce(first, structured, timed), r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(F.try_to_date(iso, "yyyy-MM-dd"), F.try_to_date(written, "yyyy-MM-dd"))


def in_february(date: Column) -> Column:
    """Whether a date lies in the 1st to 28th of February 2020 to 2025; no date does not."""
    return F.coalesce((F.year(date).between(2020, 2025)) & (F.month(date) == 2) & (F.dayofmonth(date) <= 28), F.lit(False))


def update_in_february(markup: Column) -> Column:
    """The same of a ``span`` whose id holds ``last_update`` (``dd. Month yyyy``, German); where
    it has another form than three words, the page's date counts."""
    text = F.regexp_extract(F.coalesce(markup, F.lit("")), r"(?is)<span\b[^>]*id\s*=\s*[\"'][^\"']*last_update[^\"']*[\"'][^>]*>(.*?)</span", 1)
    plain = F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), r"\.", "")
    there = F.coalesce(markup.rlike(r"(?is)<span\b[^>]*id\s*=\s*[\"'][^\"']*last_update"), F.lit(False))
    other = there & (F.size(F.split(plain, " ")) != 3)
    return F.when(other, in_february(page_date(markup))).otherwise(plain.rlike(r"^(0[1-9]|1\d|2[0-8]) Februar 202[0-5]$"))


_KEPT = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote", "pre", "dt", "dd"}
_SKIPPED = {"script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form", "button", "figure", "head", "svg", "iframe"}
_HOLDERS = {"div", "section", "article", "main", "body", "td", "th"}
#: Further elements that end a block of text.
_ENDS = {"table", "tbody", "thead", "tr", "ul", "ol", "dl", "hr"}
#: Loose text is a paragraph if it has so many characters and a sentence end.
_LEAST_TEXT = 30
_SENTENCE_END = re.compile(r"[.!?…][\"“”«»')\]]*(?:\s|$)")


class _Block(NamedTuple):
    holder: int
    name: str
    text: str
    linked: int
    loose: bool

    @property
    def paragraph(self) -> bool:
        """A paragraph element, or loose text that is unlinked prose."""
        if self.name not in ("p", "blockquote", "pre"):
            return False
        return not self.loose or (len(self.text) >= _LEAST_TEXT and 2 * self.linked <= len(self.text) and bool(_SENTENCE_END.search(self.text)))


class _Reader(HTMLParser):
    """Blocks of a page with the innermost holder that they stand in; text straight in a holder is a block too."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.heading_meta = "", ""
        self.found: list[_Block] = []
        self.parents = {0: 0}
        self.inner: set[int] = set()  # holders that hold others
        self._holders, self._skip = [0], []
        self._open: str | None = None
        self._text: list[str] = []
        self._linked, self._in_link, self._in_title = 0, False, False

    def end(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.found.append(_Block(self._holders[-1], self._open or "p", text, self._linked, self._open is None))
        self._open, self._text, self._linked, self._in_link = None, [], 0, False

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self._in_title = True
        if tag == "meta":
            given = dict(attrs)
            if (given.get("property") or given.get("name")) == "og:title" and given.get("content"):
                self.heading_meta = given["content"]
        if tag in _SKIPPED:
            self.end()
            self._skip.append(tag)
        elif self._skip:
            return
        elif tag in _HOLDERS:
            self.end()
            number = len(self.parents)
            self.parents[number] = self._holders[-1]
            self.inner.add(self._holders[-1])
            self._holders.append(number)
        elif tag in _KEPT:
            self.end()
            self._open = tag
        elif tag in _ENDS or (tag == "br" and not self._open):
            self.end()
        elif tag == "a":
            self._in_link = True
        elif tag == "br":
            self._text.append(" ")

    def handle_endtag(self, tag):
        if tag == "title":
            self._in_title = False
        if self._skip:
            if tag in self._skip:
                while self._skip.pop() != tag:
                    pass
        elif tag in _HOLDERS:
            self.end()
            if len(self._holders) > 1:
                self._holders.pop()
        elif tag in _KEPT or tag in _ENDS:
            self.end()
        elif tag == "a":
            self._in_link = False

    def handle_data(self, data):
        if self._in_title:
            self.title += data
        elif not self._skip:
            self._text.append(data)
            if self._in_link:
                self._linked += len(data.strip())


def main_elements(page: str | None, heading: bool = True) -> list[tuple[str, str]]:
    """Elements ``(name, text)`` of the holder with most running text.

    A holder with nothing but one text is a paragraph of the holder around it, so pages that
    are laid out with ``div`` or table cells count like those with ``p``. Of the holder the
    blocks from the first to the last paragraph are kept, with a heading before them and a list
    behind them; what is mostly linked, or loose text without a sentence, is not. Where the
    first is no heading, one from the page's title data is put before it. Empty if the page
    has no paragraph.
    """
    if not page:
        return []
    reader = _Reader()
    reader.feed(page)
    reader.close()
    reader.end()
    number = Counter(b.holder for b in reader.found)
    found = []
    for b in reader.found:
        alone = b.loose and number[b.holder] == 1 and b.holder not in reader.inner
        found.append(b._replace(holder=reader.parents[b.holder]) if alone else b)
    weight: dict[int, int] = {}
    for b in found:
        if b.paragraph:
            weight[b.holder] = weight.get(b.holder, 0) + max(0, len(b.text) - 2 * b.linked)
    if not weight or max(weight.values()) <= 0:
        return []
    best = min(weight, key=lambda h: (-weight[h], h))
    mine = [b for b in found if b.holder == best and 2 * b.linked <= len(b.text)]
    at = [k for k, b in enumerate(mine) if b.paragraph]
    first, last = at[0], at[-1]
    while last + 1 < len(mine) and mine[last + 1].name in ("li", "dt", "dd"):
        last += 1
    titled = {" ".join(x.split()) for x in (reader.heading_meta, reader.title) if x}
    before = [b._replace(name="h1") if b.loose else b for b in mine[:first] if b.name in ("h1", "h2", "h3") or b.text in titled][-1:]
    chosen = before + [b for b in mine[first : last + 1] if b.paragraph or not b.loose]
    if heading and not (chosen[0].name[0] == "h" and chosen[0].name[1:].isdigit()):
        title = " ".join((reader.heading_meta or reader.title).split())
        if title:
            return [("h1", title), *((b.name, b.text) for b in chosen)]
    return [(b.name, b.text) for b in chosen]


@F.pandas_udf(StringType())
def main_html(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Main content as simple markup, null where there is none."""
    for batch in pages:
        made = []
        for page in batch:
            found = main_elements(page)
            made.append("<html><body>" + "\n".join(f"<{n}>{html.escape(t, quote=False)}</{n}>" for n, t in found) + "</body></html>" if found else None)
        yield pd.Series(made, dtype=object)


@F.pandas_udf(StringType())
def main_markdown(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Main content as simple markdown, null where there is none."""
    for batch in pages:
        made = []
        for page in batch:
            parts = [("#" * int(n[1]) + " " + t) if n[0] == "h" and n[1:].isdigit() else "- " + t if n == "li" else t for n, t in main_elements(page)]
            made.append("\n\n".join(parts) if parts else None)
        yield pd.Series(made, dtype=object)


def markup_to_text(markup: Column) -> Column:
    """Plain text of simple markup: an element a paragraph, list items with a dash, entities decoded."""
    out = F.regexp_replace(markup, r"(?is)<(script|style|head)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?U)\s+", " ")
    out = F.regexp_replace(out, r"(?i)<li\b[^>]*>", "\n- ")
    out = F.regexp_replace(out, r"(?i)<br\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"(?i)</?(?:p|h[1-6]|div|ul|ol|blockquote|pre|table|tr|section|article|body|html)\b[^>]*>", "\n\n")
    out = F.regexp_replace(out, "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, r" *\n *", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""))
