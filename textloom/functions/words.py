"""Token predicates and text patterns as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters that make an array element a word, by language.
LETTERS = {"de": "[a-zA-ZäÄÜüÖöß]", "en": "[a-zA-Z]"}


def has_letter(word: Column, lang: str = "de") -> Column:
    """Whether a word contains a letter of the language."""
    if lang not in LETTERS:
        raise ValueError(f"no letters known for language {lang!r}")
    return word.rlike(LETTERS[lang])


def all_have_letters(term: Column, lang: str = "de") -> Column:
    """Whether every word of an n-gram contains a letter."""
    return F.forall(term, lambda w: has_letter(w, lang))


def is_stopword(word: Column, stopwords: Iterable[str]) -> Column:
    return F.lower(word).isin(sorted({w.lower() for w in stopwords}))


def edge_stopword(term: Column, stopwords: Iterable[str]) -> Column:
    """Whether the first or the last word of an n-gram is a stop word."""
    words = sorted({w.lower() for w in stopwords})
    return F.lower(F.try_element_at(term, F.lit(1))).isin(words) | F.lower(F.try_element_at(term, F.lit(-1))).isin(words)


def quoted(text: str) -> str:
    """A pattern that matches ``text`` literally."""
    return "".join("\\" + c if not (c.isalnum() or c in "_ ") and c.isascii() else c for c in text)


def term_pattern(words: Iterable[str]) -> str:
    """Pattern of the words in order with anything between."""
    return r"\b" + r"\b.*?\b".join(quoted(w) for w in words) + r"\b"


def java_flags(pattern: str, ignore_case: bool = False, verbose: bool = False) -> str:
    """``pattern`` with Unicode classes and, if asked, Unicode case folding or free spacing."""
    return "(?" + ("iu" if ignore_case else "") + ("x" if verbose else "") + "U)" + pattern


def markdown_to_text(text: Column) -> Column:
    """Plain text of simple markdown.

    Emphasis and links lose their marks, single line breaks become blanks unless a list item
    follows, headings become paragraphs of their own, blank lines are reduced to one.
    """
    star, line = "", ""  # private-use marks for escaped characters
    steps = [
        (r"\\\*", star),
        (r"\\_", line),
        (r"\*{1,2}([^*\n]*)\*{1,2}", "$1"),
        (r"_{1,2}([^_\n]*)_{1,2}", "$1"),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(?m)^[ \t]+|[ \t]+$", ""),
        (r" {2,}", " "),
        (r"(?m)^#+ *(.*)$", "\n\n$1\n\n"),
        (r"(?<!\n)\n(?![\n*+-])", " "),
        (r"\n{3,}", "\n\n"),
        (r" {2,}", " "),
        (star, "*"),
        (line, "_"),
    ]
    out = text
    for pattern, replacement in steps:
        out = F.regexp_replace(out, pattern, replacement)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def keyword_items(content: Column) -> Column:
    """Items of a keyword attribute: split at commas and semicolons, trimmed, no empty ones."""
    return F.filter(F.transform(F.split(content, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def formatted_size(size: Column) -> Column:
    """Bytes in the largest unit below 1024, to two places, up to TB."""
    value = size.cast("double")
    out = F.format_string("%.2f TB", value / float(1024**4))
    for power, unit in reversed(list(enumerate(["B", "KB", "MB", "GB"]))):
        out = F.when(value < float(1024 ** (power + 1)), F.format_string(f"%.2f {unit}", value / float(1024**power))).otherwise(out)
    return out


def chained_source(url: Column, sources: dict[str, str], default: str = "other") -> Column:
    """Name of the first source whose mark the url contains."""
    out = F.lit(default)
    for mark, name in reversed(list(sources.items())):
        out = F.when(F.contains(url, F.lit(mark)), F.lit(name)).otherwise(out)
    return out


Filter = Callable[[Column], Column]
