"""The six languages of the project and the labels that name them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO 639-1 and 639-2 codes and English names.
NAMES = {
    "de": ["de", "deu", "ger", "german"],
    "en": ["en", "eng", "english"],
    "fr": ["fr", "fra", "fre", "french"],
    "tr": ["tr", "tur", "turkish"],
    "es": ["es", "spa", "spanish"],
    "nl": ["nl", "nld", "dut", "dutch"],
}
LANGUAGES = list(NAMES)
#: Labels that say that a text is in no language.
NO_LANGUAGE = ["und", "zxx"]
NONE = "zxx"


def label_language(label: Column) -> Column:
    """Language code that a label names, ``zxx`` for ``und`` and ``zxx``, else null.

    Case, outer white space and a region suffix behind ``-`` or ``_`` are ignored.
    """
    plain = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    plain = F.regexp_extract(plain, r"^(\p{L}+)(?:[-_][\p{L}\p{N}]+)*$", 1)
    known = F.create_map(*[F.lit(x) for code, names in NAMES.items() for name in names for x in (name, code)], *[F.lit(x) for name in NO_LANGUAGE for x in (name, NONE)])
    return F.try_element_at(known, plain)
