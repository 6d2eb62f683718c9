"""Token counts by the public GPT-2 pre-tokenization pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the public pre-tokenization pattern; (?U) makes \\s cover all white space.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def n_tokens(text: Column) -> Column:
    """Number of tokens of a text; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(PATTERN)), F.lit(0)).cast("long")
