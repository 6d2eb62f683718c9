"""Problem 5: per-document text statistics and the structural kind they tell.

Each document gives three small distributions: over classes of characters, of tokens and
of lines. Function words are token classes of their own. A distribution is compared with
the profile of each kind of text (prose in each language, list, table, junk) by
Jensen-Shannon divergence, and the document gets the kind of the nearest profile.

The profiles are the mean distributions of the documents that plain counts already
settle, summed over all documents; a few bytes a class, whatever the corpus' size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .languages import LANGUAGES

CASE_CHARS = 40

CHARS = ["lower", "upper", "digit", "blank", "line_end", "sentence_end", "comma", "cell", "other"]
#: A function word counts for its language, or as shared where several have it.
TOKENS = [*[f"function_{code}" for code in LANGUAGES], "function_shared", "word", "capital", "number", "mixed", "unspeakable", "symbol", "again"]
LINES = ["sentence", "bullet", "row", "leader", "short", "numbers", "long"]
#: Relative weight of the three comparisons.
WEIGHTS = {"chars": 1.0, "tokens": 4.0, "lines": 1.0}

_CELL = set("|;\t")
_BULLET = re.compile(r"\s*(?:[-*•–—·+]|\(?\d{1,4}[.)]|\(?[a-zA-Z][.)])\s+\S")
_LEADER = re.compile(r"(?:\.{4,}|(?:\. ){4,}|_{4,}|…{2,})\s*\d+\s*$")
_SPLITTERS = [re.compile("\t"), re.compile(r" ?\| ?"), re.compile(";"), re.compile(r" {3,}"), re.compile(",")]
_EDGE = ".,;:!?\"'()[]„“”«»–—-*•…|"
_SENTENCE_END = tuple(".!?…“\"»")
_VOWEL = re.compile("[aeiouyäöüàâáéèêëîïíóôúùûœæıAEIOUYÄÖÜÉ]")


def _char_classes() -> np.ndarray:
    """Class of each character below 0x3000."""
    at = {name: k for k, name in enumerate(CHARS)}
    out = np.full(0x3000, at["other"], dtype=np.uint8)
    for code in range(0x3000):
        c = chr(code)
        if c in "\n\r\x85  ":
            kind = "line_end"
        elif c in _CELL:
            kind = "cell"
        elif c.isspace():
            kind = "blank"
        elif c.isupper():
            kind = "upper"
        elif c.isalpha():
            kind = "lower"
        elif c.isdigit():
            kind = "digit"
        elif c in ".!?":
            kind = "sentence_end"
        elif c == ",":
            kind = "comma"
        else:
            continue
        out[code] = at[kind]
    return out


_CLASSES = _char_classes()
_TOKEN = {name: k for k, name in enumerate(TOKENS)}
_LINE = {name: k for k, name in enumerate(LINES)}
N_FUNCTION = len(LANGUAGES) + 1


def function_classes(words: list[tuple[str, str]]) -> dict[str, int]:
    """Token class of each frequent word, of ``(lang, word)`` pairs."""
    by: dict[str, set[str]] = {}
    for lang, word in words:
        if lang in LANGUAGES and word:
            by.setdefault(word.lower(), set()).add(lang)
    return {word: _TOKEN[f"function_{min(langs)}" if len(langs) == 1 else "function_shared"] for word, langs in by.items()}


def token_class(token: str, function_words: dict[str, int]) -> int:
    """Class of one token (stripped of punctuation at its ends)."""
    core = token.strip(_EDGE)
    if not core:
        return _TOKEN["symbol"]
    function = function_words.get(core.lower())
    if function is not None:
        return function
    letters = sum(map(str.isalpha, core))
    if letters == 0:
        return _TOKEN["number"] if any(map(str.isdigit, core)) else _TOKEN["symbol"]
    if letters < len(core) and (any(map(str.isdigit, core)) or sum(not c.isalnum() and c not in "-'’/.@" for c in core)):
        return _TOKEN["mixed"]
    if letters >= 2 and not _VOWEL.search(core):
        return _TOKEN["unspeakable"]
    if letters >= 7 and len(_VOWEL.findall(core)) * 6 < letters:
        return _TOKEN["unspeakable"]
    return _TOKEN["capital"] if core[0].isupper() else _TOKEN["word"]


def _cells(line: str) -> int:
    best = 1
    for splitter in _SPLITTERS:
        parts = splitter.split(line.strip().rstrip(".;"))
        if len(parts) > best and sum(len(p.split()) for p in parts) <= 3 * len(parts):
            best = len(parts)
    return best


def line_class(line: str) -> int:
    words = line.split()
    if _LEADER.search(line):
        return _LINE["leader"]
    if _BULLET.match(line):
        return _LINE["bullet"]
    if ("\t" in line or "|" in line or ";" in line or "," in line or "   " in line) and _cells(line) >= 2 and not (", " in line and "\t" not in line and "|" not in line and "   " not in line and ";" not in line.strip().rstrip(";")):
        return _LINE["row"]
    if sum(any(map(str.isdigit, w)) for w in words) * 2 > len(words):
        return _LINE["numbers"]
    if len(words) <= 4:
        return _LINE["short"]
    if line.rstrip().endswith(_SENTENCE_END):
        return _LINE["sentence"]
    return _LINE["long"]


def features(text: str, known: dict[str, int], function_words: dict[str, int]) -> tuple[list[int], list[int], list[int], dict[str, float]]:
    """Counts by class of characters, tokens and lines, and further statistics."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    chars = np.bincount(_CLASSES[np.minimum(codes, 0x2FFF)], minlength=len(CHARS)).tolist()
    tokens = text.split()
    classes = []
    for token in tokens:
        kind = known.get(token)
        if kind is None:
            kind = token_class(token, function_words)
            if len(known) < 500_000:
                known[token] = kind
        classes.append(kind)
    again = sum(a == b for a, b in zip(tokens, tokens[1:]))
    counts = Counter(classes)
    by_token = [counts.get(k, 0) for k in range(len(TOKENS))]
    by_token[_TOKEN["again"]] = again
    by_line = [0] * len(LINES)
    widths: Counter = Counter()
    lines = 0
    ended = 0
    for line in text.splitlines():
        if not line or line.isspace():
            continue
        lines += 1
        kind = line_class(line)
        by_line[kind] += 1
        ended += line.rstrip().endswith(_SENTENCE_END)
        if kind == _LINE["row"]:
            widths[_cells(line)] += 1
    n = len(tokens)
    letters = chars[0] + chars[1]
    statistics = {
        "n_chars": len(text),
        "n_words": n,
        "n_lines": lines,
        "mean_word_length": sum(map(len, tokens)) / n if n else 0.0,
        "symbol_ratio": (chars[8] + chars[7]) / max(1, len(text)),
        "digit_ratio": chars[2] / max(1, len(text)),
        "letter_ratio": letters / max(1, len(text)),
        "ended_lines": ended / lines if lines else 0.0,
        "function_share": sum(by_token[:N_FUNCTION]) / n if n else 0.0,
        "distinct_share": len(set(tokens)) / n if n else 0.0,
        "even_rows": max(widths.values(), default=0) / lines if lines else 0.0,
        "commas_a_word": chars[6] / n if n else 0.0,
    }
    return chars, by_token, by_line, statistics


STATISTICS = ["n_chars", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "digit_ratio", "letter_ratio", "ended_lines", "function_share", "distinct_share", "even_rows", "commas_a_word"]


def settled_kind(chars: list[int], tokens: list[int], lines: list[int], statistics: dict[str, float]) -> str | None:
    """Kind and variety of a document where plain counts leave no doubt, else None."""
    n = sum(tokens[:-1])
    odd = tokens[_TOKEN["mixed"]] + tokens[_TOKEN["unspeakable"]] + tokens[_TOKEN["symbol"]]
    spoken = tokens[_TOKEN["word"]] + tokens[_TOKEN["capital"]]
    if not n:
        return "junk/empty"
    if statistics["function_share"] >= 0.15:
        by = tokens[: len(LANGUAGES)]
        case = " upper" if chars[1] > chars[0] else ""
        return f"prose/{LANGUAGES[by.index(max(by))]} {LINES[lines.index(max(lines))]}{case}"
    if statistics["function_share"] > 0.05:
        return None
    case = "capital" if tokens[_TOKEN["capital"]] > tokens[_TOKEN["word"]] else "lower"
    if tokens[_TOKEN["again"]] > 0.6 * n and n > 4:
        return "junk/again"
    if statistics["even_rows"] >= 0.8 and statistics["n_lines"] >= 3:
        return "table/joined" if tokens[_TOKEN["mixed"]] > 0.5 * n else "table/spaced"
    if statistics["n_lines"] >= 2:
        for variety in ("bullet", "leader"):
            if lines[_LINE[variety]] >= 0.8 * statistics["n_lines"]:
                return f"list/{variety} {case}"
    if spoken < 0.1 * n:
        return "junk/unspeakable" if tokens[_TOKEN["unspeakable"]] > 0.5 * n else "junk/numbers"
    if odd > 0.5 * n:
        return "junk/mixed"
    if spoken > 0.9 * n:
        if statistics["n_lines"] >= 2 and lines[_LINE["short"]] >= 0.8 * statistics["n_lines"]:
            return f"list/short {case}"
        if statistics["commas_a_word"] > 0.2:
            return f"list/commas {case}"
    return None


_PARTS = [("chars", len(CHARS)), ("tokens", len(TOKENS)), ("lines", len(LINES))]


def document_features(documents: DataFrame, key: str, text: str, common_words: DataFrame) -> DataFrame:
    """``(key, chars, tokens, lines, settled)`` and the statistics of each document.

    Null texts count as empty ones. ``common_words`` has the frequent words (``lang, word``).
    """
    classes = function_classes([(r.lang, r.word) for r in common_words.select("lang", "word").collect()])
    kind = documents.schema[key].dataType.simpleString()
    wholes = {"n_chars", "n_words", "n_lines"}
    fields = ", ".join([f"key {kind}", *[f"{p} array<int>" for p, _ in _PARTS], "settled string", *[f"{s} {'bigint' if s in wholes else 'double'}" for s in STATISTICS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            rows = []
            for value in batch.column(1):
                chars, tokens, lines, statistics = features(value.as_py() or "", known, classes)
                rows.append((chars, tokens, lines, settled_kind(chars, tokens, lines, statistics), *[statistics[s] for s in STATISTICS]))
            columns = list(zip(*rows)) if rows else [[]] * (4 + len(STATISTICS))
            made = [pa.array(c, pa.list_(pa.int32())) for c in columns[:3]] + [pa.array(columns[3], pa.string())]
            made += [pa.array(c, pa.int64() if s in wholes else pa.float64()) for s, c in zip(STATISTICS, columns[4:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["key", *[p for p, _ in _PARTS], "settled", *STATISTICS])

    return documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, fields)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence (bits) of the rows of p and of q, all with all."""
    a, b = p[:, None, :], q[None, :, :]
    m = (a + b) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(a > 0, a * np.log2(a / m), 0.0).sum(axis=2)
        right = np.where(b > 0, b * np.log2(b / m), 0.0).sum(axis=2)
    return (left + right) / 2


def _shares(column, width: int) -> np.ndarray:
    counts = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def structure_profiles(found: DataFrame) -> dict[str, list[np.ndarray]]:
    """Mean distributions of the settled documents of each kind and variety."""
    shares = []
    for part, width in _PARTS:
        total = F.aggregate(F.col(part), F.lit(0), lambda x, y: x + y)
        shares += [(F.sum(F.try_divide(F.col(part)[k], total)) / F.count("*")).alias(f"{part}_{k}") for k in range(width)]
    rows = found.where(F.col("settled").isNotNull() & (F.col("n_words") > 0)).groupBy("settled").agg(*shares).collect()
    return {r.settled: [np.array([r[f"{part}_{k}"] or 0.0 for k in range(width)]) for part, width in _PARTS] for r in rows}


def text_structure(documents: DataFrame, key: str, text: str, common_words: DataFrame) -> DataFrame:
    """Statistics and structural kind of each document.

    Returns ``key``, the statistics, ``kind`` (``prose``, ``list``, ``table`` or ``junk``),
    ``variety`` and ``divergence``, the weighted divergence from the nearest profile. A text
    without tokens (null and empty ones too) is ``junk``. Equal divergences are decided by
    the profile's name.
    """
    found = cut_lineage(document_features(documents, key, text, common_words))
    profiles = sorted(structure_profiles(found).items())
    names = [name for name, _ in profiles]
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros((batch.num_rows, len(names)))
            for k, (part, width) in enumerate(_PARTS):
                profile = np.stack([p[k] for _, p in profiles])
                total += WEIGHTS[part] * divergence(_shares(batch.column(k + 1), width), profile)
            best = total.argmin(axis=1)
            made = [pa.array([names[b] for b in best], pa.string()), pa.array(total.min(axis=1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[4:], *made], names=["key", *batch.schema.names[4:], "nearest", "divergence"])

    wholes = {"n_chars", "n_words", "n_lines"}
    fields = ", ".join([f"key {kind}", *[f"{s} {'bigint' if s in wholes else 'double'}" for s in STATISTICS], "nearest string", "divergence double"])
    if not names:
        return found.select(F.col("key").alias(key), *STATISTICS, F.lit("junk").alias("kind"), F.lit("empty").alias("variety"), F.lit(0.0).alias("divergence"))
    compared = found.select("key", *[p for p, _ in _PARTS], *STATISTICS).mapInArrow(run, fields)
    bare = F.col("n_words") == 0
    nearest = F.split("nearest", "/")
    return compared.select(
        F.col("key").alias(key),
        *STATISTICS,
        F.when(bare, F.lit("junk")).otherwise(nearest[0]).alias("kind"),
        F.when(bare, F.lit("empty")).otherwise(nearest[1]).alias("variety"),
        "divergence",
    )
