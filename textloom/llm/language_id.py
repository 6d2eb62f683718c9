"""Problem 2: language of documents and of their paragraphs, by compression.

Every language has a raw-content zstandard dictionary of words of that language; a text
belongs to the language whose dictionary compresses it smallest. Where the best size is
not clearly below the second, the text is in none of them: junk compresses alike with all.

Paragraphs are classified one by one. A document's language is the one with most letters,
so mixed documents need no second look.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .languages import LANGUAGES, NONE, label_language

#: Bounds of the labelled sample that the dictionaries are made of.
SAMPLE_DOCUMENTS = 600
DICTIONARY_BYTES = 100_000
#: A sample paragraph must have this share of frequent words of its label's language.
SAMPLE_SHARE = 0.2
LEVEL = 3
MARGIN = 0.07
SEGMENT_LETTERS = 40
CASE_LETTERS = 50

_WORD = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"(?:\r\n?|\n)(?:[^\S\r\n]*(?:\r\n?|\n))+")


def paragraphs(text: str) -> list[str]:
    """Stretches of text between blank lines, empty ones left out."""
    return [p for p in _GAP.split(text) if p and not p.isspace()]


def fit_dictionaries(
    documents: DataFrame,
    key: str,
    text: str,
    label: str,
    common_words: DataFrame,
    sample_documents: int = SAMPLE_DOCUMENTS,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> dict[str, bytes]:
    """Dictionary content by language from a bounded sample of labelled documents.

    Of each language the ``sample_documents`` documents with the least key hash are read;
    of these the paragraphs count in which the frequent words (``lang, word``) of the
    label's language prevail, for labels are wrong at times. The frequent words themselves
    close each dictionary, so a language without sample still has one.
    """
    words: dict[str, set[str]] = {code: set() for code in LANGUAGES}
    for row in common_words.where(F.col("lang").isin(LANGUAGES) & F.col("word").isNotNull()).collect():
        words[row.lang].add(row.word.lower())
    labelled = documents.select(F.col(key).alias("key"), label_language(F.col(label)).alias("lang")).where(F.col("lang").isin(LANGUAGES))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key"))
    chosen = labelled.withColumn("rank", rank).where(F.col("rank") <= sample_documents).select("key", "lang")
    # at most sample_documents rows a language
    sample = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    # executors judge the paragraphs; of a document no more than a share of a dictionary reaches the driver
    fair = max(1, dictionary_bytes // 20)

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = []
            for lang, value in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                kept: list[str] = []
                for paragraph in paragraphs(value or ""):
                    found = _WORD.findall(paragraph.lower())
                    counts = {code: sum(w in known for w in found) for code, known in words.items()}
                    if len(found) >= 5 and counts[lang] == max(counts.values()) and counts[lang] >= SAMPLE_SHARE * len(found):
                        kept += found
                contents.append(" ".join(kept).encode()[:fair])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(contents, pa.binary())], names=["h", "lang", "content"])

    made = sample.select(F.xxhash64("key").alias("h"), "lang", "text").mapInArrow(accepted, "h bigint, lang string, content binary")
    parts: dict[str, list[bytes]] = {code: [] for code in LANGUAGES}
    sizes = dict.fromkeys(LANGUAGES, 0)
    for row in sorted(made.where(F.length("content") > 0).collect()):
        if sizes[row.lang] < dictionary_bytes:
            parts[row.lang].append(bytes(row.content))
            sizes[row.lang] += len(row.content)
    return {code: b" ".join([*parts[code], " ".join(sorted(words[code])).encode()])[-dictionary_bytes:] for code in LANGUAGES}


def _classifiers(dictionaries: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    made = []
    for code, content in sorted(dictionaries.items()):
        if len(content) < 8:
            continue
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        made.append((code, zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return made


def classify(content: bytes, classifiers: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float]:
    """Best language and by what part its size is below the second best."""
    best, second, language = 1 << 60, 1 << 60, NONE
    for code, compressor in classifiers:
        size = len(compressor.compress(content))
        if size < best:
            best, second, language = size, best, code
        elif size < second:
            second = size
    return language, (second - best) / second if second < 1 << 60 else 1.0


def _content(words: list[str]) -> bytes:
    """Each distinct word once, in order: what a text repeats would compress alike with any dictionary."""
    return " ".join(dict.fromkeys(words)).encode()


def segment_languages(text: str | None, classifiers, margin: float = MARGIN) -> list[tuple[int, str, float, int]]:
    """``(seg_no, lang, confidence, letters)``: -1 for the text, then paragraphs in another language."""
    total, by, kept = 0, {}, []
    for number, paragraph in enumerate(paragraphs(text or "")):
        words = _WORD.findall(paragraph.lower())
        letters = sum(map(len, words))
        total += letters
        if not letters:
            continue
        code, clear = classify(_content(words), classifiers)
        if clear < margin:
            continue
        n, weighed = by.get(code, (0, 0.0))
        by[code] = (n + letters, weighed + letters * clear)
        kept.append((number, code, clear, letters))
    if not by:
        # short paragraphs may be unclear one by one
        words = _WORD.findall((text or "").lower())
        code, clear = classify(_content(words), classifiers) if words else (NONE, 0.0)
        return [(-1, code if clear >= margin else NONE, clear if clear >= margin else 1.0 - clear, total)]
    main = max(sorted(by), key=lambda code: by[code][0])
    n, weighed = by[main]
    out = [(-1, main, weighed / n * (n / total), total)]
    return out + [row for row in kept if row[1] != main and row[3] >= SEGMENT_LETTERS]


def identify_languages(
    documents: DataFrame, key: str, text: str, dictionaries: dict[str, bytes], margin: float = MARGIN, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Language of each document and of each paragraph in another language.

    Returns ``key``, the columns ``carry``, and ``(seg_no, lang, confidence, letters,
    text_letters)``: one row with ``seg_no`` -1 a document, ``zxx`` where no language is
    clear (null and empty texts too), and one row for each paragraph, numbered from 0, of
    40 or more letters in another language. Whole texts are read, whatever their length.
    """
    kept = documents.select(F.col(text).alias("__text"), key, *carry)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifiers = _classifiers(dictionaries)
        for batch in batches:
            at, rows = [], []
            for k, value in enumerate(batch.column(0)):
                found = segment_languages(value.as_py(), classifiers, margin)
                at += [k] * len(found)
                rows += [(*row, found[0][3]) for row in found]
            number, code, clear, letters, whole = zip(*rows) if rows else [[]] * 5
            made = [pa.array(number, pa.int32()), pa.array(code, pa.string()), pa.array(clear, pa.float64()), pa.array(letters, pa.int64()), pa.array(whole, pa.int64())]
            others = [column.take(pa.array(at, pa.int64())) for column in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([*others, *made], names=[*batch.schema.names[1:], "seg_no", "lang", "confidence", "letters", "text_letters"])

    return kept.mapInArrow(run, f"{fields}, seg_no int, lang string, confidence double, letters bigint, text_letters bigint")


def wrong_labels(documents: DataFrame, key: str, text: str, label: str, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """Cases ``(key, seg_no, lang)``: labels that do not name the main language, and paragraphs
    in another one. Texts of fewer than 50 letters are no cases; for texts in no language
    a null label is right as well.
    """
    named = documents.select(key, F.col(text).alias("__content"), label_language(F.col(label)).alias("__named"), F.col(label).isNull().alias("__bare"))
    found = identify_languages(named, key, "__content", dictionaries, margin, ("__named", "__bare"))
    right = F.coalesce(F.col("__named") == F.col("lang"), F.lit(False)) | ((F.col("lang") == NONE) & F.col("__bare"))
    cases = found.where((F.col("text_letters") >= CASE_LETTERS) & ((F.col("seg_no") >= 0) | ~right))
    return cases.select(key, "seg_no", "lang")
