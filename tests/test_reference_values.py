"""Values that a hand count gives on tiny corpora."""

import math

import pytest
from pyspark.sql import functions as F

from textloom.functions import association
from textloom.operators import cooccurrence as co
from textloom.operators.corpus import corpus, ngram_counts, treat_as_one, words_as_one
from textloom.operators.keyness import contingency, keywords
from textloom.operators.retrieval import match_wordlist

DOCS = [
    ["This", "is", "a", "test", "document", "."],
    ["this", "is", "another", "test", "document", "234"],
    ["This", "is", "yet", "another", "test", "document", "."],
    ["Another", "test", "document", "This", "is", "!"],
]
REFERENCE = [
    ["The", "quick", "brown", "fox", "jumps", "over", "the", "lazy", "dog", "."],
    ["Lorem", "ipsum", "dolor", "sit", "amet", ",", "consectetur", "adipiscing", "elit", "."],
    ["Hello", "world", "!", "This", "is", "a", "test", "document", "."],
]
LOWER = [
    ["this", "is", "a", "test", "document", "."],
    ["this", "is", "another", "test", "document", ".", "this", "is", "second", "sentence", "."],
    ["yet", "another", "test", "document", "."],
]


def frame(spark, docs):
    return spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "doc_id long, tokens array<string>")


def edges(df):
    return {(r.w, r.o): r.cnt for r in df.collect()}


def lower_first(w):
    return F.substring(w, 1, 1).rlike(r"^\p{Ll}")


def test_window(spark):
    got = edges(co.window_counts(frame(spark, LOWER), 2))
    assert (got["this", "is"], got["is", "this"], got["test", "."], got["yet", "test"], got["this", "document"]) == (3, 3, 3, 1, 1)


def test_window_with_separator(spark):
    got = edges(co.window_counts(frame(spark, LOWER), 2, "."))
    assert got["this", "is"] == 3 and ("test", ".") not in got and ("document", "this") not in got


def test_whole_document(spark):
    got = edges(co.unit_counts(frame(spark, LOWER)))
    assert got["this", "."] == 3 and got["yet", "."] == 1
    once = edges(co.unit_counts(frame(spark, LOWER), count_duplicates=False))
    assert once["this", "is"] == 2 and once["another", "this"] == 1


def brute_window(docs, w, separator, duplicates):
    from collections import Counter

    out = Counter()
    for doc in docs:
        unit, units = [], []
        for t in doc + [separator]:
            if t == separator:
                units.append(unit)
                unit = []
            else:
                unit.append(t)
        for unit in units:
            seen = set()
            for i, t in enumerate(unit):
                if not duplicates and t in seen:
                    continue
                seen.add(t)
                for o in set(unit[max(0, i - w) : i] + unit[i + 1 : i + 1 + w]):
                    out[t, o] += 1
    return dict(out)


@pytest.mark.parametrize("w,separator,duplicates", [(1, None, True), (2, ".", False), (5, ".", True), (3, None, False)])
def test_window_equals_brute_force(spark, w, separator, duplicates):
    docs = LOWER + DOCS + [[], ["x"], ["x", "x", ".", "."], ["."]]
    assert edges(co.window_counts(frame(spark, docs), w, separator, duplicates)) == brute_window(docs, w, separator, duplicates)


def test_smoothing_is_analytic(spark):
    # every cell of the table plus s, margins and total of the full table
    counts = edges(co.unit_counts(frame(spark, LOWER)))
    vocabulary = sorted({w for w, _ in counts})
    s, v = 0.5, len(vocabulary)
    full = {(a, b): counts.get((a, b), 0) + s for a in vocabulary for b in vocabulary}
    total = {a: sum(full[a, b] for b in vocabulary) for a in vocabulary}
    grand = sum(total.values())
    rows = co.scored_edges(co.unit_counts(frame(spark, LOWER)), table_smoothing=s).collect()
    for r in rows:
        f = full[r.w, r.o]
        assert abs(r.pmi - math.log2(f * grand / (total[r.w] * total[r.o]))) < 1e-9
        assert abs(r.log_dice - (14 + math.log2(2 * f / (total[r.w] + total[r.o])))) < 1e-9
        assert abs(r.npmi - r.pmi / -math.log2(f / grand)) < 1e-9


def test_stopwords_keep_margins(spark):
    e = co.unit_counts(frame(spark, LOWER))
    kept, left = co.without_stopwords(e, ["this"])
    assert not [k for k in edges(kept) if "this" in k]
    before = {r.w: r.total for r in co.margins(e).collect()}
    assert all(before[r.w] == r.total for r in left.collect())
    _, new = co.without_stopwords(e, ["this"], recompute_margins=True)
    assert {r.w: r.total for r in new.collect()}["is"] < before["is"]


def test_collocations(spark):
    e = co.unit_counts(frame(spark, LOWER))
    got = {r.term: r.stat for r in co.collocations(e, "yet", "pmi", 0).collect()}
    assert got["second"] == float("-inf") and got["another"] > 0
    assert co.collocations(e, "missing").count() == 0
    assert co.collocations(e, "yet", lambda f, a, b, n, v, s: f * 2).where("stat = 2").count() == 4
    with pytest.raises(ValueError):
        co.collocations(e, "yet", "unknown")


def test_ngrams(spark):
    docs = frame(spark, DOCS)
    one = {tuple(r.term): (r.freq, r.doc_freq) for r in ngram_counts(docs, 1).collect()}
    assert {k[0]: v[0] for k, v in one.items()} == {"This": 3, "is": 4, "a": 1, "test": 4, "document": 4, ".": 2, "this": 1, "another": 2, "234": 1, "yet": 1, "Another": 1, "!": 1}
    two = {tuple(r.term): r.freq for r in ngram_counts(docs, 2).collect()}
    assert two["This", "is"] == 3 and two["is", "a"] == 1
    assert ngram_counts(docs, 8).count() == 0
    with pytest.raises(ValueError):
        ngram_counts(docs, 0)


def test_corpus_filter(spark):
    raw = spark.createDataFrame([(1, DOCS[0] + [None]), (2, None), (3, [])], "id long, lemmas array<string>")
    assert {r.doc_id: r.tokens for r in corpus(raw, "id", "lemmas", keep=None).collect()} == {1: DOCS[0], 2: [], 3: []}
    assert corpus(raw, "id", "lemmas", keep=lower_first).where("doc_id = 1").first().tokens == ["is", "a", "test", "document"]
    assert corpus(raw, "id", "lemmas").where("doc_id = 1").first().tokens == DOCS[0][:5]
    with pytest.raises(TypeError):
        corpus(raw, "id", "lemmas", keep="x")


def test_treat_as_one(spark):
    docs = frame(spark, DOCS + [["a", "a", "a"], []])
    got = {r.doc_id: r.tokens for r in treat_as_one(docs, ["test", "document"], "test_document").collect()}
    assert got[0] == ["This", "is", "a", "test_document", "."] and got[3] == ["Another", "test_document", "This", "is", "!"] and got[5] == []
    got = {r.doc_id: r.tokens for r in treat_as_one(docs, ["This", "is"]).collect()}
    assert got[0][0] == "This is" and got[1][0] == "this" and got[3][3] == "This is"
    assert treat_as_one(docs, ["a", "a"]).where("doc_id = 4").first().tokens == ["a a", "a"]
    assert words_as_one(docs, ["a", "yet"]).where("doc_id = 2").first().tokens[2] == "a/yet"


def test_contingency(spark):
    study, reference = frame(spark, DOCS), frame(spark, REFERENCE)
    row = contingency(study, reference, 1, 0).where("term[0] = 'This'").first()
    assert (row.o11, row.o12, row.o21) == (3, 1, 22)
    row = contingency(study, reference, 2, 1, keep=lower_first).where("term = array('test', 'document')").first()
    assert (row.o11, row.o21) == (5, 15)


def _measure(spark, f, *cells):
    df = spark.createDataFrame([tuple(map(float, cells))], "a double, b double, c double, d double")
    return df.select(f(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0]


def test_measures(spark):
    assert _measure(spark, association.odds_ratio, 2, 1, 8, 9) == 2.25
    assert abs(_measure(spark, association.percent_difference, 2, 1, 8, 9) - 100) < 1e-9
    assert 2 < _measure(spark, association.g_test, 10, 5, 5, 10) < 2.2
    assert 1.6 < _measure(spark, association.log_likelihood, 10, 5, 5, 10) < 1.8
    assert _measure(spark, association.log_likelihood, 5, 10, 10, 5) < 0
    assert _measure(spark, association.log_likelihood, 0, 10, 10, 5) is None
    assert _measure(spark, association.odds_ratio, 2, 0, 8, 9) == float("inf")
    assert _measure(spark, association.percent_difference, 2, 0, 8, 9) == float("inf")
    with pytest.raises(ValueError):
        association.keyness_metric("unknown")


def test_keyword_list(spark):
    study, reference = frame(spark, DOCS), frame(spark, REFERENCE)
    got = keywords(study, reference, 2, metric="odds_ratio", min_docs=2, stopwords=["is"]).collect()
    assert all(r.doc_freq >= 2 and "is" not in (r.term[0], r.term[-1]) for r in got) and {r.n for r in got} == {1, 2}


def test_wordlist_match(spark):
    docs = frame(spark, [["find", "this"], ["not", "this"], ["and", "this", "and", "this"]])
    hits = match_wordlist(docs, ["find", ("this",), ("and", "this")], 2).collect()
    assert {r.doc_id: r.n_hits for r in hits} == {0: 2, 2: 2}
