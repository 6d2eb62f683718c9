import random
import unicodedata
from collections import Counter

import pytest

from textloom.llm.cooccurrence import frequent_pairs
from textloom.llm.frequency import ngram_frequencies, term_marks
from textloom.llm.terms import normal_term


def _records(seed, n=120):
    rnd = random.Random(seed)
    words = ["ä", "ä", "Ab", "ab ", "c", "d", "\n\n", "", ".", None, " e", "12", "x1", "İ"]
    return [None if rnd.random() < 0.05 else [rnd.choice(words) for _ in range(rnd.randrange(0, 14))] for _ in range(n)]


def _brute(records, sigma):
    occurs, within = Counter(), Counter()
    for record in records:
        terms = [normal_term(x) for x in record or []]
        here = Counter()
        for i in range(len(terms)):
            for k in range(1, sigma + 1):
                gram = terms[i : i + k]
                if len(gram) == k and all(gram):
                    here[tuple(gram)] += 1
        occurs.update(here)
        within.update(here.keys())
    return {g: (occurs[g], within[g]) for g in occurs}, sum(any(normal_term(x) for x in r or []) for r in records)


@pytest.mark.parametrize("sigma,seed", [(1, 1), (2, 2), (3, 3), (4, 4)])
def test_counts_equal_brute_force(spark, sigma, seed):
    records = _records(seed)
    df = spark.createDataFrame([(k, r) for k, r in enumerate(records)], "suffix long, lemmas array<string>").repartition(5)
    got = {tuple(r.ngram): (r.occurrences, r.records) for r in ngram_frequencies(df, "lemmas", sigma).collect()}
    want, total = _brute(records, sigma)
    assert got.pop(()) == (0, total)
    assert got == want


def test_normal_term():
    assert normal_term("Ä ") == "ä"
    assert normal_term(" x") == "x"
    assert normal_term(" 12 ") is None and normal_term(None) is None and normal_term("\n\n") is None
    assert unicodedata.is_normalized("NFC", normal_term("İ"))


def test_marks_and_empty(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a", "b"],), (["a", "b"],), (["a", "c"],), (["a"],), (None,), ([],)], "lemmas array<string>")
    got = {r.term: (r.records, r.mark) for r in term_marks(df, "lemmas").collect()}
    assert got == {"a": (5, "common"), "b": (3, "common"), "c": (1, "rare")}
    assert term_marks(df.limit(0), "lemmas").count() == 0


@pytest.mark.parametrize("dictionary", [400_000, 0])
def test_pairs_equal_brute_force(spark, dictionary):
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(40)]
    records = []
    for _ in range(300):
        base = rnd.randrange(0, 38)
        records.append([words[base], words[base + 1].upper(), None, "."] + rnd.sample(words, rnd.randrange(0, 4)))
    records += [None, [], ["."]]
    df = spark.createDataFrame([(r,) for r in records], "item array<string>").repartition(4)
    sets = [{normal_term(x) for x in r or []} - {None} for r in records]
    total = sum(bool(s) for s in sets)
    n = Counter(t for s in sets for t in s)
    both = Counter((a, b) for s in sets for a in s for b in s if a < b)
    want = {(a, b): (n[a], n[b], k) for (a, b), k in both.items() if k >= 5 and k * total >= 4 * n[a] * n[b]}
    got = frequent_pairs(df, "item", 5, 0.001, 4.0, dictionary_items=dictionary).collect()
    assert {(r.term_a, r.term_b): (r.n_a, r.n_b, r.n_ab) for r in got} == want and want
    assert all(abs(r.lift - r.n_ab * total / (r.n_a * r.n_b)) < 1e-9 for r in got)


def test_sparse_equals_dense():
    import numpy as np

    from textloom.llm.cooccurrence import _dense, _sparse

    rng = np.random.default_rng(1)
    x = rng.random((50, 30)) < 0.3
    rows, items = np.nonzero(x)
    sizes = np.bincount(rows, minlength=50)
    def as_dict(t):
        return {(int(a), int(b)): int(n) for a, b, n in zip(*t)}
    assert as_dict(_dense(items, rows, 30)) == as_dict(_sparse(items, np.cumsum(sizes) - sizes, sizes))


def test_pairs_of_empty_table(spark):
    assert frequent_pairs(spark.createDataFrame([], "x array<string>"), "x").count() == 0


def test_pieces_are_whole_records():
    import pyarrow as pa

    from textloom.llm.terms import encode, pieces

    column = pa.array([["a"] * 3, None, ["b"] * 9, [], ["c", "d"], ["a"]], pa.list_(pa.string()))
    parts = list(pieces(column, 4))
    assert sum(map(len, parts)) == len(column) and [x for p in parts for x in p.to_pylist()] == column.to_pylist() and len(parts) > 1
    assert [len(encode(p)[1]) for p in parts] == [sum(len(x or []) for x in p.to_pylist()) for p in parts]
