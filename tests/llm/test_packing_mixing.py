import random
from collections import Counter, defaultdict

import pytest
import regex

from textloom.llm.mixing import mix, rake
from textloom.llm.packing import container_contents, pack, shortest_pack_first
from textloom.llm.topics import fit_topics, with_topics
from textloom.llm.tokens import n_tokens

GPT2 = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def test_tokens_equal_the_pattern(spark):
    texts = ["", None, "Hello  world's  end.\n\n x", "  lead  nbsp \t tab", "äöü 123abc!? …　x ", "'tis don't we'll", " \n ", "a" * 5000 + " " * 300 + "b"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", n_tokens(rows_col()).alias("n")).collect()
    assert {r.k: r.n for r in rows} == {k: len(GPT2.findall(t or "")) for k, t in enumerate(texts)}


def rows_col():
    from pyspark.sql import functions as F

    return F.col("text")


@pytest.mark.parametrize("seed", range(5))
def test_patterns_hold_everything_once(seed):
    rnd = random.Random(seed)
    histogram = Counter(rnd.randint(1, 50) for _ in range(rnd.randint(0, 400)))
    patterns = shortest_pack_first(dict(histogram), 50)
    placed = Counter()
    for pattern, times in patterns:
        assert sum(pattern) <= 50
        for length in pattern:
            placed[length] += times
    assert placed == histogram
    if histogram:
        used = sum(t for _, t in patterns)
        assert used <= 1.25 * sum(k * v for k, v in histogram.items()) / 50 + 2


def test_pack_places_each_part_once(spark):
    rnd = random.Random(1)
    # a third of all rows have one length
    sizes = [(k, 7 if k % 3 == 0 else rnd.randint(1, 40), "x") for k in range(900)] + [(1000, 95, "x"), (1001, 20, "x"), (1002, None, "x"), (1003, 0, "x"), (None, 5, "x"), (1001, 20, "x")]
    df = spark.createDataFrame(sizes, "doc long, n long, container string").repartition(6)
    rows = pack(df, "doc", "n", 20, buckets=8).collect()
    whole = defaultdict(list)
    used = Counter()
    for r in rows:
        whole[r["item"]].append((r.part, r.start, r.length, r.n_parts))
        used[r.container] += r.length
    assert max(used.values()) <= 20
    assert set(whole) == {k for k, n, _ in sizes if k is not None and n}
    for key, n, _ in sizes:
        if key is not None and n and key != 1001:
            parts = sorted(whole[key])
            assert sum(p[2] for p in parts) == n and [p[0] for p in parts] == list(range(-(-n // 20)))
            assert len(parts) == 1 or all(p[2] == 20 for p in parts[:-1])
    assert len(whole[1001]) == 2
    assert sorted(used) == list(range(len(used)))
    contents = container_contents(pack(df, "doc", "n", 20), 20).collect()
    assert all(r.free == 20 - sum(x.length for x in r["items"]) for r in contents)
    assert pack(df.limit(0), "doc", "n", 20).count() == 0


def test_rake_meets_margins():
    tokens = {("a", "x", "1"): 100, ("a", "y", "1"): 300, ("b", "x", "1"): 400, ("b", "y", "1"): 200}
    weight, lack = rake(tokens, {"a": 500, "b": 300}, {"a": 3, "b": 2}, {1: {"x": 0.5, "y": 0.5}})
    assert abs(weight["a", "x", "1"] + weight["a", "y", "1"] - 500) < 1e-3
    assert abs(weight["a", "x", "1"] + weight["b", "x", "1"] - 400) < 1
    assert lack == {"a": 0, "b": 0}
    short, lack = rake(tokens, {"a": 5000, "b": 300, "none": 7}, {"a": 2, "b": 2, "none": 1}, {})
    assert lack == {"a": 4200, "b": 0, "none": 7}
    assert short["a", "x", "1"] == 200 and short["a", "y", "1"] == 600


def test_mix(spark):
    rnd = random.Random(4)
    docs = [(k, rnd.choice(["A ", "a", "b", "c", None]), rnd.randint(5, 50), rnd.choice(["de", "en", None])) for k in range(3000)]
    df = spark.createDataFrame(docs, "id long, src string, n long, lang string")
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.05, 1), (" B", 0.05, 1), ("none", 0.3, 4)], "source string, target_share double, max_repeats int")
    sample, report = mix(df, targets, "id", "src", "n", "lang")
    rows = {r.source: r for r in report.collect()}
    own = Counter()
    for _, s, n, _ in docs:
        own[(s or "").strip().lower()] += n
    total = sum(own.values())
    assert rows["a"].short == (0.6 * total > 2 * own["a"]) and rows["none"].short and not rows["b"].short
    taken = {(r.id, r.source): r.copies for r in sample.collect()}
    assert max(taken.values()) <= 2 and all(s in ("a", "b") for _, s in taken)
    got = Counter()
    for (k, s), c in taken.items():
        got[s] += c * docs[k][2]
    assert got["a"] == rows["a"].mixed_tokens
    assert abs(got["b"] - 0.1 * total) < 0.05 * total
    assert abs(sum(r.actual_share for r in rows.values()) - 1) < 1e-9
    empty, nothing = mix(df.limit(0), targets, "id", "src", "n")
    assert empty.count() == 0 and nothing.count() == 3
    assert all(r.actual_share is None for r in nothing.collect())


def test_topics(spark):
    rnd = random.Random(2)
    words = {k: [f"{stem}{x}" for x in "abcdefghijklmnopqrst"] for k, stem in enumerate(("wetter", "sport", "technik"))}
    rows = [(k, " ".join(rnd.choice(words[k % 3]) for _ in range(40))) for k in range(90)] + [(100, None), (101, ""), (102, "zzzz")]
    df = spark.createDataFrame(rows, "doc long, text string")
    model = fit_topics(df, "doc", "text", 3)
    got = {r.doc: r.topic for r in with_topics(df.repartition(3), "text", model).collect()}
    assert len({got[k] for k in range(3)}) == 3 and all(got[k] == got[k % 3] for k in range(90))
    assert got[100] == got[101] == got[102] == -1
    assert with_topics(df, "text", fit_topics(df.limit(0), "doc", "text")).where("topic >= 0").count() == 0


def _themes(documents, fill=""):
    rnd = random.Random(5)
    words = {k: [f"{stem}{x}" for x in "abcdefghijklmnopqrst"] for k, stem in enumerate(("wetter", "sport", "technik", "garten"))}
    return [(k, fill + " ".join(rnd.choice(words[theme]) for _ in range(30)), theme) for k, theme in documents]


def test_topics_of_all_documents(spark):
    from pyspark.sql import functions as F

    # the documents of the last theme have the greatest key hashes
    hashed = [r.id for r in spark.range(2600).orderBy(F.xxhash64("id")).collect()]
    rows = _themes([(k, 3 if n >= 2100 else n % 3) for n, k in enumerate(hashed)])
    df = spark.createDataFrame(rows, "doc long, text string, theme int")
    found = with_topics(df, "text", fit_topics(df, "doc", "text", 4)).groupBy("theme", "topic").count().collect()
    assert len(found) == 4 and {r.topic for r in found} == {0, 1, 2, 3}


def test_topics_of_all_words(spark):
    # 320 words that every document has more often than any of its own words
    fill = "".join(f"wort{a}{b} " for a in "abcdefghijklmnop" for b in "abcdefghijklmnopqrst") * 31
    df = spark.createDataFrame(_themes([(k, k % 4) for k in range(120)], fill), "doc long, text string, theme int")
    found = with_topics(df, "text", fit_topics(df, "doc", "text", 4)).groupBy("theme", "topic").count().collect()
    assert len(found) == 4 and {r.topic for r in found} == {0, 1, 2, 3}


def test_topics_equal_the_dense_computation(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from textloom.llm.topics import ROUNDS

    rnd = random.Random(6)
    pool = ["wort" + "".join(rnd.choice("abcdeä") for _ in range(3)) for _ in range(120)]
    docs = [(k, " ".join(rnd.choice(pool[(k % 5) * 20 :][:40]) for _ in range(rnd.randint(0, 60))) + " Ab1x x_y das") for k in range(400)] + [(None, "wort wort"), (900, None)]
    df = spark.createDataFrame(docs, "doc long, text string")
    texts = [(r.h, r.text) for r in df.where("doc is not null and text is not null").select(F.xxhash64("doc").alias("h"), "text").collect()]
    counts = [(h, Counter(regex.findall(r"\p{L}{4,}", t.lower()))) for h, t in texts]
    spread = Counter(w for _, c in counts for w in c)
    words = sorted((w for w, n in spread.items() if 2 <= n <= 0.3 * len(texts)), key=lambda w: (-spread[w], w))
    idf = np.log(len(texts) / np.array([spread[w] for w in words]))
    points = np.array([[np.log1p(c[w]) for w in words] * idf for _, c in sorted(counts, key=lambda x: x[0])])
    points = points[points.any(axis=1)]
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    centres = points[[(points @ points.mean(axis=0)).argmax()]]
    while len(centres) < 6:
        centres = np.vstack([centres, points[(points @ centres.T).max(axis=1).argmin()]])
    for _ in range(ROUNDS):
        own = (points @ centres.T).argmax(axis=1)
        centres = np.array([points[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in range(6)])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    one, many = (fit_topics(df.repartition(n), "doc", "text", 6) for n in (1, 7))
    assert list(one.vocabulary.numbers) == words == list(many.vocabulary.numbers)
    assert (one.centres == many.centres).all()
    assert np.abs(one.centres / (1 << 24) - centres).max() < 1e-4
