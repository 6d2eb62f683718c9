import json
import random

import pytest
from pyspark.sql import functions as F

from textloom.llm.language_id import fit_dictionaries, identify_languages, paragraphs, wrong_labels
from textloom.llm.languages import label_language
from textloom.llm.repeated_lines import frequent_sequences, line_keys, site_of, without_repeated
from textloom.llm.structure import text_structure

WORDS = {
    "de": "der die das und ist nicht ein eine mit auf Haus Straße Wetter kaufen schnell Garten Schule Lehrer fahren".split(),
    "en": "the and is not a with on house street weather buy quick garden school teacher drives through because".split(),
    "fr": "le la les et est pas un une avec sur maison rue temps acheter rapide jardin école professeur conduire".split(),
}
COMMON = [(lang, w) for lang, ws in WORDS.items() for w in ws[:9]]


def _text(lang, n, seed):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def languages(spark):
    rows = []
    for k in range(60):
        lang = ["de", "en", "fr"][k % 3]
        rows.append((k, _text(lang, 60, k), lang if k % 10 else "xx", "s"))
    rows += [(100, _text("de", 60, 1) + "\n\n" + _text("en", 20, 2), "de_AT", "s"), (101, _text("fr", 40, 3), "German", "s"), (102, None, "de", "s"), (103, "", None, "s")]
    rows += [(104, "qzx " + " ".join(f"xq{k}zvw" for k in range(40)), None, "s"), (105, "qzx " + " ".join(f"pw{k}gvk" for k in range(40)), "de", "s"), (106, "kurz", None, "s"), (107, None, None, None)]
    return spark.createDataFrame(rows, "id long, text string, lang string, key string"), spark.createDataFrame(COMMON, "lang string, word string")


def test_languages(spark, languages):
    df, common = languages
    dictionaries = fit_dictionaries(df, "id", "text", "lang", common)
    rows = identify_languages(df, "id", "text", dictionaries).collect()
    main = {r.id: r.lang for r in rows if r.seg_no == -1}
    assert len(main) == df.count()
    assert all(main[k] == ["de", "en", "fr"][k % 3] for k in range(60))
    assert main[102] == main[103] == main[104] == "zxx"
    assert [(r.seg_no, r.lang) for r in rows if r.id == 100 and r.seg_no >= 0] == [(1, "en")]
    assert all(0 <= r.confidence <= 1 for r in rows)
    cases = {tuple(r) for r in wrong_labels(df, "id", "text", "lang", dictionaries).collect()}
    assert (101, -1, "fr") in cases and (100, 1, "en") in cases and (0, -1, "de") in cases and (105, -1, "zxx") in cases
    assert not {c for c in cases if c[0] in (100, 104) and c[1] == -1} and not {c for c in cases if c[0] in (102, 103, 106, 107)}
    assert identify_languages(df.limit(0), "id", "text", dictionaries).count() == 0
    assert fit_dictionaries(df.limit(0), "id", "text", "lang", common)["de"]


def test_paragraphs_and_labels(spark):
    assert paragraphs("a\r\n\r\nb\n \t\nc\nd\r\re\n\n") == ["a", "b", "c\nd", "e"]
    names = [(" DE-at", "de"), ("German", "de"), ("eng", "en"), ("und", "zxx"), ("ZXX", "zxx"), ("fr_FR", "fr"), ("french ", "fr"), ("n/a", None), (None, None), ("", None), ("den", None)]
    got = spark.createDataFrame(names, "l string, want string").select("want", label_language(F.col("l")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def _structure_rows():
    rnd = random.Random(2)
    rows = []
    nouns = "Haus Garten Schule Lehrer Wetter Straße Auto Fahrrad Brücke Museum".split()
    for k in range(30):
        rows.append((k, ". ".join(_text("de", 12, k * 7 + j)[:-1].capitalize() for j in range(6)) + ".", "prose"))
        rows.append((100 + k, "\n".join(f"- {rnd.choice(nouns)} {rnd.choice(nouns)}" for _ in range(12)), "list"))
        rows.append((200 + k, "\n".join("\t".join([rnd.choice(nouns), str(rnd.randint(1, 999)), f"{rnd.random():.2f}"]) for _ in range(10)), "table"))
        rows.append((300 + k, " ".join("".join(rnd.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(40)), "junk"))
    return rows


def test_structure(spark):
    rows = _structure_rows()
    df = spark.createDataFrame([(k, t, "x") for k, t, _ in rows] + [(900, None, "x"), (901, "", "x")], "doc long, text string, kind string")
    common = spark.createDataFrame(COMMON, "lang string, word string")
    got = {r.doc: r for r in text_structure(df, "doc", "text", common).collect()}
    assert sum(got[k].kind == kind for k, _, kind in rows) >= len(rows) - 1
    assert got[900].kind == got[901].kind == "junk" and got[900].n_chars == 0
    r, text = got[0], rows[0][1]
    assert r.n_chars == len(text) and r.n_words == len(text.split()) and abs(r.mean_word_length - sum(map(len, text.split())) / r.n_words) < 1e-9 and r.ended_lines == 1.0
    assert text_structure(df.limit(0), "doc", "text", common).count() == 0
    long = spark.createDataFrame([(1, _text("de", 200_000, 1))], "doc long, text string")
    assert text_structure(long, "doc", "text", common).first().n_words == 200_000


def _brute_sequences(rows, support, most):
    from collections import defaultdict

    seen = defaultdict(set)
    single = defaultdict(set)
    clean = [(d, s, [x for x in keys if x]) for d, s, keys in rows if d is not None and s is not None and keys is not None]
    for d, s, keys in clean:
        for x in keys:
            single[s, x].add(d)
    often = {k for k, v in single.items() if len(v) >= support}
    for d, s, keys in clean:
        for i in range(len(keys)):
            for n in range(1, most + 1):
                part = tuple(keys[i : i + n])
                if len(part) == n and all((s, x) in often for x in part):
                    seen[s, part].add(d)
    return {k: len(v) for k, v in seen.items() if len(v) >= support}


@pytest.mark.parametrize("seed", [1, 2])
def test_sequences_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for k in range(200):
        lines = [rnd.choice(["Impressum", "AGB ", " Seite 12", "seite  7", "", "© Haus", f"own {k} x" + "y" * k, "teilen"]) for _ in range(rnd.randrange(0, 9))]
        rows.append((k, rnd.choice(["a", "a", "b", None]), "\n".join(lines), "l"))
    notice = "\n".join(f"Hinweis {'abcdefgh'[n]}" for n in range(8))
    rows += [(300 + k, "a", f"eigen {'xyzuvw'[k]}\n{notice}\n\nAGB", "l") for k in range(6)]
    rows += [(500, "a", None, "l"), (None, "a", "AGB", "l"), (501, "a", "", "l")]
    df = spark.createDataFrame(rows, "doc long, site string, text string, lines string").repartition(4)
    keys = {r.text: r.k for r in df.select("text", line_keys(F.col("text")).alias("k")).collect()}
    got = {(r.site, tuple(r.lines)): r.n_documents for r in frequent_sequences(df, "doc", "site", "text", 5).collect()}
    assert got == _brute_sequences([(d, s, keys[t]) for d, s, t, _ in rows], 5, 12) and len(got) > 10
    assert max(len(k[1]) for k in got) == 9
    cleaned = {r.doc: r for r in without_repeated(df.where("doc is not null"), "doc", "site", "text").collect()}
    gone = {(s, x[0]) for s, x in got if len(x) == 1}
    for d, s, t, _ in rows:
        if d is not None:
            want = t if t is None or s is None else "\n".join(raw for raw, key in zip(t.split("\n"), keys[t]) if (s, key) not in gone)
            assert cleaned[d].text_clean == want
    assert frequent_sequences(df.limit(0), "doc", "site", "text").count() == 0


def test_sites(spark):
    urls = [("https://WWW.Ab.example:8080/x?y", "ab.example"), ("http://u@ab.example", "ab.example"), ("//www.ab.example/", "ab.example"), (None, None), ("", None), ("https://wwwx.example", "wwwx.example")]
    got = spark.createDataFrame(urls, "u string, want string").select("want", site_of(F.col("u")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
