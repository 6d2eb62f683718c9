import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm.html_blocks import block_key, blocks
from textloom.llm.main_content import article_content
from textloom.llm import shared_spans as shared_spans_module
from textloom.llm.shared_spans import _symbols, candidates, class_table, normal_text, recompress, shared_parts, sharing_pairs, span_keys, span_table


def _words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def _brute(texts, length):
    out = set()
    keys = sorted(texts)
    for i, a in enumerate(keys):
        seen = {texts[a][k : k + length] for k in range(len(texts[a]) - length + 1)}
        for b in keys[i + 1 :]:
            if any(texts[b][k : k + length] in seen for k in range(len(texts[b]) - length + 1)):
                out.add((a, b))
    return out


def _documents(seed):
    rnd = random.Random(seed)
    shared = [_words(rnd, 60) for _ in range(6)]
    rows = []
    for k in range(120):
        text = _words(rnd, rnd.randint(5, 120))
        if rnd.random() < 0.5:
            cut = rnd.choice(shared)
            size = rnd.randint(150, 260)
            at = rnd.randrange(0, len(cut) - size) if len(cut) > size else 0
            text = text + " " + cut[at : at + size] + ("" if rnd.random() < 0.5 else rnd.choice("xyz")) + " " + _words(rnd, 30)
        rows.append((k, text))
    rows += [(200 + k, rows[3][1].replace(" ", " \n ")) for k in range(4)]
    rows += [(300, "zz " * 200), (301, "zz " * 300 + _words(rnd, 20)), (302, "x" * 1000), (303, "y" + "x" * 400), (304, None), (305, ""), (306, "kurz")]
    return rows


def _check_spans(found, texts):
    """Spans are equal stretches, and every shared window of a text but the least one's lies in one."""
    seen, told = {}, {}
    for r in span_table(found).collect():
        assert r.size >= 200 and texts[r.doc_a][r.start_a : r.start_a + r.size] == texts[r.doc_b][r.start_b : r.start_b + r.size]
        told.setdefault(r.doc_b, set()).update(range(r.start_b, r.start_b + r.size - 199))
    classes = {r.doc: r["class"] for r in found.classes.collect()}
    for k in set(classes.values()):
        for i in range(len(texts[k]) - 199):
            seen.setdefault(texts[k][i : i + 200], {}).setdefault(k, []).append(i)
    want = {}
    for places in seen.values():
        for k, at in places.items():
            if k != min(places):
                want.setdefault(k, set()).update(at)
    assert told == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_equal_brute_force(spark, seed):
    rows = _documents(seed)
    df = spark.createDataFrame([(k, t, "a") for k, t in rows], "doc long, text string, span_key string").repartition(3)
    found = candidates(df, "doc", "text")
    pairs = [tuple(r) for r in sharing_pairs(found).collect()]
    texts = {k: normal_text(t) for k, t in rows}
    long = {k: t for k, t in texts.items() if len(t) >= 200}
    want = _brute(long, 200)
    assert set(pairs) == want and len(pairs) == len(want) > 20
    _check_spans(found, texts)
    of = {k: min(j for j in long if long[j] == t) for k, t in long.items()}
    linked = {(of[a], of[b]) for a, b in want if of[a] != of[b]}
    for r in class_table(df, found, "doc").collect():
        assert r["class"] == of.get(r.doc, r.doc) and r.n_copies == sum(of.get(k) == of.get(r.doc, -1) for k in of) or r.n_copies == 1
        assert r.n_links == len({x for p in linked if r["class"] in p for x in p} - {r["class"]})
    seen = {}
    for k, t in long.items():
        for i in range(len(t) - 199):
            seen.setdefault(t[i : i + 200], set()).add(k)
    parts = {r.doc: r.shared_chars for r in shared_parts(df, "doc", "text").collect()}
    for k, t in texts.items():
        covered = set()
        for i in range(len(t) - 199):
            if len(seen.get(t[i : i + 200], ())) > 1:
                covered.update(range(i, i + 200))
        assert parts[k] == len(covered)


def test_shared_parts(spark):
    rnd = random.Random(5)
    part = _words(rnd, 60)[:300].strip()
    rows = [(1, "aaa bbb " + part + " ccc"), (2, part + " " + _words(rnd, 40)), (3, _words(rnd, 80)), (4, "same " * 60), (5, "same \n" * 60), (6, None)]
    got = {r.doc: (r.n_chars, r.shared_chars) for r in shared_parts(spark.createDataFrame(rows, "doc long, text string"), "doc", "text").collect()}
    assert got[1][1] in (len(part), len(part) + 1, len(part) + 2) and abs(got[2][1] - len(part)) <= 2
    assert got[3][1] == 0 and got[4] == got[5] == (299, 299) and got[6] == (0, 0)
    empty = spark.createDataFrame([], "doc long, text string")
    assert shared_parts(empty, "doc", "text").count() == 0
    assert sharing_pairs(candidates(empty, "doc", "text")).count() == 0
    with pytest.raises(ValueError):
        candidates(empty, "doc", "text", 100)


@pytest.mark.parametrize("run", ["-" * 250, "label " + "la " * 70, "Anzeige hier " * 20])
def test_long_runs_of_many_texts(spark, run):
    rnd = random.Random(6)
    rows = [(k, f"{_words(rnd, 12)} {k} {run}{run[-13:] * (k % 4)} {k} {_words(rnd, 12)}") for k in range(30)]
    df = spark.createDataFrame(rows, "doc long, text string").repartition(3)
    texts = {k: normal_text(t) for k, t in rows}
    want = _brute(texts, 200)
    assert len(want) > 200
    found = candidates(df, "doc", "text")
    assert {tuple(r) for r in sharing_pairs(found).collect()} == want
    _check_spans(found, texts)


def test_copies_and_hot_passages_do_not_depend_on_partitions(spark):
    rnd = random.Random(12)
    passage = _words(rnd, 50)
    rows = [(k, "copy " + passage + " of one") for k in range(40)] + [(50, _words(rnd, 9) + " " + passage), (51, passage + " " + _words(rnd, 9))]
    df = spark.createDataFrame(rows, "doc long, text string")
    want = {(a, b) for a in range(40) for b in [*range(a + 1, 40), 50, 51]} | {(50, 51)}
    for n in (1, 42):
        found = candidates(df.repartition(n), "doc", "text")
        assert {tuple(r) for r in sharing_pairs(found).collect()} == want
        assert {(r.doc_a, r.doc_b) for r in span_table(found).collect()} == {(0, 50), (0, 51)}
        assert {(r["class"], r.n_copies, r.n_links) for r in class_table(df, found, "doc").collect()} == {(0, 40, 2), (50, 1, 2), (51, 1, 2)}


def test_many_copies_and_another_text(spark):
    rnd = random.Random(13)
    passage = _words(rnd, 50)
    df = spark.createDataFrame([(k, passage + " copy") for k in range(205)] + [(300, "own " + passage)], "doc long, text string").repartition(5)
    assert sharing_pairs(candidates(df, "doc", "text")).count() == 206 * 205 // 2


def test_pairs_of_large_groups_are_spread(spark, monkeypatch):
    monkeypatch.setattr(shared_spans_module, "PAIRED_TEXTS", 7)
    members = spark.createDataFrame([(k % 3, k) for k in range(90)], "g int, doc long")
    got = shared_spans_module._pairs(members, ["g"]).collect()
    assert len(got) == len(set(got)) == 3 * 30 * 29 // 2


def test_long_periodic_texts_end_soon(spark):
    rows = [(1, "a b c d e f g h " * 65_000), (2, "x " + "a b c d e f g h " * 64_000), (3, "-" * 1_000_000), (4, "." + "-" * 900_000)]
    began = time.time()
    found = candidates(spark.createDataFrame(rows, "doc long, text string"), "doc", "text")
    assert {tuple(r) for r in sharing_pairs(found).collect()} == {(1, 2), (3, 4)}
    assert {(r.doc_a, r.doc_b, r.size) for r in span_table(found).collect()} >= {(3, 4, 900_000)}
    assert time.time() - began < 90


def test_equal_substrings_get_equal_symbols():
    rnd = random.Random(3)
    part = _words(rnd, 80)
    found = []
    for side in range(2):
        text = _words(rnd, 30) + part + _words(rnd, 30)
        symbols, starts, sizes = recompress(*_symbols(text))
        assert starts[0] == 0 and sizes.sum() == len(text) and (np.diff(starts) == sizes[:-1]).all()
        found.append(set(span_keys(text)[0].tolist()))
    assert len(found[0] & found[1]) >= 4


PAGE = """<!DOCTYPE html><html><head><title>{title} | Blatt</title><style>p {{}}</style></head><body><!-- x --><div class="nav"><a href=1>Start</a> | <a href=2>Sport</a></div>
<div class="main"><h1>{title}</h1><div class="by">Von {name}</div><ul><li>Teilen</li><li>Drucken</li></ul>{body}<div class="ad"><div>Anzeige</div></div></div>
<aside><h3>Mehr</h3><p>{teaser}</p></aside><div class="foot"><p>Impressum</p><p>Alle Rechte vorbehalten. Nachdruck nur mit Erlaubnis. Siehe AGB.</p></div></body></html>"""


def _pages(n=40):
    rnd = random.Random(1)
    pages, truth = [], {}
    for k in range(n):
        title = "Titel " + _words(rnd, 6)
        paragraphs = [_words(rnd, 25).capitalize() + ". " + _words(rnd, 20) + " &amp; mehr. Ende." for _ in range(4)]
        body = "".join(f"<p>{p}" + ("</p>" if k % 5 else "") for p in paragraphs[:2]) + f"<h2>Zwischen {k} titel {_words(rnd, 3)}</h2>" + "".join(f"<p>{p}</p>" for p in paragraphs[2:])
        body += f"<ul><li>Punkt {_words(rnd, 4)}</li></ul>"
        html = PAGE.format(title=title, name=_words(rnd, 2), body=body, teaser=_words(rnd, 12) + ".")
        pages.append((k, f"https://www.blatt.example/a/{k}", html))
        truth[k] = {block_key(b.text) for b in blocks("<div>" + f"<h1>{title}</h1>" + body + "</div>")}
    return pages, truth


def test_article_content(spark):
    pages, truth = _pages()
    extra = [(900, None, None), (901, "https://www.blatt.example/a/901", ""), (902, "u", "<p"), (None, "u", pages[0][2]), (1, pages[1][1], pages[1][2])]
    df = spark.createDataFrame(pages + extra, "page long, url string, html string").withColumn("site", F.lit("other"))
    texts = spark.createDataFrame([(0, "Impressum\n\n" + next(iter(blocks(pages[0][2]))).text + "\n" + "zzz"), (1, None), (7777, "x")], "page long, text string")
    rows = article_content(df, texts, "page", F.lit("blatt"), F.coalesce("url", F.lit("")), "html", "text").collect()
    got = {}
    for r in rows:
        if r.src_field == "html":
            got.setdefault(r.page, set()).add(r.block_key)
    assert got == truth
    assert len(rows) == len(set(rows))
    lines = article_content(df, spark.createDataFrame([(2, "Teilen\n\n" + "\n".join(b.text for b in blocks(pages[2][2])))], "page long, text string"), "page", F.lit("blatt"), F.col("url"), "html", "text")
    assert {r.block_key for r in lines.where("src_field = 'text'").collect()} == truth[2]
    empty = article_content(df.limit(0), texts.limit(0), "page", F.lit("blatt"), F.col("url"), "html", "text")
    assert empty.count() == 0


def _site(spark, pages):
    df = spark.createDataFrame([(k, f"/a/{k}", h) for k, h in enumerate(pages)], "page long, url string, html string")
    texts = spark.createDataFrame([], "page long, text string")
    got = {}
    for r in article_content(df, texts, "page", F.lit("s"), F.col("url"), "html", "text").collect():
        got.setdefault(r.page, set()).add(r.block_key)
    return got


def test_rare_layout_and_rare_headings(spark):
    rnd = random.Random(8)
    bodies = [[_words(rnd, 20) + ". " + _words(rnd, 20) + ". Ende." for _ in range(3)] for _ in range(200)]
    pages = []
    for k, body in enumerate(bodies):
        heading = "Fazit" if k in (10, 20, 30) else _words(rnd, 3)
        tag = "section" if k % 50 == 0 else "div"
        pages.append(f"<{tag} class='m{tag}'><h2>{heading}</h2>" + "".join(f"<p>{p}</p>" for p in body) + f"<ul><li>Teilen</li></ul></{tag}>")
    got = _site(spark, pages)
    for k, body in enumerate(bodies):
        assert {block_key(p) for p in body} <= got[k]
    assert all("Fazit" in got[k] for k in (10, 20, 30)) and "Teilen" not in set.union(*(got[k] for k in range(200) if k % 50))


def test_addresses_of_one_remainder_count_each(spark):
    rnd = random.Random(10)
    by_rest = {}
    for r in spark.range(200).select("id", F.pmod(F.xxhash64(F.concat(F.lit("/a/"), F.col("id").cast("string"))), F.lit(63)).alias("rest")).collect():
        by_rest.setdefault(r.rest, []).append(r.id)
    three = next(ids[:3] for ids in by_rest.values() if len(ids) > 2)
    full = [k for k in range(200) if k not in three][:30] + three
    pages = [f"<div class=m><h2>{'Mehr' if k in three else _words(rnd, 3)}</h2><p>{_words(rnd, 20)}. {_words(rnd, 20)}. Ende.</p></div>" if k in full else "" for k in range(200)]
    got = _site(spark, pages)
    assert len(got) == 33
    assert not any("Mehr" in found for found in got.values())


def test_one_sentence_paragraphs(spark):
    rnd = random.Random(9)
    bodies = [[_words(rnd, 20) + "." for _ in range(3)] for _ in range(20)]
    got = _site(spark, ["<div class=m>" + "".join(f"<p>{p}</p>" for p in body) + "</div>" for body in bodies])
    assert got == {k: {block_key(p) for p in body} for k, body in enumerate(bodies)}


def test_blocks():
    found = blocks("<table><tr><td>a<td>b<br>c</table><p>x <b>y</b> &auml;<p>z</div></p><li>1<li>2")
    assert [b.text for b in found] == ["a", "b", "c", "x y ä", "z", "1", "2"]
    assert [b.path for b in found][:2] == ["table/tr/td:0", "table/tr/td:1"]
    assert blocks(None) == [] and blocks("<script>if (a<b) {}</script>") == []
    assert block_key(" A-b_c 1ä!") == "Abc1ä"


@pytest.mark.parametrize("titled", [True, False])
def test_pages_without_article_have_no_rows(spark, titled):
    rnd = random.Random(11)
    pages, bodies = [], []
    for k in range(40):
        title = "Titel " + _words(rnd, 5)
        body = [_words(rnd, 18) + ". " + _words(rnd, 18) + ". " + _words(rnd, 9) + "." for _ in range(4)]
        head = f"<title>{title} | Blatt</title>" if titled else ""
        bodies.append({block_key(title), *map(block_key, body)})
        pages.append(f"{head}<body><div class=main><h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in body) + "</div></body>")
    for k in range(8):
        teasers = "".join(f"<p>{_words(rnd, 9)}.</p>" for _ in range(6))
        pages.append(("<title>Archiv | Blatt</title>" if titled else "") + f"<body><div class=main><h3>Mehr zum Thema</h3>{teasers}</div></body>")
    got = _site(spark, pages)
    assert set(got) == set(range(40))
    assert all(got[k] == bodies[k] for k in range(40))


def test_paths_bent_by_broken_markup_go_with_their_neighbours(spark):
    rnd = random.Random(14)
    bodies = [[_words(rnd, 20) + ". " + _words(rnd, 20) + ". Ende." for _ in range(3)] for _ in range(60)]
    # an unclosed container before the article on a few pages puts all paths one level deeper
    pages = [("<section class=x>" if k in (7, 8) else "") + "<div class=m>" + "".join(f"<p>{p}</p>" for p in body) + "</div>" for k, body in enumerate(bodies)]
    got = _site(spark, pages)
    assert all({block_key(p) for p in body} == got[k] for k, body in enumerate(bodies))
