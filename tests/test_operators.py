import json
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from textloom.functions import markup
from textloom.functions import words as fw
from textloom.operators import annotation, cooccurrence, deduplication, evaluation, filters, rating, relevance, retrieval, urls, wordlists
from textloom.operators.cleaning import SiteProfile, clean_pages, read_profile


def frame(spark, docs):
    return spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "doc_id long, tokens array<string>")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# Wordlists and relevance


def test_top_keeps_ties(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 2.0), ("d", 1.0), ("e", None)], "term string, score double")
    assert {r.term for r in wordlists.top_with_ties(df, "score", 2).collect()} == {"a", "b", "c"}
    assert wordlists.top_with_ties(df, "score", 99).count() == 4
    assert wordlists.top_with_ties(df.limit(0), "score", 2).count() == 0


def test_top_with_core(spark):
    df = spark.createDataFrame([(["a"], 3.0, 1), (["b"], 2.0, 1), (["c"], 1.0, 1)], "term array<string>, score double, n long")
    core = relevance.term_table(spark, ["c", ("x", "y")])
    got = {tuple(r.term): (r.score, r.n) for r in wordlists.top_with_core(df, core, "score", 1).collect()}
    assert got == {("a",): (3.0, 1), ("c",): (1.0, 1), ("x", "y"): (0.0, 0)}


def _brute_redundant(rows):
    seen, out = set(), []
    for term, _ in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True):
        subs = {term[i : i + n] for n in range(1, len(term) + 1) for i in range(len(term) - n + 1)}
        if not subs & seen:
            out.append(term)
        seen.add(term)
    return set(out)


def test_redundant_equals_brute_force(spark):
    rnd = random.Random(2)
    rows = [(tuple(rnd.choice("abcd") for _ in range(rnd.randint(1, 3))), float(rnd.randint(1, 5))) for _ in range(40)]
    df = spark.createDataFrame([(list(t), s) for t, s in rows], "term array<string>, score double")
    got = [tuple(r.term) for r in wordlists.without_redundant(df, "term", "score").collect()]
    assert set(got) == _brute_redundant(rows) and len(got) == len(set(got))


def test_relevance(spark):
    docs = frame(spark, [["a", "b", "x"], ["a", "c"], ["b", "x", "x"], ["x", "y"], ["y"], []])
    core = relevance.term_table(spark, ["a", "b"])
    counts = {r.term[0]: (r.term_count, r.cooc_count) for r in relevance.core_counts(docs, core).collect()}
    assert counts == {"a": (2, 1), "b": (2, 1)}
    base, term = relevance.baseline(docs, core)
    assert (base, term) == (0.5, ["a"])
    found = {r.term[0]: (r.term_count, r.cooc_count) for r in relevance.cooccurrence_counts(docs, core, 1, ["c"]).collect()}
    assert found == {"x": (3, 2)}
    score = relevance.relevance(relevance.cooccurrence_counts(docs, core, 1), base, "rqtrn").where("term[0] = 'x'").first().score
    assert abs(score - 100 * (2 / 3 - 0.5) / 0.5) < 1e-9
    with pytest.raises(ValueError):
        relevance.baseline(docs, relevance.term_table(spark, ["a"]))
    with pytest.raises(ValueError):
        relevance.baseline(docs, relevance.term_table(spark, ["a", "missing"]))
    assert relevance.baseline(docs, relevance.term_table(spark, ["a", "missing"]), strict=False) == (0.0, ["a"])
    with pytest.raises(ValueError):
        relevance.normal_terms(["a", ("a",)])
    with pytest.raises(TypeError):
        relevance.normal_terms([3])
    for metric, b in (("rqtr", 0), ("rqtrn", 1), ("other", 0.5)):
        with pytest.raises(ValueError):
            relevance.relevance(found_df(spark), b, metric)


def found_df(spark):
    return spark.createDataFrame([(["x"], 2, 1)], "term array<string>, term_count long, cooc_count long")


# Retrieval and evaluation


def test_retrieval(spark):
    docs = frame(spark, [["C++", "a.b", "x"], ["CCC", "aXb"], []])
    assert {r.doc_id for r in retrieval.match_wordlist(docs, ["C++"]).collect()} == {0}
    assert {r.doc_id for r in retrieval.match_wordlist(docs, ["a.b"]).collect()} == {0}
    assert {r.doc_id for r in retrieval.match_wordlist(docs, ["a.b"], escape=False).collect()} == {0, 1}
    assert retrieval.match_wordlist(docs, ["zz"], 0).count() == 3
    assert retrieval.match_wordlist(docs, [], 1).count() == 0 and retrieval.match_wordlist(docs, [], 0).count() == 3
    pmw = {r.doc_id: (r.n_hits, r.doc_len, r.pmw) for r in retrieval.match_wordlist_pmw(docs, ["x"], 1.0).collect()}
    assert pmw == {0: (1, 3, 1e6 / 3), 1: (0, 2, 0.0), 2: (0, 0, None)}
    order = retrieval.match_wordlist(frame(spark, [["a", "b", "c"]]), [("a",), ("a", "b")]).first().matches
    assert order == ["a"]
    assert retrieval.match_wordlist(frame(spark, [["a", "b", "c"]]), [("a", "b"), ("a",)]).first().matches == ["a b"]
    weighted = retrieval.match_weighted(frame(spark, [["a", "a", "b"]]), {"a": 1.5, ("b",): 1.0}, 0)
    assert weighted.first().weight == 4.0
    assert retrieval.match_weighted(frame(spark, [["a", "a", "b"]]), {"a": 1.5, ("b",): 1.0}, 0, unique=True).first().weight == 2.5
    texts = spark.createDataFrame([(1, "Größe GRÖßE"), (2, None)], "doc_id long, text string")
    assert retrieval.match_regex(texts, r"\bgröße\b", "text", ignore_case=True).first().n_hits == 2
    assert retrieval.match_regex(texts, "x", "text", 0).count() == 2
    assert retrieval.match_regex_pmw(texts, "Größe", "text", 1).first().doc_len == 2


def test_evaluation(spark):
    docs = spark.createDataFrame([(1, "1_hauptthema", "a"), (2, "2_nebenthema", "a"), (3, "3_kein_thema", "b"), (4, None, "b"), (5, "1_hauptthema", "c")], "doc_id long, label string, genre string")
    hits = spark.createDataFrame([(1, ["x"]), (3, ["y"])], "doc_id long, matches array<string>")
    rows = {r.topic: r for r in evaluation.evaluate_retrieval(docs, hits, "label").collect()}
    assert (rows["main"].tp, rows["main"].fp, rows["main"].fn, rows["main"].tn) == (1, 1, 1, 2)
    assert rows["main"].precision == rows["main"].recall == 0.5 and rows["main_or_side"].fn == 2
    assert {r.support + r.support_neg for r in evaluation.evaluate_retrieval(docs, hits, "label", "annotated").collect()} == {4}
    assert {r.genre for r in evaluation.evaluate_by_genre(docs, hits, "label", "genre").collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        evaluation.judged(docs, hits, "label", "x")
    scored = spark.createDataFrame([(3, True), (1, True), (2, False), (None, True)], "s int, g boolean")
    curve = {r.threshold: (r.tp, r.fp, r.fn) for r in evaluation.threshold_curve(scored, "s", F.col("g"), [1, 2, 3, 4]).collect()}
    assert curve == {1: (2, 1, 1), 2: (1, 1, 2), 3: (1, 0, 2), 4: (0, 0, 3)}
    assert {r.doc_id for r in evaluation.false_positives(docs, hits, "label", ["1_hauptthema"]).collect()} == {3}
    assert {r.doc_id for r in evaluation.false_negatives(docs, hits, "label", ["1_hauptthema"]).collect()} == {5}


# Urls


def _brute_bpe(words, rounds):
    state = [(list(w), n) for w, n in Counter(words).items()]
    merges = []
    for _ in range(rounds):
        pairs = Counter()
        for s, n in state:
            for p in zip(s, s[1:]):
                pairs[p] += n
        if not pairs:
            break
        (a, b), k = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        merges.append((a, b, k))
        new = []
        for s, n in state:
            out, i = [], 0
            while i < len(s):
                if s[i : i + 2] == [a, b]:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            new.append((out, n))
        state = new
    return merges, {tuple(s): n for s, n in state}


def test_byte_pairs_equal_brute_force(spark):
    words = ["aaab", "aab", "aaaa", "banana", "bandana", "", "x"] * 3 + ["anan"]
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    state, merges = urls.byte_pairs(df, "w", 8)
    want, strings = _brute_bpe([w for w in words if w], 8)
    assert merges == want and {tuple(r.symbols): r.n for r in state.collect()} == strings
    assert urls.byte_pairs(df.where("w = 'x'"), "w", 3)[1] == []


def test_byte_pairs_in_one_task_and_in_rounds(spark):
    words = ["artikel-2024-1?ref=a", "artikel-2024-12?ref=b", "aaaa", "aaaaa", "thema-7", "thema-77", "ä-2024"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    want, strings = _brute_bpe(words, 12)
    for most in (0, 1000):
        state, merges = urls.byte_pairs(df, "w", 12, most)
        assert merges == want and {tuple(r.symbols): r.n for r in state.collect()} == strings


def test_byte_pairs_of_many_strings_take_few_jobs(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("bdgklmnr") + rnd.choice("aeiou") for _ in range(3)) + f"-{i:05}" + "?ref=rss" * (i % 9 == 0) for i in range(3000)]
    df = spark.createDataFrame([(w,) for w in words + words[:50]], "w string").repartition(6)
    one, want = urls.byte_pairs(df, "w", 200)
    spark.sparkContext.setJobGroup("pairs", "byte pairs in rounds")
    try:
        state, merges = urls.byte_pairs(df, "w", 200, 8000)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("pairs")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert merges == want and len(want) == 200 and len(jobs) < 150
    assert {tuple(r.symbols): r.n for r in state.collect()} == {tuple(r.symbols): r.n for r in one.collect()}


def test_urls(spark):
    df = spark.createDataFrame([("http://a/b/c",), ("http://a/d/",), (None,)], "url string")
    assert {r.part: r.n for r in urls.path_part_counts(df, "url").collect()} == {"http:": 2, "": 2, "a": 2, "b": 1, "d": 1}
    assert {r.ending for r in urls.url_endings(df, "url").collect()} == {"c", "d"}
    share = urls.match_share(df, F.col("url").rlike("c$")).first()
    assert (share.n_matching, share.n_total) == (1, 3) and urls.match_share(df.limit(0), F.lit(True)).first().percentage == 0.0
    assert [r.x for r in df.select(urls.is_relevant(F.col("url"), ["/d/"]).alias("x")).collect()] == [True, False, True]
    days = spark.createDataFrame([("2024-01-02T03:04:05.000001",), ("2024-01-02T05:04:05.100000",), ("x",), (None,), ("2024-01-03T00:00:00.000000",)], "t string")
    assert {str(r.day): (r.n, r.is_peak) for r in urls.crawl_history(days, "t").collect()} == {"2024-01-02": (2, True), "2024-01-03": (1, False)}


# Duplicates and filters


def test_elements_and_dedup(spark):
    page = "<h1>T</h1><p>one <b>two</b><p>x</p><span>s</span><li>i"
    df = spark.createDataFrame([(1, page), (2, page.replace("one", "1")), (3, None), (4, "")], "id long, html string")
    found = deduplication.elements(df, "id", "html")
    assert [(r.name, r.text) for r in found.where("doc_id = 1").orderBy("pos").collect()] == [("h1", "T"), ("p", "one two"), ("p", "x"), ("span", "s"), ("li", "i")]
    dupl = {(r.name, r.text): r.n for r in deduplication.duplicate_elements(found).collect()}
    assert dupl == {("h1", "T"): 2, ("p", "x"): 2, ("span", "s"): 2, ("li", "i"): 2}
    texts = {r.doc_id: (r.text_deduped, r.n_removed) for r in deduplication.deduplicated_texts(found, deduplication.markup_repeated).collect()}
    assert texts[1] == ("T\n\none two\n\nx\n\ni", 1)
    long = spark.createDataFrame([(1, "<p>" + "word " * 50_000 + "</p>")], "id long, html string")
    assert deduplication.elements(long, "id", "html").count() == 1
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id long, u string")
    assert {r.id for r in deduplication.first_of(rows, F.col("u"), "id").collect()} == {1, 3}
    assert {r.id for r in deduplication.first_of(rows, F.col("u"), "id", keep_null=True).collect()} == {1, 3, 4}


def test_filters(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abcde"), (3, None), (4, "")], "id long, text string")
    stats = filters.length_stats(df, "text").first()
    assert (stats.n, stats["max"], stats["min"], stats["median"]) == (3, 5, 0, 3.0)
    assert {r.id for r in filters.without_lengths(df, "text", 3, "<").collect()} == {1, 2, 3}
    assert {r.id for r in filters.without_lengths(df, "text", 3, ">").collect()} == {1, 3, 4}
    with pytest.raises(ValueError):
        filters.beyond(F.lit(1), 2, "=")
    assert sum(r.n for r in filters.length_histogram(df, F.length("text"), 4).collect()) == 3
    assert filters.length_histogram(df.limit(0), F.length("text")).count() == 0
    common = spark.createDataFrame([("de", "und"), ("en", "and"), ("de", "die"), ("nl", "die")], "lang string, word string")
    texts = spark.createDataFrame([(1, "Und die"), (2, "and AND"), (3, "x"), (4, None), (5, "die")], "id long, text string")
    assert {r.doc_id: r.language for r in filters.detected_languages(texts, "id", "text", common).collect()} == {1: "de", 2: "en", 3: "Unknown", 4: "Unknown", 5: "de"}
    pairs = spark.createDataFrame([(1, ["geht", "geht", "x"], ["gehen", "gehen", "x"], "geht x neu"), (2, ["geht"], ["gang"], None), (3, ["a"], ["b", "c"], "a")], "id long, token array<string>, lemmas array<string>, text string")
    made = {r.doc_id: (r.token, r.lemmas) for r in filters.lemmatized(pairs, "id", "text", filters.lexicon(pairs, "token", "lemmas")).collect()}
    assert made == {1: (["geht", "x", "neu"], ["gehen", "x", "neu"]), 2: ([], []), 3: (["a"], ["a"])}


# Markup

PAGE = """<html><head><title>Title – Site</title><meta name="date" content="2024-02-28T01:02:03"><meta property='og:title' content='A'><meta name=keywords content="x, y;z ,">
<meta property="og:title" content="B"><meta property="article:content_tier" content="free"></head><body><nav><p>menu menu menu menu menu menu</p></nav><h1 class=a> Head <b>line</b></h1>
<div><h2>Sub</h2><p>First &amp; best paragraph of the article.<p>Second one, <a href=x>linked</a>.</p><ul><li>item</li></ul></div><img src="/i.jpg"><img alt=x><footer><p>imprint</p></footer></body></html>"""


def test_markup(spark):
    page = F.lit(PAGE)
    assert value(spark, markup.meta_map(page, ["date", "og:title"])) == {"date": "2024-02-28T01:02:03", "og:title": "B"}
    assert value(spark, markup.meta_map(F.lit(None).cast("string"))) == {}
    assert value(spark, markup.first_element_text(page, "h1")) == "Head line" and value(spark, markup.first_element_text(page, "h4")) is None
    assert value(spark, markup.image_links(page)) == ["/i.jpg"]
    assert value(spark, markup.meta_keywords(page)) == ["x", "y", "z"] and value(spark, markup.meta_keywords(page, "news_keywords")) == []
    assert value(spark, markup.tag_keywords(F.lit("""<meta property='"article:tag"' content='"KI"'>"""))) == ["KI"]
    assert value(spark, markup.in_february(markup.page_date(page))) is True
    assert value(spark, markup.in_february(F.to_date(F.lit("2024-02-29")))) is False and value(spark, markup.in_february(F.lit(None).cast("date"))) is False
    assert value(spark, markup.update_in_february(F.lit('<span id="last_update_1">05. Februar 2023</span>'))) is True
    assert value(spark, markup.update_in_february(F.lit("<span>05. Februar 2023</span>"))) is False
    html = value(spark, markup.main_html(page))
    assert html == "<html><body><h2>Sub</h2>\n<p>First &amp; best paragraph of the article.</p>\n<p>Second one, linked.</p>\n<li>item</li></body></html>"
    assert value(spark, markup.markup_to_text(F.lit(html))) == "Sub\n\nFirst & best paragraph of the article.\n\nSecond one, linked.\n\n- item"
    assert value(spark, markup.main_markdown(page)).startswith("## Sub\n\nFirst & best")
    assert value(spark, markup.main_html(F.lit("<div>no paragraph</div>"))) is None and value(spark, markup.main_html(F.lit(None).cast("string"))) is None
    assert value(spark, markup.main_html(F.lit("<title>T</title><p>only text</p>"))) == "<html><body><h1>T</h1>\n<p>only text</p></body></html>"


def test_markdown(spark):
    md = "# Head #1\nText **bold** and *it* and [link](http://x)\nnext  line\n\n* a\n- b\n\n\n\nend \\* and \\_x\\_"
    assert value(spark, fw.markdown_to_text(F.lit(md))) == "Head #1\n\nText bold and it and link next line\n\n* a\n- b\n\nend * and _x_"
    assert value(spark, fw.markdown_to_text(F.lit(""))) == ""


def test_words(spark):
    assert value(spark, fw.has_letter(F.lit("1ß"))) and not value(spark, fw.has_letter(F.lit("ß"), "en"))
    with pytest.raises(ValueError):
        fw.has_letter(F.lit("x"), "xx")
    term = F.array(F.lit("der"), F.lit("Hund"))
    assert value(spark, fw.edge_stopword(term, ["Der"])) and not value(spark, fw.edge_stopword(term, ["und"]))
    assert value(spark, fw.all_have_letters(term)) and not value(spark, fw.all_have_letters(F.array(F.lit("a"), F.lit("1"))))
    assert value(spark, F.lit("a (b) x c").rlike(fw.term_pattern(["a", "c"])))
    assert [value(spark, fw.formatted_size(F.lit(n))) for n in (0, 1023, 1024, 5 * 1024**3, 3 * 1024**5)] == ["0.00 B", "1023.00 B", "1.00 KB", "5.00 GB", "3072.00 TB"]


def test_cleaning(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u/a", PAGE), (2, "u/thema/x", PAGE), (3, "u/b", None), (4, "u/c", "<p></p>"), (5, "u/d", PAGE)], "page_id long, url string, html_content string")
    profile = SiteProfile(irrelevant=["/thema/"], metadata=["og:title", "h1"], checks=["is_february", "not_locked"], keywords="keywords")
    done = spark.createDataFrame([(5,)], "page_id long")
    (row,) = clean_pages(pages, profile, existing=done).collect()
    assert row.page_id == 1 and row.meta == {"og:title": "B", "h1": "Head line", "h2": "Sub"} and row.keywords == ["x", "y", "z"] and row.text.startswith("Sub\n\nFirst & best")
    with pytest.raises(AttributeError):
        SiteProfile(checks=["nothing"])
    path = tmp_path / "c.yaml"
    path.write_text("site:\n  irrelevant:\n  checks: [is_february]\n")
    assert read_profile(str(path), "site").checks == ["is_february"]
    with pytest.raises(KeyError):
        read_profile(str(path), "other")


# Rating


def test_alpha(spark):
    # worked example of the nominal and ordinal coefficient with missing values
    data = {
        "A": [1, 2, 3, 3, 2, 1, 4, 1, 2, None, None, None],
        "B": [1, 2, 3, 3, 2, 2, 4, 1, 2, 5, None, 3],
        "C": [None, 3, 3, 3, 2, 3, 4, 2, 2, 5, 1, None],
        "D": [1, 2, 3, 3, 2, 4, 4, 1, 2, 5, 1, None],
    }
    rows = [(str(k), who, str(v)) for who, values in data.items() for k, v in enumerate(values) if v is not None]
    votes = spark.createDataFrame(rows, "item string, rater string, label string")
    assert abs(rating.krippendorff_alpha(votes).first().alpha - 0.743) < 0.001
    assert abs(rating.krippendorff_alpha(votes, "ordinal").first().alpha - 0.815) < 0.001
    same = votes.where("label = '3'")
    assert rating.krippendorff_alpha(same).first().alpha is None
    assert rating.krippendorff_alpha(votes.limit(0)).first().n_pairable == 0
    with pytest.raises(ValueError):
        rating.krippendorff_alpha(votes, "interval")


def test_dawid_skene(spark):
    rnd = random.Random(1)
    truth, rows = {}, []
    for k in range(300):
        truth[str(k)] = t = rnd.choice(rating.CLASSES)
        for who, p in (("a", 0.95), ("b", 0.9), ("c", 0.55)):
            rows.append((str(k), who, t if rnd.random() < p else rnd.choice(rating.CLASSES)))
    estimated, errors = rating.dawid_skene(spark.createDataFrame(rows, "item string, rater string, label string"))
    got = estimated.collect()
    assert sum(truth[r["item"]] == r.label for r in got) > 0.9 * len(truth)
    assert all(abs(r.p1 + r.p2 + r.p3 - 1) < 1e-9 for r in got)
    right = {r.rater: 0.0 for r in errors.collect()}
    for r in errors.where("truth = given").collect():
        right[r.rater] += r.rate / 3
    assert right["a"] > right["b"] > right["c"]
    few = spark.createDataFrame(rows[:150], "item string, rater string, label string")
    a, ea = rating.dawid_skene(few, max_rounds=4)
    b, eb = rating.dawid_skene(few, max_rounds=4, driver_votes=0)
    assert {(r["item"], r.label, round(r.p1, 6), round(r.p2, 6)) for r in a.collect()} == {(r["item"], r.label, round(r.p1, 6), round(r.p2, 6)) for r in b.collect()}
    assert {(r.rater, r.truth, r.given, round(r.rate, 6)) for r in ea.collect()} == {(r.rater, r.truth, r.given, round(r.rate, 6)) for r in eb.collect()}
    experts = spark.createDataFrame([("0", "1_hauptthema", None), ("1", None, None)], "item string, a string, b string")
    assert rating.expert_disagreement(estimated, experts, ["a", "b"]).count() == 1
    assert rating.dawid_skene(spark.createDataFrame([], "item string, rater string, label string"))[0].count() == 0


def test_labels(spark):
    raw = [(" 2_Erwähnung", "2_nebenthema"), ("1_HAUPT", "1_hauptthema"), ("9_x", None), ("", None), (None, None), ("3_", "3_kein_thema")]
    df = spark.createDataFrame(raw, "l string, want string")
    assert all(r.want == r.got for r in df.select("want", rating.normal_label(F.col("l")).alias("got")).collect())
    assert [value(spark, rating.rank_of(F.lit(x))) for x in ("2_a", "x_a", "")] == [2, None, None]
    files = spark.createDataFrame([("/d/1_a/doc1.txt",), ("/d/3_b/doc1.txt",), ("/d/x/doc2.txt",), ("/d/2_c/doc3.txt",)], "path string")
    assert {r["item"]: r.label for r in rating.rankings_from_folders(files).collect()} == {"doc1": "3_kein_thema", "doc3": "2_nebenthema"}


# Annotation


def test_annotation(spark):
    schema = annotation.json_schema({"a": str, "b": bool, "c": list[int], "d": dict[str, float], "e": {"f": float}})
    assert schema["properties"]["c"] == {"type": "array", "items": {"type": "integer"}} and schema["required"] == ["a", "b", "c", "d", "e"]
    with pytest.raises(TypeError):
        annotation.json_schema({"a": set})
    prompt = annotation.Prompt("sys", "B ", " {{x}}E")
    assert value(spark, prompt.user_text(F.lit("doc"), x=F.lit("v"))) == "B doc vE" and value(spark, prompt.user_text(F.lit(None).cast("string"))) == "B  {{x}}E"
    df = spark.createDataFrame([("1", 'say "x"'), ("2", None)], "id string, text string")
    done = spark.createDataFrame([("2",)], "custom_id string")
    (row,) = annotation.batch_records(df, "id", prompt, F.col("text"), "m", done=done).collect()
    request = json.loads(row.request)
    assert request["params"]["messages"][0] == {"role": "user", "content": 'B say "x" {{x}}E'} and request["custom_id"] == "1"
    results = spark.createDataFrame([("1", "succeeded", True), ("2", "errored", None)], "custom_id string, result_type string, topic_ai boolean")
    got = annotation.aligned_results(df, "id", results, F.col("topic_ai"), F.col("result_type") == "succeeded")
    assert {r.custom_id: r.result for r in got.collect()} == {"1": "true", "2": "FAIL"}
    assert value(spark, annotation.token_cost(F.lit(1000), F.lit(10), batch=False)) == Decimal("0.003150000000")
    with pytest.raises(ValueError):
        annotation.token_cost(F.lit(1), F.lit(1), "other")
    assert value(spark, annotation.predicted(F.lit("{broken"), "topic_ai")) is False and value(spark, annotation.predicted(F.lit('{"topic_ai": true}'), "topic_ai")) is True
    labels = spark.createDataFrame([("1", "new")], "id string, label string")
    base = spark.createDataFrame([("1", "old"), ("1", ""), ("2", "keep")], "id string, label string")
    assert sorted(r.label for r in annotation.written_back(base, "id", labels, "label").collect()) == ["keep", "new", "new"]
    assert sorted(r.label for r in annotation.written_back(base, "id", labels, "label", overwrite=False).collect()) == ["keep", "new", "old"]
    record = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    assert value(spark, annotation.kept_keys(record, ["a"])) == {"a": 1} and value(spark, annotation.removed_keys(record, ["a"])) == {"b": 2}


def test_neighbours_across_partitions(spark):
    rows = [(k, f"t{k}" if k % 7 else None, "ab"[k % 3 == 0]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, g string").repartition(5)
    for group in ("g", None):
        got = {r.id: (r.previous_text, r.next_text) for r in annotation.with_neighbours(df, "id", "id", "text", group).collect()}
        for k, _, g in rows:
            mine = [r for r in rows if group is None or r[2] == g]
            at = [r[0] for r in mine].index(k)
            assert got[k] == (mine[at - 1][1] if at else None, mine[at + 1][1] if at + 1 < len(mine) else None)


def test_main_text_of_the_test_pages():
    """The main text against the articles' own markup, over all pages and layouts (tables and ``div`` too)."""
    import html
    import re
    from pathlib import Path

    import duckdb

    from textloom.functions.markup import main_elements

    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test tables")
    rows = duckdb.sql(f"select distinct on (page_id) html_content, text_html from '{folder}/raw_pages.parquet' join '{folder}/articles.parquet' using (page_id) where text_html is not null").fetchall()
    key = lambda x: "".join(re.findall(r"[^\W_]+", html.unescape(x)))[:48]
    wanted = found = more = 0
    for page, text in rows:
        truth = {key(x) for x in re.split("<[^>]*>", text)} - {""}
        got = {key(x) for _, x in main_elements(page)}
        assert got, "a page with an article has main text"
        wanted, found, more = wanted + len(truth), found + len(truth & got), more + len(got - truth)
    assert found >= 0.98 * wanted and more <= 0.05 * wanted


def test_main_text_of_layouts():
    from textloom.functions.markup import main_elements

    one, two = "Ein Satz steht hier, lang genug für Text. Noch einer.", "Der zweite Absatz steht in der Zelle. Er endet hier."
    table = f"<title>T | X</title><table><tr><td><a href=1>Start</a></td><td><div>T | X</div><div>Von Max</div><p>{one}</p><table><tr><td>1</td><td>2</td></tr></table><p>{two}</p></td></tr></table>"
    assert main_elements(table) == [("h1", "T | X"), ("p", one), ("p", two)]
    divs = f"<div><h2>T</h2><div>Von Max</div><ul><li>Teilen</li></ul><div class=a>{one}</div><div class=a>{two}</div><div>Ende</div></div>"
    assert main_elements(divs) == [("h2", "T"), ("p", one), ("p", two)]
    breaks = f"<div>{one}<br><br>{two}<br></div>"
    assert main_elements(breaks) == [("p", one), ("p", two)]


def test_dates_beside_metadata(spark):
    assert value(spark, markup.page_date(F.lit('<script>{"datePublished": "2023-02-05T10:00"}</script>'))).isoformat() == "2023-02-05"
    assert value(spark, markup.page_date(F.lit("<p>Stand: 7. März 2021, 12 Uhr</p>"))).isoformat() == "2021-03-07"
    assert value(spark, markup.page_date(F.lit("<p>am 3.2.2024</p>"))).isoformat() == "2024-02-03"
    assert value(spark, markup.page_date(F.lit("<p>am 33.2.2024</p>"))) is None
    assert value(spark, markup.update_in_february(F.lit('<span id="last_update">am 3.2.2024 geprüft, neu</span>'))) is True
    assert value(spark, markup.update_in_february(F.lit('<meta name="date" content="2024-02-05"><span id="last_update">29. Februar 2024</span>'))) is False


def test_records_of_a_chat_service(spark):
    import json

    prompt = annotation.Prompt("Judge.", "Text:", "Answer")
    assert (prompt.begin, prompt.end) == ("Text:\n", "Answer\n")
    assert annotation.Prompt("", "", "").begin == "" and annotation.Prompt("s", "a ", " b").end == " b"
    form = annotation.response_format("TopicAI", {"topic_ai": str, "sure": bool})
    assert form["json_schema"]["strict"] is True and form["json_schema"]["schema"]["required"] == ["topic_ai", "sure"]
    assert annotation.last_key({"a": int, "b": str}) == "b"
    df = spark.createDataFrame([("1", "x"), ("2", None), ("3", "z")], "id string, text string")
    done = spark.createDataFrame([("3",)], "custom_id string")
    rows = {r.custom_id: json.loads(r.request) for r in annotation.chat_records(df, "id", prompt, F.col("text"), "judge-1", form, done).collect()}
    assert set(rows) == {"1", "2"} and rows["1"]["body"]["response_format"] == form
    assert rows["1"]["body"]["messages"] == [{"role": "system", "content": "Judge."}, {"role": "user", "content": "Text:\nxAnswer\n"}]
    assert value(spark, annotation.token_cost(F.lit(10), F.lit(10), "opus", batch=False)) == 10 * (annotation.PRICES["opus"].input + annotation.PRICES["opus"].output)
    assert json.loads(value(spark, annotation.as_string(F.struct(F.lit("ä").alias("a"), F.lit(None).cast("int").alias("b"))))) == {"a": "ä", "b": None}


def test_search_terms(spark):
    from textloom.functions.searchterms import KI_REGEX_LLM, SUBJECTIVE_1, SUBJECTIVE_2

    docs = spark.createDataFrame([(1, ["Der", "Chatbot", "KI"], "Künstliche Intelligenz und Überwachtes Lernen"), (2, ["Haus"], "Ein Haus"), (3, ["ein", "Testbot"], "KI-Forschung")], "doc_id long, tokens array<string>, text string")
    assert {r.doc_id: r.n_hits for r in retrieval.match_wordlist(docs, SUBJECTIVE_1, 1, escape=False).collect()} == {1: 2, 3: 1}
    assert {r.doc_id: r.n_hits for r in retrieval.match_wordlist(docs, SUBJECTIVE_2, 1, escape=False).collect()} == {1: 1}
    assert {r.doc_id: len(r.matches) for r in retrieval.match_regex(docs, KI_REGEX_LLM, "text", 1).collect()} == {1: 2, 3: 1}


def test_unit_node_counts_equal_edges(spark):
    rows = [(1, ["a", "b", "a", "c", "x", "|", "x", "b", "b"]), (2, ["x", "x"]), (3, ["b", None, "x"]), (4, [])]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>").withColumn("tokens", F.filter("tokens", lambda w: w.isNotNull()))
    for twice in (True, False):
        edges = {(r.w, r.o): r.cnt for r in cooccurrence.unit_counts(docs, "|", twice).collect()}
        got = {r.term: r for r in cooccurrence.unit_node_counts(docs, "x", "|", twice).collect()}
        assert {t: r.total for t, r in got.items()} == {w: sum(n for (a, _), n in edges.items() if a == w) for w in {a for a, _ in edges}}
        assert {t: r.cnt for t, r in got.items() if r.cnt} == {o: n for (w, o), n in edges.items() if w == "x"}
        assert {t: r.back for t, r in got.items() if r.back} == {w: n for (w, o), n in edges.items() if o == "x"}


def test_nested_elements(spark):
    one = "<html><body><div><p>Teilen <b>jetzt</b></p><ul><li>A &amp; B</li><li>C</li></ul></div><p>Eigen eins</p><br></body></html>"
    two = "<div><p>Teilen <b>jetzt</b></p></div><p>Eigen zwei"
    df = spark.createDataFrame([(1, one), (2, two), (3, None), (4, "")], "doc long, html string")
    found = deduplication.nested_elements(df, "doc", "html")
    assert [(r.name, r.text) for r in found.where("doc_id = 1").orderBy("pos").collect()] == [
        ("html", "Teilen jetzt A & B C Eigen eins"), ("body", "Teilen jetzt A & B C Eigen eins"), ("div", "Teilen jetzt A & B C"), ("p", "Teilen jetzt"), ("b", "jetzt"),
        ("ul", "A & B C"), ("li", "A & B"), ("li", "C"), ("p", "Eigen eins"), ("br", ""),
    ]
    assert {(r.name, r.text, r.n) for r in deduplication.duplicate_elements(found).collect()} == {("p", "Teilen jetzt", 2), ("b", "jetzt", 2)}
    left = deduplication.without_elements(df, "doc", "html", lambda name, text, n: (name == "p") & (n > 1))
    assert {r.doc_id: (r.text_deduped, r.n_removed) for r in left.collect()} == {1: ("- A & B\n- C\n\nEigen eins", 1), 2: ("Eigen zwei", 1), 3: ("", 0), 4: ("", 0)}
    none = deduplication.without_elements(df, "doc", "html", lambda name, text, n: name == "html")
    assert none.where("doc_id = 1").first().text_deduped == ""


def test_language_model_on_held_out_documents(spark):
    from pathlib import Path

    from textloom.operators import filters

    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("no test tables")
    rows = spark.read.parquet(f"{folder}/documents.parquet").where("lang in ('de', 'en', 'fr', 'tr', 'es', 'nl') and length(text) >= 200")
    model = filters.language_model(rows.where("doc_id % 2 = 0"), "text", "lang")
    found = filters.classified_languages(rows.where("doc_id % 2 = 1"), "doc_id", "text", model).join(rows.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) > 200 and sum(r.language == r.lang for r in found) >= 0.9 * len(found)  # 6 % of the labels are wrong, 3 % of the texts in no language
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "1 2 3")], "doc_id long, text string")
    assert {(r.language, r.n_words) for r in filters.classified_languages(odd, "doc_id", "text", model).collect()} == {("Unknown", 0)}
    empty = filters.language_model(rows.limit(0), "text", "lang")
    assert {r.language for r in filters.classified_languages(odd, "doc_id", "text", empty).collect()} == {"Unknown"}
