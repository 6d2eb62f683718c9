"""Queries over the test tables, one or more for each operator, with their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import association, markup, searchterms
from ..functions import words as fw
from ..operators import annotation, cleaning, cooccurrence, corpus, deduplication, evaluation, filters, keyness, rating, relevance, retrieval, urls, wordlists
from ..session import cut_lineage, scratch_path, table
from ..sources import readers, writers
from .tables import RATERS, SOURCES, articles, core_terms, labelled_words, pages, ratings, stopwords, term_weights, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


_LATEST = "latest as (select * from articles where id is not null qualify row_number() over (partition by id order by ingested_at desc nulls last) = 1)"
_RATED = "rated as (select * from ratings where id is not null qualify row_number() over (partition by id order by ingested_at desc nulls last) = 1)"
_PAGES = "crawled as (select * from raw_pages where page_id is not null qualify row_number() over (partition by page_id order by ingested_at desc nulls last) = 1)"
_DOCS = f"""{_LATEST}, docs as (select id as doc_id, source, url, og_title, og_description, text, text_deduped,
  list_filter(list_transform(coalesce(lemmas, []), lambda x: trim(x, ' ' || chr(160) || chr(9))), lambda x: x is not null and regexp_matches(x, '[a-zA-ZäÄÜüÖöß]')) as tokens from latest)"""
_RAW = f"{_LATEST}, raw as (select id as doc_id, list_filter(list_transform(coalesce(lemmas, []), lambda x: trim(x, ' ' || chr(160) || chr(9))), lambda x: x is not null) as tokens from latest)"


def _label(column: str) -> str:
    return f"case when lower(trim({column})) like '1\\_%' escape '\\' then '1_hauptthema' when lower(trim({column})) like '2\\_%' escape '\\' then '2_nebenthema' when lower(trim({column})) like '3\\_%' escape '\\' then '3_kein_thema' end"


_GOLD = f"{_RATED}, gold as (select id as doc_id, {_label('gold_label')} as label from rated)"
_ENCODED = "case when len(tokens) > 0 then '__' || array_to_string(tokens, '____') || '__' else '' end"
_PATTERN = "(select string_agg('__' || array_to_string(term, '____') || '__', '|' order by ord) from wordlist)"
_HITS = f"""{_DOCS}, hits as (
  select doc_id, tokens, list_transform(regexp_extract_all({_ENCODED}, {_PATTERN}), lambda m: trim(regexp_replace(m, '__+', ' ', 'g'))) as matches from docs)"""
_SPLIT = f"""{_HITS}, study as (select doc_id, tokens from hits where len(matches) >= 2), reference as (select doc_id, tokens from hits where len(matches) < 2)"""


def _grams(docs: str, n: int) -> str:
    joined = " || ' ' || ".join(f"tokens[i + {k}]" if k else "tokens[i]" for k in range(n))
    return f"(select doc_id, {joined} as term from {docs}, unnest(range(1, len(tokens) - {n - 2})) as u(i))"


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns or ("term",):
        df = df.withColumn(c, F.array_join(c, " "))
    return df


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Sources and sinks


@query(f"""with {_DOCS} select doc_id, case when contains(url, 'tagesecho.example') then 'tagesecho' when contains(url, 'wissensblatt.example') then 'wissensblatt'
  when contains(url, 'forumtechnik.example') then 'forumtechnik' else 'other' end as source, len(tokens) as n_tokens from docs""")
def source_load_corpus(spark, folder):
    docs = words(spark, folder, "url")
    return docs.select("doc_id", fw.chained_source(F.col("url"), SOURCES).alias("source"), F.size("tokens").alias("n_tokens"))


@query(f"with {_LATEST} select id from latest order by md5('7:' || id), id limit 50")
def source_reference_sample(spark, folder):
    return readers.reference_sample(articles(spark, folder).select("id"), "id", 50, seed=7)


@query("select distinct source from articles")
def source_distinct_values(spark, folder):
    return readers.distinct_values(table(spark, folder, "articles"), "source")


@query("""with s as (select count(*) as n_files, sum(octet_length(encode(html_content))) as n_bytes from raw_pages)
  select n_files, n_bytes, case when n_bytes < 1024 then printf('%.2f B', n_bytes::double) when n_bytes < 1048576 then printf('%.2f KB', n_bytes / 1024.0::double)
  when n_bytes < 1073741824 then printf('%.2f MB', n_bytes / 1048576.0::double) else printf('%.2f GB', n_bytes / 1073741824.0::double) end as size from s""")
def source_sizes(spark, folder):
    return readers.file_totals(table(spark, folder, "raw_pages").select(F.octet_length("html_content").alias("length")))


@query("select string_agg(array_to_string(term, ' '), ' | ' order by ord) as query from wordlist")
def sink_query_string(spark, folder):
    return wordlists.query_string(table(spark, folder, "wordlist"))


@query(f"with {_LATEST} select id, 'doc_' || lpad(row_number() over (order by id)::varchar, length((select count(*) from latest)::varchar)::int, '0') as name from latest")
def sink_padded_index(spark, folder):
    return writers.with_padded_index(articles(spark, folder).select("id"), "id", "name", "doc_")


@query(f"""with {_RATED} select url, id, pub_date as "date", og_title as "og:title", og_description as "og:description", h1, h2, time_crawled, expert_annotator_1,
  expert_annotator_2, student_annotator_1, student_annotator_2, gold_label as label, claude37_label as "claude3.7_label", gpt4o_label from rated""")
def sink_table_rows(spark, folder):
    rows = ratings(spark, folder, "url", "pub_date", "og_title", "og_description", "h1", "h2", "time_crawled", *RATERS, "gold_label", "claude37_label", "gpt4o_label")
    names = {"pub_date": "date", "id": "filename", "og_title": "og:title", "og_description": "og:description", "claude37_label": "Claude_0shot", "gpt4o_label": "GPT4o"}
    return writers.table_rows(rows.withColumnsRenamed(names))


@query(f"with {_LATEST}, {_GOLD} select l.id, coalesce(g.label, 'none') as label from latest l left join gold g on l.id = g.doc_id")
def sink_write_back(spark, folder):
    base = articles(spark, folder).select("id", F.lit("none").alias("label"))
    gold = ratings(spark, folder, "gold_label").select("id", rating.normal_label(F.col("gold_label")).alias("label"))
    return annotation.written_back(base, "id", gold, "label")


@query("select source as key, count(*) as n, 1 as run from documents group by source union all by name select source as key, count(*) as n, 'b' as note from articles group by source")
def sink_append_run(spark, folder):
    first = table(spark, folder, "documents").groupBy(F.col("source").alias("key")).agg(F.count("*").alias("n"), F.lit(1).alias("run"))
    second = table(spark, folder, "articles").groupBy(F.col("source").alias("key")).agg(F.count("*").alias("n"), F.lit("b").alias("note"))
    return writers.append_run(first, second)


# Pages and markup


@query(f"with {_LATEST} select id, url, h1, text from latest where url is not null")
def sink_json_round_trip(spark, folder):
    path = scratch_path(spark)
    rows = articles(spark, folder, "url", "h1", "text").where(F.col("url").isNotNull()).select("id", "url", "h1", "text")
    writers.write_json(rows.where(F.length("id") % 2 == 0), path, overwrite=True)
    writers.copy_corpus(rows.withColumn("more", F.lit(1)), path, ["id", "url", "h1", "text"], spark.read.schema(rows.schema).json(path))
    return spark.read.schema(rows.schema).json(path)


@query(f"with {_LATEST} select id, url, coalesce(og_title, '') as title, coalesce(text, '') as text from latest where url is not null")
def sink_table_round_trip(spark, folder):
    path = scratch_path(spark)
    rows = articles(spark, folder, "url", "og_title", "text").where(F.col("url").isNotNull())
    writers.write_table(writers.table_rows(rows, {"id": "id", "url": "url", "og_title": "title", "text": "text"}), path)
    return readers.read_table(spark, path).select("id", "url", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "text")])


@query(f"with {_LATEST} select id, url from latest where not coalesce(regexp_matches(url, 'seite-[0-9]+|tagesecho|\\.example:[0-9]+'), false)")
def source_patterns(spark, folder):
    path = scratch_path(spark)
    spark.createDataFrame([("seite-[0-9]+\ntagesecho\n\n\\.example:[0-9]+",)], "value string").write.text(path)
    return articles(spark, folder, "url").where(urls.is_relevant(F.col("url"), [readers.read_patterns(spark, path)])).select("id", "url")


@query("select custom_id, result_type, case when result_type = 'succeeded' then topic_ai end as topic_ai, case when result_type = 'succeeded' then input_tokens end as input_tokens from llm_results")
def source_batch_results(spark, folder):
    path = scratch_path(spark)
    message = F.struct(F.array(F.struct(F.struct("topic_ai").alias("input"))).alias("content"), F.struct("input_tokens", "output_tokens").alias("usage"))
    result = F.struct(F.col("result_type").alias("type"), F.when(F.col("result_type") == "succeeded", message).alias("message"))
    table(spark, folder, "llm_results").select(F.to_json(F.struct("custom_id", result.alias("result"))).alias("value")).write.text(path)
    return readers.read_batch_output(spark, path).select("custom_id", "result_type", "topic_ai", "input_tokens")


@query("select (row_number() over (order by ord) - 1)::int as ord, array_to_string(term, ' ') as term from wordlist")
def sink_wordlist_round_trip(spark, folder):
    path = scratch_path(spark)
    writers.write_wordlist(table(spark, folder, "wordlist"), path)
    return readers.read_wordlist(spark, path).select("ord", F.array_join("term", " ").alias("term"))


@query(f"""with {_PAGES} select page_id, nullif(regexp_extract(html_content, '<meta property="og:title" content="([^"]*)"', 1), '') as og_title,
  nullif(regexp_extract(html_content, '<meta name="date" content="([^"]*)"', 1), '') as date from crawled""")
def html_meta(spark, folder):
    rows = pages(spark, folder, "html_content").select("page_id", markup.meta_map(F.col("html_content"), ["og:title", "date"]).alias("m"))
    return rows.select("page_id", F.try_element_at("m", F.lit("og:title")).alias("og_title"), F.try_element_at("m", F.lit("date")).alias("date"))


def _element_sql(name: str) -> str:
    inner = f"regexp_extract(coalesce(html_content, ''), '(?is)<{name}\\b[^>]*>(.*?)</{name}\\s*>', 1)"
    return f"nullif(trim(regexp_replace(regexp_replace({inner}, '<[^>]*>', '', 'g'), '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')), '')"


@query(f"with {_PAGES} select page_id, {_element_sql('h1')} as h1, {_element_sql('h2')} as h2 from crawled")
def html_headings(spark, folder):
    rows = pages(spark, folder, "html_content")
    return rows.select("page_id", *[markup.first_element_text(F.col("html_content"), n).alias(n) for n in ("h1", "h2")])


@query(f"""with {_PAGES} select page_id, nullif(regexp_extract(t, '(?is)\\ssrc\\s*=\\s*"([^"]*)"', 1), '') as src
  from crawled, unnest(regexp_extract_all(html_content, '(?is)<img\\b[^>]*>')) as u(t) where nullif(regexp_extract(t, '(?is)\\ssrc\\s*=\\s*"([^"]*)"', 1), '') is not null""")
def html_images(spark, folder):
    return pages(spark, folder, "html_content").select("page_id", F.explode(markup.image_links(F.col("html_content"))).alias("src"))


@query(f"""with {_LATEST}, joined as (select id, array_to_string(keywords, ';') as k from latest where keywords is not null)
  select id, trim(x) as keyword from joined, unnest(regexp_split_to_array(k, '[,;]')) as u(x) where trim(x) <> ''""")
def html_keyword_items(spark, folder):
    rows = articles(spark, folder, "keywords").where(F.col("keywords").isNotNull())
    return rows.select("id", F.explode(fw.keyword_items(F.array_join("keywords", ";"))).alias("keyword"))


@query(f"""with {_PAGES}, dated as (select page_id, try_cast(regexp_extract(html_content, '<meta name="date" content="(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) as date) as d from crawled)
  select page_id, d as date, coalesce(year(d) between 2020 and 2025 and month(d) = 2 and day(d) <= 28, false) as february from dated""")
def html_february(spark, folder):
    rows = pages(spark, folder, "html_content").select("page_id", markup.page_date(F.col("html_content")).alias("date"))
    return rows.withColumn("february", markup.in_february(F.col("date")))


@query(f"""with {_LATEST} select id, not coalesce(contains(text, '© dpa-infocom'), false) as not_agency, not coalesce(regexp_matches(url, '/seite-[0-9]+'), false) as not_multipage,
  true as not_locked from latest""")
def html_checks(spark, folder):
    rows = articles(spark, folder, "text", "url")
    return rows.select("id", filters.not_agency(F.col("text")).alias("not_agency"), filters.not_multipage(F.col("url")).alias("not_multipage"), filters.not_locked(F.lit(None).cast("string")).alias("not_locked"))


@query(f"""with {_LATEST}, k as (select id, list_filter(keywords, lambda x: x is not null) as k from latest where keywords is not null)
  select id, 'keywords' as kind, trim(x) as item from k, unnest(regexp_split_to_array(array_to_string(k, ';'), '[,;]')) as u(x) where trim(x) <> ''
  union all select id, 'tag', x from k, unnest(k) as u(x)""")
def html_meta_keywords(spark, folder):
    rows = articles(spark, folder, "keywords").where(F.col("keywords").isNotNull()).withColumn("k", F.array_compact("keywords"))
    named = F.concat(F.lit('<meta content="'), F.array_join("k", ";"), F.lit('" name="keywords"><meta name="news_keywords" content="x">'))
    tags = F.array_join(F.transform("k", lambda x: F.concat(F.lit("""<meta property='\\"article:tag\\"' content='\\\""""), x, F.lit("""\\"'>"""))), "")
    parts = [rows.select("id", F.lit(kind).alias("kind"), F.explode(found).alias("item")) for kind, found in (("keywords", markup.meta_keywords(named)), ("tag", markup.tag_keywords(tags)))]
    return parts[0].unionByName(parts[1])


@query(f"""with {_LATEST} select id, lpad(((len(url) % 31) + 1)::varchar, 2, '0') || case when len(url) % 2 = 0 then ' Februar ' else ' März ' end || (2018 + len(url) % 9) as day,
  (len(url) % 31) + 1 <= 28 and len(url) % 2 = 0 and 2018 + len(url) % 9 between 2020 and 2025 as updated, coalesce(source, '') <> 'tagesecho' as free from latest where url is not null""")
def html_page_checks(spark, folder):
    rows = articles(spark, folder, "url", "source").where(F.col("url").isNotNull())
    n = F.length("url")
    day = F.concat(F.lpad((n % 31 + 1).cast("string"), 2, "0"), F.when(n % 2 == 0, F.lit(" Februar ")).otherwise(F.lit(" März ")), (2018 + n % 9).cast("string"))
    tier = F.when(F.col("source") == "tagesecho", F.lit("locked")).otherwise(F.coalesce("source", F.lit("")))
    page = F.concat(F.lit('<meta name="article:content_tier" content="'), tier, F.lit('"><span class=x id="a_last_update_b">'), F.replace(day, F.lit(" F"), F.lit(". F")), F.lit("</span>"))
    return rows.select("id", day.alias("day"), cleaning.CHECKS["update_is_february"](page).alias("updated"), cleaning.CHECKS["not_locked"](page).alias("free"))


@query()
def html_clean_pages(spark, folder):
    profile = cleaning.SiteProfile(irrelevant=["/thema/"], metadata=["og:title", "date"], getters=["h1", "h2"])
    made = cleaning.clean_pages(pages(spark, folder, "url", "html_content"), profile)
    return made.select("page_id", F.try_element_at("meta", F.lit("h1")).alias("h1"), F.map_keys("meta").alias("meta_keys"), "text_html", "text")


@query(f"""with {_LATEST}, a as (select id, text_html as t from latest where text_html is not null),
  b as (select id, regexp_replace(regexp_replace(t, '\\s+', ' ', 'g'), '<li>', chr(10) || '- ', 'g') as t from a),
  c as (select id, regexp_replace(regexp_replace(t, '</?(p|h[1-6]|div|ul|ol|body|html)>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g') as t from b),
  d as (select id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') as t from c)
  select id, trim(regexp_replace(regexp_replace(regexp_replace(t, ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) as text from d""")
def html_to_text(spark, folder):
    rows = articles(spark, folder, "text_html").where(F.col("text_html").isNotNull())
    return rows.select("id", markup.markup_to_text(F.col("text_html")).alias("text"))


@query(f"""with {_LATEST} select id, h1 || chr(10) || chr(10) || 'see here ' || rtrim(og_description) || chr(10) || '- an item' as text from latest where h1 is not null and og_description is not null""")
def html_markdown_to_text(spark, folder):
    rows = articles(spark, folder, "h1", "og_description").where(F.col("h1").isNotNull() & F.col("og_description").isNotNull())
    md = F.concat(F.lit("## "), F.col("h1"), F.lit("\n**see**  [here](https://a.example/_x_)\n"), F.lit("*"), F.col("og_description"), F.lit("*\n- an item\n\n\n"))
    return rows.select("id", fw.markdown_to_text(md).alias("text"))


# Urls and the crawl


@query("select part, count(*) as n from (select unnest(list_slice(string_split(url, '/'), 1, -2)) as part from raw_pages where url is not null) group by part")
def url_path_parts(spark, folder):
    return urls.path_part_counts(table(spark, folder, "raw_pages"), "url")


@query("select distinct case when url like '%/' then string_split(url, '/')[-2] else string_split(url, '/')[-1] end as ending from raw_pages where url is not null")
def url_endings(spark, folder):
    return urls.url_endings(table(spark, folder, "raw_pages"), "url")


@query()
def url_byte_pairs(spark, folder):
    ends = urls.url_endings(table(spark, folder, "raw_pages"), "url")
    return urls.common_byte_pairs(ends, "ending", 1000, 5)


@query("select page_id, url from raw_pages where regexp_matches(url, '/thema/|[?]ref=')")
def url_matching(spark, folder):
    return urls.matching(table(spark, folder, "raw_pages"), "url", "/thema/|[?]ref=").select("page_id", "url")


@query("select page_id, not coalesce(regexp_matches(url, '/thema/|[?]ref='), false) as relevant from raw_pages")
def url_relevant(spark, folder):
    return table(spark, folder, "raw_pages").select("page_id", urls.is_relevant(F.col("url"), ["/thema/", "[?]ref="]).alias("relevant"))


@query("select count(*) filter (where regexp_matches(url, '/thema/')) as n_matching, count(*) as n_total, 100.0::double * count(*) filter (where regexp_matches(url, '/thema/')) / count(*) as percentage from raw_pages")
def url_match_share(spark, folder):
    return urls.match_share(table(spark, folder, "raw_pages"), F.col("url").rlike("/thema/"))


@query("""with days as (select try_strptime(time_crawled, '%Y-%m-%dT%H:%M:%S.%f')::date as day from raw_pages), n as (select day, count(*) as n from days where day is not null group by day)
  select day, n, n = (select max(n) from n) as is_peak from n""")
def crawl_history(spark, folder):
    return urls.crawl_history(table(spark, folder, "raw_pages"), "time_crawled")


# Duplicates

_TAGS = "p|li|h1|h2|h3|h4|td|span"
# begins and ends of the listed tags become private-use marks, other tags blanks
_ELEMENTS = f"""{_PAGES}, marked as (select page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html_content, ''), '(?i)<({_TAGS})\\b[^>]*>', chr(57344) || '\\1' || chr(57345), 'g'),
    '(?i)</({_TAGS})\\b[^>]*>', chr(57346), 'g'), '<[^>]*>', ' ', 'g') as t from crawled),
  tags as (select page_id, pos, e from marked, unnest(regexp_extract_all(t, '\\x{{e000}}[A-Za-z0-9]+\\x{{e001}}[^\\x{{e000}}\\x{{e002}}]*')) with ordinality as u(e, pos)),
  found as (select page_id as doc_id, pos, lower(regexp_extract(e, '\\x{{e000}}(\\w+)', 1)) as name, trim(regexp_replace(split_part(e, chr(57345), 2), '[\\s\\x{{a0}}]+', ' ', 'g')) as text from tags),
  elements as (select * from found where text <> ''),
  counts as (select name, text, count(*) as n from elements group by name, text having count(*) >= 2)"""
_GONE = "(name in ('span', 'td') or (name = 'p' and length(text) - length(replace(text, ' ', '')) > 10 and coalesce(n, 0) > 2) or (name in ('h1', 'h2', 'h3', 'p') and coalesce(n, 0) > 5))"


def _page_elements(spark, folder):
    return deduplication.elements(pages(spark, folder, "html_content"), "page_id", "html_content")


@query(f"with {_ELEMENTS} select name, text, n from counts")
def dedup_elements(spark, folder):
    return deduplication.duplicate_elements(_page_elements(spark, folder))


@query(f"with {_ELEMENTS} select name, text, n, {_GONE} as removed from counts")
def dedup_split(spark, folder):
    gone, kept = deduplication.split_elements(deduplication.duplicate_elements(_page_elements(spark, folder)), deduplication.markup_repeated)
    return gone.withColumn("removed", F.lit(True)).unionByName(kept.withColumn("removed", F.lit(False)))


@query(f"with {_ELEMENTS} select name, text, n from counts where name = 'p' and n > 3")
def dedup_paragraphs(spark, folder):
    return deduplication.split_elements(deduplication.duplicate_elements(_page_elements(spark, folder)), deduplication.paragraph_repeated)[0]


@query(f"""with {_ELEMENTS} select doc_id, coalesce(string_agg(text, chr(10) || chr(10) order by pos) filter (where not {_GONE}), '') as text_deduped, count(*) filter (where {_GONE}) as n_removed
  from elements left join counts using (name, text) group by doc_id""")
def dedup_texts(spark, folder):
    return deduplication.deduplicated_texts(_page_elements(spark, folder), deduplication.markup_repeated)


@query(f"with {_ELEMENTS} select distinct text from counts where {_GONE}")
def dedup_removed_text(spark, folder):
    gone, _ = deduplication.split_elements(deduplication.duplicate_elements(_page_elements(spark, folder)), deduplication.markup_repeated)
    return deduplication.removed_texts(gone)


_ALL_ELEMENTS = " union all ".join(
    f"select id, '{name}' as name, unnest(regexp_extract_all(text_html, '(?s)<{name}>(.*?)</{name}>', 1)) as inside from latest where text_html is not null" for name in ("html", "body", "h1", "h2", "p", "li")
)
_NESTED = f"""{_LATEST}, found as ({_ALL_ELEMENTS}),
  nested as (select id, name, array_to_string(list_filter(list_transform(string_split_regex(inside, '<[^>]*>'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> ''), ' ') as text from found)"""


@query(f"with {_NESTED} select name, text, count(*) as n from nested group by all having count(*) >= 2")
def dedup_nested_elements(spark, folder):
    rows = articles(spark, folder, "text_html").where(F.col("text_html").isNotNull())
    return deduplication.duplicate_elements(deduplication.nested_elements(rows, "id", "text_html"))


@query("select doc_id from documents qualify row_number() over (partition by text order by doc_id) = 1")
def dedup_exact_texts(spark, folder):
    return deduplication.first_of(table(spark, folder, "documents").select("doc_id", "text"), F.col("text"), "doc_id").select("doc_id")


@query("select page_id from (select distinct page_id, url from raw_pages) qualify url is null or row_number() over (partition by url order by page_id) = 1")
def dedup_urls(spark, folder):
    rows = table(spark, folder, "raw_pages").select("page_id", "url").distinct()
    return deduplication.first_of(rows, F.col("url"), "page_id", keep_null=True).select("page_id")


# Filters


@query("select count(length(text)) as n, avg(length(text)) as mean, quantile_cont(length(text), 0.5) as median, max(length(text)) as max, min(length(text)) as min from documents")
def filter_length_stats(spark, folder):
    return filters.length_stats(table(spark, folder, "documents"), "text")


@query("""with v as (select length(text)::double as v from documents where text is not null), e as (select min(v) as lo, max(v) as hi from v),
  b as (select lo as l, hi, case when hi = lo then 0 else least(floor((v - lo) / ((hi - lo) / 100)), 99)::int end as bin from v, e)
  select bin, l + bin * (hi - l) / 100 as lo, count(*) as n from b group by bin, l, hi""")
def filter_length_histogram(spark, folder):
    return filters.length_histogram(table(spark, folder, "documents"), F.length("text"))


@query("select doc_id from documents where not coalesce(length(text) < 300, false) and not coalesce(length(text) > 5000, false)")
def filter_lengths(spark, folder):
    rows = filters.without_lengths(table(spark, folder, "documents"), "text", 300, "<")
    return filters.without_lengths(rows, "text", 5000, ">").select("doc_id")


@query("select doc_id, (u.k - 1)::int as par_no, length(p) as n_chars from documents, unnest(string_split(text, chr(10) || chr(10))) with ordinality as u(p, k)")
def filter_paragraph_lengths(spark, folder):
    return filters.paragraph_lengths(table(spark, folder, "documents"), "doc_id", "text")


@query("""select doc_id from documents where not coalesce(list_sum(list_transform(string_split(text, chr(10) || chr(10)), lambda p: length(p))) / len(string_split(text, chr(10) || chr(10))) < 80, false)""")
def filter_paragraph_means(spark, folder):
    return filters.without_paragraph_lengths(table(spark, folder, "documents"), "text", 80, "<").select("doc_id")


_DETECTED = """hits as (select doc_id, lang, count(*) as k from (select doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) as word from documents) join (select distinct lang, lower(word) as word from common_words) using (word) group by all),
  best as (select doc_id, lang, k from hits qualify row_number() over (partition by doc_id order by k desc, lang) = 1),
  detected as (select d.doc_id, coalesce(b.lang, 'Unknown') as language, coalesce(k, 0) as n_words from documents d left join best b using (doc_id))"""


@query(f"with {_DETECTED} select doc_id, language, n_words from detected")
def filter_detected_languages(spark, folder):
    return filters.detected_languages(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "common_words"))


_LANGUAGE_MODEL = """labelled as (select lower(trim(lang)) as language, text from documents where lower(trim(lang)) in ('de', 'en', 'fr', 'tr', 'es', 'nl')),
  counts as (select language, word, count(*) as k from labelled, unnest(regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+')) as u(word) group by all),
  known as (select distinct word from (select *, row_number() over (partition by language order by k desc, word) as r from counts) where r <= 5000),
  totals as (select language, sum(k) as total from counts semi join known using (word) group by language),
  model as (select w.word, t.language, ln((coalesce(k, 0) + 1) / (total + (select count(*) from known))) as logp from known w cross join totals t left join counts c on c.word = w.word and c.language = t.language)"""


@query(f"""with {_LATEST}, {_LANGUAGE_MODEL}, words as (select id, word, count(*) as k from latest, unnest(regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+')) as u(word) group by all),
  scores as (select id, language, sum(k * logp) as score, sum(k)::bigint as n_words from words join model using (word) group by all),
  ranked as (select *, row_number() over w as r, lead(score) over w as second from scores window w as (partition by id order by round(score, 6) desc, language))
  select l.id as doc_id, coalesce(language, 'Unknown') as language, coalesce(n_words, 0) as n_words, round(coalesce((score - second) / n_words, 0), 6) as margin from latest l left join (select * from ranked where r = 1) using (id)""")
def filter_classified_languages(spark, folder):
    label = F.lower(F.trim("lang"))
    labelled = table(spark, folder, "documents").select("text", F.when(label.isin("de", "en", "fr", "tr", "es", "nl"), label).alias("language"))
    model = cut_lineage(filters.language_model(labelled, "text", "language"))
    return _rounded(filters.classified_languages(articles(spark, folder, "text"), "id", "text", model), "margin")


@query(f"with {_DETECTED} select doc_id from documents where doc_id not in (select doc_id from detected where language in ('de', 'en'))")
def filter_languages(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = filters.detected_languages(docs, "doc_id", "text", table(spark, folder, "common_words"))
    return filters.with_languages(docs, "doc_id", found, ["de", "en"], keep=False).select("doc_id")


@query("select doc_id from documents where coalesce(contains(text, 'Roboter'), false)")
def filter_custom(spark, folder):
    return filters.apply_removal(table(spark, folder, "documents"), F.contains(F.col("text"), F.lit("Roboter"))).select("doc_id")


_LEXICON = f"""{_LATEST}, pairs as (select token[i] as word, lemmas[i] as lemma from latest, unnest(range(1, len(token) + 1)) as u(i) where len(token) = len(lemmas)),
  lexicon as (select word, lemma from (select word, lemma, count(*) as k from pairs where word is not null and lemma is not null group by all) qualify row_number() over (partition by word order by k desc, lemma) = 1)"""


@query(f"""with {_LATEST}, named as (select id, id || case when len(url) % 3 = 0 then '_deduped.json' else '.json' end as file, text from latest)
  select id, file from named where len(text) >= 500 or contains(file, 'deduped')""")
def filter_custom_files(spark, folder):
    rows = articles(spark, folder, "url", "text").withColumn("file", F.concat("id", F.when(F.length("url") % 3 == 0, F.lit("_deduped.json")).otherwise(F.lit(".json"))))
    return filters.apply_removal(rows, F.length("text") >= 500, "file").select("id", "file")


@query(f"with {_LEXICON} select word, lemma from lexicon")
def filter_lexicon(spark, folder):
    return filters.lexicon(articles(spark, folder, "token", "lemmas"), "token", "lemmas")


@query(f"""with {_LEXICON}, w as (select id as doc_id, k, word from latest, unnest(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_]+')) with ordinality as u(word, k)),
  l as (select doc_id, array_to_string(list(word order by k), ' ') as t, array_to_string(list(coalesce(lemma, word) order by k), ' ') as m from w left join lexicon using (word) group by doc_id)
  select id as doc_id, coalesce(l.t, '') as token, coalesce(l.m, '') as lemmas from latest left join l on id = doc_id""")
def filter_lemmatized(spark, folder):
    rows = articles(spark, folder, "token", "lemmas", "text")
    made = filters.lemmatized(rows, "id", "text", filters.lexicon(rows, "token", "lemmas"))
    return made.select("doc_id", F.array_join("token", " ").alias("token"), F.array_join("lemmas", " ").alias("lemmas"))


# Corpus


@query(f"with {_DOCS} select doc_id, array_to_string(tokens, ' ') as tokens from docs")
def corpus_tokens(spark, folder):
    return words(spark, folder).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query(f"""with {_DOCS} select doc_id, trim(regexp_replace(replace(' ' || array_to_string(tokens, '  ') || ' ', ' künstlich  Intelligenz ', ' KI '), ' +', ' ', 'g')) as tokens from docs""")
def corpus_treat_as_one(spark, folder):
    return corpus.treat_as_one(words(spark, folder), ["künstlich", "Intelligenz"], "KI").select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query(f"""with {_DOCS} select doc_id, array_to_string(list_transform(tokens, lambda x: case when x in ('Modell', 'Sprachmodell') then 'Modell/Sprachmodell' else x end), ' ') as tokens from docs""")
def corpus_words_as_one(spark, folder):
    return corpus.words_as_one(words(spark, folder), ["Modell", "Sprachmodell"]).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def _ngram_sql(n: int) -> str:
    return f"with {_DOCS} select term, count(*) as freq, count(distinct doc_id) as doc_freq from {_grams('docs', n)} group by term"


@query(_ngram_sql(1))
def corpus_unigrams(spark, folder):
    return _joined(corpus.ngram_counts(words(spark, folder), 1))


@query(_ngram_sql(2))
def corpus_bigrams(spark, folder):
    return _joined(corpus.ngram_counts(words(spark, folder), 2))


@query(_ngram_sql(3))
def corpus_trigrams(spark, folder):
    return _joined(corpus.ngram_counts(words(spark, folder), 3))


@query(f"with {_DOCS} select n, coalesce(sum(greatest(len(tokens) - n + 1, 0)), 0)::bigint as size from docs, unnest([1, 2, 3]) as u(n) group by n")
def corpus_sizes(spark, folder):
    docs = words(spark, folder)
    parts = [corpus.corpus_size(docs, n).withColumn("n", F.lit(n)) for n in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""with {_DOCS}, {_GOLD}, j as (select source, label from docs left join gold using (doc_id)),
  s as (select source, count(*) as total, count(*) filter (where label = '1_hauptthema') as main, count(*) filter (where label = '2_nebenthema') as side, count(*) filter (where label is not null) as annotated from j group by source)
  select * from s union all select 'Total', sum(total)::bigint, sum(main)::bigint, sum(side)::bigint, sum(annotated)::bigint from s""")
def corpus_label_stats(spark, folder):
    return corpus.label_stats(labelled_words(spark, folder, "source"), "source", "label", "1_hauptthema", "2_nebenthema")


# Co-occurrence


def _window_sql(window: int, docs: str = "units", first: bool = False) -> str:
    only = "and list_position(tokens, tokens[i]) = i" if first else ""
    return f"""places as (select tokens[i] as w, list_distinct(list_concat(list_slice(tokens, greatest(i - {window}, 1), i - 1), list_slice(tokens, i + 1, i + {window}))) as near
    from {docs}, unnest(range(1, len(tokens) + 1)) as u(i) where len(tokens) > 1 {only}), edges as (select w, o, count(*) as cnt from places, unnest(near) as v(o) group by w, o)"""


_UNITS = f"""{_RAW}, tok as (select doc_id, i, tokens[i] as w from raw, unnest(range(1, len(tokens) + 1)) as u(i)),
  marked as (select *, count(*) filter (where w = chr(10) || chr(10)) over (partition by doc_id order by i rows unbounded preceding) as unit_no from tok),
  units as (select doc_id, unit_no, list(w order by i) as tokens from marked where w <> chr(10) || chr(10) group by doc_id, unit_no)"""
_UNIT_EDGES = f"""{_UNITS}, tf as (select doc_id, unit_no, t as w, count(*) as tf from units, unnest(tokens) as u(t) group by all),
  edges as (select a.w, b.w as o, sum(a.tf)::bigint as cnt from tf a join tf b using (doc_id, unit_no) where a.w <> b.w group by a.w, b.w)"""
_MARGINS = "margins as (select w, sum(cnt) as total from edges group by w), whole as (select count(*) as v, sum(total) as grand from margins)"
_SEPARATOR = "\n\n"


def _raw_words(spark, folder):
    return words(spark, folder, keep=None)


@query(f"with {_DOCS}, units as (select * from docs), {_window_sql(5)} select w, o, cnt from edges")
def cooc_window(spark, folder):
    return cooccurrence.window_counts(words(spark, folder), 5)


@query(f"with {_UNITS}, {_window_sql(2, first=True)} select w, o, cnt from edges")
def cooc_window_units_first(spark, folder):
    return cooccurrence.window_counts(_raw_words(spark, folder), 2, _SEPARATOR, count_duplicates=False)


@query(f"with {_UNIT_EDGES} select w, o, cnt from edges")
def cooc_units(spark, folder):
    return cooccurrence.unit_counts(_raw_words(spark, folder), _SEPARATOR)


@query(f"with {_UNIT_EDGES}, {_MARGINS} select w, total, v as vocabulary, grand from margins, whole")
def cooc_margins(spark, folder):
    edges = cut_lineage(cooccurrence.unit_counts(_raw_words(spark, folder), _SEPARATOR))
    return cooccurrence.margins(edges).crossJoin(F.broadcast(cooccurrence.totals(edges)))


def _pmi_sql(f: str, f1: str, f2: str, n: str, norm: bool) -> str:
    value = f"log2(({f}) * ({n}) / (({f1}) * ({f2})))"
    value = f"case when -log2(({f}) / ({n})) = 0 then {value} else {value} / -log2(({f}) / ({n})) end" if norm else value
    return f"case when ({f}) > 0 and ({f1}) > 0 and ({f2}) > 0 then {value} else '-inf'::double end"


_S = "1e-4"
_F, _F1, _F2, _N = f"(e.cnt + {_S})", f"(a.total + {_S} * v)", f"(b.total + {_S} * v)", f"(grand + {_S} * v * v)"


@query(f"""with {_UNIT_EDGES}, {_MARGINS} select e.w, e.o, round({_pmi_sql(_F, _F1, _F2, _N, False)}, 6) as pmi, round({_pmi_sql(_F, _F1, _F2, _N, True)}, 6) as npmi,
  round(14 + log2(2 * {_F} / ({_F1} + {_F2})), 6) as log_dice, round(case when r.cnt > 0 then least({_F} / {_F1}, (r.cnt + {_S}) / {_F2}) else '-inf'::double end, 6) as min_sens
  from edges e join margins a on e.w = a.w join margins b on e.o = b.w left join edges r on r.w = e.o and r.o = e.w, whole""")
def cooc_measures(spark, folder):
    edges = cut_lineage(cooccurrence.unit_counts(_raw_words(spark, folder), _SEPARATOR))
    return _rounded(cooccurrence.scored_edges(edges, 1e-4).select("w", "o", *cooccurrence.MEASURES), *cooccurrence.MEASURES)


_TF, _TF1, _TF2, _TN = "(e.cnt + 0.5)", "(a.total + 0.5 * v)", "(b.total + 0.5 * v)", "(grand + 0.5 * v * v)"


@query(f"""with {_UNIT_EDGES}, {_MARGINS} select e.w, e.o, round({_pmi_sql(_TF, _TF1, _TF2, _TN, False)}, 6) as pmi, round({_pmi_sql(_TF, _TF1, _TF2, _TN, True)}, 6) as npmi,
  round(14 + log2(2 * {_TF} / ({_TF1} + {_TF2})), 6) as log_dice, round(least({_TF} / {_TF1}, (coalesce(r.cnt, 0) + 0.5) / {_TF2}), 6) as min_sens
  from edges e join margins a on e.w = a.w join margins b on e.o = b.w left join edges r on r.w = e.o and r.o = e.w, whole""")
def cooc_table_smoothing(spark, folder):
    edges = cut_lineage(cooccurrence.unit_counts(_raw_words(spark, folder), _SEPARATOR))
    return _rounded(cooccurrence.scored_edges(edges, table_smoothing=0.5).select("w", "o", *cooccurrence.MEASURES), *cooccurrence.MEASURES)


@query(f"""with {_UNIT_EDGES}, stop as (select distinct lower(word) as s from common_words where lang in ('de', 'en')), {_MARGINS}
  select e.w, e.o, e.cnt, m.total as w_total from edges e join margins m using (w) where lower(e.w) not in (select s from stop) and lower(e.o) not in (select s from stop)""")
def cooc_without_stopwords(spark, folder):
    edges = cut_lineage(cooccurrence.unit_counts(_raw_words(spark, folder), _SEPARATOR))
    kept, left = cooccurrence.without_stopwords(edges, stopwords(spark, folder))
    return kept.join(left.withColumnRenamed("total", "w_total"), "w")


def _node_sql(measure: str, least: int = 1) -> str:
    join = "left join" if least <= 0 else "join"
    return f"""with {_UNIT_EDGES}, {_MARGINS}, node as (select total from margins where w = 'Modell')
      select m.w as term, {measure} as stat from margins m {join} (select o, cnt from edges where w = 'Modell') e on e.o = m.w
      left join (select w, cnt from edges where o = 'Modell') r on r.w = m.w, whole, node where coalesce(e.cnt, 0) >= {least}"""


_C, _L, _R2, _G = "coalesce(e.cnt, 0)::double", "node.total", "m.total", "grand"


@query(_node_sql(f"round({_pmi_sql(_C, _L, _R2, _G, True)}, 6)", 2))
def colloc_npmi(spark, folder):
    edges = cut_lineage(cooccurrence.unit_counts(_raw_words(spark, folder), _SEPARATOR))
    return _rounded(cooccurrence.collocations(edges, "Modell", "npmi", 2), "stat")


@query(_node_sql(f"case when {_C} > 0 then round(14 + log2(2 * {_C} / ({_L} + {_R2})), 6) else '-inf'::double end", 0))
def colloc_log_dice(spark, folder):
    edges = cut_lineage(cooccurrence.unit_counts(_raw_words(spark, folder), _SEPARATOR))
    return _rounded(cooccurrence.collocations(edges, "Modell", "log_dice", 0), "stat")


@query(_node_sql(f"case when {_C} > 0 and r.cnt > 0 then round(least({_C} / {_L}, r.cnt / {_R2}), 6) else '-inf'::double end"))
def colloc_min_sens(spark, folder):
    edges = cut_lineage(cooccurrence.unit_counts(_raw_words(spark, folder), _SEPARATOR))
    return _rounded(cooccurrence.collocations(edges, "Modell", "min_sens"), "stat")


@query(f"""with {_UNIT_EDGES}, {_MARGINS}, node as (select total from margins where w = 'Modell'), df as (select w, count(distinct doc_id) as doc_freq from tok group by w),
  s as (select e.o as term, round(case when -log2((e.cnt + {_S}) / (grand + {_S} * v * v)) = 0 then 0 else log2((e.cnt + {_S}) * (grand + {_S} * v * v) / ((node.total + {_S} * v) * (m.total + {_S} * v))) / -log2((e.cnt + {_S}) / (grand + {_S} * v * v)) end, 6) as stat, doc_freq
    from edges e join margins m on m.w = e.o join df on df.w = e.o, whole, node where e.w = 'Modell' and doc_freq >= 5)
  select term, stat, doc_freq from s where stat > 0 qualify rank() over (order by stat desc) <= 50""")
def colloc_query(spark, folder):
    docs = cut_lineage(_raw_words(spark, folder))
    terms = cut_lineage(cooccurrence.unit_node_counts(docs, "Modell", _SEPARATOR))
    frequent = corpus.ngram_counts(docs, 1).select(F.col("term")[0].alias("term"), "doc_freq")
    rounded = _rounded(cooccurrence.node_collocations(terms, "Modell", "npmi", 1, 1e-4), "stat").where(F.col("stat") > 0)
    return wordlists.top_with_ties(rounded.join(frequent, "term").where(F.col("doc_freq") >= 5), "stat", 50)


# Keyness


def _study(spark, folder):
    docs = cut_lineage(words(spark, folder))
    hits = cut_lineage(retrieval.match_wordlist(docs, core_terms(spark, folder), 2))
    return retrieval.found_documents(docs, hits), retrieval.other_documents(docs, hits), docs, hits


def _table_sql(n: int, name: str, s: str = "1e-4") -> str:
    return f"""s{name} as (select term, count(*) as freq, count(distinct doc_id) as doc_freq from {_grams('study', n)} group by term),
      r{name} as (select term, count(*) as freq from {_grams('reference', n)} group by term),
      t{name} as (select (select sum(freq) from s{name}) as zs, (select sum(freq) from r{name}) as zr, (select count(*) from s{name}) as us, (select count(*) from r{name}) as ur),
      k{name} as (select s.term, s.freq, s.doc_freq, s.freq + {s} as o11, coalesce(r.freq, 0) + {s} as o12, zs - (s.freq + {s}) + {s} * us as o21, zr - (coalesce(r.freq, 0) + {s}) + {s} * ur as o22
        from s{name} s left join r{name} r using (term), t{name})"""


_METRIC_SQL = {
    "percent_difference": "100 * ((o11 / (o11 + o21)) - (o12 / (o12 + o22))) / (o12 / (o12 + o22))",
    "log_likelihood": "(case when o11 / (o11 + o21) < o12 / (o12 + o22) then -1 else 1 end) * 2 * (o11 * ln(o11 / ((o11 + o21) * (o11 + o12) / (o11 + o12 + o21 + o22))) + o12 * ln(o12 / ((o12 + o22) * (o11 + o12) / (o11 + o12 + o21 + o22))))",
    "odds_ratio": "o11 * o22 / (o12 * o21)",
}
_METRIC_SQL["bayes_factor"] = _METRIC_SQL["log_likelihood"] + " - ln(o11 + o12 + o21 + o22)"


def _g_sql() -> str:
    cells = []
    for o, row, col in (("o11", "(o11 + o12)", "(o11 + o21)"), ("o12", "(o11 + o12)", "(o12 + o22)"), ("o21", "(o21 + o22)", "(o11 + o21)"), ("o22", "(o21 + o22)", "(o12 + o22)")):
        e = f"({row} * {col} / (o11 + o12 + o21 + o22))"
        near = f"({o} + sign({e} - {o}) * least(0.5, abs({o} - {e})))"
        cells.append(f"(case when {near} > 0 then {near} * ln({near} / {e}) else 0 end)")
    return f"(case when o11 / (o11 + o21) < o12 / (o12 + o22) then -2 else 2 end) * ({' + '.join(cells)})"


_METRIC_SQL["g_test"] = _g_sql()


@query(f"with {_SPLIT}, {_table_sql(2, '')} select term, freq, doc_freq, round(o11, 6) as o11, round(o12, 6) as o12, round(o21, 6) as o21, round(o22, 6) as o22 from k")
def key_contingency(spark, folder):
    study, reference, _, _ = _study(spark, folder)
    return _joined(_rounded(keyness.contingency(study, reference, 2, 1e-4), "o11", "o12", "o21", "o22")).drop("n")


def _register_metric(metric: str) -> None:
    def run(spark, folder):
        study, reference, _, _ = _study(spark, folder)
        found = keyness.keywords_of_length(study, reference, 1, metric, min_docs=2)
        return _joined(found.withColumn("keyness", F.round("keyness", 3)))

    run.__name__ = f"key_{metric}"
    query(f"with {_SPLIT}, {_table_sql(1, '')} select term, 1 as n, freq, doc_freq, round({_METRIC_SQL[metric]}, 3) as keyness from k where doc_freq >= 2")(run)


for _metric in association.KEYNESS:
    _register_metric(_metric)

_STOP = "(select lower(word) from common_words where lang in ('de', 'en'))"
_KEYWORDS = f"""{_SPLIT}, {_table_sql(1, '1')}, {_table_sql(2, '2')}, keys as (select term, n, freq, doc_freq, {_METRIC_SQL['log_likelihood']} as keyness
  from (select *, 1 as n from k1 union all select *, 2 as n from k2) where doc_freq >= 3 and freq >= 3 and lower(split_part(term, ' ', 1)) not in {_STOP} and lower(split_part(term, ' ', -1)) not in {_STOP})"""


def _keywords(spark, folder):
    study, reference, docs, hits = _study(spark, folder)
    return keyness.keywords(study, reference, 2, min_docs=3, min_freq=3, stopwords=stopwords(spark, folder))


@query(f"with {_KEYWORDS} select term, n, freq, doc_freq, round(keyness, 4) as keyness from keys")
def key_keyword_list(spark, folder):
    return _joined(_keywords(spark, folder).withColumn("keyness", F.round("keyness", 4)))


@query(f"with {_KEYWORDS} select term, n, freq, doc_freq, round(keyness, 4) as keyness from keys where round(keyness, 4) > 15.13 qualify rank() over (order by round(keyness, 4) desc) <= 50")
def key_top_keywords(spark, folder):
    rounded = _keywords(spark, folder).withColumn("keyness", F.round("keyness", 4))
    return _joined(wordlists.top_with_ties(rounded.where(F.col("keyness") > 15.13), "keyness", 50))


# Relevance

_CORE = "core as (select ord, array_to_string(term, ' ') as term, len(term) as n from wordlist)"
_CORE_HITS = f"""{_DOCS}, {_CORE}, core_hits as (select distinct doc_id, term, ord from (select doc_id, term, 1 as n from {_grams('docs', 1)} union all select doc_id, term, 2 as n from {_grams('docs', 2)}) g join core using (term, n)),
  per_doc as (select doc_id, count(*) as k from core_hits group by doc_id),
  core_counts as (select term, ord, count(*) as term_count, count(*) filter (where k > 1) as cooc_count, count(*) filter (where k > 1) / count(*) as qtr from core_hits join per_doc using (doc_id) group by term, ord)"""


def _core(spark, folder):
    return relevance.term_table(spark, core_terms(spark, folder))


@query(f"with {_CORE_HITS} select term, ord, term_count, cooc_count, round(qtr, 6) as qtr from core_counts")
def rel_core_counts(spark, folder):
    return _joined(_rounded(relevance.core_counts(words(spark, folder), _core(spark, folder)), "qtr"))


@query(f"with {_CORE_HITS} select doc_id, term, ord from core_hits")
def rel_terms_in_documents(spark, folder):
    return _joined(relevance.terms_in_documents(words(spark, folder), _core(spark, folder)))


@query(f"with {_CORE_HITS} select term, round(qtr, 6) as qtr from core_counts order by core_counts.qtr, ord limit 1")
def rel_baseline(spark, folder):
    value, term = relevance.baseline(words(spark, folder), _core(spark, folder), strict=False)
    return spark.createDataFrame([(" ".join(term), round(value, 6))], "term string, qtr double")


def _cooc_sql(n: int) -> str:
    return f"""c{n} as (select term, count(*) as term_count, count(p.doc_id) as cooc_count from (select distinct doc_id, term from {_grams('docs', n)}) g left join per_doc p using (doc_id)
      where term not in (select term from core where n = {n}) and lower(split_part(term, ' ', 1)) not in {_STOP} and lower(split_part(term, ' ', -1)) not in {_STOP} group by term having count(p.doc_id) > 0)"""


@query(f"with {_CORE_HITS}, {_cooc_sql(1)}, {_cooc_sql(2)} select term, term_count, cooc_count from c1 union all select term, term_count, cooc_count from c2")
def rel_cooccurrence_counts(spark, folder):
    docs, core, stop = cut_lineage(words(spark, folder)), _core(spark, folder), stopwords(spark, folder)
    parts = [relevance.cooccurrence_counts(docs, core, n, stop) for n in (1, 2)]
    return _joined(parts[0].unionByName(parts[1]))


def _register_relevance(metric: str, sql: str) -> None:
    def run(spark, folder):
        docs, core = cut_lineage(words(spark, folder)), _core(spark, folder)
        base, _ = relevance.baseline(docs, core, strict=False)
        found = relevance.relevance(relevance.cooccurrence_counts(docs, core, 1, stopwords(spark, folder)), base, metric, 5)
        return _joined(_rounded(found, "score"))

    run.__name__ = f"rel_{metric}"
    query(f"with {_CORE_HITS}, {_cooc_sql(1)}, base as (select min(qtr) as b from core_counts) select term, term_count, cooc_count, round({sql}, 6) as score from c1, base where term_count >= 5")(run)


_register_relevance("qtr", "cooc_count / term_count")
_register_relevance("rqtr", "100 * (cooc_count / term_count - b) / b")
_register_relevance("rqtrn", "100 * (cooc_count / term_count - b) / (1 - b)")


@query(f"""with {_KEYWORDS}, {_CORE}, core_hits as (select distinct doc_id, term, ord from (select doc_id, term, 1 as n from {_grams('docs', 1)} union all select doc_id, term, 2 as n from {_grams('docs', 2)}) g join core using (term, n)),
  per_doc as (select doc_id, count(*) as k from core_hits group by doc_id), core_counts as (select term, count(*) filter (where k > 1) / count(*) as qtr from core_hits join per_doc using (doc_id) group by term), {_cooc_sql(1)}, base as (select min(qtr) as b from core_counts)
  select keys.term, round(keyness, 4) as keyness, round(100 * (cooc_count / term_count - b) / (1 - b), 4) as score from keys join c1 using (term), base where keyness > 15.13""")
def rel_combined(spark, folder):
    study, reference, docs, hits = _study(spark, folder)
    core, stop = _core(spark, folder), stopwords(spark, folder)
    keys = keyness.keywords(study, reference, 2, min_docs=3, min_freq=3, stopwords=stop).select("term", "keyness")
    base, _ = relevance.baseline(docs, core, strict=False)
    scores = relevance.relevance(relevance.cooccurrence_counts(docs, core, 1, stop), base).select("term", "score")
    both = wordlists.combined_scores(keys, scores).where(F.col("keyness") > 15.13)
    return _joined(both.select("term", F.round("keyness", 4).alias("keyness"), F.round("score", 4).alias("score")))


# Wordlists


@query(f"""with {_KEYWORDS}, {_CORE}, r as (select term, n, freq, doc_freq, round(keyness, 4) as keyness from keys),
  top as (select * from r where term not in (select term from core) qualify rank() over (order by keyness desc) <= 20)
  select term, n, freq, doc_freq, keyness from top union all
  select c.term, coalesce(r.n, 0), coalesce(freq, 0), coalesce(doc_freq, 0), coalesce(keyness, 0) from core c left join r on r.term = c.term""")
def list_top_with_core(spark, folder):
    rounded = _keywords(spark, folder).withColumn("keyness", F.round("keyness", 4))
    return _joined(wordlists.top_with_core(rounded, _core(spark, folder), "keyness", 20))


@query(f"""with {_KEYWORDS}, r as (select term, string_split(term, ' ') as t, n, round(keyness, 4) as keyness from keys),
  subs as (select r.term, r.keyness, case when x = 3 then r.term else t[x] end as sub from r, unnest([1, 2, 3]) as u(x) where x <= n or x = 3),
  bad as (select distinct s.term from subs s join r on r.term = s.sub where r.keyness > s.keyness or (r.keyness = s.keyness and r.t > string_split(s.term, ' ')))
  select term, n, keyness from r where term not in (select term from bad)""")
def list_without_redundant(spark, folder):
    rounded = _keywords(spark, folder).select("term", "n", F.round("keyness", 4).alias("keyness"))
    return _joined(wordlists.without_redundant(cut_lineage(rounded), "term", "keyness"))


# Retrieval


def _matches(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("doc_id", F.array_join("matches", "|").alias("matches"), *columns)


@query(f"with {_HITS} select doc_id, array_to_string(matches, '|') as matches, len(matches) as n_hits from hits where len(matches) >= 2")
def find_wordlist(spark, folder):
    return _matches(retrieval.match_wordlist(words(spark, folder), core_terms(spark, folder), 2), "n_hits")


@query(f"with {_HITS} select doc_id, array_to_string(list_sort(list_distinct(matches)), '|') as matches, len(list_distinct(matches)) as n_hits from hits where len(list_distinct(matches)) >= 1")
def find_wordlist_unique(spark, folder):
    hits = retrieval.match_wordlist(words(spark, folder), core_terms(spark, folder), 1, unique=True)
    return hits.select("doc_id", F.array_join(F.array_sort("matches"), "|").alias("matches"), "n_hits")


@query(f"""with {_DOCS} select doc_id, array_to_string(list_transform(regexp_extract_all({_ENCODED}, '(?i)__[^_]*roboter[^_]*__|__modell__'), lambda m: trim(regexp_replace(m, '__+', ' ', 'g'))), '|') as matches,
  len(regexp_extract_all({_ENCODED}, '(?i)__[^_]*roboter[^_]*__|__modell__')) as n_hits from docs where len(regexp_extract_all({_ENCODED}, '(?i)__[^_]*roboter[^_]*__|__modell__')) >= 1""")
def find_wordlist_patterns(spark, folder):
    return _matches(retrieval.match_wordlist(words(spark, folder), ["[^_]*roboter[^_]*", "modell"], 1, escape=False, ignore_case=True), "n_hits")


@query(f"""with {_HITS}, rated as (select doc_id, matches, len(tokens) as doc_len, len(matches) * 1e6 / nullif(len(tokens), 0) as pmw from hits)
  select doc_id, case when pmw >= 10000 then array_to_string(matches, '|') else '' end as matches, case when pmw >= 10000 then len(matches) else 0 end as n_hits, doc_len, round(pmw, 6) as pmw from rated""")
def find_wordlist_pmw(spark, folder):
    return _rounded(_matches(retrieval.match_wordlist_pmw(words(spark, folder), core_terms(spark, folder), 10_000), "n_hits", "doc_len", "pmw"), "pmw")


_REGEX = "Sprachmodell[a-zäöüß]*|Roboter[a-zäöüß]*"


@query(f"""with {_DOCS}, h as (select doc_id, regexp_extract_all(coalesce(text_deduped, ''), '{_REGEX}') as m from docs)
  select doc_id, array_to_string(m, '|') as matches, len(m) as n_hits from h where len(m) >= 2""")
def find_regex(spark, folder):
    return _matches(retrieval.match_regex(words(spark, folder, "text_deduped"), _REGEX, "text_deduped", 2), "n_hits")


@query(f"""with {_DOCS}, h as (select doc_id, regexp_extract_all(coalesce(text_deduped, ''), '{_REGEX}') as m, len(regexp_extract_all(coalesce(text_deduped, ''), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')) as doc_len from docs)
  select doc_id, array_to_string(m, '|') as matches, len(m) as n_hits, doc_len, round(len(m) * 1e6 / doc_len, 6) as pmw from h where doc_len > 0 and len(m) * 1e6 / doc_len >= 5000""")
def find_regex_pmw(spark, folder):
    found = retrieval.match_regex_pmw(words(spark, folder, "text_deduped"), _REGEX, "text_deduped", 5000)
    return _rounded(_matches(found, "n_hits", "doc_len", "pmw"), "pmw")


_SUBJECTIVE = retrieval.alternation(searchterms.SUBJECTIVE_1, escape=False)


@query(f"""with {_DOCS}, h as (select doc_id, list_transform(regexp_extract_all({_ENCODED}, '{_SUBJECTIVE}'), lambda m: trim(regexp_replace(m, '__+', ' ', 'g'))) as m from docs)
  select doc_id, array_to_string(m, '|') as matches, len(m) as n_hits from h where len(m) >= 1""")
def find_subjective(spark, folder):
    return _matches(retrieval.match_wordlist(words(spark, folder), searchterms.SUBJECTIVE_1, 1, escape=False), "n_hits")


# the free spacing taken out; the other engine has none
_TOPIC = "(?i)" + "".join(line.strip() for line in searchterms.KI_REGEX_LLM.splitlines()[1:])


@query(f"""with {_DOCS}, h as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_TOPIC}') as m from docs)
  select doc_id, array_to_string(m, '|') as matches, len(m) as n_hits from h where len(m) >= 1""")
def find_topic_regex(spark, folder):
    return _matches(retrieval.match_regex(words(spark, folder, "text"), searchterms.KI_REGEX_LLM, "text", 1), "n_hits")


@query(f"""with {_LATEST} select id, regexp_matches(coalesce(text, ''), '(?s)Roboter\\b.*?\\bModell\\b') as found from latest""".replace("Roboter", "\\bRoboter"))
def find_term_pattern(spark, folder):
    pattern = fw.java_flags(fw.term_pattern(["Roboter", "Modell"])).replace("(?", "(?s", 1)
    return articles(spark, folder, "text").select("id", F.coalesce("text", F.lit("")).rlike(pattern).alias("found"))


@query(f"""with {_HITS}, w as (select doc_id, any_value(list_sort(list_distinct(matches))) as matches, sum(weight) as weight from (select doc_id, matches, unnest(matches) as m from hits) x join (select array_to_string(term, ' ') as m, weight from wordlist) using (m) group by doc_id)
  select doc_id, array_to_string(matches, '|') as matches, round(weight, 6) as weight from w where round(weight, 6) >= 2.5""")
def find_weighted(spark, folder):
    found = retrieval.match_weighted(words(spark, folder), term_weights(spark, folder), 0.0)
    rounded = found.select("doc_id", F.array_join(F.array_sort("matches"), "|").alias("matches"), F.round("weight", 6).alias("weight"))
    return rounded.where(F.col("weight") >= 2.5)


@query(f"with {_HITS} select doc_id, len(matches) >= 2 as found from hits")
def find_found_and_other(spark, folder):
    study, reference, _, _ = _study(spark, folder)
    return study.select("doc_id", F.lit(True).alias("found")).unionByName(reference.select("doc_id", F.lit(False).alias("found")))


@query(f"with {_DOCS} select doc_id, source from docs where source in ('tagesecho', 'klimaheft')")
def find_by_keys(spark, folder):
    return retrieval.documents_by_keys(words(spark, folder, "source"), "source", ["tagesecho", "klimaheft"]).select("doc_id", "source")


@query(f"with {_HITS}, {_GOLD} select doc_id from hits left join gold using (doc_id) where len(matches) >= 2 and label is null")
def find_not_annotated(spark, folder):
    docs = labelled_words(spark, folder)
    return retrieval.not_annotated(docs, retrieval.match_wordlist(docs, core_terms(spark, folder), 2), "label").select("doc_id")


@query(f"with {_HITS}, {_RATED} select doc_id, len(matches) as n_hits from hits join rated on id = doc_id where len(matches) >= 2 and claude37_label = '1_hauptthema'")
def find_gated(spark, folder):
    docs = words(spark, folder)
    labels = ratings(spark, folder, "claude37_label").select(F.col("id").alias("doc_id"), "claude37_label")
    return retrieval.gated(retrieval.match_wordlist(docs, core_terms(spark, folder), 2), labels, "claude37_label", ["1_hauptthema"]).select("doc_id", "n_hits")


# Evaluation


def _report_sql(rows: str, by: str = "") -> str:
    head = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    z = "coalesce(({0}) / nullif({1}, 0), 0)".format
    p1, r1, f1 = z("tp", "tp + fp"), z("tp", "tp + fn"), z("2 * tp", "2 * tp + fp + fn")
    p0, r0, f0 = z("tn", "tn + fn"), z("tn", "tn + fp"), z("2 * tn", "2 * tn + fp + fn")
    n = "(tp + fp + fn + tn)"
    values = {
        "precision": p1, "recall": r1, "f1": f1, "precision_neg": p0, "recall_neg": r0, "f1_neg": f0, "accuracy": z("tp + tn", n),
        "macro_precision": f"({p0} + {p1}) / 2", "macro_recall": f"({r0} + {r1}) / 2", "macro_f1": f"({f0} + {f1}) / 2",
        "weighted_precision": z(f"{p1} * (tp + fn) + {p0} * (tn + fp)", n), "weighted_recall": z(f"{r1} * (tp + fn) + {r0} * (tn + fp)", n), "weighted_f1": z(f"{f1} * (tp + fn) + {f0} * (tn + fp)", n),
    }
    return f"""select {head} topic, tp, fp, fn, tn, tp + fn as support, tn + fp as support_neg, {', '.join(f'round({v}, 6) as {k}' for k, v in values.items())} from (
      select {head} topic, count(*) filter (where g and p) as tp, count(*) filter (where not g and p) as fp, count(*) filter (where g and not p) as fn, count(*) filter (where not g and not p) as tn
      from (select *, unnest(['main', 'main_or_side']) as topic, unnest([coalesce(label = '1_hauptthema', false), coalesce(label in ('1_hauptthema', '2_nebenthema'), false)]) as g from {rows}) {group + ', topic' if by else 'group by topic'})"""


_JUDGED = f"{_HITS}, {_GOLD}, judged as (select h.doc_id, d.source, label, len(h.matches) >= 2 as p from hits h join docs d using (doc_id) left join gold using (doc_id))"
_SCORES = ["precision", "recall", "f1", "precision_neg", "recall_neg", "f1_neg", "accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1"]


def _labelled_hits(spark, folder, minimum=2):
    docs = cut_lineage(labelled_words(spark, folder, "source"))
    return docs, retrieval.match_wordlist(docs, core_terms(spark, folder), minimum)


@query(f"with {_JUDGED} {_report_sql('judged')}")
def eval_pooling(spark, folder):
    docs, hits = _labelled_hits(spark, folder)
    return _rounded(evaluation.evaluate_retrieval(docs, hits, "label"), *_SCORES)


@query(f"with {_JUDGED} {_report_sql('(select * from judged where label is not null)')}")
def eval_annotated(spark, folder):
    docs, hits = _labelled_hits(spark, folder)
    return _rounded(evaluation.evaluate_retrieval(docs, hits, "label", "annotated"), *_SCORES)


@query(f"with {_JUDGED} select * from ({_report_sql('judged', 'source')}) where tp + fp > 0")
def eval_by_genre(spark, folder):
    docs, hits = _labelled_hits(spark, folder)
    return _rounded(evaluation.evaluate_by_genre(docs, hits, "label", "source"), *_SCORES)


def _curve_sql(scored: str, marks: str) -> str:
    return f"""select threshold, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from (
      select t::double as threshold, count(*) filter (where g and coalesce(s >= t, false)) as tp, count(*) filter (where not g and coalesce(s >= t, false)) as fp, count(*) filter (where g and not coalesce(s >= t, false)) as fn from {scored}, {marks} group by t)"""


_SCORED = f"{_HITS}, {_GOLD}, scored as (select coalesce(label = '1_hauptthema', false) as g, len(matches) as s, len(matches) * 1e6 / nullif(len(tokens), 0) as r from hits left join gold using (doc_id))"


@query(f"with {_SCORED} {_curve_sql('scored', 'range(1, 26) as u(t)')}")
def eval_thresholds(spark, folder):
    docs, hits = _labelled_hits(spark, folder, 0)
    scored = docs.select("doc_id", "label").join(hits, "doc_id")
    return _rounded(evaluation.threshold_curve(scored, "n_hits", F.coalesce(F.col("label") == "1_hauptthema", F.lit(False)), range(1, 26)), "precision", "recall", "f1")


@query(f"with {_SCORED} {_curve_sql('(select g, r as s from scored)', 'range(1000, 40001, 1000) as u(t)')}")
def eval_thresholds_pmw(spark, folder):
    docs = cut_lineage(labelled_words(spark, folder))
    rated = retrieval.match_wordlist_pmw(docs, core_terms(spark, folder), 0.0)
    scored = docs.select("doc_id", "label").join(rated, "doc_id")
    return _rounded(evaluation.threshold_curve(scored, "pmw", F.coalesce(F.col("label") == "1_hauptthema", F.lit(False)), range(1000, 40001, 1000)), "precision", "recall", "f1")


def _method_sql(least: str) -> str:
    return f"(select g, case when {least} then s end as s from scored)"


_METHODS = f"""all_hits as (select coalesce(label = '1_hauptthema', false) as g, len(matches) as a, len(list_distinct(matches)) as b from hits left join gold using (doc_id))"""


@query(f"""with {_HITS}, {_GOLD}, {_METHODS}, curve as (select 'hits' as method, * from ({_curve_sql('(select g, a as s from all_hits)', '(values (1), (2), (4)) as u(t)')}) union all select 'unique' as method, * from ({_curve_sql('(select g, b as s from all_hits)', '(values (1), (2), (4)) as u(t)')}))
  select method, {', '.join(f"max({c}) filter (where threshold = {t}) as t{t}_{c}" for t in (1, 2, 4) for c in ('precision', 'recall', 'f1'))} from curve group by method""")
def eval_comparison(spark, folder):
    docs = cut_lineage(labelled_words(spark, folder))
    gold = F.coalesce(F.col("label") == "1_hauptthema", F.lit(False))
    parts = []
    for name, unique in (("hits", False), ("unique", True)):
        hits = retrieval.match_wordlist(docs, core_terms(spark, folder), 0, unique=unique)
        scored = docs.select("doc_id", "label").join(hits, "doc_id").withColumn("method", F.lit(name))
        parts.append(evaluation.threshold_curve(scored, "n_hits", gold, (1, 2, 4), "method"))
    return evaluation.comparison_table(parts[0].unionByName(parts[1]), "method", (1, 2, 4), 6)


@query(f"with {_RATED} select {_label('gold_label')} as gold, claude37_label as predicted, count(*) as n from rated group by all")
def eval_confusion(spark, folder):
    rows = ratings(spark, folder, "gold_label", "claude37_label").withColumn("gold", rating.normal_label(F.col("gold_label")))
    return evaluation.confusion(rows, "gold", "claude37_label")


_CLASSES = f"""{_RATED}, pairs as (select * from (select {_label('gold_label')} as g, claude37_label as p from rated) where g is not null and p is not null),
  labels as (select g as label from pairs union select p from pairs),
  cls as (select label, (select count(*) from pairs where g = label and p = label) as tp, (select count(*) from pairs where p = label) as pp, (select count(*) from pairs where g = label) as gg from labels),
  rep as (select label, coalesce(tp / nullif(pp, 0), 0) as precision, coalesce(tp / nullif(gg, 0), 0) as recall, coalesce(2 * tp / nullif(pp + gg, 0), 0) as f1, gg as support, tp from cls),
  full_report as (select label, precision, recall, f1, support::bigint as support from rep union all select 'macro', avg(precision), avg(recall), avg(f1), sum(support)::bigint from rep
    union all select k, sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support)::bigint from rep, (values ('accuracy'), ('micro')) as u(k) group by k)"""


def _class_report(spark, folder):
    rows = ratings(spark, folder, "gold_label", "claude37_label").withColumn("gold", rating.normal_label(F.col("gold_label")))
    return evaluation.multiclass_report(rows, "gold", "claude37_label")


@query(f"with {_CLASSES} select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from full_report")
def eval_classes(spark, folder):
    return _rounded(_class_report(spark, folder), "precision", "recall", "f1")


@query(f"with {_CLASSES} select label || '.' || m as metric, round(v, 6) as value from full_report, lateral (select unnest(['precision', 'recall', 'f1', 'support']) as m, unnest([precision, recall, f1, support::double]) as v)")
def eval_flattened(spark, folder):
    return _rounded(evaluation.flattened(_class_report(spark, folder)), "value")


@query(f"""with {_RATED} select id, case when g and p then 'TP' when not g and p then 'FP' when g then 'FN' else 'TN' end as outcome from (select id, coalesce({_label('gold_label')} = '1_hauptthema', false) as g, coalesce(topic_ai, false) as p from rated left join llm_results on custom_id = id)""")
def eval_outcomes(spark, folder):
    rows = ratings(spark, folder, "gold_label").join(table(spark, folder, "llm_results").select(F.col("custom_id").alias("id"), "topic_ai"), "id", "left")
    return rows.select("id", evaluation.outcome(rating.normal_label(F.col("gold_label")) == "1_hauptthema", F.col("topic_ai")).alias("outcome"))


@query(f"with {_HITS}, {_GOLD} select doc_id, array_to_string(matches, '|') as matches from hits left join gold using (doc_id) where len(matches) >= 2 and coalesce(label, '3_kein_thema') not in ('1_hauptthema', '2_nebenthema')")
def eval_false_positives(spark, folder):
    docs, hits = _labelled_hits(spark, folder)
    return _matches(evaluation.false_positives(docs, hits, "label", ["1_hauptthema", "2_nebenthema"]))


@query(f"with {_HITS}, {_GOLD} select doc_id, label from hits join gold using (doc_id) where len(matches) < 2 and label = '1_hauptthema'")
def eval_false_negatives(spark, folder):
    docs, hits = _labelled_hits(spark, folder)
    return evaluation.false_negatives(docs, hits, "label", ["1_hauptthema"]).select("doc_id", "label")


# Rating

_VOTES = f"{_RATED}, votes as (select * from (" + " union all ".join(f"select id as item, '{c}' as rater, {_label(c)} as label from rated" for c in RATERS) + ") where label is not null)"
_COINCIDENCES = f"""{_VOTES}, m as (select item, label, count(*) as m from votes group by item, label), a as (select item, sum(m) as n from m group by item having sum(m) > 1),
  o as (select x.label as c, y.label as k, sum(case when x.label = y.label then x.m * (x.m - 1) else x.m * y.m end / (n - 1)) as n from m x join m y using (item) join a using (item) group by all)"""


def _votes(spark, folder):
    rows = ratings(spark, folder, *RATERS)
    return rating.votes_of(rows.withColumns({c: rating.normal_label(F.col(c)) for c in RATERS}), "id", RATERS)


@query(f"with {_VOTES} select item, rater, label from votes")
def rate_votes(spark, folder):
    return _votes(spark, folder)


@query(f"with {_RATED} select id, try_cast(split_part(trim(expert_annotator_1), '_', 1) as int) as rank from rated")
def rate_ranks(spark, folder):
    return ratings(spark, folder, "expert_annotator_1").select("id", rating.rank_of(F.col("expert_annotator_1")).alias("rank"))


@query("""select item, case when f like '1%' then '1_hauptthema' when f like '2%' then '2_nebenthema' else '3_kein_thema' end as label, f as folder
  from (select id as item, max(expert_annotator_1) as f from ratings where regexp_matches(expert_annotator_1, '^[123]') group by id)""")
def rate_folders(spark, folder):
    files = table(spark, folder, "ratings").select(F.concat(F.lit("/a/"), "expert_annotator_1", F.lit("/"), "id", F.lit(".txt")).alias("path"))
    return rating.rankings_from_folders(files.where(F.col("path").isNotNull()))


@query(f"with {_COINCIDENCES} select c, k, round(n, 6) as n from o")
def rate_coincidences(spark, folder):
    return _rounded(rating.coincidences(_votes(spark, folder)), "n")


@query(f"""with {_COINCIDENCES}, g as (select c, sum(n) as m from o group by c), s as (select sum(m) as n from g)
  select round(1 - (s.n - 1) * (select sum(o.n) from o where c <> k) / (select sum(x.m * y.m) from g x, g y where x.c <> y.c), 6) as alpha, round(s.n, 6) as n_pairable from s""")
def rate_alpha_nominal(spark, folder):
    return _rounded(rating.krippendorff_alpha(_votes(spark, folder)), "alpha", "n_pairable")


@query(f"""with {_COINCIDENCES}, g as (select c, sum(n) as m from o group by c), s as (select sum(m) as n from g),
  d as (select x.c, y.c as k, x.m as mx, y.m as my, case when x.c = y.c then 0 else power((select sum(z.m) from g z where z.c between least(x.c, y.c) and greatest(x.c, y.c)) - (x.m + y.m) / 2, 2) end as d from g x, g y)
  select round(1 - (s.n - 1) * (select sum(o.n * d.d) from o join d using (c, k)) / (select sum(mx * my * d.d) from d), 6) as alpha, round(s.n, 6) as n_pairable from s""")
def rate_alpha_ordinal(spark, folder):
    return _rounded(rating.krippendorff_alpha(_votes(spark, folder), "ordinal"), "alpha", "n_pairable")


def _em_sql(rounds: int) -> str:
    """The rounds of the estimation one by one: rates ``r``, shares of classes ``q``, probabilities ``p``."""
    steps = [
        _VOTES,
        "classes as (select unnest(['1_hauptthema', '2_nebenthema', '3_kein_thema']) as c)",
        "p0 as materialized (select item, c, count(*) filter (where label = c) / count(*) as p from votes, classes group by item, c)",
    ]
    for k in range(rounds):
        steps += [
            f"r{k} as materialized (select rater, c, label, coalesce(sum(p) / nullif(sum(sum(p)) over (partition by rater, c), 0), 0) as rate from votes join p{k} using (item) group by rater, c, label)",
            f"q{k} as materialized (select c, ln(greatest(sum(p) / sum(sum(p)) over (), 1e-300)) as prior from p{k} group by c)",
            f"""l{k} as materialized (select v.item, r.c, any_value(prior) + sum(ln(greatest(rate, 1e-300))) as l from votes v join r{k} r on v.rater = r.rater and v.label = r.label join q{k} q on q.c = r.c group by v.item, r.c)""",
            f"m{k} as materialized (select item, max(l) as top from l{k} group by item)",
            f"p{k + 1} as materialized (select item, c, exp(l - top) / sum(exp(l - top)) over (partition by item) as p from l{k} join m{k} using (item))",
        ]
    return ", ".join(steps)


_ROUNDS = 45
_ESTIMATED = f"""{_em_sql(_ROUNDS)}, estimated as (select item, arg_max(c, (p, -ascii(c))) as label, max(p) as probability,
  max(p) filter (where c like '1%') as p1, max(p) filter (where c like '2%') as p2, max(p) filter (where c like '3%') as p3 from p{_ROUNDS} group by item)"""


@query(f"with {_ESTIMATED} select item, label, round(probability, 6) as probability, round(p1, 6) as p1, round(p2, 6) as p2, round(p3, 6) as p3 from estimated")
def rate_dawid_skene(spark, folder):
    return _rounded(rating.dawid_skene(_votes(spark, folder), max_rounds=_ROUNDS)[0], "probability", "p1", "p2", "p3")


@query(f"""with {_em_sql(_ROUNDS)} select a.rater, t.c as truth, g.c as given, round(coalesce(rate, 0), 6) as rate
  from (select distinct rater from votes) a, classes t, classes g left join r{_ROUNDS - 1} r on r.rater = a.rater and r.c = t.c and r.label = g.c""")
def rate_error_rates(spark, folder):
    return _rounded(rating.dawid_skene(_votes(spark, folder), max_rounds=_ROUNDS)[1], "rate")


@query(f"""with {_ESTIMATED}, experts as (select id as item, list_filter([{_label('expert_annotator_1')}, {_label('expert_annotator_2')}], lambda x: x is not null) as given from rated)
  select item, label, not list_contains(given, label) as differs from estimated join experts using (item) where len(given) > 0""")
def rate_expert_disagreement(spark, folder):
    estimated, _ = rating.dawid_skene(_votes(spark, folder))
    experts = ratings(spark, folder, *RATERS[:2]).select(F.col("id").alias("item"), *[rating.normal_label(F.col(c)).alias(c) for c in RATERS[:2]])
    return rating.expert_disagreement(estimated, experts, RATERS[:2])


# Model annotation

_PROMPT = annotation.Prompt("You judge the topic of articles.", "Article:\n", "\nIs it about AI?")


@query(f"with {_LATEST} select id as custom_id, 'judge-1' as model, 'Article:' || chr(10) || coalesce(text, '') || chr(10) || 'Is it about AI?' as content from latest where id not in (select custom_id from llm_results)")
def model_batch_records(spark, folder):
    made = annotation.batch_records(articles(spark, folder, "text"), "id", _PROMPT, F.col("text"), "judge-1", done=table(spark, folder, "llm_results"))
    return made.select("custom_id", F.get_json_object("request", "$.params.model").alias("model"), F.get_json_object("request", "$.params.messages[0].content").alias("content"))


@query(f"""with {_LATEST} select id as custom_id, 'POST' as method, 'judge-2' as model, 'You judge the topic of articles.' as system,
  'Article:' || chr(10) || coalesce(text, '') || chr(10) || 'Is it about AI?' as content, 'topic_ai' as required from latest where id not in (select custom_id from llm_results)""")
def model_chat_records(spark, folder):
    form = annotation.response_format("TopicAI", {"topic_ai": bool})
    made = annotation.chat_records(articles(spark, folder, "text"), "id", _PROMPT, F.col("text"), "judge-2", form, table(spark, folder, "llm_results"))
    parts = {"method": "$.method", "model": "$.body.model", "system": "$.body.messages[0].content", "content": "$.body.messages[1].content", "required": "$.body.response_format.json_schema.schema.required[0]"}
    return made.select("custom_id", *[F.get_json_object("request", path).alias(name) for name, path in parts.items()])


@query(f"""with {_LATEST}, m as (select id, unnest(['h1', 'h2', 'url']) as key, unnest([h1, h2, url]) as value from latest)
  select id, 'kept' as kind, key, value from m where key in ('h1', 'url') union all select id, 'removed', key, value from m where key = 'h2'""")
def model_keys(spark, folder):
    rows = articles(spark, folder, "h1", "h2", "url").withColumn("m", F.create_map(*[x for c in ("h1", "h2", "url") for x in (F.lit(c), F.col(c))]))
    chosen = {"kept": annotation.kept_keys(F.col("m"), ["h1", "url", "none"]), "removed": annotation.removed_keys(F.col("m"), ["h1", "url"])}
    parts = [rows.select("id", F.lit(kind).alias("kind"), F.explode(found).alias("key", "value")) for kind, found in chosen.items()]
    return parts[0].unionByName(parts[1])


@query(f"""with {_LATEST}, o as (select id, coalesce(lag(og_title) over w, '') as a, coalesce(lead(og_title) over w, '') as b, coalesce(og_title, '') as t from latest window w as (partition by source order by id))
  select id, 'Before: ' || a || ' Title: ' || t || ' After: ' || b as prompt from o""")
def model_neighbour_prompts(spark, folder):
    rows = annotation.with_neighbours(articles(spark, folder, "source", "og_title"), "id", "id", "og_title", "source")
    prompt = annotation.Prompt("", "Before: {{before}} Title: ", " After: {{after}}")
    return rows.select("id", prompt.user_text(F.col("og_title"), before=F.col("previous_text"), after=F.col("next_text")).alias("prompt"))


@query(f"with {_LATEST} select id as custom_id, coalesce(topic_ai::varchar, 'FAIL') as result from latest left join (select * from llm_results where result_type = 'succeeded') on custom_id = id")
def model_aligned_results(spark, folder):
    return annotation.aligned_results(articles(spark, folder), "id", table(spark, folder, "llm_results"), F.col("topic_ai"), F.col("result_type") == "succeeded")


@query("select custom_id from llm_results where result_type = 'succeeded'")
def model_succeeded(spark, folder):
    return annotation.succeeded_ids(table(spark, folder, "llm_results"))


@query("select result_type, round(sum(coalesce(input_tokens, 0)) * 0.0000015 + sum(coalesce(output_tokens, 0)) * 0.0000075, 9)::double as cost from llm_results group by result_type")
def model_cost(spark, folder):
    cost = annotation.token_cost(F.col("input_tokens"), F.col("output_tokens"))
    return table(spark, folder, "llm_results").groupBy("result_type").agg(F.round(F.sum(cost), 9).cast("double").alias("cost"))


@query("select custom_id, coalesce(topic_ai, false) as predicted, topic_ai from llm_results")
def model_parsed_output(spark, folder):
    answers = table(spark, folder, "llm_results").select("custom_id", F.to_json(F.struct("topic_ai")).alias("answer"))
    parsed = annotation.parsed_output(F.col("answer"), "topic_ai boolean")
    return answers.select("custom_id", annotation.predicted(F.col("answer"), "topic_ai").alias("predicted"), parsed["topic_ai"].alias("topic_ai"))


@query(f"""with {_HITS}, {_GOLD} select h.doc_id, 'URL: ' || coalesce(url, '') || chr(10) || 'Title: ' || coalesce(og_title, '') || chr(10) || 'Description: ' || coalesce(og_description, '') || chr(10) || 'Search terms: ' || array_to_string(matches, ', ') || chr(10) || chr(10) || coalesce(text, '') as sheet
  from hits h join docs using (doc_id) left join gold using (doc_id) where len(matches) >= 2 and label is null""")
def model_annotation_sheets(spark, folder):
    docs = labelled_words(spark, folder, "url", "og_title", "og_description", "text")
    hits = retrieval.match_wordlist(docs, core_terms(spark, folder), 2)
    todo = retrieval.not_annotated(docs, hits, "label").join(hits, "doc_id")
    sheet = annotation.annotation_text(*[F.col(c) for c in ("url", "og_title", "og_description", "matches", "text")])
    return todo.select("doc_id", sheet.alias("sheet"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords of the documents on the core topic against all others, ties at the end included."""
    return key_top_keywords(spark, folder)
