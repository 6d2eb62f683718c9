"""Problem 3: the article of a page without the page's furniture, by tag-path ratios.

Every block of text has the path of its block-level elements, from the root to the leaf. Over
all pages of a site the blocks are aggregated by path: letters, sentence ends, link text, and
how much of it stands on several pages. The fused ratio of a path is high where long,
punctuated, unlinked text of one page each is. It is smoothed towards the ratio of the paths
that end alike (the same leaf in the same container), the more the fewer blocks a path has, so
that a path bent by broken markup goes with its neighbours. Paths near the site's best one are
content; headings, headlines and list items in the same container join them if their text is
not repeated over the site.

A page is an article if a headline of its own, that its title names, stands in it. Where a
site's pages seldom have one, its content must reach a share of the site's ratio instead, so
lists of teasers are left out.

Paths and texts are told by hashes; path statistics are small and meet the blocks by join, and
blocks are counted with partial sums, so a site with a third of all pages is many rows with
one join key of a small table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, discard
from .html_blocks import block_key, blocks, sentence_ends

#: A path is content if its fused ratio is at least this share of the site's best.
CONTENT_SHARE = 0.25
#: Text on at least this share of the addresses of a path of a site, and on so many, is repeated.
REPEATED_SHARE = 0.05
REPEATED_PAGES = 3
#: What one sentence a block counts; each further one counts 1.
ONE_SENTENCE = 0.1
HEADLINE_SHARE = 0.5
#: Blocks that the ratio of the paths that end alike counts for in a path's smoothed ratio.
SMOOTH_BLOCKS = 50
#: Sites with headlines on a smaller share of their pages are judged by the ratio of each page,
#: which must be at least this share of the site's best.
HEADLINE_PAGES = 0.5
PAGE_SHARE = 0.1

_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)
_DIGITS = re.compile(r"\d+")
_LISTS = {"ul", "ol", "menu", "dl"}
_HEADING = re.compile(r"h[1-6]\b")
_NODES = (
    "page {page}, path_id bigint, address bigint, text_hash bigint, letters int, sentences int, link_chars int, headline boolean, first boolean, block_key string, "
    "site string, path string, parent string, container string, leaf string, role string"
)


def _tag(signature: str) -> str:
    return re.split(r"[.#@:]", signature, maxsplit=1)[0]


def _place(path: str) -> tuple[str, str, str, str]:
    """Path above the leaf, its last element, leaf and role of a path; list elements between are passed over."""
    steps = path.split("/")
    leaf = steps[-1]
    tag = _tag(leaf)
    above = [s for s in steps[:-1] if not (tag in ("li", "dt", "dd") and _tag(s) in _LISTS)]
    role = "item" if tag in ("li", "dt", "dd") else "heading" if _HEADING.fullmatch(tag) else "caption" if tag in ("figcaption", "caption") else "text"
    return "/".join(above), (above[-1] if above else ""), leaf, role


def _signed(number: int) -> int:
    return number - (1 << 64) if number >= 1 << 63 else number


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path_id", "address", "text_hash", "letters", "sentences", "link_chars", "headline", "first", "block_key", "site", "path", "parent", "container", "leaf", "role"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), *[pa.string()] * 7]
    for batch in batches:
        at, rows = [], []
        # the names of a path travel with its first block of a batch only
        known: dict[tuple, int] = {}
        for k, (site, address, page) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3))):
            page = page.as_py()
            if not page:
                continue
            found = _TITLE.search(page)
            title = block_key(re.sub("&[#a-zA-Z0-9]+;", _entity, found.group(1)).replace("<", "")) if found else ""
            first = True
            for block in blocks(page):
                key = block_key(block.text)
                if not key:
                    continue
                path_id = known.get((site, block.path))
                told = (None,) * 6
                if path_id is None:
                    path_id = known[site, block.path] = _signed(xxhash.xxh3_64_intdigest(f"{'' if site is None else site}\n{site is None}\n{block.path}".encode("utf-8", "surrogatepass")))
                    told = (site, block.path, *_place(block.path))
                same = len(key) >= 12 and (title == key if len(key) == 48 else title.startswith(key))
                digest = xxhash.xxh3_64_intdigest(_DIGITS.sub("0", block.text).encode("utf-8", "surrogatepass"))
                at.append(k)
                rows.append((path_id, address, _signed(digest), len(block.text), sentence_ends(block.text), min(block.link_chars, len(block.text)), same, first, key, *told))
                first = False
        columns = list(zip(*rows)) or [[]] * len(names)
        made = [pa.array(c, t) for c, t in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *made], names=["page", *names])


def _entity(match: re.Match) -> str:
    import html

    return html.unescape(match.group(0))


def page_blocks(pages: DataFrame, page: str, site: Column, address: Column, html: str) -> DataFrame:
    """Blocks of every page with their place and measures; pages without text have none."""
    kind = pages.schema[page].dataType.simpleString()
    chosen = pages.select(F.col(page).alias("page"), site.alias("site"), F.xxhash64(address).alias("address"), F.col(html).alias("html"))
    return chosen.mapInArrow(_parse, _NODES.format(page=kind))


def _repeated(addresses: Column, path_addresses: Column) -> Column:
    return addresses >= F.greatest(F.lit(REPEATED_PAGES), REPEATED_SHARE * path_addresses)


_SUMS = ("n", "letters", "link_chars", "headlines", "single", "sentences", "single_letters")


def _fused(group: str | None = None) -> Column:
    """Ratio of a path, or of all paths of a group: text and punctuation of a block that stands on one page, unlinked."""
    c = {x: F.col(x).cast("double") if group is None else F.sum(x).over(Window.partitionBy("site", "container", "leaf", "role")).cast("double") for x in _SUMS}
    unlinked = 1 - F.least(F.lit(1.0), F.try_divide(c["link_chars"], c["letters"]))
    ends = c["sentences"] / c["n"]
    return c["single_letters"] / c["n"] * _end_ratio(ends) * unlinked * c["single"] / c["n"]


def _end_ratio(ends: Column) -> Column:
    return F.greatest(ends - 1, ONE_SENTENCE * F.least(ends, F.lit(1.0)))


def text_pages(nodes: DataFrame) -> DataFrame:
    """``(path_id, text_hash, n, letters, sentences, link_chars, headlines, repeated)`` of each text of each path."""
    by_address = nodes.groupBy("path_id", "text_hash", "address").agg(
        F.count("*").alias("n"),
        F.sum("letters").alias("letters"),
        F.sum("sentences").alias("sentences"),
        F.sum("link_chars").alias("link_chars"),
        F.sum(F.col("headline").cast("int")).alias("headlines"),
    )
    sized = nodes.select("path_id", "address").distinct().groupBy("path_id").agg(F.count("*").alias("path_addresses"))
    texts = by_address.groupBy("path_id", "text_hash").agg(*(F.sum(c).alias(c) for c in ("n", "letters", "sentences", "link_chars", "headlines")), F.count("*").alias("addresses"))
    texts = texts.join(sized, "path_id")
    return texts.withColumn("repeated", _repeated(F.col("addresses"), F.col("path_addresses"))).drop("addresses", "path_addresses")


def content_paths(nodes: DataFrame, texts: DataFrame, content_share: float = CONTENT_SHARE) -> DataFrame:
    """Content paths of each site: ``(path_id, site, strict, text, best)``.

    ``strict`` says that only text not repeated over the site counts (headings, items),
    ``text`` that the path is content by its own ratio, ``best`` is the site's best ratio.
    """
    told = nodes.where(F.col("path").isNotNull()).groupBy("path_id").agg(*(F.first(c).alias(c) for c in ("site", "path", "parent", "container", "leaf", "role")))
    single = ~F.col("repeated")
    paths = texts.groupBy("path_id").agg(
        F.sum("n").alias("n"),
        F.sum("letters").alias("letters"),
        F.sum("link_chars").alias("link_chars"),
        F.sum("headlines").alias("headlines"),
        F.sum(F.when(single, F.col("n")).otherwise(0)).alias("single"),
        F.sum(F.when(single, F.col("sentences")).otherwise(0)).alias("sentences"),
        F.sum(F.when(single, F.col("letters")).otherwise(0)).alias("single_letters"),
    )
    smooth = (F.col("n") * _fused() + SMOOTH_BLOCKS * _fused("ending")) / (F.col("n") + SMOOTH_BLOCKS)
    scored = paths.join(told, "path_id").withColumn("ratio", F.when(F.col("role") == "text", smooth).otherwise(0.0))
    # the best path is one with many blocks; others, of rarer layouts, meet its ratio whatever their number
    weight = F.struct((F.col("ratio") * F.sqrt(F.col("n").cast("double"))).alias("weight"), "ratio")
    scored = scored.withColumn("best", F.max(weight).over(Window.partitionBy("site"))["ratio"])
    content = (F.col("ratio") > 0) & (F.col("ratio") >= content_share * F.col("best"))
    scored = cut_lineage(scored.withColumn("content", content))
    main = scored.where("content")
    # a container holds the content path or is its leaf (text with line breaks straight in it)
    holders = main.select("site", F.explode(F.array(F.struct("parent", F.col("container").alias("last")), F.struct(F.col("path").alias("parent"), F.col("leaf").alias("last")))).alias("h"))
    holders = holders.where(~F.col("h.last").rlike("^(body|html)?$")).select(F.col("site").alias("of_site"), F.col("h.parent").alias("parent")).distinct()
    headline = F.col("headlines") >= HEADLINE_SHARE * F.col("n")
    heading = (F.col("role") == "heading") & (F.col("single") >= 0.5 * F.col("n"))
    unlinked = F.least(F.lit(1.0), F.try_divide("link_chars", "letters")) < 0.5
    beside = (
        scored.where(~F.col("content") & (F.col("role") != "caption"))
        .where((headline | heading | (F.col("role") == "item")) & unlinked)
        .join(holders, F.col("site").eqNullSafe(F.col("of_site")) & (scored["parent"] == holders["parent"]))
    )
    return main.select("path_id", "site", F.lit(False).alias("strict"), F.lit(True).alias("text"), "best").unionByName(
        beside.select("path_id", "site", (~headline).alias("strict"), F.lit(False).alias("text"), "best")
    )


def article_blocks(nodes: DataFrame, content_share: float = CONTENT_SHARE) -> DataFrame:
    """``(page, block_key)`` of the article of each page, each once."""
    texts = cut_lineage(text_pages(nodes))
    repeated = texts.where("repeated").select("path_id", "text_hash")
    paths = cut_lineage(content_paths(nodes, texts, content_share))
    kept = nodes.drop("site").join(paths, "path_id")
    furniture = kept.where("strict").select("path_id", "text_hash").distinct().join(repeated, ["path_id", "text_hash"]).withColumn("furniture", F.lit(True))
    kept = kept.join(furniture, ["path_id", "text_hash"], "left").where("not strict or (furniture is null and 2 * link_chars < letters)")
    headed = nodes.where("headline").join(repeated, ["path_id", "text_hash"], "left_anti").select("page").distinct()
    # the site is told with a path's first block of a batch, so it is counted by path
    firsts = nodes.where("first").groupBy("page").agg(F.min("path_id").alias("path_id"))
    of_site = nodes.where(F.col("path").isNotNull()).groupBy("path_id").agg(F.first("site").alias("site"))
    practice = firsts.join(headed.withColumn("headed", F.lit(1)), "page", "left").join(of_site, "path_id").groupBy("site")
    practice = practice.agg((F.sum(F.coalesce("headed", F.lit(0))) >= HEADLINE_PAGES * F.count("*")).alias("usual")).where("usual").select(F.col("site").alias("usual_site"))
    kept = kept.join(practice, F.col("site").eqNullSafe(F.col("usual_site")), "left").join(headed.withColumn("headed", F.lit(True)), "page", "left")
    by_head = kept.where("usual_site is not null and headed")
    other = kept.where("usual_site is null")
    text = F.col("text")
    own = other.groupBy("page").agg(
        F.sum(F.when(text, F.col("letters"))).alias("letters"),
        F.sum(F.when(text, F.col("link_chars"))).alias("links"),
        F.sum(F.when(text, F.col("sentences"))).alias("ends"),
        F.count(F.when(text, 1)).alias("n"),
        F.max("best").alias("best"),
    )
    ratio = (F.col("letters") - F.col("links")) / F.col("n") * _end_ratio(F.col("ends") / F.col("n"))
    reached = own.where(F.col("n") > 0).where(ratio >= PAGE_SHARE * F.col("best")).select("page")
    by_ratio = other.join(reached, "page", "left_semi")
    return by_head.select("page", "block_key").unionByName(by_ratio.select("page", "block_key")).distinct()


def line_blocks(texts: DataFrame, page: str, text: str) -> DataFrame:
    """``(page, block_key)`` of the non-empty lines of plain texts."""
    kind = texts.schema[page].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys = [], []
            for k, value in enumerate(batch.column(1)):
                for line in (value.as_py() or "").splitlines():
                    key = block_key(line)
                    if key:
                        at.append(k)
                        keys.append(key)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.string())], names=["page", "block_key"])

    return texts.select(F.col(page).alias("page"), F.col(text).alias("text")).mapInArrow(run, f"page {kind}, block_key string")


def article_content(
    pages: DataFrame, texts: DataFrame, page: str, site: Column, address: Column, html: str, text: str, content_share: float = CONTENT_SHARE
) -> DataFrame:
    """Article blocks of pages and of the plain texts made from them.

    ``pages`` and ``texts`` share the key ``page``; ``site`` groups pages of one layout and
    ``address`` tells one page from another when text is repeated (crawls of one address
    count once). Returns distinct ``(page, src_field, block_key)``: ``src_field`` is the name
    of ``html`` for blocks of pages, of ``text`` for lines of texts that are article blocks
    of their page. Null pages and texts, and null keys, have no rows.
    """
    nodes = cut_lineage(page_blocks(pages.where(F.col(page).isNotNull()), page, site, address, html))
    article = cut_lineage(article_blocks(nodes, content_share))
    discard(nodes)
    lines = line_blocks(texts.where(F.col(page).isNotNull()), page, text).distinct().join(article, ["page", "block_key"], "left_semi")
    both = article.select("page", F.lit(html).alias("src_field"), "block_key").unionByName(lines.select("page", F.lit(text).alias("src_field"), "block_key"))
    return both.withColumnRenamed("page", page)
