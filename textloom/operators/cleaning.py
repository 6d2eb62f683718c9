"""Pages to articles: site profiles, checks, metadata, main text; incremental."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from .urls import is_relevant

CHECKS: dict[str, Callable[[Column], Column]] = {
    "is_february": lambda page: markup.in_february(markup.page_date(page)),
    "update_is_february": markup.update_in_february,
    "not_agency": lambda page: ~F.coalesce(page.rlike(r"(?i)\bdpa\b"), F.lit(False)),
    "not_locked": lambda page: F.coalesce(F.try_element_at(markup.meta_map(page), F.lit("article:content_tier")) != "locked", F.lit(True)),
}
GETTERS: dict[str, Callable[[Column], Column]] = {
    "h1": lambda page: markup.first_element_text(page, "h1"),
    "h2": lambda page: markup.first_element_text(page, "h2"),
    "images": lambda page: F.to_json(markup.image_links(page)),
}
KEYWORDS: dict[str, Callable[[Column], Column]] = {
    "none": lambda page: F.array().cast("array<string>"),
    "keywords": lambda page: markup.meta_keywords(page, "keywords"),
    "news_keywords": lambda page: markup.meta_keywords(page, "news_keywords"),
    "tags": markup.tag_keywords,
}


@dataclass
class SiteProfile:
    """What to drop and to keep of a site's pages; lists may be None."""

    irrelevant: list[str] | None = None
    metadata: list[str] | None = None
    checks: list[str] | None = None
    getters: list[str] | None = field(default_factory=lambda: ["h1", "h2"])
    keywords: str = "none"

    def __post_init__(self) -> None:
        self.irrelevant, self.metadata = self.irrelevant or [], self.metadata or []
        self.checks, self.getters = self.checks or [], self.getters or []
        for known, given in ((CHECKS, self.checks), (GETTERS, self.getters), (KEYWORDS, [self.keywords])):
            for name in given:
                if name not in known:
                    raise AttributeError(f"unknown function {name!r}; known are {sorted(known)}")


def read_profile(path: str, section: str) -> SiteProfile:
    """Profile of a section of a YAML file; a missing section is a KeyError."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return SiteProfile(**(yaml.safe_load(f)[section] or {}))


def example_text(pages: DataFrame, seed: int = 0, url: str = "url", page: str = "html_content") -> DataFrame:
    """One page, told by a hash of its address and the seed, with its main text: ``(url, text, meta)``."""
    one = pages.where(F.col(page).isNotNull()).orderBy(F.xxhash64(F.col(url), F.lit(seed)), url).limit(1)
    return one.select(F.col(url).alias("url"), markup.markup_to_text(markup.main_html(F.col(page))).alias("text"), markup.meta_map(F.col(page)).alias("meta"))


def clean_pages(pages: DataFrame, profile: SiteProfile, url: str = "url", page: str = "html_content", existing: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """Articles of the relevant pages: the columns of ``pages`` without the markup, and
    ``meta, keywords, text_html, text``.

    Pages whose key is in ``existing`` are done already. Cheap conditions come before the
    parsing of the markup. Pages without main text give no article.
    """
    todo = pages.join(existing.select(key), key, "left_anti") if existing is not None else pages
    todo = todo.where(F.col(page).isNotNull() & (F.col(page) != "") & is_relevant(F.col(url), profile.irrelevant))
    for name in profile.checks:
        todo = todo.where(CHECKS[name](F.col(page)))
    others = F.map_filter(F.create_map(*[x for n in profile.getters for x in (F.lit(n), GETTERS[n](F.col(page)))]), lambda k, v: v.isNotNull()) if profile.getters else None
    meta = markup.meta_map(F.col(page), profile.metadata)
    if others is not None:
        # what the getters find overrides metadata of the same name
        meta = F.map_concat(F.map_filter(meta, lambda k, v: ~k.isin(profile.getters)), others)
    made = todo.withColumns({"meta": meta, "keywords": KEYWORDS[profile.keywords](F.col(page)), "text_html": markup.main_html(F.col(page))})
    return made.where(F.col("text_html").isNotNull()).withColumn("text", markup.markup_to_text(F.col("text_html"))).drop(page)
