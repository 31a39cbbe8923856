"""The engine by site: listings, articles, and articles behind listing items."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pageloom import fixed
from pageloom.operators.articles import canonical_a, canonical_b, hydrate
from pageloom.plans.article_a import article_a
from pageloom.plans.article_b import article_b
from pageloom.plans.listing_a import index_a
from pageloom.plans.listing_b import index_b
from pageloom.plans.trees import page_trees
from pageloom.sources.channels import channel_pages, index_pages

_INDEX = {fixed.SOURCE_A: index_a, fixed.SOURCE_B: index_b}
_ARTICLE = {fixed.SOURCE_A: article_a, fixed.SOURCE_B: article_b}
_CANONICAL = {fixed.SOURCE_A: canonical_a, fixed.SOURCE_B: canonical_b}


def listing_items(pages: DataFrame, source: str) -> DataFrame:
    """Items of listing pages (``page_id, html``) of one site."""
    return _INDEX[source](page_trees(pages, "page_id"))


def channel_items(pages: DataFrame, channel: str) -> DataFrame:
    """Items that the listing pages of one channel of site A show.

    ``pages`` may hold pages of any address; they are told by ``url`` before the parse.
    """
    return listing_items(channel_pages(pages, channel), fixed.SOURCE_A)


def index_items(pages: DataFrame) -> DataFrame:
    """Items that the listing pages of site B show."""
    return listing_items(index_pages(pages), fixed.SOURCE_B)


def articles(pages: DataFrame, source: str) -> DataFrame:
    """Site records of article pages (``page_id, url, html``), one per page."""
    keep = ["page_id", "url"] + [c for c in ("item_kind",) if c in pages.columns]
    return _ARTICLE[source](page_trees(pages, *keep))


def articles_of(items: DataFrame, pages: DataFrame, source: str) -> DataFrame:
    """Records of the articles that listing items point to."""
    if source == fixed.SOURCE_A:
        items = items.withColumnRenamed("article_link", "link")
    return articles(hydrate(items, pages), source)


def canonical_articles(pages: DataFrame, source: str) -> DataFrame:
    """Article pages straight to the common record."""
    return _CANONICAL[source](articles(pages, source))
