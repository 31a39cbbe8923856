"""Pages to the article store: chosen before the parse, written once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from pageloom.operators.articles import pending_pages
from pageloom.plans.sites import canonical_articles
from pageloom.sources.store import articles_at


def store_pages(spark: SparkSession, path: str, pages: dict[str, DataFrame], batch: str | None = None) -> bool:
    """Appends the articles of pages (``page_id, url, html``, by source) whose link is
    not stored; False if ``batch`` was stored before.

    An article's link is its page's url, so the latest snapshot of each url that is
    not stored is chosen on narrow columns; only those pages are parsed, and their
    records are written once.
    """

    def fresh(there: DataFrame) -> DataFrame:
        known = there.select("link")
        parsed = [canonical_articles(pending_pages(p, known), source) for source, p in pages.items()]
        return reduce(DataFrame.unionByName, parsed)

    return articles_at(spark, path).add(fresh, batch)
