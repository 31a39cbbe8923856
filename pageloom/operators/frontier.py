"""Frontier operators: union of listings, links not stored yet, newest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom import fixed
from pageloom.operators.sized import stored_side


def index_union(items_a: DataFrame, items_b: DataFrame) -> DataFrame:
    """Both sites' listing items as ``source, link, published_at``."""
    a = items_a.select(
        F.lit(fixed.SOURCE_A).alias("source"), F.col("article_link").alias("link"), "published_at"
    )
    b = items_b.select(F.lit(fixed.SOURCE_B).alias("source"), "link", "published_at")
    return a.unionByName(b)


def distinct_links(items: DataFrame) -> DataFrame:
    """One row per source and link, with the latest time it was listed under.

    A link listed in a third of all rows is no hot spot: the maximum is taken
    map-side, so each task sends one row per link.
    """
    return (
        items.where("link IS NOT NULL")
        .groupBy("source", "link")
        .agg(F.max("published_at").alias("published_at"))
    )


def without_known(items: DataFrame, known: DataFrame) -> DataFrame:
    """Existence test of all links at once."""
    return items.join(known.select("link"), "link", "left_anti")


def stored_among(found: DataFrame, store: DataFrame) -> DataFrame:
    """Links of ``found`` that the store holds.

    The store grows for ever and a batch does not, so the store is scanned past
    the batch and not shuffled, as long as the batch's measured size allows a
    broadcast; beyond that Spark picks the join.  Give it a ``stored_side``, or any
    stored table.
    """
    return store.select("link").join(found.select("link"), "link", "left_semi")


def new_links(items: DataFrame, known: DataFrame) -> DataFrame:
    """Listed links that are not stored, each once per source, whatever the source.

    What is listed is reduced before it moves and stored, with its size measured on
    the way; beyond a broadcast the existence test moves narrow rows once more.
    """
    found = stored_side(distinct_links(items), "listed")
    return without_known(found, stored_among(found, known)).select("source", "link", "published_at")


def newest_first(frontier: DataFrame) -> DataFrame:
    """Total order; a range-partitioned sort, undated links last."""
    return frontier.orderBy(F.desc_nulls_last("published_at"), F.asc("link"), F.asc("source"))


def take_next(frontier: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``(next k links to fetch, the rest)``.

    The head is a top-k (k rows per task, no full sort), stored because both parts
    use it.  The rest is an anti join; Spark broadcasts the head if it is small.
    """
    head = stored_side(newest_first(frontier).limit(k), "head")
    taken = head.select(F.col("source").alias("_source"), F.col("link").alias("_link"))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("link") == F.col("_link"))
    return head, frontier.join(taken, same, "left_anti")
