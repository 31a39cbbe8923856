"""The article store: known links, appends that store a link once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.operators.frontier import stored_among, without_known
from pageloom.operators.sized import build_side
from pageloom.schema import ARTICLE, ARTICLE_COLUMNS
from pageloom.session import stored
from pageloom.sources import files
from pageloom.sources.ledger import Ledger


def articles_at(spark: SparkSession, path: str) -> Ledger:
    return Ledger(spark, path, ARTICLE)


def read_store(spark: SparkSession, path: str, schema: str = ARTICLE) -> DataFrame:
    """The store's rows; a store that was never written is empty.  Any other folder of
    parquet files is read as it lies."""
    if files.names(spark, f"{path}/ledger"):
        return Ledger(spark, path, schema).rows()
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def known_links(spark: SparkSession, path: str, schema: str = ARTICLE) -> DataFrame:
    """Links already stored; only the link column is read."""
    return read_store(spark, path, schema).select("link")


def write_articles(articles: DataFrame, path: str, batch: str | None = None) -> None:
    """Append the articles whose link is not in the store yet.

    Running the same input again adds nothing.  A stored link is never replaced,
    so later changes of a page are not taken over; of several snapshots of one
    link in the input the latest published (then updated) is kept, ties by a hash
    of the record.

    For records from anywhere: they are written once to the shared folder; which of
    them go on is decided on narrow columns, with the store scanned past the batch.
    Contents are neither sorted nor, while the choice is small enough to be broadcast,
    moved.  Pages that were chosen by ``pending_pages`` need none of that:
    ``plans.ingest`` writes their records once.
    """
    row = F.monotonically_increasing_id().alias("row")
    parsed = stored(articles.where("link IS NOT NULL").select(*ARTICLE_COLUMNS, row), "parsed")
    digest = F.xxhash64(*ARTICLE_COLUMNS).alias("digest")
    rank = F.struct("published_at", "updated_at", "digest", "row")
    newest = (
        parsed.select("link", "published_at", "updated_at", digest, "row")
        .groupBy("link").agg(F.max(rank)["row"].alias("row"))
    )
    newest = stored(newest, "newest")

    def fresh(there: DataFrame) -> DataFrame:
        known = there.select("link")
        rows = stored(without_known(newest, stored_among(newest, known)).select("row"), "fresh")
        return parsed.join(build_side(rows), "row", "left_semi").select(*ARTICLE_COLUMNS)

    articles_at(articles.sparkSession, path).add(fresh, batch)
