"""The channel dimension of site A."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.fixed import CHANNELS, INDEX_B


def channels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHANNELS, "name STRING, base_url STRING")


def with_base_url(df: DataFrame, name_column: str) -> DataFrame:
    """Add ``base_url`` by channel name.  The dimension has 22 rows for good, so
    it is broadcast and the other side is not moved."""
    dim = F.broadcast(channels(df.sparkSession).withColumnRenamed("name", name_column))
    return df.join(dim, name_column, "left")


def channel_pages(pages: DataFrame, name: str) -> DataFrame:
    """Listing pages of one channel, later pages of the listing included.

    The address is a literal prefix, so the filter reaches the scan.
    """
    return _below(pages, dict(CHANNELS)[name])


def index_pages(pages: DataFrame) -> DataFrame:
    """Pages of site B's one listing."""
    return _below(pages, INDEX_B)


def _below(pages: DataFrame, base: str) -> DataFrame:
    return pages.where((F.col("url") == base) | F.col("url").startswith(base + "?"))
