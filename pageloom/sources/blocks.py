"""Block payloads stored as shredded VARIANT and read back by path.

Writing infers from the payloads which members are worth columns of their own; the
rest stays in the binary part.  Reading asks for paths, and the scan then takes those
members alone.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

BLOCK_ROW = "id STRING, link STRING, pos INT, type STRING, data VARIANT"
_WRITING = {
    "spark.sql.variant.writeShredding.enabled": "true",
    "spark.sql.variant.inferShreddingSchema": "true",
}
_READING = {
    "spark.sql.variant.allowReadingShredded": "true",
    "spark.sql.variant.pushVariantIntoScan": "true",
}


@contextlib.contextmanager
def _set(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Appends the rows of ``operators.articles.block_variant``."""
    with _set(blocks.sparkSession, _WRITING):
        blocks.select("id", "link", "pos", "type", "data").write.mode("append").parquet(path)


def read_blocks(spark: SparkSession, path: str, members: Mapping[str, str], kind: str = "string") -> DataFrame:
    """``id, link, pos, type`` and a column for each of ``members`` (name -> path); null
    where a payload has none, or one of another kind."""
    taken = [f"try_variant_get(data, '{at}', '{kind}') AS {name}" for name, at in members.items()]
    for key, value in _READING.items():  # the plan is made when the frame is used
        spark.conf.set(key, value)
    return spark.read.schema(BLOCK_ROW).parquet(path).selectExpr("id", "link", "pos", "type", *taken)
