"""Page snapshots: reading, spreading over the cluster, gating by HTTP status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pageloom import fixed
from pageloom.schema import PAGE_MIN


def read_pages(
    spark: SparkSession, path: str, schema: str = PAGE_MIN, fmt: str = "parquet"
) -> DataFrame:
    """Snapshots from any file format Spark reads; compressed text is decoded by
    Spark's own codecs.  The schema is given, never inferred."""
    return spark.read.schema(schema).format(fmt).load(path)


def _nodes(plan) -> list[str]:
    """Names of the nodes of a physical plan, before it runs."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.initialPlan()
    below = plan.children()
    return [plan.nodeName(), *(n for i in range(below.size()) for n in _nodes(below.apply(i)))]


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a small or badly split input a task per core before the parse.

    Only a scan is looked at: what has been exchanged already, and what has several
    splits per core, as every large input has, passes through.  So does an input of
    as many files as cores; with fewer, a row group that cannot be cut may be dealt
    out as several splits of which one has all rows.  The count of partitions is never
    lowered.  Hashing a key, unlike dealing rows out in turn, gives the same
    partitions again when a lost task is re-run.
    """
    if df.isStreaming or "Exchange" in _nodes(df._jdf.queryExecution().executedPlan()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits, files = df.rdd.getNumPartitions(), len(df.inputFiles())
    if splits >= 4 * cores or (splits >= cores and (files >= cores or not files)):
        return df
    return df.repartition(max(splits, cores), key)


def accepted(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("status") == 200)


def reject_reason(source: Column) -> Column:
    """Why a page is left out, as each site words it; NULL for an accepted page.

    Site A tells a missing page from other errors, which carry the body; site B
    carries the status code.
    """
    code = F.coalesce(F.col("status").cast("string"), F.lit("0"))
    error_b = F.replace(F.lit(fixed.FETCH_ERROR_B), F.lit("{status}"), code)
    error_a = F.concat(F.lit(fixed.FETCH_ERROR_A), F.coalesce(F.col("html"), F.lit("")))
    ok = F.coalesce(F.col("status") == 200, F.lit(False))
    return F.when(
        ~ok,
        F.when(source == fixed.SOURCE_B, error_b)
        .when(F.col("status") == 404, F.lit(fixed.NOT_FOUND_A))
        .otherwise(error_a),
    )


def status_gate(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``; the second has a ``reason``.  No row is lost.

    ``pages`` needs ``source`` and ``status``.
    """
    reasoned = pages.withColumn("reason", reject_reason(F.col("source")))
    return accepted(pages), reasoned.where("reason IS NOT NULL")
