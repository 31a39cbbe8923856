"""Endless poll of listings as a stream of page files.

Each trigger parses the pages that arrived and keeps the links that were never seen.
What was seen is the query's state, one entry for each link, seeded once from what
the store held when the query first started: no trigger reads the store.  A trigger's
rows become one for each link before they meet the state, which is Spark's own
de-duplication: no Python call for a link.  Only links that pass it are looked up among
the seeds, and only if there were any.  A page is one row, so every micro-batch holds
whole pages.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pageloom import fixed
from pageloom.operators.frontier import distinct_links, index_union, stored_among, without_known
from pageloom.operators.sized import stored_side
from pageloom.plans.sites import listing_items
from pageloom.schema import FRONTIER, FRONTIER_COLUMNS
from pageloom.session import keep_state_on_disk
from pageloom.sources import files
from pageloom.sources.pages import spread

# Listing pages as they arrive; ``source`` tells the site.
LISTING_PAGE = "page_id BIGINT, source STRING, url STRING, html STRING"


def listed(pages: DataFrame) -> DataFrame:
    """Listing items of both sites; each page is parsed once, by its own site."""

    def items(source: str) -> DataFrame:
        return listing_items(pages.where(F.col("source") == source), source)

    return index_union(items(fixed.SOURCE_A), items(fixed.SOURCE_B))


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each source and link of a batch, with the latest time: a link that
    every page lists moves once a batch."""
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch]).group_by(["source", "link"]).aggregate([("published_at", "max")])
            table = table.rename_columns({"published_at_max": "published_at"}).select(FRONTIER_COLUMNS)
            yield from table.combine_chunks().to_batches()


#: A link's sources and times of one trigger.
_LISTED = "link STRING, sources ARRAY<STRING>, times ARRAY<TIMESTAMP>"


def _merged(tables: list[pa.Table]) -> pa.Table:
    """One row for each source and link, with the latest time."""
    table = pa.concat_tables(tables).group_by(["source", "link"], use_threads=False)
    return table.aggregate([("published_at", "max")]).rename_columns({"published_at_max": "published_at"})


def _by_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each link of a task, which has all rows of its links; rows are merged
    whenever they are twice what was left by the last time."""
    held, rows, limit = [], 0, 1 << 16
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows > limit:
            held = [_merged(held)]
            rows = held[0].num_rows
            limit = max(limit, 2 * rows)
    if rows:
        lists = _merged(held).group_by("link", use_threads=False)
        lists = lists.aggregate([("source", "list"), ("published_at", "list")])
        lists = lists.select(["link", "source_list", "published_at_list"]).rename_columns(["link", "sources", "times"])
        yield from lists.to_batches(max_chunksize=1 << 14)


class _Unstored(StatefulProcessor):
    """A flag for each seed; the rows of any other link pass."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("stored", "there BOOLEAN")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.stored.update((True,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if not self.stored.exists():
            yield from rows

    def close(self) -> None:
        pass


def unseen(items: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Links of a stream of ``source, link, published_at`` the first time they are seen,
    one row for each source of that trigger, with its latest time.

    ``known``, if given, is read by the first batch alone and becomes state.
    """
    keep_state_on_disk(items.sparkSession)
    links = items.where("link IS NOT NULL").select(*FRONTIER_COLUMNS).mapInArrow(_reduced, FRONTIER)
    each = links.repartition("link").mapInArrow(_by_link, _LISTED).dropDuplicates(["link"])
    listed_by = F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("times").alias("published_at")))
    first = each.select("link", listed_by).select(*FRONTIER_COLUMNS)
    if known is None:
        return first
    seeds = known.select("link").where("link IS NOT NULL").distinct()
    return first.groupBy("link").transformWithState(
        _Unstored(), FRONTIER, "append", "none", initialState=seeds.groupBy("link")
    )


def _seeded(spark: SparkSession, found: DataFrame, checkpoint: str) -> bool:
    """Whether the query of a checkpoint has seeds: whether anything was found when its
    first batch began."""
    path = f"{checkpoint}/seeded"
    if not files.names(spark, f"{checkpoint}/offsets"):
        files.remove(spark, path)
        files.create(spark, path, "no" if found.isEmpty() else "yes")
    elif "seeded" not in files.names(spark, checkpoint):
        raise ValueError("a checkpoint of an earlier form: start with a new one, its links are in the store")
    return files.text(spark, path) == "yes"


def frontier_rows(spark: SparkSession, store_path: str, but: str = "") -> DataFrame:
    """Everything the polls of a store have found, or all but what one has; empty if
    there was none yet."""
    folders = [f"{store_path}/{n}" for n in files.names(spark, store_path) if n != but and n[0] not in "._"]
    if not folders:
        return spark.createDataFrame([], FRONTIER)
    return spark.read.schema(FRONTIER).option("recursiveFileLookup", "true").parquet(*folders)


def append_new(pages: DataFrame, store_path: str) -> None:
    """One round without a stream: what a batch lists minus what is stored, appended.

    Running a batch again finds all of its links stored and adds nothing, so a
    replay after a failure is harmless.
    """
    found = stored_side(distinct_links(listed(spread(pages, "page_id"))), "found")
    store = frontier_rows(pages.sparkSession, store_path)
    fresh = without_known(found, stored_among(found, store))
    fresh.select(*FRONTIER_COLUMNS).write.mode("append").parquet(f"{store_path}/rounds")


def poll(
    spark: SparkSession,
    pages_path: str,
    store_path: str,
    checkpoint: str,
    every: str | None = None,
    max_files: int = 1000,
    parts: int | None = None,
) -> StreamingQuery:
    """Start the poll: once over what is there, or ``every`` interval for good.

    Batch ``n`` of a query writes its own folder and nothing else, so a batch that is
    run again after a failure replaces what it had written.  ``parts`` deals the pages
    of a trigger out to so many tasks, for page files that cannot be split.
    """
    arriving = (
        spark.readStream.schema(LISTING_PAGE).option("maxFilesPerTrigger", max_files).parquet(pages_path)
    )
    if parts:
        arriving = arriving.repartition(parts, "page_id")
    # the query's own name, which outlives restarts but not its checkpoint
    files.create(spark, f"{checkpoint}/owner", uuid.uuid4().hex)
    owner = files.text(spark, f"{checkpoint}/owner")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store_path}/{owner}/{number}")

    # its own rows are in its state; a first batch run again must not find them stored
    known = frontier_rows(spark, store_path, owner)
    fresh = unseen(listed(arriving), known if _seeded(spark, known, checkpoint) else None)
    writer = fresh.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
