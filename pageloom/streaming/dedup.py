"""Link de-duplication inside a stream of listing items."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pageloom.session import keep_state_on_disk


def first_sightings(items: DataFrame, delay: str, time_column: str = "seen_at") -> DataFrame:
    """Each link once per ``delay`` of event time.

    State is one entry per link and is dropped when the watermark passes, so it
    is bounded by the links seen within ``delay``; a link that comes back later
    is caught by the store, not here.

    ``delay`` is also what may be lost: a row that arrives more than ``delay`` of
    event time behind the newest one is left out.  ``late_rows`` counts those.
    """
    return items.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(["source", "link"])


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query left out for being later than its delay, as far as its
    kept progress goes (``spark.sql.streaming.numRecentProgressUpdates`` batches)."""
    return sum(
        state["numRowsDroppedByWatermark"]
        for progress in query.recentProgress for state in progress["stateOperators"]
    )


def without_stored(items: DataFrame, store: DataFrame) -> DataFrame:
    """Stream-static existence test against links already stored."""
    return items.join(store.select("link"), "link", "left_anti")


class _Sighted(StatefulProcessor):
    """One timestamp for each link, cleared by a timer ``keep`` of event time later."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at TIMESTAMP")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        first = None
        for row in rows:
            if row.ms < mark:
                yield Row(source=key[0], link=key[1], seen_at=row.seen_at, late=True)
            elif first is None or row.ms < first.ms:
                first = row
        if first is not None and not self.seen.exists():
            self.seen.update((first.seen_at,))
            self.handle.registerTimer(first.ms + self.keep_ms)
            yield Row(source=key[0], link=key[1], seen_at=first.seen_at, late=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def sightings(items: DataFrame, keep: timedelta, delay: str, time_column: str = "seen_at") -> DataFrame:
    """``(source, link, seen_at, late)``: each link once per ``keep`` of event time, and
    every row that came later than ``delay`` as a row of its own.

    State is one time for each link, cleared by a timer when the watermark passes the
    link's end.  Spark leaves late rows out where it sees the watermarked column; here
    the grouped rows carry a copy of the time, so they arrive, are told by the
    watermark of their batch and come out marked.  A row without a time is left out.
    """
    keep_state_on_disk(items.sparkSession)
    timed = items.where(F.col(time_column).isNotNull()).withWatermark(time_column, delay)
    plain = timed.select(
        "source", "link", F.unix_millis(time_column).alias("ms"),
        F.timestamp_micros(F.unix_micros(time_column)).alias("seen_at"),
    )
    return plain.groupBy("source", "link").transformWithState(
        _Sighted(int(keep / timedelta(milliseconds=1))), "source STRING, link STRING, seen_at TIMESTAMP, late BOOLEAN",
        "append", "eventTime",
    )
