"""The frontier as a queue that lasts between rounds: sorted runs, merged when read.

``add`` appends one run: its rows sorted newest first, cut into files of ``BLOCK``
rows, and one line for each file with the first and last place it holds.  ``take``
finds from those lines the files that can hold the next rows, reads them alone and
keeps the best by a top-k; the place of the last row taken is where every run of that
time goes on.  Nothing that was added is ever sorted again.

A place is ``(undated, minus the time, link, source, run)``: newest first, undated
links last, ties by link, source and run, nulls before others.  Places are all
different, as a run holds a link of a source once.  One caller at a time.  A take
counts when its line is in the log; one that fell before that is simply taken again.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pageloom.operators.frontier import distinct_links
from pageloom.schema import FRONTIER, FRONTIER_COLUMNS
from pageloom.session import stored
from pageloom.sources import files

BLOCK = 65_536

_PLACE = "STRUCT<undated: BOOLEAN, minus: BIGINT, link: STRING, source: STRING, run: INT>"
_BLOCKS = f"file STRING, n BIGINT, first {_PLACE}, last {_PLACE}, run INT"


def place(run: Column) -> Column:
    """Where a row stands; smaller is taken first."""
    undated = F.col("published_at").isNull()
    return F.struct(
        undated.alias("undated"), (-F.unix_micros("published_at")).alias("minus"), "link", "source", run.alias("run")
    )


class Queue:
    """A queue of ``source, link, published_at`` under ``path``."""

    def __init__(self, spark: SparkSession, path: str, block: int = BLOCK) -> None:
        self.spark, self.path, self.block = spark, path.rstrip("/"), block

    # -- what is there ----------------------------------------------------------------

    def _events(self) -> list[tuple[int, str, dict]]:
        """``(number, kind, detail)`` of adds, takes and merges, in order: one small file
        each, and merging starts them anew."""
        found = []
        for name in files.names(self.spark, f"{self.path}/log"):
            number, kind = name.split("-")
            found.append((int(number), kind, json.loads(files.text(self.spark, f"{self.path}/log/{name}"))))
        merges = [i for i, (_, kind, _) in enumerate(found) if kind == "merge"]
        return found[merges[-1]:] if merges else found

    def _log(self, number: int, kind: str, detail: dict) -> None:
        if not files.create(self.spark, f"{self.path}/log/{number:08d}-{kind}", json.dumps(detail)):
            raise ValueError(f"round {number} was already done")

    def _next(self, events: list) -> int:
        return events[-1][0] + 1 if events else 0

    def _cursors(self, events: list) -> dict[int, dict | None]:
        """For each run the place of its last row that was taken."""
        cursors: dict[int, dict | None] = {}
        for number, kind, detail in events:
            if kind in ("add", "merge"):
                cursors[number] = None
            elif detail["last"] is not None:
                # all runs of that time were read up to there
                for run, at in cursors.items():
                    cursors[run] = detail["last"] if at is None else max(at, detail["last"], key=_order)
        return cursors

    def _after(self, cursors: dict[int, dict | None], of: Column) -> Column:
        """True for places that were not taken yet."""
        left = F.lit(False)
        for run, at in cursors.items():
            own = of["run"] == run
            left = left | (own if at is None else own & (of > _literal(at)))
        return left

    def _blocks(self, cursors: dict) -> DataFrame:
        paths = [f"{self.path}/blocks/run={run}" for run in cursors]
        return self.spark.read.schema(_BLOCKS).option("basePath", f"{self.path}/blocks").parquet(*paths)

    def _rows(self, cursors: dict, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], f"{FRONTIER}, place {_PLACE}")
        rows = self.spark.read.schema(f"{FRONTIER}, run INT").option("basePath", f"{self.path}/runs").parquet(*paths)
        rows = rows.select(*FRONTIER_COLUMNS, place(F.col("run")).alias("place"))
        return rows.where(self._after(cursors, F.col("place")))

    # -- operations -------------------------------------------------------------------

    def _write(self, run: int, rows: DataFrame) -> None:
        """One run, and the lines that tell what its files hold."""
        order = [F.col("published_at").isNull(), F.desc("published_at"), "link", F.asc_nulls_first("source")]
        to = f"{self.path}/runs/run={run}"
        rows.select(*FRONTIER_COLUMNS).repartitionByRange(*order).sortWithinPartitions(*order).write.mode(
            "overwrite"
        ).option("maxRecordsPerFile", self.block).parquet(to)
        there = self.spark.read.schema(FRONTIER).parquet(to)
        at = place(F.lit(run))
        lines = there.select(F.col("_metadata.file_name").alias("file"), at.alias("place")).groupBy("file").agg(
            F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.max("place").alias("last")
        )
        lines.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/blocks/run={run}")

    def add(self, items: DataFrame) -> int:
        """Appends a run, each link of a source once; returns its number."""
        number = self._next(self._events())
        self._write(number, distinct_links(items))
        self._log(number, "add", {})
        return number

    def take(self, k: int) -> DataFrame:
        """The next ``k`` rows, newest first, which then are no longer in the queue."""
        events = self._events()
        number, cursors = self._next(events), self._cursors(events)
        head = self.head(k, cursors).select("place", *FRONTIER_COLUMNS) if cursors else self._rows({}, [])
        to = f"{self.path}/heads/{number}"
        head.write.mode("overwrite").parquet(to)
        head = self.spark.read.schema(f"place {_PLACE}, {FRONTIER}").parquet(to)
        last = head.agg(F.max("place").alias("last")).first()["last"]
        self._log(number, "take", {"last": last.asDict() if last else None})
        return head.select(*FRONTIER_COLUMNS)

    def head(self, k: int, cursors: dict | None = None) -> DataFrame:
        """The next ``k`` rows: the heads of the runs, merged by a top-k."""
        cursors = self._cursors(self._events()) if cursors is None else cursors
        return self._rows(cursors, self.head_files(k, cursors)).orderBy("place").limit(k)

    def head_files(self, k: int, cursors: dict) -> list[str]:
        """Files that can hold the next ``k`` rows.

        Whole files are counted by their last places until ``k`` rows are certain: no
        file that starts after that place is needed.  A file that was read in part
        counts for nothing.
        """
        if not cursors or k <= 0:
            return []
        lines = self._blocks(cursors).where(self._after(cursors, F.col("last")))
        whole = lines.where(self._after(cursors, F.col("first")))
        upto = Window.orderBy("last").rowsBetween(Window.unboundedPreceding, 0)  # a line for each file
        enough = whole.withColumn("sum", F.sum("n").over(upto)).where(F.col("sum") >= k)
        end = enough.agg(F.min("last").alias("end")).first()["end"]
        if end:
            lines = lines.where(F.col("first") <= _literal(end.asDict()))
        return [f"{self.path}/runs/run={r.run}/{r.file}" for r in lines.select("run", "file").collect()]

    def rest(self) -> DataFrame:
        """What is in the queue, in no order."""
        cursors = self._cursors(self._events())
        paths = [f"{self.path}/runs/run={run}" for run in cursors]
        return self._rows(cursors, paths).select(*FRONTIER_COLUMNS)

    def merge(self) -> int:
        """All runs become one, so that a take has few heads to read; returns its number.

        A link that several runs hold is kept once, with its latest time.
        """
        number = self._next(self._events())
        self._write(number, distinct_links(stored(self.rest(), "rest")))
        self._log(number, "merge", {})
        return number


def _order(at: dict) -> tuple:
    """Spark's order of places: nulls first."""
    return tuple((v is not None, v if not isinstance(v, str) else v.encode()) for v in at.values())


def _literal(at: dict) -> Column:
    kinds = {"undated": "boolean", "minus": "bigint", "link": "string", "source": "string", "run": "int"}
    return F.struct(*[F.lit(at[name]).cast(kind).alias(name) for name, kind in kinds.items()])
