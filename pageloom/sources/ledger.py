"""A store of batches with a ledger: what is listed there is stored, nothing else.

A batch is written to a folder of its own and counts from the moment its line is in
the ledger.  Lines are files numbered without gaps, each created only if its number is
free, which is the one step that has to be atomic.  A writer that finds its number
taken has been overtaken: it takes out what the batches listed meanwhile hold too, and
tries the next number.  So two writers, or one that was killed and runs again, store a
key once, and readers never see half a batch.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from pageloom.sources import files


class Ledger:
    """Batches under ``path``; ``key`` names the column that is stored once."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "link") -> None:
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def lines(self) -> list[dict]:
        """``batch`` and ``folder`` of every line, in order."""
        names = [n for n in files.names(self.spark, f"{self.path}/ledger") if n.isdigit()]
        return [json.loads(files.text(self.spark, f"{self.path}/ledger/{n}")) for n in names]

    def rows(self, lines: list[dict] | None = None) -> DataFrame:
        """The rows of all batches listed, or of some."""
        folders = [f"{self.path}/data/{x['folder']}" for x in (self.lines() if lines is None else lines)]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def write(self, rows: DataFrame, folder: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/data/{folder}")

    def commit(self, batch: str, folder: str, after: int) -> bool:
        """Lists a folder that was written when the ledger had ``after`` lines.

        False if the batch is listed already; then the folder stays unseen.
        """
        while True:
            lines = self.lines()
            if any(x["batch"] == batch for x in lines):
                return False
            if newer := lines[after:]:
                self.spark.catalog.refreshByPath(f"{self.path}/data")
                own = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{folder}")
                folder = f"{folder}-after-{len(lines)}"
                self.write(own.join(self.rows(newer).select(self.key), self.key, "left_anti").select(*own.columns), folder)
                after = len(lines)
            line = json.dumps({"batch": batch, "folder": folder})
            if files.create(self.spark, f"{self.path}/ledger/{after:08d}", line):
                return True

    def add(self, rows_of, batch: str | None = None) -> bool:
        """Stores what ``rows_of`` makes of the rows already there, unless the batch is
        listed.  Give a batch of a stream its own name, and running it again is safe."""
        batch = batch or uuid.uuid4().hex
        lines = self.lines()
        if any(x["batch"] == batch for x in lines):
            return False
        folder = uuid.uuid4().hex
        self.write(rows_of(self.rows(lines)), folder)
        return self.commit(batch, folder, len(lines))
