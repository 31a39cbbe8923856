"""A store of links laid out by link, with Bloom filters in front of it.

Links lie in a fixed number of hash buckets, one folder each, and the table says so:
a join on the link reads the store in place, without an exchange, however large it
is.  Each append keeps a Bloom filter of its links for every bucket it touches.  A
batch asks the filters first: links that no filter knows are new without a look at
the store, and only the buckets of the others are read, where the exact test decides.

Appends write the filters first and then the links, so a crash between them costs a
false alarm and no link.  An append that is run again finds its links stored.  There
is one writer at a time; readers see whole appends.  Compaction appends the merged
bucket before it removes the old files: a crash between leaves rows twice, which
``rows`` folds, inside the buckets.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pageloom.operators.frontier import distinct_links, without_known
from pageloom.operators.sized import stored_side
from pageloom.schema import FRONTIER_COLUMNS
from pageloom.session import stored
from pageloom.sources import files

BUCKETS = 64
#: Bits a link, probes a link, and the largest filter of a bucket in words of 64 bits;
#: a fuller filter raises more false alarms, which the exact test settles.
BITS, PROBES, MOST_WORDS = 12, 6, 1 << 17

_ROW = "link STRING, source STRING, published_at TIMESTAMP"
_FILTER = "bucket INT, words ARRAY<BIGINT>"


def _hashes() -> Column:
    return F.array(*[F.xxhash64("link", F.lit(i)) for i in range(PROBES)])


class LinkStore:
    """Links under ``path``, in ``buckets`` buckets, a number the store keeps."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        if not files.create(spark, f"{self.path}/layout", str(buckets)):
            buckets = int(files.text(spark, f"{self.path}/layout"))
        self.buckets = buckets
        self.table = "links_" + hashlib.md5(self.path.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({_ROW}, bucket INT) USING parquet "
            f"PARTITIONED BY (bucket) CLUSTERED BY (link) SORTED BY (link) INTO {buckets} BUCKETS "
            f"LOCATION '{self.path}/links'"
        )
        if spark.conf.get("spark.sql.catalogImplementation") == "hive":
            spark.sql(f"MSCK REPAIR TABLE {self.table}")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        """The number that Spark's own hash partitioning gives a link."""
        return rows.withColumn("bucket", F.pmod(F.hash("link"), F.lit(self.buckets)).cast("int"))

    # -- reading ----------------------------------------------------------------------

    def stored(self, buckets: list[int] | None = None) -> DataFrame:
        """The table as it lies, or some of its buckets."""
        self.spark.catalog.refreshTable(self.table)
        table = self.spark.table(self.table)
        return table if buckets is None else table.where(F.col("bucket").isin(buckets))

    def rows(self) -> DataFrame:
        """``source, link, published_at`` of every stored link and source, once."""
        return self.stored().groupBy("link", "source").agg(
            F.max("published_at").alias("published_at")
        ).select(*FRONTIER_COLUMNS)

    def filters(self) -> DataFrame:
        """``(bucket, filters)``: the filters of each bucket, one for each append."""
        if not files.names(self.spark, f"{self.path}/filters"):
            return self.spark.createDataFrame([], "bucket INT, filters ARRAY<ARRAY<BIGINT>>")
        kept = self.spark.read.schema(_FILTER).parquet(f"{self.path}/filters")
        return kept.groupBy("bucket").agg(F.collect_list("words").alias("filters"))

    def asked(self, found: DataFrame) -> DataFrame:
        """``found`` with ``bucket`` and ``maybe``: whether a filter knows the link.

        False is certain, true may be a false alarm.
        """
        known = F.expr(
            "exists(filters, w -> forall(_at, h -> (shiftright(w[CAST(pmod(h, 64L * size(w)) DIV 64 AS INT)],"
            " CAST(pmod(h, 64) AS INT)) & 1L) = 1L))"
        )
        hashed = self._bucketed(found).withColumn("_at", _hashes())
        joined = hashed.join(self.filters(), "bucket", "left")
        return joined.withColumn("maybe", F.coalesce(known, F.lit(False))).drop("_at", "filters")

    def known_among(self, found: DataFrame) -> DataFrame:
        """Links of ``found`` that are stored.

        Only the buckets of ``found`` are read.  They stream past the batch, which moves
        to the buckets; the store does not move.
        """
        there = [r.bucket for r in self._bucketed(found).select("bucket").distinct().collect()]
        batch = found.select("link").distinct().hint("shuffle_hash")
        return self.stored(there).select("link").join(batch, "link", "left_semi").distinct()

    def unseen(self, items: DataFrame) -> DataFrame:
        """Listed links that are not stored, each once per source."""
        found = stored(self.asked(distinct_links(items)), "asked")
        maybe = found.where("maybe")
        fresh = without_known(maybe, self.known_among(maybe))
        return found.where("NOT maybe").unionByName(fresh).select(*FRONTIER_COLUMNS)

    # -- writing ----------------------------------------------------------------------

    def add(self, rows: DataFrame) -> None:
        """Appends ``source, link, published_at``; the filters first."""
        rows = stored_side(self._bucketed(rows.where("link IS NOT NULL")), "adding")
        largest = rows.groupBy("bucket").count().agg(F.max("count")).first()[0]
        if not largest:
            return
        self._filter(rows, largest).write.mode("append").partitionBy("bucket").parquet(f"{self.path}/filters")
        self._append(rows)

    def add_unseen(self, items: DataFrame) -> DataFrame:
        """What ``items`` list and the store lacks, appended and given back."""
        fresh = stored(self.unseen(items), "fresh")
        self.add(fresh)
        return fresh

    def _append(self, rows: DataFrame) -> None:
        laid = rows.select("link", "source", "published_at", "bucket").repartition(self.buckets, "link")
        laid.write.insertInto(self.table)

    def _filter(self, rows: DataFrame, largest: int) -> DataFrame:
        """``(bucket, words)``: one filter for each bucket of ``rows``."""
        words = min(MOST_WORDS, 1 << max(0, (largest * BITS - 1) // 64).bit_length())
        at = F.pmod(F.col("h"), F.lit(64 * words))
        bits = rows.select("bucket", F.explode(_hashes()).alias("h")).select("bucket", at.alias("at")).select(
            "bucket", F.floor(F.col("at") / 64).cast("int").alias("word"),
            F.expr("shiftleft(1L, CAST(pmod(at, 64) AS INT))").alias("bits"),
        )
        blank = rows.select("bucket").distinct().select(
            "bucket", F.explode(F.sequence(F.lit(0), F.lit(words - 1))).alias("word"), F.lit(0).cast("bigint").alias("bits")
        )
        each = bits.unionByName(blank).groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
        inside = F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"])
        return each.groupBy("bucket").agg(inside.alias("words"))

    # -- compaction -------------------------------------------------------------------

    def _files(self, part: str) -> list[tuple[int, str]]:
        """``(bucket, path)`` of the files of ``links`` or ``filters``."""
        found = []
        for folder in files.names(self.spark, f"{self.path}/{part}"):
            if match := re.fullmatch(r"bucket=(\d+)", folder):
                inside = files.names(self.spark, f"{self.path}/{part}/{folder}")
                found += [
                    (int(match[1]), f"{self.path}/{part}/{folder}/{name}")
                    for name in inside if name.startswith("part-")
                ]
        return found

    def file_counts(self) -> dict[int, int]:
        """Files of each bucket."""
        return dict(Counter(bucket for bucket, _ in self._files("links")))

    def compact(self, most_files: int = 8) -> int:
        """Buckets with more than ``most_files`` files become one sorted file and one
        filter each; returns how many."""
        crowded = [b for b, n in self.file_counts().items() if n > most_files]
        if not crowded:
            return 0
        old = [path for part in ("links", "filters") for b, path in self._files(part) if b in set(crowded)]
        merged = self.stored(crowded).groupBy("link", "source").agg(F.max("published_at").alias("published_at"))
        self.add(merged)
        for path in old:
            files.remove(self.spark, path)
        return len(crowded)

