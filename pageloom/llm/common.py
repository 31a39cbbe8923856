"""What the operators share: reading, bounded batches, ordered runs, samples."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pageloom.operators.sized import is_small
from pageloom.session import shared_dir as shared_dir, stored as stored

#: Characters of text that a Python worker handles at once.
SLICE_CHARS = 2_000_000
#: The same where distinct words are looked up, which larger slices repeat less.
WORD_SLICE_CHARS = 4_000_000


def read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def empty_as(text: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(text), F.lit(""))


def if_small(df: DataFrame) -> DataFrame:
    """A stored narrow table, marked for a broadcast if its measured size allows."""
    return F.broadcast(df) if is_small(df) else df


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[list[str]]:
    """``texts`` in runs of at most ``limit`` characters, or one text."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield texts[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield texts[start:]


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_CHARS):
    """``(batch slice, texts)`` of at most ``limit`` bytes, or one row.

    The text is the last column; null comes as the empty string.  Only the texts of
    one slice are Python strings at a time.
    """
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start, size = 0, 0
        for i, n in enumerate([*sizes, None]):
            if n is None or (i > start and size + n > limit):
                if i > start:
                    yield batch.slice(start, i - start), [
                        t or "" for t in column.slice(start, i - start).to_pylist()
                    ]
                start, size = i, 0
            size += n or 0


def per_text(
    docs: DataFrame, keep: list[str], added: str, fn: Callable[[list[str]], dict],
    limit: int = SLICE_CHARS,
) -> DataFrame:
    """One row per document: the ``keep`` columns, then ``added`` (DDL) as ``fn``
    gives it for a list of texts.  Other columns are not read.

    Kept columns pass through as Arrow arrays, so nulls and large integers stay
    as they are.
    """
    chosen = docs.select(*keep, "text")
    fields = [f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep]
    ddl = ", ".join([*fields, added])
    shape = docs.sparkSession.createDataFrame([], ddl).schema
    arrow = to_arrow_schema(shape)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, limit):
            made = fn(texts)
            new = [
                made[f.name] if isinstance(made[f.name], pa.Array)
                else pa.array(made[f.name], type=f.type)
                for f in list(arrow)[n:]
            ]
            old = [part.column(i).cast(arrow.field(i).type) for i in range(n)]
            yield pa.RecordBatch.from_arrays([*old, *new], names=arrow.names)

    return chosen.mapInArrow(run, shape)


def tasks(spark: SparkSession) -> int:
    """Tasks to deal rows out to: the session's own setting for shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """An object that lives as long as the Python worker, over many tasks."""
    holder = sys.modules.setdefault("_worker_cache", types.ModuleType("_worker_cache"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def sample_by_class(rows: DataFrame, label: str, key: str, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each class, at most twice as many in all.

    Chosen by the hash of ``key``: one narrow count, then one scan, no shuffle
    of texts, the same rows every time.  Classes with fewer rows come whole.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows.limit(0)
    space = 1 << 30
    rate = F.lit(0)
    for value, n in counts.items():
        share = space if n <= per_class else int(space * per_class / n)
        rate = F.when(F.col(label).eqNullSafe(F.lit(value)), F.lit(share)).otherwise(rate)
    chosen = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(space)) < rate
    return rows.where(chosen).limit(2 * per_class * len(counts))


def run_of(text: str, chars: int) -> Column:
    """At most ``chars`` code points of a text, from a place its hash decides: what a
    classifier is fitted to, where texts of any length have to fit the driver."""
    length = F.length(text)
    at = F.pmod(F.xxhash64(text), F.greatest(F.lit(1), length - chars + 1)).cast("int")
    return F.substring(F.col(text), at + 1, F.lit(chars))


def running_totals(df: DataFrame, order: list, amounts: dict[str, str]) -> DataFrame:
    """``df`` with, for each ``name: amount``, the sum of the column ``amount``
    over all rows before this one.

    Rows are laid out in ranges of ``order``, each range is summed on its own,
    and only the sums of the ranges, one per task, are added up in one place.
    ``order`` has to be total but for rows that are equal in every column.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(tasks(spark), *order).withColumn("_run", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    inside = Window.partitionBy("_run").orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    sums = ranged.groupBy("_run").agg(*[F.sum(a).alias(f"_sum_{n}") for n, a in amounts.items()])
    starts = sums.select(
        "_run", *[F.coalesce(F.sum(f"_sum_{n}").over(over), zero).alias(f"_at_{n}") for n in amounts]
    )
    before = {f"_in_{n}": F.coalesce(F.sum(a).over(inside), zero) for n, a in amounts.items()}
    return (
        ranged.withColumns(before)
        .join(F.broadcast(starts), "_run")  # one row per task of the range exchange
        .withColumns({n: F.col(f"_at_{n}") + F.col(f"_in_{n}") for n in amounts})
        .drop("_run", *before, *[f"_at_{n}" for n in amounts])
    )
