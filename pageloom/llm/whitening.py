"""Whitening of embeddings with MLlib block matrices.

Rows are centred by exact whole-number sums, numbered without gaps and indexed into
blocks of a distributed matrix.  The transposed matrix times the matrix is the scatter;
its eigenvectors, found locally, over the roots of the eigenvalues are the whitening
matrix, and the matrix times that one projects the rows.  The covariance of what
comes out is taken the same way, centred again, and compared with the identity.

Size.  A block holds ``BLOCK_ROWS`` rows; products over rows are summed in as many
tasks as the session's shuffles have, so no task gets all blocks for the one block of
the result.  The driver holds matrices of dimension times dimension only.

Cases.  Rows whose vector is null or holds a null or non-finite entry are dropped.
Shorter vectors count as filled up with zeros.  Entries are held at 2^40 either way
before rounding.  ``deviation`` is null where 64 bits cannot hold it.  Equal rows come
back alike and count as often.  A component without spread (an eigenvalue under
``LEAST`` of the largest) has a null ``whitened`` and is left out of ``identity_error``,
which is null if no component has spread.  ``explained`` is null if no dimension has
spread.  With fewer dimensions than components there are as many components as
dimensions.  An empty table, or one of empty vectors, gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pageloom.llm.common import read, stored, tasks
from pageloom.llm.vectors import finite, width

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Largest entry, either way, and rows of a block.
MOST, BLOCK_ROWS = float(1 << 40), 1024
#: Eigenvalue, as a share of the largest, under which a component has no spread.
LEAST = 1e-12


def whole(table: DataFrame, dim: int) -> DataFrame:
    """``(vec_id, x)``: the remaining rows as whole numbers, ``dim`` each."""
    held = F.transform("embedding", lambda c: F.least(F.lit(MOST), F.greatest(F.lit(-MOST), c.cast("double"))))
    x = F.transform(held, lambda c: F.floor(c * SCALE) + SHIFT)
    filled = F.slice(F.concat(x, F.array_repeat(F.lit(SHIFT).cast("bigint"), dim)), 1, dim)
    return table.select("vec_id", filled.alias("x"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` stored with ``row``, counting from 0 without a gap."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    kept = stored(rows.withColumns({"part": F.spark_partition_id(), "inside": inside}), "rows")
    sizes = kept.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()  # one for each task
    starts, total = {}, 0
    for part, n in sorted(map(tuple, sizes)):
        starts[part], total = total, total + n
    before = kept.sparkSession.createDataFrame(list(starts.items()) or [(0, 0)], "part INT, before BIGINT")
    return kept.join(F.broadcast(before), "part").withColumn("row", F.col("before") + F.col("inside")).drop(
        "part", "inside", "before"
    )


def sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Rows, and the exact sum of each dimension."""
    each = [F.sum(F.col("x")[i].cast("decimal(38,0)")) for i in range(dim)]
    n, *totals = rows.agg(F.count(F.lit(1)), *each).first()
    return n, [int(t or 0) for t in totals]


def block_matrix(rows: DataFrame, vector: Column, n: int, dim: int) -> BlockMatrix:
    """The rows as blocks, each in the place that its ``row`` says."""
    indexed = rows.select(F.col("row").alias("index"), array_to_vector(vector).alias("vector"))
    indexed = MLUtils.convertVectorColumnsFromML(indexed, "vector")
    return IndexedRowMatrix(indexed, n, dim).toBlockMatrix(BLOCK_ROWS, dim)


def scatter(spark: SparkSession, blocks: BlockMatrix) -> np.ndarray:
    """The transposed matrix times the matrix.

    The sum over rows is split into as many tasks as the session's shuffles have: by
    default MLlib would bring all blocks to the one task that holds the result.
    """
    turned = blocks.transpose()
    split = min(tasks(spark), blocks.numRowBlocks)
    product = turned._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, split)
    return BlockMatrix(product, turned.rowsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def released(blocks: BlockMatrix) -> None:
    """Frees the kept blocks; what still needs them computes them again."""
    blocks._java_matrix_wrapper._java_model.blocks().unpersist(False)


def projected(spark: SparkSession, blocks: BlockMatrix, by: np.ndarray) -> DataFrame:
    """``(row, w)``: every row times the matrix ``by``, through block products."""
    dim, k = by.shape
    right = spark.sparkContext.parallelize([((0, 0), Matrices.dense(dim, k, by.ravel("F").tolist()))], 1)
    product = blocks.multiply(BlockMatrix(right, dim, k)).toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return stored(rows.select(F.col("index").alias("row"), vector_to_array("vector").alias("w")), "whitened")


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def whitened(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row and component, see ``query``."""
    spark = table.sparkSession
    kept = table.where(finite(F.col("embedding"))).select(F.col("vec_id").alias("vec_id"), "embedding")
    dim = width(kept, "embedding")
    rows = numbered(whole(kept, dim))
    n, totals = sums(rows, dim)
    if not n or not dim:
        none = F.lit(None)
        return rows.where("false").select(
            "vec_id", none.cast("int").alias("component"), none.cast("bigint").alias("n"),
            none.cast("bigint").alias("deviation"),
            *[none.cast("double").alias(c) for c in ("whitened", "explained", "identity_error")],
        )
    # S = n q + r: x - q is a whole number, and r / n is less than one
    off = F.zip_with("x", _longs([t // n for t in totals]), lambda x, q: x - q)
    rows = rows.withColumn("off", off)
    rest = [t % n for t in totals]
    shares = F.array(*[F.lit(r / n) for r in rest])
    centred = F.zip_with("off", shares, lambda x, r: x.cast("double") - r)
    exact = F.expr(
        "aggregate(zip_with(off, rest, (x, r) -> CAST(n AS DECIMAL(19,0)) * CAST(x AS DECIMAL(19,0)) - r),"
        " CAST(0 AS DECIMAL(38,0)), (t, d) -> CAST(try_add(t, try_multiply(d, d)) AS DECIMAL(38,0)))"
    )
    counted = rows.withColumns({"n": F.lit(n).cast("bigint"), "rest": _longs(rest)}).select(
        "row", "vec_id", "n", exact.try_cast("bigint").alias("deviation"),
    )
    blocks = block_matrix(rows, centred, n, dim).persist(StorageLevel.MEMORY_AND_DISK)
    values, vectors = np.linalg.eigh(scatter(spark, blocks) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, dim)
    spread = values[:k] > LEAST * max(values[0], 0)
    spread &= values[:k] > 0
    roots = np.sqrt(np.where(spread, values[:k], 1))
    by = np.where(spread, vectors[:, :k] / roots, 0)
    made = projected(spark, blocks, by)
    released(blocks)

    means = made.agg(*[F.avg(F.col("w")[i]) for i in range(k)]).first()
    again = F.zip_with("w", F.array(*[F.lit(float(m)) for m in means]), lambda w, m: w - m)
    again = block_matrix(made, again, n, k).persist(StorageLevel.MEMORY_AND_DISK)
    covariance = scatter(spark, again) / n
    released(again)
    chosen = np.flatnonzero(spread)
    error = np.abs(covariance - np.eye(k))[np.ix_(chosen, chosen)].max() if len(chosen) else None
    trace = float(values.sum())
    explained = [float(v) / trace if trace > 0 else None for v in values[:k]]
    of = F.array(*[F.lit(e).cast("double") for e in explained])
    there = F.array(*[F.lit(bool(s)) for s in spread])
    each = made.select("row", F.posexplode("w").alias("at", "whitened"))
    return each.join(counted, "row").select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
        F.when(there[F.col("at")], F.col("whitened")).alias("whitened"),
        of[F.col("at")].alias("explained"),
        F.lit(None if error is None else float(error)).cast("double").alias("identity_error"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened ``embeddings``: ``vec_id, component, n, deviation, whitened, explained,
    identity_error``."""
    return whitened(read(spark, sf_dir, "embeddings"))
