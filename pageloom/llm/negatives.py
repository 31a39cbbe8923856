"""Hard negatives, found by segment summaries.

A vector is cut into segments; of each its mean and its deviation are stored, for
finer and finer cuts (``LEVELS``).  With segments of ``l`` components the inner
product of two vectors lies between ``l (m m' - s s')`` and ``l (m m' + s s')``, summed
over the segments: the products of the deviations bound what the means leave out.
Pairs whose bounds miss every score still wanted go; the rest is bounded again by
the next finer cut, and only what is left then is scored exactly.

Two searches: an anchor's best rows of its own label (positives), then for each
positive the best rows of other labels whose score lies in its band.  A search
deals anchors and rows out to tiles of bounded size, and each tile gives at most the
wanted number for every anchor and band; ranks over all tiles decide.  Once a tile has
enough for a band, its worst score there is what later rows of the tile have to reach.

Scores are exact integers: products of whole numbers in double precision where they
stay under 2^53, else Python integers.

Size.  Anchors are a stated share of all rows, so the pairs looked at grow with the
square of the table; rows and anchors meet in tiles of ``TILE_CELLS`` numbers a side and
a label with a third of all rows is as many more tiles.  Nothing else is gathered.

Cases.  Rows with a null label, a null vector or a null or non-finite component take
no part.  Equal rows are different rows: each is a candidate and, if its id says so,
an anchor.  Ties go to the smaller id, a null id last.  Of vectors of different length
the shorter counts as filled up with zeros.  A score that 64 bits cannot hold is held
at their ends.  A positive with a score below zero has an empty band.  An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pageloom.llm.common import if_small, read, stored
from pageloom.llm.vectors import dealt, finite, lists, matrix, numbered, part_of, per_tile, width

ANCHORS_EVERY, POSITIVES, NEGATIVES = 100, 5, 10
#: The band of a negative's score, in percent of the positive's.
LOW, HIGH = 30, 90
#: Labels that count as the next one: noise that the miner has to bear.
SHIFT_EVERY, LABELS = 7, 10
SCALE = 256
#: Segments of each cut, coarse to fine.
LEVELS = (4, 16, 32)
#: Rows of a tile that are bounded together.
STEP = 512
FAR = 1 << 63

FOUND = "anchor BIGINT, band INT, score BIGINT, other BIGINT, other_id BIGINT"


# -- the index ----------------------------------------------------------------------


def prepared(table: DataFrame) -> DataFrame:
    """``(row, vec_id, label, x)``: the rows that take part, ``x`` in whole numbers."""
    shifted = F.col("vec_id") % SHIFT_EVERY == 0
    label = F.col("label").cast("bigint")
    label = F.when(shifted, (label + 1) % LABELS).otherwise(label)

    def floor(c: Column) -> Column:
        big = c.cast("double") * SCALE  # beyond 2^52 a double is whole anyway
        return F.when(F.abs(big) < 2.0**52, F.floor(big).cast("double")).otherwise(big)

    whole = F.transform("embedding", floor)
    kept = table.where(F.col("label").isNotNull() & finite(F.col("embedding")))
    return numbered(kept.select(F.col("vec_id").cast("bigint"), label.alias("label"), whole.alias("x")), "whole")


def edges(dim: int) -> list[np.ndarray]:
    """The cuts of ``dim`` components, coarse to fine: starts of the segments."""
    return [np.unique(np.arange(n) * dim // n) for n in LEVELS if dim]


def summary(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each segment, both times the root of its length."""
    sizes = np.diff(np.append(starts, x.shape[1]))
    mean = np.add.reduceat(x, starts, axis=1) / sizes
    off = x - np.repeat(mean, sizes, axis=1)
    deviation = np.sqrt(np.add.reduceat(off * off, starts, axis=1) / sizes)
    return mean * np.sqrt(sizes), deviation * np.sqrt(sizes)


def indexed(rows: DataFrame, dim: int) -> DataFrame:
    """``rows`` with ``segments``: means and deviations of all cuts, one after the other."""
    cuts = edges(dim)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("x"), dim)
            parts = [p for starts in cuts for p in summary(x, starts)] or [np.empty((len(x), 0))]
            made = lists(np.concatenate(parts, axis=1), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "segments"])

    shape = "vec_id BIGINT, label BIGINT, x ARRAY<DOUBLE>, row BIGINT, segments ARRAY<DOUBLE>"
    return stored(rows.select("vec_id", "label", "x", "row").mapInArrow(run, shape), "segments")


# -- one tile -----------------------------------------------------------------------


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` and ``b``, whole numbers, as 64-bit integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, -FAR, FAR - 1).astype(np.int64)


def tile(
    anchors: pa.Table, rows: pa.Table, low: np.ndarray, high: np.ndarray, wanted: int, dim: int,
    same_label: bool, met: list[int] | None = None,
) -> pa.Table:
    """The ``wanted`` best rows of each anchor in each of its bands.

    ``low`` and ``high`` (anchors x bands) are the least and greatest score of a band;
    ``met``, if given, gets the pairs at each cut and those scored exactly.
    """
    ax, rx = matrix(anchors["x"], dim), matrix(rows["x"], dim)
    a_row, r_row = (t["row"].to_numpy() for t in (anchors, rows))
    a_label, r_label = (t["label"].to_numpy() for t in (anchors, rows))
    no_id = np.asarray(rows["vec_id"].is_null())
    r_id = rows["vec_id"].fill_null(0).to_numpy()
    cuts = edges(dim)
    n_cells = sum(2 * len(c) for c in cuts)
    a_seg, r_seg = matrix(anchors["segments"], n_cells), matrix(rows["segments"], n_cells)
    a_norm, r_norm = (np.sqrt((m * m).sum(1)) for m in (ax, rx))
    bands = low.shape[1]
    least = low.copy()  # what a row of the tile has to reach, by anchor and band
    most = np.where(low <= high, high, -np.inf).astype(np.float64).max(1)
    held = [[np.empty((0, 2), np.int64) for _ in range(bands)] for _ in ax]
    for at in range(0, len(rx), STEP):
        part = slice(at, min(at + STEP, len(rx)))
        alive = (a_label[:, None] == r_label[None, part]) == same_label
        alive &= a_row[:, None] != r_row[None, part]
        slack = 1e-11 * a_norm[:, None] * r_norm[None, part] + 1e-6
        reach = np.where(low <= high, least, np.inf).min(1)
        first = 0
        for starts in cuts:
            i, j = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            if not len(i):
                break
            if met is not None:
                met.append(int(alive.sum()))
            k = len(starts)
            a, r = a_seg[i, first : first + 2 * k], r_seg[part][j, first : first + 2 * k]
            first += 2 * k
            middle, spread = a[:, :k] @ r[:, :k].T, a[:, k:] @ r[:, k:].T + slack[np.ix_(i, j)]
            can = (middle + spread >= reach[i, None]) & (middle - spread <= most[i, None])
            alive[np.ix_(i, j)] &= can
        i, j = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if met is not None:
            met.append(int(alive.sum()))
        if not len(i):
            continue
        scores = exact(ax[i], rx[part][j])
        ids, missing, numbers = r_id[part][j], no_id[part][j], j + at
        open_pairs = alive[np.ix_(i, j)]
        for band in range(bands):
            inside = open_pairs & (scores >= least[i, band][:, None])
            inside &= scores <= high[i, band][:, None]
            for m in np.flatnonzero(inside.any(1)):
                c = np.flatnonzero(inside[m])
                old = held[i[m]][band]
                new = np.column_stack([scores[m, c], numbers[c]])
                both = np.concatenate([old, new])
                if len(both) > wanted:
                    p = both[:, 1]
                    order = np.lexsort((r_row[p], r_id[p], no_id[p], ~both[:, 0]))[:wanted]
                    both = both[order]
                    least[i[m], band] = max(least[i[m], band], both[-1, 0])
                held[i[m]][band] = both
    out = [(a, band, h) for a, own in enumerate(held) for band, h in enumerate(own) if len(h)]
    sizes = [len(h) for _, _, h in out]
    all_held = np.concatenate([h for _, _, h in out] or [np.empty((0, 2), np.int64)])
    return pa.table({
        "anchor": pa.array(np.repeat(a_row[[a for a, _, _ in out]], sizes) if out else [], pa.int64()),
        "band": pa.array(np.repeat([b for _, b, _ in out], sizes) if out else [], pa.int32()),
        "score": pa.array(all_held[:, 0], pa.int64()),
        "other": pa.array(r_row[all_held[:, 1]], pa.int64()),
        "other_id": rows["vec_id"].combine_chunks().take(pa.array(all_held[:, 1])) if out else pa.array([], pa.int64()),
    })


def searched(
    anchors: DataFrame, rows: DataFrame, keys: list[str], wanted: int, dim: int,
    bounds: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], same_label: bool,
) -> DataFrame:
    """``(anchor, band, score, other, other_id, rank)`` over all tiles of ``keys``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            left, right = left.slice(0, 0), right.slice(0, 0)
        return tile(left, right, *bounds(left), wanted, dim, same_label)

    found = anchors.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(run, FOUND)
    order = [F.desc("score"), F.asc_nulls_last("other_id"), F.asc("other")]
    place = F.row_number().over(Window.partitionBy("anchor", "band").orderBy(*order))
    return found.withColumn("rank", place).where(F.col("rank") <= wanted)


# -- the two searches ---------------------------------------------------------------


def _everything(anchors: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    shape = (anchors.num_rows, 1)
    return np.full(shape, -FAR, np.int64), np.full(shape, FAR - 1, np.int64)


def _bands(anchors: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score for each positive; a band that is not there is empty."""
    low = np.full((anchors.num_rows, POSITIVES), 1, np.int64)
    high = np.zeros((anchors.num_rows, POSITIVES), np.int64)
    for i, scores in enumerate(anchors["positives"].to_pylist()):
        for k, score in enumerate(scores):
            low[i, k], high[i, k] = -(-LOW * score // 100), HIGH * score // 100
    return low, high


def mined(table: DataFrame) -> DataFrame:
    """Anchors, their positives and hard negatives, by id, with ranks and scores."""
    rows = prepared(table)
    dim = width(rows, "x")
    rows = indexed(rows, dim)
    size = per_tile(dim)
    anchors = stored(rows.where(F.col("vec_id") % ANCHORS_EVERY == 0), "anchors")

    # own label: tiles of each label
    per_label = rows.groupBy("label").agg(
        part_of(F.count(F.lit(1)), size).alias("chunks"),
        part_of(F.count_if(F.col("vec_id") % ANCHORS_EVERY == 0), size).alias("blocks"),
        F.max(F.coalesce(F.col("vec_id") % ANCHORS_EVERY == 0, F.lit(False))).alias("asked"),
    )
    per_label = if_small(stored(per_label.where("asked").drop("asked"), "labels"))

    def every(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(parts) - 1))

    of_label = dealt(rows.join(per_label, "label"), F.col("chunks"), "chunk", "chunk")
    asking = dealt(anchors.join(per_label, "label"), F.col("blocks"), "block", "block")
    keys = ["label", "chunk", "block"]
    positives = searched(
        asking.withColumn("chunk", every("chunks")).drop("chunks", "blocks"),
        of_label.withColumn("block", every("blocks")).drop("chunks", "blocks"),
        keys, POSITIVES, dim, _everything, True,
    )
    positives = stored(positives.select("anchor", "rank", "score", "other_id"), "positives")

    # other labels: tiles of all rows
    scores = F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]
    )
    asked = anchors.join(
        positives.groupBy("anchor").agg(scores.alias("positives")).withColumnRenamed("anchor", "row"), "row"
    )
    n_rows, n_anchors = rows.count(), anchors.count()
    chunks, blocks = (max(1, -(-n // size)) for n in (n_rows, n_anchors))
    all_chunks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint")))
    all_blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    found = searched(
        dealt(asked, blocks, "block", "block").withColumn("chunk", all_chunks),
        dealt(rows, chunks, "chunk", "chunk").withColumn("block", all_blocks),
        ["chunk", "block"], NEGATIVES, dim, _bands, False,
    )
    found = found.select(
        "anchor", (F.col("band") + 1).alias("of"), "rank", F.col("score").alias("negative_score"),
        F.col("other_id").alias("negative_id"),
    )
    named = positives.join(
        anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor"
    ).select(
        "anchor", F.col("rank").alias("of"), "anchor_id", F.col("other_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    return found.join(named, ["anchor", "of"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
        "positive_score", "negative_score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor in ``embeddings``."""
    return mined(read(spark, sf_dir, "embeddings"))


def oracle() -> str:
    """The query as DuckDB SQL, by all pairs."""
    return f"""
WITH whole AS (SELECT vec_id,
  CASE WHEN vec_id % {SHIFT_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
  list_transform(embedding, lambda c: floor({SCALE} * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
  CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM whole AS a JOIN whole AS b ON a.vec_id != b.vec_id WHERE a.vec_id % {ANCHORS_EVERY} = 0),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (
  PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}),
ranked AS (SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id,
  p.score AS positive_score, n.score AS negative_score, row_number() OVER (
  PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS place
  FROM positives AS p JOIN scored AS n ON n.anchor_id = p.anchor_id AND NOT n.same
  WHERE {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score,
  negative_score FROM ranked WHERE place <= {NEGATIVES}"""
