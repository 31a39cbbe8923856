"""Approximate nearest neighbours by cosine: adaptive dimension scan over inverted lists.

Unit vectors are turned by one random rotation, after which any few columns are a
fair sample of a difference.  Rows lie in the list of their nearest centre; a query
probes the lists of its nearest centres.  Within a list the turned vectors are read in
column blocks: the squared distance over the first ``d`` of ``D`` columns, scaled by
``D / d``, estimates the whole, and a candidate goes as soon as it is beyond the
query's present fifth-best distance by a factor of ``(1 + ERROR / sqrt(d))^2``: the
hypothesis that it is nearer is rejected.  What reads all columns is scored exactly,
in double precision on the original vectors.

Fit.  Centres, and the share of lists a query probes, come from a sample of at most
``SAMPLE_CELLS`` numbers, chosen by hash: the share is the least one under which
sample rows find ``RECALL`` of their true neighbours in the sample.  Every row is
indexed.  A query starts from the fifth-best distance among sample rows in the lists it
probes; those are rows of the table and count as found.

Size.  The sample, its centres (``LISTS`` at most) and the rotation go to every task
and are bounded by their parameters.  A list is cut into slices of ``per_tile`` rows,
its queries into blocks of as many, so a list with a third of all rows is as many more
tiles.  A tile gives five rows a query at most.

Cases.  Vectors that are null, zero or empty, or hold a null or non-finite component
take no part.  Equal rows are different rows: each is indexed and, if its id says so, a
query.  Ties go to the smaller id, a null id last.  Of vectors of different length
the shorter counts as filled up with zeros.  With fewer than five other rows all
are found.  An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pageloom.llm.common import if_small, read, stored
from pageloom.llm.vectors import dealt, finite, lists, matrix, numbered, part_of, per_tile, width

QUERIES_EVERY, WANTED = 50, 5
SAMPLE_CELLS = 640_000
LISTS, STEPS = 1024, 8
#: Share of true neighbours that sample rows have to find in the lists they probe.
RECALL = 0.98
#: Columns of a block, and how sure a rejection is (larger: surer).
BLOCK, ERROR = 8, 2.1
#: Rows of a tile between two looks at the threshold.
STEP = 256
SEED = 20
#: Rounding of distances between unit vectors in single precision.
SLACK = 1e-5

FOUND = "query BIGINT, row BIGINT, vec_id BIGINT, score DOUBLE"


# -- the index ----------------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    """What is fitted; ``rows``, ``ids`` (null: ``no_id``) and ``sample`` are the sampled rows."""

    dim: int
    rotation: np.ndarray
    centres: np.ndarray
    probes: int
    rows: np.ndarray
    ids: np.ndarray
    no_id: np.ndarray
    sample: np.ndarray
    home: np.ndarray


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled down first, so that squares stay finite."""
    x = x / np.abs(x).max(1, initial=0, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of ``a`` with the same row of ``b``, in double precision.

    Vectors whose squares would leave the range of doubles are scaled by a power of
    two, which changes no digit of the result.
    """
    a, b = (np.ldexp(m, -_exponent(m)) for m in (a, b))
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _exponent(m: np.ndarray) -> np.ndarray:
    power = np.frexp(np.abs(m).max(1, initial=0, keepdims=True))[1]
    return np.where(np.abs(power) > 400, power, 0)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of unit vectors; the first of equally near centres."""
    return (x @ centres.T).argmax(1)


def centres_of(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of unit vectors, of unit length; one without members takes a new start."""
    centres = x[rng.choice(len(x), n, replace=False)]
    for _ in range(STEPS):
        home = nearest_centre(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        size = np.sqrt((sums * sums).sum(1))
        empty = size < 1e-9
        sums[empty], size[empty] = x[rng.choice(len(x), int(empty.sum()))], 1
        centres = sums / size[:, None]
    return centres


def probes_needed(x: np.ndarray, home: np.ndarray, centres: np.ndarray, rng: np.random.Generator) -> int:
    """Lists to probe so that ``RECALL`` of the true neighbours within ``x`` are met."""
    asked = rng.choice(len(x), min(len(x), 400), replace=False)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -2
    k = min(WANTED, len(x) - 1)
    if k < 1:
        return len(centres)
    true = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = (-(x[asked] @ centres.T)).argsort(1, kind="stable").argsort(1)
    ranks = np.sort(order[np.arange(len(asked))[:, None], home[true]].ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(RECALL * len(ranks))))]) + 1


def prepared(table: DataFrame) -> DataFrame:
    """``(vec_id, v, row)`` of the rows that take part."""
    vector = F.col("embedding")
    there = finite(vector) & F.exists(vector, lambda c: c != 0)
    v = F.transform(vector, lambda c: c.cast("double"))
    return numbered(table.where(there).select(F.col("vec_id").cast("bigint"), v.alias("v")), "vectors")


def fit(rows: DataFrame) -> Index | None:
    """Rotation, centres and probes; None for an empty table."""
    n, dim = rows.count(), width(rows)
    if not n:
        return None
    rng = np.random.default_rng(SEED)
    most = max(1, SAMPLE_CELLS // dim)
    space = 1 << 30
    share = space if n <= most else int(space * 0.9 * most / n)
    chosen = F.pmod(F.xxhash64("row", F.lit("sample")), F.lit(space)) < share
    picked = rows.where(chosen).limit(most).toArrow().sort_by("row")
    sample = matrix(picked["v"], dim)
    x = units(sample)
    centres = centres_of(x, min(LISTS, len(x), max(1, round(n**0.5))), rng)
    home = nearest_centre(x, centres)
    rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    no_id = np.asarray(picked["vec_id"].combine_chunks().is_null())
    return Index(
        dim, rotation, centres, probes_needed(x, home, centres, rng), picked["row"].to_numpy(),
        picked["vec_id"].fill_null(0).to_numpy(), no_id, sample, home,
    )


def indexed(rows: DataFrame, index: Index) -> DataFrame:
    """``rows`` with ``list`` and ``turned``, the rotated unit vector."""

    def run(batches):
        for batch in batches:
            x = units(matrix(batch.column("v"), index.dim))
            home = pa.array(nearest_centre(x, index.centres).astype(np.int32))
            turned = lists((x @ index.rotation).astype(np.float32), pa.float32())
            yield pa.RecordBatch.from_arrays([*batch.columns, home, turned], names=[*batch.schema.names, "list", "turned"])

    shape = "vec_id BIGINT, v ARRAY<DOUBLE>, row BIGINT, list INT, turned ARRAY<FLOAT>"
    return stored(rows.select("vec_id", "v", "row").mapInArrow(run, shape), "index")


# -- queries ------------------------------------------------------------------------


def best(score: np.ndarray, no_id: np.ndarray, ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` first: highest score, then smallest id, null last."""
    return np.lexsort((rows, ids, no_id, -score))[:n]


def planned(queries: DataFrame, index: Index, sizes: np.ndarray) -> DataFrame:
    """``queries`` with the lists they probe, the squared distance that a row has to beat
    and the sample rows found: ``probes``, ``limit``, ``seeds``.

    A query probes more lists than the fit says where those hold too few rows.
    """

    def run(batches):
        sample = units(index.sample)
        for batch in batches:
            v = matrix(batch.column("v"), index.dim)
            x, own = units(v), batch.column("row").to_numpy()
            order = (-(x @ index.centres.T)).argsort(1, kind="stable")
            enough = (np.cumsum(sizes[order], axis=1) > WANTED).argmax(1) + 1
            enough[sizes.sum() <= WANTED] = len(sizes)
            probes, limits, seeds = [], [], []
            for i in range(len(v)):
                chosen = order[i, : max(index.probes, enough[i])]
                there = np.flatnonzero(np.isin(index.home, chosen) & (index.rows != own[i]))
                near = sample[there] @ x[i]
                if len(there) > WANTED:  # what is as near as the fifth, and ties
                    there = there[near >= np.partition(near, -WANTED)[-WANTED] - SLACK]
                score = cosines(np.repeat(v[i : i + 1], len(there), 0), index.sample[there])
                first = best(score, index.no_id[there], index.ids[there], index.rows[there], WANTED)
                probes.append(chosen.astype(np.int32))
                limits.append(2 - 2 * float(score[first[-1]]) if len(first) == WANTED else 9.0)
                seeds.append([
                    {"row": int(index.rows[p]), "vec_id": None if index.no_id[p] else int(index.ids[p]), "score": float(s)}
                    for p, s in zip(there[first], score[first], strict=True)
                ])
            made = [
                pa.array(probes, pa.list_(pa.int32())), pa.array(limits, pa.float64()),
                pa.array(seeds, pa.list_(pa.struct([("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))),
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *made], names=[*batch.schema.names, "probes", "limit", "seeds"]
            )

    shape = (
        "row BIGINT, v ARRAY<DOUBLE>, turned ARRAY<FLOAT>, probes ARRAY<INT>, limit DOUBLE, "
        "seeds ARRAY<STRUCT<row: BIGINT, vec_id: BIGINT, score: DOUBLE>>"
    )
    return stored(queries.select("row", "v", "turned").mapInArrow(run, shape), "queries")


def scan(queries: pa.Table, rows: pa.Table, dim: int, read: list[int] | None = None) -> pa.Table:
    """The nearest rows of one tile for each query; ``read``, if given, gets the
    candidates at each column block and those scored exactly."""
    qv, rv = matrix(queries["v"], dim), matrix(rows["v"], dim)
    qt, rt = (matrix(t["turned"], dim, np.float32) for t in (queries, rows))
    q_row, r_row = (t["row"].to_numpy() for t in (queries, rows))
    no_id = np.asarray(rows["vec_id"].combine_chunks().is_null())
    ids = rows["vec_id"].fill_null(0).to_numpy()
    limit = queries["limit"].to_numpy() + SLACK
    held = [(np.empty(0, np.int64), np.empty(0)) for _ in qv]
    for at in range(0, len(rv), STEP):
        end = min(at + STEP, len(rv))
        q, r = np.nonzero(q_row[:, None] != r_row[None, at:end])
        r += at
        far = np.zeros(len(q), np.float32)
        for start in range(0, dim, BLOCK):
            if read is not None:
                read.append(len(q))
            block = slice(start, min(start + BLOCK, dim))
            if start == 0:  # all pairs: distances by one product
                a, b = qt[:, block], rt[at:end, block]
                far = ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T))[q, r - at]
            else:
                off = qt[q, block] - rt[r, block]
                far += np.einsum("ij,ij->i", off, off)
            d = block.stop
            factor = (1 + ERROR / d**0.5) ** 2 * d / dim if d < dim else 1.0
            stays = far <= np.maximum(limit[q] * factor, SLACK)
            q, r, far = q[stays], r[stays], far[stays]
        if read is not None:
            read.append(len(q))
        if not len(q):
            continue
        score = cosines(qv[q], rv[r])
        cuts = np.flatnonzero(np.diff(q, prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(q)], strict=True):
            i = q[lo]
            places = np.concatenate([held[i][0], r[lo:hi]])
            scores = np.concatenate([held[i][1], score[lo:hi]])
            first = best(scores, no_id[places], ids[places], r_row[places], WANTED)
            held[i] = places[first], scores[first]
            if len(first) == WANTED:
                limit[i] = min(limit[i], 2 - 2 * scores[first[-1]] + SLACK)
    places = np.concatenate([p for p, _ in held] or [np.empty(0, np.int64)])
    return pa.table({
        "query": pa.array(np.repeat(q_row, [len(p) for p, _ in held]), pa.int64()),
        "row": pa.array(r_row[places], pa.int64()),
        "vec_id": pa.array(ids[places], pa.int64(), mask=no_id[places]),
        "score": pa.array(np.concatenate([s for _, s in held] or [np.empty(0)]), pa.float64()),
    })


def every(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(parts) - 1))


def nearest(table: DataFrame) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of every query."""
    rows = prepared(table)
    index = fit(rows)
    if index is None:
        none = F.lit(None)
        return rows.select(
            F.col("vec_id").alias("query_id"), none.cast("int").alias("rank"), "vec_id",
            none.cast("double").alias("score"),
        )
    rows = indexed(rows, index)
    size, dim = per_tile(index.dim), index.dim
    counts = {r[0]: r[1] for r in rows.groupBy("list").count().collect()}  # one for each centre
    sizes = np.array([counts.get(i, 0) for i in range(len(index.centres))])
    asked = planned(rows.where(F.col("vec_id") % QUERIES_EVERY == 0), index, sizes)
    probing = asked.withColumn("list", F.explode("probes")).select("row", "list")
    per_list = rows.groupBy("list").agg(part_of(F.count(F.lit(1)), size).alias("slices")).join(
        probing.groupBy("list").agg(part_of(F.count(F.lit(1)), size).alias("blocks")), "list"
    )
    per_list = if_small(stored(per_list, "lists"))
    asking = asked.drop("seeds").withColumn("list", F.explode("probes")).drop("probes")
    asking = dealt(asking.join(per_list, "list"), F.col("blocks"), "block", "block")
    lying = dealt(rows.join(per_list, "list"), F.col("slices"), "slice", "slice")
    keys = ["list", "slice", "block"]
    asking = asking.withColumn("slice", every("slices")).drop("slices", "blocks")
    lying = lying.withColumn("block", every("blocks")).drop("slices", "blocks")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            left, right = left.slice(0, 0), right.slice(0, 0)
        return scan(left, right, dim)

    found = asking.groupBy(*keys).cogroup(lying.groupBy(*keys)).applyInArrow(run, FOUND)
    seeds = asked.select(F.col("row").alias("query"), F.inline("seeds"))
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("row")]
    first = Window.partitionBy("query").orderBy(*order)
    # a sample row is found twice at most: among the seeds and in its list
    ranked = found.unionByName(seeds).withColumn("place", F.row_number().over(first))
    ranked = ranked.where(F.col("place") <= 2 * WANTED).dropDuplicates(["query", "row"])
    ranked = ranked.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= WANTED)
    names = asked.select(F.col("row").alias("query")).join(
        rows.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query"
    )
    return ranked.join(names, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every query in ``embeddings``."""
    return nearest(read(spark, sf_dir, "embeddings"))
