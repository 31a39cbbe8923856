"""Packing documents into sequences by cutting-stock column generation.

Every document is cut into full sequences and a rest.  The rests are sorted into
classes by length, in units of ``UNIT`` ids.  A pattern says how many rests of
each class share a sequence.  The linear program that covers the histogram of
classes with the fewest patterns is solved by column generation: the dual prices
of the classes go to a knapsack, solved by dynamic programming, whose best
pattern enters the basis, until no pattern pays.  Pattern counts are rounded
down, what is left is packed first-fit decreasing.  Documents are ranked within
their class and the ranks are dealt out to the patterns.

Size.  The driver sees the histogram (``LENGTH / UNIT`` counts) and gives back
as many patterns; neither grows with the corpus.  Ranks come from a sort by
ranges, so a class that holds a third of all documents is spread over tasks.
Texts are read once and never moved; what is sorted is a narrow row a document.

Cases.  A null or empty text has its end id alone.  Rows of one ``doc_id`` are
ranked by text hash and packed each; equal rows are interchangeable.  An empty
table gives no pieces.  Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pageloom.llm.common import WORD_SLICE_CHARS, empty_as, per_text, read, running_totals, stored
from pageloom.llm.tokens import KEPT, default_tokenizer, encoder

LENGTH = 2048
UNIT = 8
END = 1
#: Pivots after which the basis at hand is taken as it is.
MAX_PIVOTS = 6000


# -- the linear program ---------------------------------------------------------------


def knapsack(values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Best pattern: counts per class ``1..room`` (size = class) of greatest value."""
    best = np.zeros(room + 1)
    taken = np.zeros(room + 1, np.int64)
    for w in range(1, room + 1):
        options = best[w - 1 :: -1][:w] + values[:w]  # class c = index + 1
        c = int(options.argmax())
        if options[c] > best[w - 1] + 1e-15:
            best[w], taken[w] = options[c], c + 1
        else:
            best[w] = best[w - 1]
    counts = np.zeros(room, np.int64)
    w = room
    while w > 0:
        if taken[w]:
            counts[taken[w] - 1] += 1
            w -= taken[w]
        else:
            w -= 1
    return float(best[room]), counts


def first_fit(demand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A first basis: first-fit-decreasing patterns, each used until it empties a class.

    Every pattern is paired with the class it empties, so the basis is triangular.
    """
    room = len(demand)
    used = np.flatnonzero(demand)
    left = demand.astype(float)
    patterns = np.zeros((len(used), room), np.int64)
    amounts = np.zeros(len(used))
    open_ = dict(zip(used.tolist(), range(len(used)), strict=True))
    while open_:
        pattern, free = np.zeros(room, np.int64), room
        for c in sorted(open_, reverse=True):
            n = min(int(np.ceil(left[c])), free // (c + 1))
            pattern[c] = n
            free -= n * (c + 1)
        held = np.flatnonzero(pattern)
        ratio = left[held] / pattern[held]
        amount = ratio.min()
        left[held] -= amount * pattern[held]
        emptied = int(held[ratio.argmin()])
        row = open_.pop(emptied)
        patterns[row], amounts[row] = pattern, amount
        left[emptied] = 0
        for c in [c for c in open_ if left[c] <= 1e-9]:  # a tie: a pattern of its own, unused
            patterns[open_.pop(c), c] = room // (c + 1)
    return patterns, amounts


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots.

    A few hundred rows at most.  The LAPACK call for this can wait for ever in a
    process that has forked, which a Spark driver has.
    """
    m = len(matrix)
    work = np.hstack([matrix.astype(float), np.eye(m)])
    for i in range(m):
        top = i + int(np.abs(work[i:, i]).argmax())
        work[[i, top]] = work[[top, i]]
        work[i] /= work[i, i]
        others = np.flatnonzero(work[:, i])
        others = others[others != i]
        work[others] -= np.outer(work[others, i], work[i])
    return work[:, m:]


def generate_columns(demand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(patterns, amounts)``: a basic solution of the covering program.

    ``demand[c - 1]`` rests of class ``c`` have to be covered; a row of
    ``patterns`` has the count of each class in a sequence of ``len(demand)``.
    """
    room = len(demand)
    used = np.flatnonzero(demand)
    m = len(used)
    patterns, amounts = first_fit(demand)
    inverse = inverted(patterns[:, used].T)
    for _ in range(MAX_PIVOTS):
        prices = np.zeros(room)
        prices[used] = inverse.sum(0)  # every pattern costs one sequence
        value, column = knapsack(np.maximum(prices, 0), room)
        if value <= 1 + 1e-7:
            break
        column[prices <= 0] = 0
        step = inverse @ column[used]
        ratio = np.full(m, np.inf)
        ratio[step > 1e-9] = amounts[step > 1e-9] / step[step > 1e-9]
        out = int(ratio.argmin())
        amounts = np.maximum(amounts - ratio[out] * step, 0)
        amounts[out] = ratio[out]
        inverse[out] /= step[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        patterns[out] = column
    return patterns, amounts


def plan(demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Whole sequences ``(pattern, how many)`` that take exactly ``demand``."""
    room = len(demand)
    left = demand.astype(np.int64).copy()
    chosen: list[tuple[np.ndarray, int]] = []
    if left.any():
        patterns, amounts = generate_columns(left)
        for pattern, amount in zip(patterns, np.floor(amounts + 1e-6).astype(int), strict=True):
            held = pattern > 0
            fits = min(amount, int((left[held] // pattern[held]).min())) if held.any() else 0
            if fits > 0:
                chosen.append((pattern, fits))
                left -= fits * pattern
    while left.any():  # the rounded-off rest, first fit decreasing
        pattern, free = np.zeros(room, np.int64), room
        for c in range(room, 0, -1):
            n = min(int(left[c - 1]), free // c)
            pattern[c - 1] += n
            free -= n * c
        held = pattern > 0
        fits = int((left[held] // pattern[held]).min())
        chosen.append((pattern, fits))
        left -= fits * pattern
    return chosen


def intervals(chosen: list[tuple[np.ndarray, int]], starts: np.ndarray) -> np.ndarray:
    """Which sequence and place the ranks of each class go to.

    Rows ``(first rank, ranks a sequence, first sequence, first place)`` in
    ascending rank; ``starts[c]`` is the rank of the first rest of class ``c``.
    """
    rows, sequence = [], 0
    at = starts.astype(np.int64).copy()
    for pattern, many in chosen:
        place = 0
        for c in np.flatnonzero(pattern)[::-1]:
            rows.append((at[c + 1], pattern[c], sequence, place))
            at[c + 1] += pattern[c] * many
            place += pattern[c]
        sequence += many
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


# -- the tables -----------------------------------------------------------------------


def measured(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, kept: int = KEPT,
    slice_chars: int = WORD_SLICE_CHARS,
) -> DataFrame:
    """``(doc_id, key, doc_tokens, crcs)``: a checksum for each cut of ``length``."""

    def fn(texts: list[str]) -> dict:
        ids, counts = encoder(tokenizer, kept).encode(texts)
        tail, crcs = np.array([end], np.uint32), []
        for stop, n in zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True):
            own = np.concatenate([ids[stop - n : stop], tail]).astype("<u4").tobytes()
            step = 4 * length
            crcs.append([zlib.crc32(own[i : i + step]) for i in range(0, len(own), step)])
        return {"doc_tokens": pa.array(counts + 1), "crcs": crcs}

    keyed = docs.select("doc_id", F.xxhash64(empty_as()).alias("key"), "text")
    return per_text(keyed, ["doc_id", "key"], "doc_tokens BIGINT, crcs ARRAY<BIGINT>", fn, slice_chars)


def pack(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, unit: int = UNIT,
    kept: int = KEPT, slice_chars: int = WORD_SLICE_CHARS,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``.  The ids of a piece are those of its document from
    ``start`` on (see ``sequences``).  ``kept`` and ``slice_chars`` trade a worker's
    memory for time: pieces of text it keeps the ids of, and characters at once."""
    if length % unit:
        raise ValueError("length has to be a multiple of unit")
    room = length // unit
    rest = F.col("doc_tokens") % length
    # stored, as the range exchange reads its input twice
    table = stored(measured(docs, tokenizer, length, end, kept, slice_chars), "measured").withColumns({
        "full": F.floor(F.col("doc_tokens") / length).cast("bigint"),
        "class": F.ceil(rest / unit).cast("int"),
        "one": F.lit(1).cast("bigint"),
    })
    ranked = running_totals(
        table, ["class", "doc_id", "key"], {"rank": "one", "full_before": "full"}
    )
    ranked = stored(ranked.drop("one"), "ranked")

    counts = np.zeros(room + 1, np.int64)
    for c, n in ranked.groupBy("class").count().collect():  # at most room + 1 rows
        counts[c] = n
    starts = np.cumsum(counts) - counts
    chosen = plan(counts[1:])
    shared = sum(many for _, many in chosen)
    places = intervals(chosen, starts)

    def assign(batches):
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            row = places[np.searchsorted(places[:, 0], rank, side="right") - 1]
            past = rank - row[:, 0]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(row[:, 2] + past // row[:, 1]),
                 pa.array(row[:, 3] + past % row[:, 1])],
                names=[*batch.schema.names[:-1], "sequence_id", "place"],
            )

    fulls = ranked.where("full > 0").select(
        "doc_id", "doc_tokens", "full", "full_before", F.posexplode("crcs").alias("i", "crc")
    ).where("i < full").select(
        "doc_id", (F.col("i").cast("bigint") * length).alias("start"),
        F.lit(length).cast("bigint").alias("length"), F.col("crc").alias("ids_crc32"),
        "doc_tokens", (F.col("full_before") + F.col("i") + shared).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )
    rests = ranked.where("class > 0").select(
        "doc_id", (F.col("full") * length).alias("start"), rest.alias("length"),
        F.element_at("crcs", -1).alias("ids_crc32"), "doc_tokens", "rank",
    )
    in_order = Window.partitionBy("sequence_id").orderBy("place")
    in_order = in_order.rowsBetween(Window.unboundedPreceding, -1)
    rests = rests.mapInArrow(
        assign, "doc_id BIGINT, start BIGINT, length BIGINT, ids_crc32 BIGINT, "
        "doc_tokens BIGINT, sequence_id BIGINT, place BIGINT",
    ).withColumn(
        "offset", F.coalesce(F.sum("length").over(in_order), F.lit(0).cast("bigint"))
    ).drop("place")
    return fulls.unionByName(rests)


def sequences(pieces: DataFrame, docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """``(sequence_id, ids)``: the ids themselves, for ``docs`` with unique ids.

    Needs an exchange of the ids; a sequence has at most ``length`` of them.
    """

    def fn(texts: list[str]) -> dict:
        ids, counts = encoder(tokenizer).encode(texts)
        stops = np.cumsum(counts)
        return {"all_ids": [
            np.append(ids[b - n : b], end).astype(np.int64)
            for b, n in zip(stops, counts, strict=True)
        ]}

    full = per_text(docs, ["doc_id"], "all_ids ARRAY<BIGINT>", fn)
    cut = full.join(pieces, "doc_id").select(
        "sequence_id", "offset", F.slice("all_ids", F.col("start") + 1, F.col("length")).alias("ids")
    )
    whole = cut.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return whole.select("sequence_id", F.flatten("p.ids").alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place."""
    return pack(read(spark, sf_dir), default_tokenizer())
