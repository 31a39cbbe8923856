"""SimHash near-duplicates by a byte-position index with count filtering.

A fingerprint is eight positional bytes.  Two fingerprints that differ in at
most ``d`` bits differ in at most ``d`` bytes, so they share at least ``8 - d``
positional bytes: that count is the filter.  The index lists fingerprints under
every combination of ``8 - d`` positions with the bytes found there, which holds
exactly the pairs whose tally can reach the minimum.  Within a list the bytes
shared by a pair are tallied, pairs under the minimum go, and the rest is
verified bit by bit.

Size.  Equal fingerprints are one row before the index is built, whatever the
number of copies.  At ``d = 3`` a list leaves three bytes open, so it has at most
2^24 entries however large the corpus is: that bounds the memory of a task.
Lists are read as sorted streams, never as groups.  A long list (many near
copies) is not paired off: its members look up their own neighbours, a fixed
number of masks each.  Links are kept as stars, so a list of n entries gives at
most n - 1 edges and no link between two texts is lost for the components.

Cases.  Null, empty and blank texts have fingerprint zero and are linked like
any other.  Repeated rows come back as often as they came.  A row with a null
``doc_id`` takes part in links; it names a component only if all members have a
null id.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.llm.common import empty_as, per_text, read, stored, tasks
from pageloom.llm.components import components
from pageloom.operators.sized import is_small
from pageloom.session import keep_batches_small

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Lists up to this length are paired off in numpy, longer ones look neighbours up.
PAIRED = 1024
#: Bytes of keys that are broadcast, so that texts need not move.
SMALL = 8 << 20
LOW = np.uint64(0x0101010101010101)
UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in ``hashes[starts[i]:starts[i + 1]]``.

    Eight counters of eight bits are added up at once in pieces of up to 255
    hashes, then the pieces of a text are added up.
    """
    sizes = np.diff(np.append(starts, len(hashes)))
    pieces = -(-sizes // 255)
    first = np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - first)
    counts = np.empty((len(starts), 64), np.int64)
    of_text = np.cumsum(pieces) - pieces
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & LOW, cuts)
        lanes = lanes.view(np.uint8).reshape(-1, 8)  # little-endian: lane i holds bit 8 i + bit
        counts[:, bit::8] = np.add.reduceat(lanes, of_text, axis=0, dtype=np.int64)
    return counts


def fingerprints(texts: list[str], shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text as an unsigned 64-bit integer."""
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").translate(UPPER).split()
        if not words:
            continue
        joined, before = b" ".join(words), len(hashes)
        if len(words) <= shingle:
            hashes.append(digest(joined, seed))
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            heads = [0, *ends[: len(words) - shingle].tolist()]
            tails = (ends[shingle - 1 :] - 1).tolist()
            hashes += [digest(joined[a:b], seed) for a, b in zip(heads, tails, strict=True)]
        sizes[i] = len(hashes) - before
    out = np.zeros(len(texts), np.uint64)
    if hashes:
        full = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[full]
        over = 2 * _bit_counts(np.array(hashes, np.uint64), starts) > sizes[full, None]
        out[full] = np.packbits(over, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprint_table(
    docs: DataFrame, shingle: int = SHINGLE, keep: list[str] | None = None
) -> DataFrame:
    """``keep`` (``doc_id``) and ``fp``, the fingerprint as a signed 64-bit integer."""
    return per_text(
        docs, keep or ["doc_id"], "fp BIGINT",
        lambda texts: {"fp": fingerprints(texts, shingle).view(np.int64)},
    )


# -- links within lists -------------------------------------------------------------


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable index of each of ``n`` nodes over the edges ``a - b``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _pairs(fps: np.ndarray, least_shared: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a short list that pass the tally and the verification."""
    a, b = np.triu_indices(len(fps), 1)
    diff = fps[a] ^ fps[b]
    shared = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(1)  # the tally
    a, b, diff = (x[shared >= least_shared] for x in (a, b, diff))
    near = np.bitwise_count(diff) <= bits
    return a[near], b[near]


def _masks(open_bytes: tuple[int, ...], bits: int) -> np.ndarray:
    """Every change of one to ``bits`` bits within the given bytes."""
    places = [8 * p + i for p in open_bytes for i in range(8)]
    return np.array(
        [sum(1 << p for p in c) for k in range(1, bits + 1) for c in combinations(places, k)],
        np.uint64,
    )


def _neighbours(fps: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a long sorted list, by looking up each change of each entry."""
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for mask in masks:
        other = fps ^ mask
        at = np.searchsorted(fps, other)
        at[at == len(fps)] = 0
        hit = np.flatnonzero((fps[at] == other) & (fps < other))
        found_a.append(hit)
        found_b.append(at[hit])
    return np.concatenate(found_a), np.concatenate(found_b)


def _link_runs(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of sorted rows ``(combo, list, fp)``; a list may span batches."""
    combos = list(combinations(range(8), 8 - bits))
    masks: dict[int, np.ndarray] = {}
    held: list[np.ndarray] = [np.empty((0, 3), np.int64)]

    def edges(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1
        starts = np.concatenate([[0], new])
        sizes = np.diff(np.append(starts, len(rows)))
        out_a, out_b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        fps = rows[:, 2].astype(np.int64).view(np.uint64)
        twos = starts[sizes == 2]  # most lists with a pair have just one
        if len(twos):
            diff = fps[twos] ^ fps[twos + 1]
            shared = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(1)
            near = twos[(shared >= 8 - bits) & (np.bitwise_count(diff) <= bits)]
            out_a.append(fps[near])
            out_b.append(fps[near + 1])
        for at, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            run = np.sort(fps[at : at + size])
            if size <= PAIRED:
                a, b = _pairs(run, 8 - bits, bits)
            else:
                combo = int(rows[at, 0])
                if combo not in masks:
                    free = tuple(p for p in range(8) if p not in combos[combo])
                    masks[combo] = _masks(free, bits)
                a, b = _neighbours(run, masks[combo])
            if len(a):
                root = _stars(len(run), a, b)
                tip = np.flatnonzero(root != np.arange(len(run)))
                out_a.append(run[tip])
                out_b.append(run[root[tip]])
        return np.concatenate(out_a), np.concatenate(out_b)

    def made(rows: np.ndarray) -> pa.RecordBatch:
        a, b = edges(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.column_stack(
            [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        )
        same = (rows[:, :2] == rows[-1, :2]).all(1)
        cut = len(rows) - int(same[::-1].argmin()) if not same.all() else 0
        if cut == 0:  # the whole batch belongs to one list
            last = held[-1]
            if len(last) and (last[-1, :2] != rows[0, :2]).any():
                yield made(np.concatenate(held))
                held = []
            held.append(rows)
            continue
        yield made(np.concatenate([*held, rows[:cut]]))
        held = [rows[cut:]]
    if held and sum(map(len, held)):
        yield made(np.concatenate(held))


def links(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Edges ``(a, b)`` between the distinct fingerprints ``fp``, as stars."""
    keys = []
    for i, places in enumerate(combinations(range(8), 8 - bits)):
        mask = sum(0xFF << 8 * p for p in places)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(
            F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(signed)).alias("list")
        ))
    index = distinct.select("fp", F.inline(F.array(*keys))).select("combo", "list", "fp")
    n = tasks(distinct.sparkSession)
    dealt = index.repartition(n, "combo", "list").sortWithinPartitions("combo", "list")
    return dealt.mapInArrow(lambda batches: _link_runs(bits, batches), "a BIGINT, b BIGINT")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, text_key, fp, component_id)``, one row per row of ``docs``.

    ``text_key`` tells rows of one ``doc_id`` apart by a hash of their texts.
    """
    keep_batches_small(docs.sparkSession)
    keyed = docs.select("doc_id", F.xxhash64(empty_as()).alias("text_key"), "text")
    marked = stored(fingerprint_table(keyed, shingle, ["doc_id", "text_key"]), "simhash")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = stored(distinct, "distinct")
    nodes = components(links(distinct, bits))
    rooted = (
        distinct.join(nodes, distinct["fp"] == nodes["node"], "left")
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(named, "root").select("fp", "root", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: that of its least ``doc_id``
    (null last, ties by text hash); of equal rows one stays.

    Rows are chosen on narrow columns.  Texts stay where they are if the keys of the
    rows that go, or of those that stay, are small enough for a broadcast; else they
    are moved once, by the last join.
    """
    marks = near_duplicates(docs, shingle, bits)
    rows = marks.groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    rows = stored(rows, "rows")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "copies")
    best = rows.groupBy("root").agg(F.min(order).alias("best"))
    best = stored(best.select("best.doc_id", "best.text_key", "best.copies"), "best")
    same_key = rows["doc_id"].eqNullSafe(best["doc_id"]) & (rows["text_key"] == best["text_key"])
    gone = stored(rows.join(best, same_key, "left_anti").select("doc_id", "text_key"), "gone")

    def by_key(left: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
        same = left["doc_id"].eqNullSafe(chosen["doc_id"])
        same &= F.xxhash64(F.coalesce(left["text"], F.lit(""))) == chosen["text_key"]
        return left.join(F.broadcast(chosen) if is_small(chosen, SMALL) else chosen, same, how)

    if is_small(gone, SMALL):
        kept = by_key(docs, gone, "left_anti")
    else:
        kept = by_key(docs, best.drop("copies"), "left_semi")
    repeated = best.where("copies > 1").select("doc_id", "text_key")
    if repeated.isEmpty():
        return kept
    return by_key(kept, repeated, "left_anti").unionByName(
        by_key(docs, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = near_duplicates(read(spark, sf_dir))
    return found.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )
