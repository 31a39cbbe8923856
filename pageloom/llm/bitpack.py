"""Token ids as fixed-width bit fields, in blocks that can be read on their own.

An id takes the least number of bits the vocabulary needs.  Eight ids fill
exactly ``bits`` bytes, so packing and unpacking are a few shifts over whole
arrays and any id lies at a place that is computed, not searched.

The file is a Parquet table in a shared folder with a row for each block:
``part`` (range of doc ids), ``block`` (place in the part), ``first`` (ids of
the part before the block), ``bits``, ``n_ids``, ``doc_ids``, ``doc_tokens`` and
``payload``.  A block holds whole documents, at least ``BLOCK_IDS`` ids if more
follow; so no reader needs another block.  The place of a block in the corpus is
the number of ids in the parts before it plus ``first``.

Size.  Documents are dealt out by ranges of ``doc_id``, texts are moved once and
sorted within a range.  A task holds one block.  Only the number of ids of each
part, one per task of the exchange, is added up in one place.

Cases.  A null or empty text has only its end id.  Null ``doc_id`` come first.
Rows of one ``doc_id`` follow each other by text hash and are all written.  An
empty table gives a file without blocks.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pageloom.llm.common import WORD_SLICE_CHARS, read, shared_dir, tasks, text_slices
from pageloom.llm.tokens import default_tokenizer, encoder

BLOCK_IDS = 1 << 16
END = 0
LAYOUT = (
    "part INT, block INT, first BIGINT, bits INT, n_ids BIGINT, "
    "doc_ids ARRAY<BIGINT>, doc_tokens ARRAY<BIGINT>, payload BINARY"
)


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` bits of each id, one after another, lowest bit first."""
    lanes = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(lanes), bits), np.uint8)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        value = lanes[:, lane] << np.uint64(shift)
        for k in range(-(-(shift + bits) // 8)):
            out[:, byte + k] |= (value >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * bits // 8)]


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of a payload; only their bytes are read."""
    skip = start % 8
    first = (start - skip) // 8 * bits
    groups = -(-(skip + count) // 8)
    raw = np.frombuffer(payload, np.uint8)[first : first + groups * bits]
    full = np.zeros((groups, bits), np.uint8)
    full.reshape(-1)[: len(raw)] = raw
    out = np.empty((groups, 8), np.uint32)
    keep = np.uint64((1 << bits) - 1)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        value = np.zeros(groups, np.uint64)
        for k in range(-(-(shift + bits) // 8)):
            value |= full[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, lane] = (value >> np.uint64(shift)) & keep
    return out.reshape(-1)[skip : skip + count]


def _blocks(path: str, end: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    bits = max(1, (max(encode.vocabulary - 1, end)).bit_length())
    part, block, first = TaskContext.get().partitionId(), 0, 0
    names: list = []
    sizes: list[int] = []
    held: list[np.ndarray] = []
    size = 0

    def made() -> pa.RecordBatch:
        ids = np.concatenate(held)
        row = [part, block, first, bits, len(ids), names, sizes, pack(ids, bits)]
        kinds = [
            pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(),
            pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(),
        ]
        columns = [pa.array([v], type=k) for v, k in zip(row, kinds, strict=True)]
        labels = [x.split()[0] for x in LAYOUT.split(", ")]
        return pa.RecordBatch.from_arrays(columns, names=labels)

    for slice_, texts in text_slices(batches, WORD_SLICE_CHARS):
        ids, counts = encode.encode(texts)
        stops = np.cumsum(counts)
        for name, stop, count in zip(slice_.column(0).to_pylist(), stops, counts, strict=True):
            names.append(name)
            sizes.append(int(count) + 1)
            held += [ids[stop - count : stop], np.array([end], np.uint32)]
            size += int(count) + 1
            if size >= BLOCK_IDS:
                yield made()
                block, first, size = block + 1, first + size, 0
                names, sizes, held = [], [], []
    if names:
        yield made()


def write(docs: DataFrame, tokenizer: str, end: int = END, path: str | None = None) -> str:
    """Writes the ids of all documents in ascending ``doc_id``; returns the path."""
    spark = docs.sparkSession
    path = path or shared_dir(spark, "ids")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    ranged = keyed.repartitionByRange(tasks(spark), "doc_id", "key").sortWithinPartitions("doc_id", "key")
    blocks = ranged.select("doc_id", "text").mapInArrow(
        lambda batches: _blocks(tokenizer, end, batches), LAYOUT
    )
    blocks.write.option("compression", "none").parquet(path)
    return path


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a file with ``start``, the ids of the whole file before each."""
    blocks = spark.read.schema(LAYOUT).parquet(path)
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # one row for each task that wrote the file
    return blocks.join(F.broadcast(parts), "part").withColumn("start", F.expr("before + first"))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4").tobytes()
            sizes = np.array(row["doc_tokens"], np.int64)
            stops = np.cumsum(sizes)
            crc = [
                zlib.crc32(ids[4 * (b - n) : 4 * b])
                for b, n in zip(stops.tolist(), sizes.tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + stops - sizes),
                    pa.array(sizes), pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the file."""
    blocks = read_blocks(spark, path)
    columns = ["start", "bits", "n_ids", "doc_ids", "doc_tokens", "payload"]
    return blocks.select(*columns).mapInArrow(
        _documents, "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT"
    )


def ids_at(spark: SparkSession, path: str, start: int, count: int) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of the whole file: random access.

    Reads the payload of the blocks that hold them; give a count that the driver
    can hold.
    """
    blocks = read_blocks(spark, path).where(
        (F.col("start") < start + count) & (F.col("start") + F.col("n_ids") > start)
    )
    found = [np.empty(0, np.uint32)]
    for row in blocks.select("start", "bits", "n_ids", "payload").orderBy("start").collect():
        a, b = max(start, row.start), min(start + count, row.start + row.n_ids)
        found.append(unpack(bytes(row.payload), row.bits, a - row.start, b - a))
    return np.concatenate(found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document, read back from the file."""
    return documents(spark, write(read(spark, sf_dir), default_tokenizer()))
