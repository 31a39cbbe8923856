"""Shards along a Hilbert curve through several metadata dimensions.

Each dimension is quantised into cells of nearly equal row counts, in the order
of its values.  The cells of a document are a point of a small cube; the Hilbert
curve visits the points so that neighbours on the curve are neighbours in the
cube.  Documents are sorted by curve index and cut into runs whose counts differ
by at most one, so a shard covers a narrow range of every dimension and a filter
on any of them skips most shards by their minima and maxima.

DataFrame operations only.  The curve is a table of ``2^(bits * dimensions)``
indices, built from the rule and folded into the plan as a constant.

Size.  Texts are read once and not moved; what is sorted is a narrow row a
document.  Cells come from counts by distinct value, summed along ranges of
values, so neither a hot value nor many values meet in one task.  The global rank
is a sum over sorted ranges (one row per range in one place).

Cases.  A null text has size 1 (0 bytes plus 1) and checksum 0.  Null values of a
dimension come first.  Rows of one curve index are ordered by ``doc_id`` (null
first), checksum and size; rows equal in all of these are interchangeable.  An
empty table gives an empty result.  Other columns are not read by the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.llm.common import empty_as, read, running_totals, stored

SHARDS = 16
DIMENSIONS, BITS = ("size", "lang", "source"), 4


def curve_index(point: list[int], bits: int) -> int:
    """Place of a point on the Hilbert curve (Gray-code transform of its bits)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations, from the top bit down
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    index = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | v >> b & 1
    return index


def curve_table(dimensions: int, bits: int) -> list[int]:
    """Curve index of every point; the first dimension is the most significant."""
    mask = (1 << bits) - 1
    return [
        curve_index([c >> bits * (dimensions - 1 - i) & mask for i in range(dimensions)], bits)
        for c in range(1 << bits * dimensions)
    ]


def with_cells(rows: DataFrame, dimension: str, bits: int, total: int) -> DataFrame:
    """``rows`` with ``cell_<dimension>``: the share of rows with smaller values, in
    steps of ``2^-bits``."""
    name = f"cell_{dimension}"
    counts = rows.groupBy(F.col(dimension).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    before = running_totals(counts, ["_value"], {"_before": "_n"})
    cell = F.floor(F.col("_before") * (1 << bits) / F.lit(total)).cast("int")
    cells = before.select("_value", cell.alias(name))
    return rows.join(cells, rows[dimension].eqNullSafe(cells["_value"])).drop("_value")


def shard(
    docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS,
    bits: int = BITS, keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """``keep``, ``size``, ``text_crc32``, ``curve``, ``shard`` and ``slot`` of each row.

    ``dimensions`` are columns of ``docs``, or ``size``: bytes of the text plus 1.
    """
    data = F.encode(empty_as(), "UTF-8")
    columns = [c for c in dimensions if c != "size"]
    rows = docs.select(
        *dict.fromkeys([*keep, "doc_id", *columns]),
        (F.octet_length(empty_as()) + 1).cast("bigint").alias("size"),
        F.crc32(data).alias("text_crc32"), F.lit(1).cast("bigint").alias("_one"),
    )
    rows = stored(rows, "metadata")
    total = rows.count()
    placed = rows
    for d in dimensions:
        placed = with_cells(placed, d, bits, total)
    place = F.lit(0)
    for d in dimensions:
        place = place * (1 << bits) + F.col(f"cell_{d}")
    table = ",".join(map(str, curve_table(len(dimensions), bits)))
    curve = F.get(F.expr(f"array({table})"), place)
    ranked = running_totals(
        placed.withColumn("curve", curve).drop(*[f"cell_{d}" for d in dimensions]),
        ["curve", "doc_id", "text_crc32", "size"], {"_rank": "_one"},
    )
    number = F.expr(f"CAST(_rank * {shards}L div {max(total, 1)}L AS INT)")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return ranked.withColumn("shard", number).select(
        *keep, "size", "text_crc32", "curve", "shard", (F.col("_rank") - first).alias("slot")
    )


def write(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes ``docs`` into a folder per shard, each in curve order."""
    own = docs.withColumn("_row", F.struct("*"))
    placed = shard(own, shards, keep=("_row",))
    ordered = placed.repartition(shards, "shard").sortWithinPartitions("shard", "slot")
    names = [F.col(f"_row.{c}").alias(c) for c in docs.columns if c != "shard"]
    ordered.select(*names, "shard").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ 0xEDB88320 if i & 1 else i >> 1
        out.append(i)
    return out


def oracle() -> str:
    """The query as DuckDB SQL; the checksum is folded byte by byte."""
    cells = ", ".join(
        f"cells_{d} AS (SELECT {d}, CAST(floor(coalesce(sum(n) OVER (ORDER BY {d} NULLS FIRST "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {1 << BITS} / "
        f"(SELECT count(*) FROM meta)) AS INTEGER) AS cell FROM "
        f"(SELECT {d}, count(*) AS n FROM meta GROUP BY {d}))"
        for d in DIMENSIONS
    )
    joins = " ".join(
        f"JOIN cells_{d} ON meta.{d} IS NOT DISTINCT FROM cells_{d}.{d}" for d in DIMENSIONS
    )
    place = "0"
    for d in DIMENSIONS:
        place = f"({place} * {1 << BITS} + cells_{d}.cell)"
    half = "((ascii({0}) & 15) + 9 * (ascii({0}) >> 6))"
    byte = f"CAST(16 * {half.format('p')} + {half.format('p[2]')} AS BIGINT)"
    fold = f"xor(c >> 8, {_crc_table()}[xor(c & 255, b) + 1])"
    return f"""
WITH texts AS (SELECT doc_id, lang, source, encode(coalesce(text, '')) AS data FROM documents),
meta AS (SELECT doc_id, lang, source, octet_length(data) + 1 AS size, CAST(xor(list_reduce(
  list_transform(regexp_extract_all(hex(data), '..'), lambda p: {byte}),
  lambda c, b: {fold}, CAST(4294967295 AS BIGINT)), 4294967295) AS BIGINT) AS text_crc32
  FROM texts),
{cells},
placed AS (SELECT meta.*, {curve_table(len(DIMENSIONS), BITS)}[{place} + 1] AS curve
  FROM meta {joins}),
ranked AS (SELECT *, row_number() OVER (ORDER BY curve, doc_id NULLS FIRST, text_crc32, size) - 1
  AS rank, count(*) OVER () AS total FROM placed),
numbered AS (SELECT *, rank * {SHARDS} // total AS shard FROM ranked)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law,
  CAST(shard AS INTEGER) AS shard,
  CAST(rank - (shard * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM numbered"""
