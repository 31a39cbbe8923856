"""Broadcasting behind a measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from pageloom.session import stored

BROADCAST_BYTES = 64 * 1024 * 1024


def row_bytes(df: DataFrame) -> Column:
    """Size of a row of strings and numbers."""
    size = F.lit(0)
    for name, kind in df.dtypes:
        size = size + 16 + (F.coalesce(F.octet_length(name), F.lit(0)) if kind == "string" else 8)
    return size


def narrow_bytes(df: DataFrame) -> int:
    """Size of a table of strings and numbers, by one aggregate over it.

    Give it a stored table: measuring runs ``df`` once.
    """
    return df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()[0]


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return narrow_bytes(df) <= limit


def build_side(df: DataFrame) -> DataFrame:
    """A narrow table as the hashed side of a join with wide rows.

    Broadcast if its measured size allows, so the wide rows stay where they are;
    else left to Spark, whose sorted join can spill.
    """
    return F.broadcast(df) if is_small(df) else df


def stored_side(df: DataFrame, purpose: str, limit: int | None = None) -> DataFrame:
    """``df`` stored, as the hashed side of joins: marked for a broadcast if it is small.

    The size is measured while the table is written, so no further job is needed.
    Give a lower ``limit`` where many such tables are broadcast one after another.
    """
    seen = Observation()
    size = F.sum(row_bytes(df)).alias("bytes")
    table = stored(df.observe(seen, size), purpose)
    small = (seen.get.get("bytes") or 0) <= (BROADCAST_BYTES if limit is None else limit)
    return F.broadcast(table) if small else table
