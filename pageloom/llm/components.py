"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom.llm.common import stored


def _with_least(pairs: DataFrame) -> DataFrame:
    """``(u, v)`` with the least ``v`` of each ``u`` as ``m``.

    Reduced before the shuffle; the join back may be split where one ``u`` is hot.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is its least node.

    Alternates large-star and small-star steps until every node points at its
    root.  Each round is two joins on narrow rows, written to the shared folder;
    nothing is gathered per component.
    """
    a, b = F.col("a"), F.col("b")
    now = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = stored(now.distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _with_least(both).where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        )
        # a node without smaller neighbours keeps its larger ones in ``large``
        large = stored(large.where("u != v").distinct(), "edges")
        small = _with_least(large)
        now = stored(
            small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v"))).distinct(),
            "edges",
        )
        sign = tuple(
            now.agg(
                F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)")),
                F.bit_xor(F.xxhash64("u", "v")),
            ).first()
        )
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
