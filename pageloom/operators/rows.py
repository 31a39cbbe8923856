"""Tree operators on the node table: one row per node, for trees of any size.

The array form (``operators.tree``) holds a page's nodes in one row.  Here a node is a
row ``(page_id, pre, fin, ...)`` and a subtree the interval ``[pre, fin]``, so a tree
need not fit one row or one task's memory.  Scans in page order are windows that keep
a running value and stream; containment is a staircase join: covered roots go first,
the rest are disjoint, and a node belongs to the last root before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Places of a page that meet under one key in ``subtrees``.
CHUNK = 1024


def _in_order():
    return Window.partitionBy("page_id").orderBy("pre")


def outermost(hits: DataFrame) -> DataFrame:
    """Hits outside every earlier hit of their page.

    A hit is nested iff it starts before the greatest end so far: one exchange on
    ``page_id``, one running maximum, linear in the hits.
    """
    before = _in_order().rowsBetween(Window.unboundedPreceding, -1)
    return hits.withColumn("_end", F.max("fin").over(before)).where("_end IS NULL OR pre > _end").drop("_end")


def walk_until(nodes: DataFrame, stop: Column) -> DataFrame:
    """Nodes seen by a scan of each page that ends at its first stop node, included."""
    before = _in_order().rowsBetween(Window.unboundedPreceding, -1)
    hit = F.when(F.coalesce(stop, F.lit(False)), 1)
    return nodes.withColumn("_stops", F.count(hit).over(before)).where("_stops = 0").drop("_stops")


def outermost_until(hits: DataFrame, stop: Column) -> DataFrame:
    """``outermost`` that gives up everything after the first surviving stop hit."""
    return walk_until(outermost(hits), stop)


def within(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that lie in the subtree of any root, once each, roots included.

    Covered roots are pruned; of what is left a node can only lie in the last root at or
    before it.  Roots and nodes go through one exchange together, so there is no join.
    """
    marks = outermost(roots.select("page_id", "pre", "fin")).select(
        "page_id", "pre", F.lit(None).alias("_node"), F.col("fin").alias("_end")
    )
    columns = F.struct(*nodes.columns).alias("_node")
    both = nodes.select("page_id", "pre", columns, F.lit(None).cast("int").alias("_end")).unionByName(marks)
    # a root's mark comes before the node itself
    upto = Window.partitionBy("page_id").orderBy("pre", F.col("_node").isNotNull()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    held = both.withColumn("_last", F.last("_end", ignorenulls=True).over(upto))
    return held.where("_node IS NOT NULL AND pre <= _last").select("_node.*")


def subtrees(nodes: DataFrame, roots: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``root`` (its ``pre``) and every node of its subtree, for roots that may be nested.

    A join on page and stretch of ``chunk`` places: a root stands once for each stretch
    it reaches, so no page is one key, and pairs are tested only where they can meet.
    """
    stretch = F.floor(F.col("pre") / chunk).cast("int")
    ends = roots.select("page_id", F.col("pre").alias("root"), F.col("fin").alias("_end"))
    reach = F.sequence(F.floor(F.col("root") / chunk).cast("int"), F.floor(F.col("_end") / chunk).cast("int"))
    ends = ends.withColumn("_stretch", F.explode(reach))
    met = nodes.withColumn("_stretch", stretch).join(ends, ["page_id", "_stretch"])
    return met.where("pre BETWEEN root AND _end").drop("_stretch", "_end")
