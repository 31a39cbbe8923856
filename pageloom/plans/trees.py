"""Pages -> trees: the scan-side half of every extractor."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from pageloom.functions import html_tree
from pageloom.schema import NODES_DDL
from pageloom.session import keep_batches_small

# The parser travels with the plan: executors need no installed package.
cloudpickle.register_pickle_by_value(html_tree)


def page_trees(pages: DataFrame, *keep: str) -> DataFrame:
    """Parse ``html`` into ``nodes ARRAY<NODE>``, one row per page.

    ``keep`` names the columns carried along (default: all but html).  Filter
    pages before calling: nothing is pushed through the Python stage.
    """
    keep_batches_small(pages.sparkSession)
    keep = keep or tuple(c for c in pages.columns if c != "html")
    chosen = pages.select(*keep, "html")
    carried = [f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep]
    return chosen.mapInArrow(html_tree.parse_batches, ", ".join([*carried, f"nodes {NODES_DDL}"]))


def node_table(trees: DataFrame) -> DataFrame:
    """The relational form: one row per node."""
    keep = [c for c in trees.columns if c != "nodes"]
    return trees.select(*keep, F.inline("nodes"))
