"""Listing pages of site B -> index items, one row per item block."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom import fixed
from pageloom.functions.scalars import (
    absent, case, let, mapped, pixels, plain_spaces, rfc3339, struct, ws_trim,
)
from pageloom.operators import tree as t

_RULES = [
    ("thumbnail", t.match(attrs={"class": fixed.B_LIST_THUMBNAIL})),
    ("time", t.match("time")),
    ("title", t.match(attrs={"class": fixed.B_LIST_TITLE})),
    ("summary", t.match(attrs={"class": fixed.B_LIST_SUMMARY})),
]


def _item(root: str) -> str:
    def thumbnail(node: str) -> str:
        def fields(img: str) -> str:
            found = struct(
                url=absent(t.attr(img, "src")),
                width=pixels(t.attr(img, "width")),
                height=pixels(t.attr(img, "height")),
                alt=absent(t.attr(img, "alt")),
            )
            return case((f"{img} IS NOT NULL", found))

        return let(t.find_first(t.subtree("nodes", node), t.match("img")), fields)

    def anchor(name: str):
        return lambda node: t.attr(t.find_first(t.subtree("nodes", node), t.match("a")), name)

    def fields(parts: str) -> str:
        def last(rule: str, value) -> str:
            return t.last_of(t.nodes_of(parts, rule), value)

        return struct(
            type=absent(t.attr(root, "data-type")),
            title=absent(plain_spaces(last("title", anchor("title")))),
            link=absent(last("title", anchor("href"))),
            thumbnail=last("thumbnail", thumbnail),
            summary=absent(last("summary", lambda n: ws_trim(t.text("nodes", n)))),
            published_at=rfc3339(last("time", lambda n: t.attr(n, "datetime"))),
        )

    return let(t.dispatch(t.subtree("nodes", root), _RULES), fields)


def index_b(trees: DataFrame) -> DataFrame:
    """``page_id, pos, type, title, link, thumbnail, summary, published_at``."""
    items = let(
        t.find_first("nodes", t.match("article", {"class": fixed.B_LIST_ROOT})),
        lambda root: mapped(
            t.outermost(t.subtree("nodes", root), t.match(attrs={"class": fixed.B_LIST_ITEM})),
            _item,
        ),
    )
    return trees.select("page_id", F.posexplode(F.expr(items)).alias("pos", "item")).select(
        "page_id", "pos", "item.*"
    )
