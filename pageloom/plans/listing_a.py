"""Listing pages of site A -> index items.

Every ``article`` element in the listing opens a segment that runs to the next
one.  Inside a segment the fields are looked for in a fixed order, each one
after the place where the one before was found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom import fixed
from pageloom.functions.scalars import absent, case, epoch_time, let, lets, mapped, struct
from pageloom.operators import tree as t

_IMAGE_DIV = t.match("div", {"class": fixed.A_LIST_IMAGE})
_SUBTITLE = t.match("h2", {"class": fixed.A_LIST_SUBTITLE})
_TITLE = t.match("h3", {"class": fixed.A_LIST_TITLE})
_LINK = t.match("a", {"class": fixed.A_LIST_LINK})
_DATE = t.match("div", {"class": fixed.A_LIST_DATE})


def _with(tag: str, attr: str) -> t.Predicate:
    return lambda n: f"{t.match(tag)(n)} AND {t.has_attr(n, attr)}"


def _item(seg: str) -> str:
    """The item of one segment, NULL unless every step was reached."""

    def at(pre: str) -> str:
        return f"get({seg}, {pre} - get({seg}, 0).pre)"

    def after(place: str, pred: t.Predicate) -> str:
        return t.find_first(seg, lambda n: f"{n}.pre > {place} AND {pred(n)}")

    def following(node: str) -> str:
        """Text of the very next node, if that is a text node."""
        return let(at(f"{node}.pre + 1"), lambda n: case((t.is_text(n), f"{n}.text")))

    def title_after(image: str) -> str:
        # The node right after a subtitle heading is read as its text, whatever it is.
        def taken(n: str) -> str:
            before = let(at(f"{n}.pre - 1"), lambda b: f"{_SUBTITLE(b)} AND {b}.pre > {image}")
            return f"coalesce({before}, false)"

        return after(image, lambda n: f"{_TITLE(n)} AND NOT {taken(n)}")

    def read_as_text(n: str, image: str) -> str:
        """Whether a subtitle heading is used up as the text of the one before it."""

        def heading(k: int) -> str:
            before = let(at(f"{n}.pre - {k}"), lambda b: f"{_SUBTITLE(b)} AND {b}.pre > {image}")
            return f"coalesce({before}, false)"

        return f"({heading(1)} AND NOT {heading(2)})"

    def record(e) -> str:
        subtitle = t.last_of(
            t.find_all(
                seg,
                lambda n: f"{_SUBTITLE(n)} AND {n}.pre BETWEEN {e.image}.pre AND {e.title}.pre "
                f"AND NOT {read_as_text(n, f'{e.image}.pre')}",
            ),
            following,
        )
        fields = struct(
            article_link=absent(t.attr(e.link, "href")),
            image_url=absent(t.attr(e.image, "src")),
            title=absent(following(e.link)),
            subtitle=absent(subtitle),
            published_at=epoch_time(t.attr(e.time, fixed.A_LIST_TIME_ATTR)),
        )
        return case((f"{e.time} IS NOT NULL", fields))

    return lets(
        record,
        div=lambda e: t.find_first(seg, _IMAGE_DIV),
        image=lambda e: after(f"{e.div}.pre", _with("img", "src")),
        title=lambda e: title_after(f"{e.image}.pre"),
        link=lambda e: after(f"{e.title}.pre", lambda n: f"{_LINK(n)} AND {t.has_attr(n, 'href')}"),
        date=lambda e: after(f"{e.link}.pre + 1", _DATE),
        time=lambda e: after(f"{e.date}.pre", _with("span", fixed.A_LIST_TIME_ATTR)),
    )


def index_a(trees: DataFrame) -> DataFrame:
    """Complete items: ``page_id, pos, article_link, image_url, title, subtitle,
    published_at``.  Pages without a listing give no rows."""

    def items(e) -> str:
        def one(start: str, i: str) -> str:
            stop = f"coalesce(get({e.starts}, {i} + 1) - 1, {e.root}.fin)"
            segment = mapped(f"sequence({start}, {stop})", lambda j: f"get(nodes, {j})")
            return let(segment, _item)

        return mapped(e.starts, one, arity=2)

    found = lets(
        items,
        root=lambda e: t.find_first("nodes", t.match("div", {"id": fixed.A_LIST_ROOT_ID})),
        starts=lambda e: mapped(
            t.find_all(t.subtree("nodes", e.root), t.match("article")), lambda n: f"{n}.pre"
        ),
    )
    return (
        trees.select("page_id", F.posexplode(F.expr(found)).alias("pos", "item"))
        .where("item IS NOT NULL")
        .select("page_id", "pos", "item.*")
    )
