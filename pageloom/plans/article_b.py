"""Article pages of site B -> one record per page."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom import fixed
from pageloom.functions.scalars import (
    absent, case, keep, let, lets, lit, mapped, pixels, plain_spaces, rfc3339, ws_trim,
)
from pageloom.operators import tree as t
from pageloom.plans import blocks as b

_TEXT, _PHOTO = lit(fixed.KIND_B_TEXT), lit(fixed.KIND_B_PHOTO)


def _has_class(name: str) -> t.Predicate:
    return t.match(attrs={"class": name})


def _content(node: str) -> str:
    return t.attr(node, "content")


def page_rules(kind: str):
    return [
        ("title", lambda n: f"({t.match('title')(n)} AND {n}.n_attrs = 0)"),
        ("description", t.match(attrs={"name": "description"})),
        ("published", t.match(attrs={"property": fixed.B_PUBLISHED})),
        ("updated", t.match(attrs={"property": fixed.B_UPDATED})),
        ("main", lambda n: f"({kind} = {_TEXT} AND {_has_class(fixed.B_MAIN)(n)})"),
        ("slider", lambda n: f"({kind} = {_PHOTO} AND {_has_class(fixed.B_SLIDER)(n)})"),
        ("author", t.match(attrs={"id": fixed.B_AUTHOR_ID, "type": fixed.JSON_LD})),
    ]


MAIN_RULES = [
    ("related", t.match(attrs={"id": fixed.B_RELATED_ID})),
    ("content", _has_class(fixed.B_CONTENT)),
]
CONTENT_RULES = [
    ("top", _has_class(fixed.B_TOP_MEDIA)),
    ("body", _has_class(fixed.B_ARTICLE_BODY)),
]


def is_page_item(node: str) -> str:
    return f"({t.is_element(node)} AND rlike({t.attr(node, 'class')}, r'{fixed.B_PAGE_ITEM}'))"


def _is_skipped(node: str) -> str:
    names = ", ".join(lit(c) for c in fixed.B_SKIPPED)
    ad = f"{t.match('div')(node)} AND {t.attr(node, 'class')} IN ({names})"
    return f"({ad} OR {t.match('h2')(node)} OR {t.match('p')(node)})"


# The last rule takes what the ones before left: ads, other h2, other p.
BLOCK_RULES = [
    ("image", t.match("div", {"class": fixed.B_IMAGE})),
    ("section", t.match("h2", {"class": fixed.B_SECTION})),
    ("paragraph", lambda n: f"({t.match('p')(n)} AND {n}.n_attrs = 0)"),
    ("skip", _is_skipped),
]


# -- blocks -----------------------------------------------------------------------


def top_image_block(div: str) -> str:
    def of(e) -> str:
        img = e.img
        found = b.image(
            url=absent(t.attr(img, "data-src")),
            caption=absent(t.attr(img, "alt")),
            width=pixels(t.attr(img, "width")),
            height=pixels(t.attr(img, "height")),
        )
        return case((f"{img} IS NOT NULL", b.block(fixed.IMAGE, image=found)))

    def inside(node: str, pred: t.Predicate) -> str:
        return t.find_first(t.subtree("nodes", node), pred)

    return lets(
        of,
        fig=lambda e: inside(div, t.match("figure", {"class": fixed.B_FIGURE})),
        link=lambda e: inside(e.fig, t.match("a", {"class": fixed.B_FIGURE_LINK})),
        img=lambda e: inside(e.link, t.match("img")),
    )


def _figure_block(fig: str, **fields: str) -> str:
    """Image block from a figure's own attributes, sized by its first img."""
    return let(
        t.find_first(t.subtree("nodes", fig), t.match("img")),
        lambda img: b.block(
            fixed.IMAGE,
            image=b.image(
                width=pixels(t.attr(img, "width")), height=pixels(t.attr(img, "height")), **fields
            ),
        ),
    )


def image_block(div: str) -> str:
    def of(fig: str) -> str:
        caption = f"btrim({t.attr(fig, 'data-description')}, {lit(fixed.B_CAPTION_STRIP)})"
        found = _figure_block(
            fig,
            url=absent(t.attr(fig, "data-image")),
            alt=absent(t.attr(fig, "data-title")),
            caption=absent(plain_spaces(caption)),
        )
        return case((f"{fig} IS NOT NULL", found))

    figure = t.match("figure", {"class": fixed.B_FIGURE})
    return let(t.find_first(t.subtree("nodes", div), figure), of)


def section_block(h2: str) -> str:
    return b.block(fixed.SECTION, text=absent(ws_trim(t.text("nodes", h2))))


def paragraph_block(p: str) -> str:
    return let(
        plain_spaces(t.mixed("nodes", p)),
        lambda s: case((f"{s} NOT IN ('', ' ')", b.block(fixed.PARAGRAPH, text=s))),
    )


def slider_block(fig: str) -> str:
    return _figure_block(
        fig,
        url=absent(t.attr(fig, "data-image")),
        title=absent(t.attr(fig, "data-title")),
        caption=absent(t.attr(fig, "data-description")),
    )


def _contents(claimed: str) -> str:
    def one(hit: str) -> str:
        node = f"{hit}.node"
        makers = {
            "top": top_image_block,
            "image": image_block,
            "section": section_block,
            "paragraph": paragraph_block,
            "slide": slider_block,
        }
        return case(*[(f"{hit}.rule = {lit(r)}", let(node, make)) for r, make in makers.items()])

    return b.present(mapped(claimed, one))


# -- other parts --------------------------------------------------------------------


def _related(lists: str) -> str:
    def card(item: str) -> str:
        def of(scope: str) -> str:
            imgs, links = keep(scope, t.match("img")), keep(scope, t.match("a"))

            def last_attr(items: str, name: str) -> str:
                return t.last_of(items, lambda n: t.attr(n, name))

            thumbnail = let(
                imgs,
                lambda i: b.image(
                    url=absent(last_attr(i, "data-src")),
                    width=pixels(last_attr(i, "width")),
                    height=pixels(last_attr(i, "height")),
                ),
            )
            found = b.related(
                absent(t.attr(item, "data-title")), absent(last_attr(links, "href")), thumbnail
            )
            return case((f"{scope} IS NOT NULL", found))

        figure = t.find_first(t.subtree("nodes", item), t.match("figure"))
        return let(t.subtree("nodes", figure), of)

    cards = t.match("div", {"class": fixed.B_RELATED_ITEM})
    per_list = mapped(
        lists, lambda r: mapped(t.outermost(t.subtree("nodes", r), cards), card)
    )
    return b.present(f"flatten({per_list})")


def _author(scripts: str) -> str:
    """Last array element with an author, over all rich-card scripts."""

    def of(script: str) -> str:
        cards = f"try_variant_get(try_parse_json({t.text('nodes', script)}), '$', 'array<variant>')"
        authors = mapped(cards, lambda c: f"try_variant_get({c}, '$.author', 'variant')")
        found = keep(authors, lambda a: f"{a} IS NOT NULL AND NOT is_variant_null({a})")
        return let(
            t.last(found),
            lambda a: case(
                (
                    f"{a} IS NOT NULL",
                    b.author(
                        absent(f"try_variant_get({a}, '$.name', 'string')"),
                        absent(f"try_variant_get({a}, '$.url', 'string')"),
                    ),
                )
            ),
        )

    return t.last_of(scripts, of)


def parts_b(trees: DataFrame) -> DataFrame:
    """Page kind and claimed nodes: ``page_id, url, nodes, kind, top, inner, claimed``.

    A column ``item_kind`` in ``trees`` (the kind the listing gave) takes
    precedence over the page's own body class.  ``inner`` holds the related and
    content parts of the main part, ``claimed`` the block nodes in page order.
    """
    own = let(
        t.attr(
            t.find_first(
                "nodes",
                lambda n: f"{t.is_element(n)} AND {t.attr(n, 'class')} IN "
                f"({lit(fixed.B_BODY_TEXT)}, {lit(fixed.B_BODY_PHOTO)})",
            ),
            "class",
        ),
        lambda c: case(
            (f"{c} = {lit(fixed.B_BODY_TEXT)}", _TEXT), (f"{c} = {lit(fixed.B_BODY_PHOTO)}", _PHOTO)
        ),
    )
    given = absent("item_kind") if "item_kind" in trees.columns else "CAST(NULL AS STRING)"

    def flat(items: str, body) -> str:
        return f"flatten({mapped(items, body)})"

    def inside(node: str, rules) -> str:
        return t.dispatch(t.subtree("nodes", node), rules)

    inner = flat(t.nodes_of("top", "main"), lambda m: inside(m, MAIN_RULES))

    def content(node: str) -> str:
        def part(hit: str) -> str:
            items = t.outermost(t.subtree("nodes", f"{hit}.node"), is_page_item)
            body = flat(items, lambda i: inside(i, BLOCK_RULES))
            return case((f"{hit}.rule = 'top'", f"array({hit})"), other=body)

        return flat(inside(node, CONTENT_RULES), part)

    slides = flat(
        t.nodes_of("top", "slider"),
        lambda s: mapped(
            t.outermost(t.subtree("nodes", s), t.match("figure")),
            lambda f: f"named_struct('rule', 'slide', 'node', {f})",
        ),
    )
    claimed = case(
        (f"kind = {_PHOTO}", slides), other=flat(t.nodes_of("inner", "content"), content)
    )
    return (
        trees.select(
            "page_id", "url", "nodes", F.expr(f"coalesce({given}, {own})").alias("kind")
        )
        .select("*", F.expr(let("kind", lambda k: t.dispatch("nodes", page_rules(k)))).alias("top"))
        .select("*", F.expr(inner).alias("inner"))
        .select("*", F.expr(claimed).alias("claimed"))
    )


def article_b(trees: DataFrame) -> DataFrame:
    """``page_id, link, kind, headline, description, published_at, updated_at,
    author, contents, related``."""

    def top(rule: str, body) -> str:
        return let(t.nodes_of("top", rule), body)

    def last_time(rule: str) -> str:
        return top(rule, lambda found: t.last_of(found, lambda n: rfc3339(_content(n))))

    headline = top(
        "title",
        lambda found: let(t.last(found), lambda n: plain_spaces(ws_trim(t.text("nodes", n)))),
    )
    columns = {
        "headline": absent(headline),
        "description": absent(top("description", lambda d: _content(t.last(d)))),
        "published_at": last_time("published"),
        "updated_at": last_time("updated"),
        "author": top("author", _author),
        "contents": let("claimed", _contents),
        "related": let(t.nodes_of("inner", "related"), _related),
    }
    return parts_b(trees).select(
        "page_id",
        F.col("url").alias("link"),
        "kind",
        *[F.expr(sql).alias(name) for name, sql in columns.items()],
    )
