"""Article pages of site A -> one record per page.

The page kind is settled first.  A dispatch over the whole page then finds the
metadata nodes and the body, a second one inside the body claims the nodes that
make content blocks.  Every output column binds what it needs, so a column
nobody reads costs nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom import fixed
from pageloom.functions.scalars import (
    absent, case, keep, known_keys, let, lets, lit, mapped, positive, rfc3339, strict_int, ws_trim,
)
from pageloom.operators import tree as t
from pageloom.plans import blocks as b

_SINGLE, _PHOTO, _VIDEO = lit(fixed.KIND_A_SINGLE), lit(fixed.KIND_A_PHOTO), lit(fixed.KIND_A_VIDEO)


def _meta(name: str) -> t.Predicate:
    return t.match("meta", {"name": name})


def _content(node: str) -> str:
    return t.attr(node, "content")


def _when(kind: str, value: str, pred: t.Predicate) -> t.Predicate:
    return lambda n: f"({kind} = {value} AND {pred(n)})"


def is_paragraph(node: str) -> str:
    return f"({t.match('p')(node)} AND {node}.n_attrs = 0)"


def page_rules(kind: str):
    mains = [
        _when(kind, _SINGLE, t.match("div", {"class": fixed.A_BODY})),
        _when(kind, _PHOTO, t.match(attrs={"class": fixed.A_DETAIL})),
        _when(kind, _VIDEO, t.match("div", {"class": fixed.A_DETAIL})),
    ]
    figure = t.match("figure", {"class": fixed.A_HEADLINE_IMAGE})
    return [
        ("kind", _meta(fixed.A_META_KIND)),
        ("author", _meta(fixed.A_META_AUTHOR)),
        ("duration", _when(kind, _VIDEO, _meta(fixed.A_META_DURATION))),
        ("jsonld", t.match("script", {"type": fixed.JSON_LD})),
        ("main", lambda n: "(" + " OR ".join(m(n) for m in mains) + ")"),
        ("headline", _when(kind, _SINGLE, figure)),
        ("related", t.match("div", {"id": fixed.A_RELATED_ID})),
    ]


def body_rules(kind: str):
    """Rules inside the body, in order of priority; each kind has its own set."""
    return [
        ("strong", _when(kind, _SINGLE, t.match("strong"))),
        ("header", _when(kind, _PHOTO, t.match(attrs={"class": fixed.A_PHOTO_HEADER}))),
        ("paragraph", is_paragraph),
        ("image", _when(kind, _SINGLE, t.match("div", {"class": fixed.A_IMAGE}))),
        ("section", _when(kind, _SINGLE, t.match("h2"))),
        ("reference", _when(kind, _SINGLE, t.match("div", {"class": fixed.A_REFERENCE}))),
        ("slider", _when(kind, _PHOTO, t.match(attrs={"id": fixed.A_PHOTO_SLIDER_ID}))),
    ]


def _named_image(imgs: str, caption: str, url=lambda n: t.attr(n, "src")) -> str:
    """Image fields of several img nodes: per field the last one that has it."""
    return b.image(
        url=absent(t.last_of(imgs, url)),
        title=absent(t.last_of(imgs, lambda n: t.attr(n, "title"))),
        alt=absent(t.last_of(imgs, lambda n: t.attr(n, "alt"))),
        caption=absent(caption),
    )


# -- blocks ---------------------------------------------------------------------


def paragraph_block(p: str) -> str:
    """Text paragraph, or a video when an embed link is a child of the paragraph."""
    embed = t.match("a", {"class": fixed.A_EMBED})

    def of(link: str) -> str:
        text = let(
            t.mixed("nodes", p),
            lambda s: case((f"{s} != ''", b.block(fixed.PARAGRAPH, text=s))),
        )
        video = b.block(fixed.VIDEO, video=b.video(embedded_url=absent(t.attr(link, "href"))))
        return case((f"{link} IS NOT NULL", video), other=text)

    children = t.find_first(
        t.subtree("nodes", p), lambda n: f"{embed(n)} AND {n}.parent = {p}.pre"
    )
    return let(children, of)


def image_block(div: str) -> str:
    def of(e) -> str:
        imgs = keep(
            e.scope,
            lambda n: f"{t.match('img')(n)} AND ({e.span} IS NULL OR {n}.pre < {e.span}.pre)",
        )
        caption = t.text("nodes", e.span)
        return let(imgs, lambda i: b.block(fixed.IMAGE, image=_named_image(i, caption)))

    return lets(
        of,
        scope=lambda e: t.subtree("nodes", div),
        span=lambda e: t.find_first(e.scope, t.match("span")),
    )


def section_block(h2: str) -> str:
    return b.block(fixed.SECTION, text=absent(t.mixed("nodes", h2)))


def reference_block(div: str) -> str:
    return let(
        t.find_first(t.subtree("nodes", div), t.match("a")),
        lambda a: b.block(
            fixed.REFERENCE,
            ref=b.reference(absent(t.last_text("nodes", a)), absent(t.attr(a, "href"))),
        ),
    )


def slider_blocks(slider: str) -> str:
    def lazy(img: str) -> str:
        return f"coalesce({absent(t.attr(img, 'data-lazy'))}, {t.attr(img, 'src')})"

    def figure(fig: str) -> str:
        def of(parts: str) -> str:
            caption = t.last_of(
                keep(parts, t.match("figcaption")),
                lambda c: ws_trim(t.mixed("nodes", c, ("figcaption", "div"))),
            )
            return let(
                keep(parts, t.match("img")),
                lambda i: b.block(fixed.IMAGE, image=_named_image(i, caption, lazy)),
            )

        wanted = t.outermost(
            t.subtree("nodes", fig),
            lambda n: f"({t.match('img')(n)} OR {t.match('figcaption')(n)})",
        )
        return let(wanted, of)

    return mapped(t.outermost(t.subtree("nodes", slider), t.match("figure")), figure)


def _contents(claimed: str, json_video: str) -> str:
    def one(hit: str) -> str:
        node = f"{hit}.node"

        def when(rule: str) -> str:
            return f"{hit}.rule = {lit(rule)}"

        return case(
            (when("paragraph"), f"array({let(node, paragraph_block)})"),
            (when("image"), f"array({let(node, image_block)})"),
            (when("section"), f"array({let(node, section_block)})"),
            (when("reference"), f"array({let(node, reference_block)})"),
            (when("slider"), let(node, slider_blocks)),
            (when("player"), f"array({b.block(fixed.VIDEO, video=json_video)})"),
            other=b.NONE,
        )

    return b.present(f"flatten({mapped(claimed, one)})")


# -- other parts ------------------------------------------------------------------


def _headline_image(figures: str) -> str:
    """The last figure wins as a whole."""

    def of(fig: str) -> str:
        def fields(scope: str) -> str:
            captions = mapped(
                keep(scope, t.match("figcaption")), lambda c: t.text("nodes", c)
            )
            return let(
                keep(scope, t.match("img")),
                lambda i: _named_image(i, ws_trim(f"array_join({captions}, '')")),
            )

        return case((f"{fig} IS NOT NULL", let(t.subtree("nodes", fig), fields)))

    return let(t.last(figures), of)


def _photo_title(headers: str) -> str:
    return absent(
        t.last_of(
            headers,
            lambda header: let(
                t.find_first(t.subtree("nodes", header), t.match("h1")),
                lambda h1: case((f"{h1} IS NOT NULL", ws_trim(t.text("nodes", h1)))),
            ),
        )
    )


def _related(roots: str) -> str:
    def link(a: str) -> str:
        return b.related(
            absent(t.attr(a, fixed.A_RELATED_TITLE_ATTR)), absent(t.attr(a, "href"))
        )

    def card(article: str) -> str:
        return mapped(t.find_all(t.subtree("nodes", article), t.match("a")), link)

    def of(root: str) -> str:
        cards = t.outermost(t.subtree("nodes", root), t.match("article"))
        return f"flatten({mapped(cards, card)})"

    return f"flatten({mapped(roots, of)})"


def parts_a(trees: DataFrame) -> DataFrame:
    """Page kind and claimed nodes: ``page_id, url, nodes, kind, top, claimed``.

    ``top`` holds the metadata nodes and bodies, ``claimed`` the block nodes of
    all bodies in page order.
    """
    kind = absent(t.last_of(keep("nodes", _meta(fixed.A_META_KIND)), _content))

    def claim(main: str) -> str:
        inside = let("kind", lambda k: t.dispatch(t.subtree("nodes", main), body_rules(k)))
        player = f"array(named_struct('rule', 'player', 'node', {main}))"
        return case((f"kind = {_VIDEO}", f"concat({player}, {inside})"), other=inside)

    claimed = f"flatten({mapped(t.nodes_of('top', 'main'), claim)})"
    return (
        trees.select("page_id", "url", "nodes", F.expr(kind).alias("kind"))
        .select("*", F.expr(let("kind", lambda k: t.dispatch("nodes", page_rules(k)))).alias("top"))
        .select("*", F.expr(claimed).alias("claimed"))
    )


#: The members that are read from a page's JSON.
_JSON_KEYS = (
    "headline", "description", "datePublished", "dateModified", "image", "contentLocation", "video", "name",
    "contentUrl", "embedUrl", "thumbnailUrl",
)


def article_a(trees: DataFrame) -> DataFrame:
    """``page_id, link, kind, headline, headline_image, description, author,
    published_from, published_at, updated_at, duration, contents, related``."""

    def field(path: str) -> str:
        return absent(f"try_variant_get(news, '$.{path}', 'string')")

    def top(rule: str, body) -> str:
        return let(t.nodes_of("top", rule), body)

    def claimed(rule: str, body) -> str:
        return let(t.nodes_of("claimed", rule), body)

    scripts = mapped(t.nodes_of("top", "jsonld"), lambda s: t.text("nodes", s))
    news = f"get({keep(scripts, lambda s: f'rlike({s}, r{chr(39)}{fixed.A_JSON_NEWS}{chr(39)})')}, 0)"
    # keys count in any case; a text that then has a key twice is read as it stands
    named = known_keys("news_text", _JSON_KEYS)
    duration = case(
        (
            f"kind = {_VIDEO}",
            positive(strict_int(top("duration", lambda d: t.last_of(d, _content)), "BIGINT")),
        )
    )
    json_video = b.video(
        url=field("video.contentUrl"),
        embedded_url=field("video.embedUrl"),
        title=field("video.name"),
        description=field("video.description"),
        duration=duration,
        thumbnail=field("video.thumbnailUrl"),
    )
    place = f"get({claimed('strong', lambda s: t.values_of(s, lambda n: t.last_text('nodes', n)))}, 0)"
    is_photo = f"kind = {_PHOTO}"
    columns = {
        "headline": f"coalesce({case((is_photo, claimed('header', _photo_title)))}, {field('headline')})",
        "headline_image": top("headline", _headline_image),
        "description": field("description"),
        "author": absent(top("author", lambda a: t.last_of(a, _content))),
        "published_from": case(
            (is_photo, field("image.contentLocation")), (f"kind = {_SINGLE}", place)
        ),
        "published_at": rfc3339(field("datePublished")),
        "updated_at": rfc3339(field("dateModified")),
        "duration": duration,
        # pages of other kinds have no player
        "contents": let(
            case((f"kind = {_VIDEO}", json_video)), lambda v: let("claimed", lambda c: _contents(c, v))
        ),
        "related": top("related", _related),
    }
    return (
        parts_a(trees)
        .select("*", F.expr(news).alias("news_text"))
        .select("*", F.expr(f"coalesce(try_parse_json({named}), try_parse_json(news_text))").alias("news"))
        .select(
            "page_id",
            F.col("url").alias("link"),
            "kind",
            *[F.expr(sql).alias(name) for name, sql in columns.items()],
        )
    )
