"""Article operators: fetch by listing item, common record, blocks, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageloom import fixed
from pageloom.operators.sized import stored_side
from pageloom.schema import ARTICLE_COLUMNS, AUTHOR_DDL, IMAGE_DDL


def latest_pages(pages: DataFrame) -> DataFrame:
    """``(url, page_id)`` of the latest snapshot of each url; reads narrow columns."""
    recency = [c for c in ("fetched_at", "page_id") if c in pages.columns]
    newest = F.max(F.struct(*recency))["page_id"] if len(recency) > 1 else F.max("page_id")
    return pages.where("url IS NOT NULL").groupBy("url").agg(newest.alias("page_id"))


def pending_pages(pages: DataFrame, known: DataFrame) -> DataFrame:
    """The latest snapshot of each url that is not among the known links, chosen before
    any parse.

    ``pages`` needs ``page_id, url, html``, a ``page_id`` naming one snapshot.  The
    choice is made on narrow columns and stored; html is matched against it, broadcast
    if it is small, as in a daily run over a large store.  The known links are scanned
    past the batch.  A page without a url cannot be stored and is left out.
    """
    found = stored_side(latest_pages(pages), "found")
    links = known.select(F.col("link").alias("url"))
    there = links.join(found.select("url"), "url", "left_semi")
    todo = stored_side(found.join(there, "url", "left_anti"), "todo")
    return pages.join(todo, ["url", "page_id"], "left_semi")


def hydrate(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Listing items joined to the page behind their link.

    ``items`` needs ``link`` (and may carry ``type``, the kind the listing
    gave); ``pages`` needs ``page_id, url, html``, a ``page_id`` naming one
    snapshot.  Each link is fetched once and the latest snapshot answers it, so neither a link listed many times nor
    a page stored many times multiplies rows.  Both choices are made on narrow
    columns; html moves in the final join only.
    """
    kind = F.min("type") if "type" in items.columns else F.lit(None).cast("string")
    wanted = items.where("link IS NOT NULL").groupBy("link").agg(kind.alias("item_kind"))
    wanted = stored_side(wanted, "wanted")
    # only snapshots of wanted links are compared
    asked = wanted.select(F.col("link").alias("url"))
    latest = latest_pages(pages.join(asked, "url", "left_semi"))
    chosen = wanted.join(latest, wanted["link"] == latest["url"]).select(
        "page_id", "url", "item_kind"
    )
    chosen = stored_side(chosen, "chosen")
    return pages.join(chosen, ["page_id", "url"]).select("page_id", "url", "item_kind", "html")


def _numbered(contents: str = "contents") -> Column:
    """Give each block its position as a field."""
    return F.expr(
        f"transform({contents}, (c, i) -> named_struct('pos', i, 'type', c.type, 'text', c.text, "
        "'image', c.image, 'video', c.video, 'ref', c.ref))"
    )


def canonical_a(articles: DataFrame) -> DataFrame:
    return articles.select(
        F.sha2("link", 256).alias("id"),
        F.lit(fixed.SOURCE_A).alias("source"),
        "link", "kind", "headline", "description", "published_from", "published_at", "updated_at",
        F.expr(
            f"CAST(if(author IS NULL, NULL, named_struct('name', author, 'profile_url', NULL)) AS {AUTHOR_DDL})"
        ).alias("author"),
        "headline_image",
        _numbered().alias("contents"),
        "related",
    )


def canonical_b(articles: DataFrame) -> DataFrame:
    return articles.select(
        F.sha2("link", 256).alias("id"),
        F.lit(fixed.SOURCE_B).alias("source"),
        "link", "kind", "headline", "description",
        F.lit(None).cast("string").alias("published_from"),
        "published_at", "updated_at", "author",
        F.lit(None).cast(IMAGE_DDL).alias("headline_image"),
        _numbered().alias("contents"),
        "related",
    )


def canonical(articles_a: DataFrame, articles_b: DataFrame) -> DataFrame:
    """Both sites' records as one, in the stored column order."""
    both = canonical_a(articles_a).unionByName(canonical_b(articles_b))
    return both.select(*ARTICLE_COLUMNS)


def unnested(df: DataFrame, array: str, *keep: str) -> DataFrame:
    """``keep, pos, item``: one row per element.

    A plain explode makes the optimizer test the array for emptiness first and
    push that test down, so a computed array would be computed twice; the outer
    form does not.
    """
    return df.select(*keep, F.posexplode_outer(array).alias("pos", "item")).where("pos IS NOT NULL")


def contents(articles: DataFrame) -> DataFrame:
    """One row per content block; an article without blocks keeps one row."""
    return articles.select("id", "link", F.explode_outer("contents").alias("block")).select(
        "id", "link", "block.*"
    )


_MEMBER = {
    fixed.SECTION: "text",
    fixed.PARAGRAPH: "text",
    fixed.IMAGE: "image",
    fixed.VIDEO: "video",
    fixed.REFERENCE: "ref",
}


def typed_blocks(blocks: DataFrame, kind: str) -> DataFrame:
    """Blocks of one type with their payload in its own shape."""
    return blocks.where(F.col("type") == kind).select("id", "link", "pos", F.col(_MEMBER[kind]).alias("data"))


def strict_member(kind: str) -> Column:
    """Payload as ``kind``; a block of another type ends the query with an error."""
    member = _MEMBER[kind]
    allowed = [k for k, m in _MEMBER.items() if m == member]
    return F.when(F.col("type").isin(*allowed), F.col(member)).otherwise(
        F.raise_error(F.concat(F.lit(f"block is not of type {kind}: "), F.col("type")))
    )


def typed_payloads(blocks: DataFrame) -> DataFrame:
    """``id, link, pos, type`` and the payload as ``text, image, video, ref``: each
    block read by the strict accessor of its type, in one pass."""
    kinds: dict[str, list[str]] = {}
    for kind, member in _MEMBER.items():
        kinds.setdefault(member, []).append(kind)
    payloads = [
        F.when(F.col("type").isin(*own), strict_member(own[0])).alias(member)
        for member, own in kinds.items()
    ]
    return blocks.where("type IS NOT NULL").select("id", "link", "pos", "type", *payloads)


def block_json(blocks: DataFrame) -> DataFrame:
    """Payload as open JSON text: a string, or an object without absent fields."""
    data = F.coalesce(
        F.to_json("image"),
        F.to_json("video"),
        F.to_json("ref"),
        # A bare string has no to_json; take it out of a one-element array.
        F.expr("substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)"),
    )
    return blocks.where("type IS NOT NULL").select("id", "link", "pos", "type", data.alias("data"))


def block_variant(blocks: DataFrame) -> DataFrame:
    """The same payload as VARIANT, for sinks that hold it; a text becomes one as it is."""
    made = F.coalesce(F.to_json("image"), F.to_json("video"), F.to_json("ref"))
    text = F.coalesce(F.col("text").cast("variant"), F.parse_json(F.lit("null")))
    data = F.when(made.isNotNull(), F.parse_json(made)).otherwise(text)
    return blocks.where("type IS NOT NULL").select("id", "link", "pos", "type", data.alias("data"))


def related_links(articles: DataFrame) -> DataFrame:
    """Page -> page edges in listed order."""
    return unnested(articles, "related", "id", "link").select(
        "id", "link", "pos", "item.title", "item.article_link", "item.thumbnail"
    )


