"""One query per operator, over the given tables or pages rendered from them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pageloom import fixed
from pageloom.operators import articles as art, frontier as fr, rows, tree as t
from pageloom.operators.queue import Queue
from pageloom.plans import sites
from pageloom.plans.article_b import CONTENT_RULES, is_page_item, parts_b
from pageloom.plans.ingest import store_pages
from pageloom.plans.trees import node_table, page_trees
from pageloom.session import shared_dir, stored
from pageloom.sources.blocks import read_blocks, write_blocks
from pageloom.sources.channels import with_base_url
from pageloom.sources.links import LinkStore
from pageloom.sources.pages import read_pages, spread, status_gate
from pageloom.sources.store import known_links, read_store
from pageloom.streaming.dedup import first_sightings, late_rows, sightings, without_stored
from pageloom.streaming.poll import frontier_rows, poll
from rendered import pages as render

Query = Callable[[SparkSession, str], DataFrame]


# -- inputs -----------------------------------------------------------------------


def raw_pages(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read_pages(spark, f"{sf}/pages.parquet"), "page_id")


def raw_trees(spark: SparkSession, sf: str) -> DataFrame:
    return page_trees(raw_pages(spark, sf))


def _rendered(make) -> Callable[[SparkSession, str], DataFrame]:
    key = "page_id" if make in (render.listing_a, render.listing_b) else "doc_id"
    return lambda spark, sf: make(render.documents(spark, sf, key))


def _trees(make) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: page_trees(_rendered(make)(spark, sf))


trees_a, trees_b = _trees(render.articles_a), _trees(render.articles_b)


def articles_of_a(spark, sf):
    return sites.articles(_rendered(render.articles_a)(spark, sf), fixed.SOURCE_A)


def articles_of_b(spark, sf):
    return sites.articles(_rendered(render.articles_b)(spark, sf), fixed.SOURCE_B)


def items_a(spark, sf):
    return sites.channel_items(_rendered(render.listing_a)(spark, sf), fixed.CHANNELS[0][0])


def items_b(spark, sf):
    return sites.index_items(_rendered(render.listing_b)(spark, sf))


def listed(spark, sf):
    return fr.index_union(items_a(spark, sf), items_b(spark, sf))


def known(spark, sf):
    """Links of the labelled documents count as stored."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return labels.selectExpr(f"{render.LINK_A} AS link").unionByName(
        labels.selectExpr(f"{render.LINK_B} AS link")
    )


def canonical(spark, sf):
    return art.canonical(articles_of_a(spark, sf), articles_of_b(spark, sf))


# -- shapes of results --------------------------------------------------------------


def seconds(name: str, alias: str) -> Column:
    return F.unix_seconds(name).alias(alias)


def _pos(name: str = "pos") -> Column:
    return F.col(name).cast("bigint").alias("pos")


def _blocks(articles: DataFrame) -> DataFrame:
    """``page_id, kind, pos`` and the members of every content block."""
    return art.unnested(articles, "contents", "page_id", "kind").select(
        "page_id", "kind", _pos(), "item.*"
    )


def _block_query(articles, where: str, *columns: str) -> Query:
    return lambda spark, sf: _blocks(articles(spark, sf)).where(where).selectExpr(
        "page_id", "pos", *columns
    )


_IMAGE = ("image.url AS url", "image.alt AS alt", "image.title AS title", "image.caption AS caption")
_SIZED = ("image.url AS url", "image.alt AS alt", "image.caption AS caption", "image.width AS width",
          "image.height AS height")

_DIGEST = (
    "concat_ws('|', {c}.type, coalesce({c}.text, ''), coalesce({c}.image.url, ''), coalesce({c}.image.title, ''), "
    "coalesce({c}.image.caption, ''), coalesce({c}.image.alt, ''), coalesce(CAST({c}.image.width AS STRING), ''), "
    "coalesce(CAST({c}.image.height AS STRING), ''), coalesce({c}.video.url, ''), coalesce({c}.video.embedded_url, ''), "
    "coalesce({c}.video.title, ''), coalesce({c}.video.description, ''), coalesce(CAST({c}.video.duration AS STRING), ''), "
    "coalesce({c}.video.thumbnail, ''), coalesce({c}.ref.headline, ''), coalesce({c}.ref.article_link, ''))"
)
_CONTENTS = f"array_join(transform(contents, c -> {_DIGEST.format(c='c')}), '\\n') AS contents"


def _record(articles, *columns: str) -> Query:
    return lambda spark, sf: articles(spark, sf).selectExpr(
        "page_id", "link", "kind", "headline", "description", *columns,
        "unix_seconds(published_at) AS published_s", "unix_seconds(updated_at) AS updated_s",
        "CAST(size(contents) AS BIGINT) AS n_contents", _CONTENTS,
        "CAST(size(related) AS BIGINT) AS n_related",
    )


def _columns(articles, *columns: str, where: str = "true") -> Query:
    return lambda spark, sf: articles(spark, sf).where(where).selectExpr("page_id", *columns)


# -- sources and sinks ----------------------------------------------------------------


def src_pages(spark, sf):
    return read_pages(spark, f"{sf}/pages.parquet").select(
        "page_id", "url", F.length("html").cast("bigint").alias("html_chars"), F.md5("html").alias("html_md5")
    )


def src_status_gate(spark, sf):
    """All documents as fetched pages of both sites, from both halves of the gate.

    The label plays the HTTP status; a document without a label has none, as a
    page whose fetch never ended.
    """
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text AS html")
    labels = spark.read.parquet(f"{sf}/labels.parquet").selectExpr(
        "doc_id", "CASE quality WHEN 0 THEN IF(toxic = 1, 404, 500) ELSE 200 END AS status"
    )
    fetched = docs.join(labels, "doc_id", "left")
    both = fetched.withColumn("source", F.explode(F.array(F.lit(fixed.SOURCE_A), F.lit(fixed.SOURCE_B))))
    taken, left = status_gate(both)
    return taken.withColumn("reason", F.lit(None).cast("string")).unionByName(left).select(
        F.col("doc_id").alias("page_id"), "source", "status", F.col("reason").isNull().alias("accepted"), "reason",
    )


def src_channels(spark, sf):
    names = F.array(*[F.lit(n) for n, _ in fixed.CHANNELS])
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.get(names, (F.col("n_chars") % len(fixed.CHANNELS)).cast("int")).alias("name"), "n_chars"
    )
    return with_base_url(docs, "name").groupBy("name", "base_url").agg(
        F.count("*").alias("n_documents"), F.sum("n_chars").alias("n_chars")
    )


def src_known_links(spark, sf):
    store = shared_dir(spark, "known")
    known(spark, sf).write.parquet(store)
    return known_links(spark, store, "link STRING")


def _canonical_row(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "source", "link", "kind", "headline", seconds("published_at", "published_s"),
        F.col("author.name").alias("author_name"),
        F.size("contents").cast("bigint").alias("n_contents"),
        F.size("related").cast("bigint").alias("n_related"),
    )


def snk_articles(spark, sf):
    """Stored twice, read back: the second round must add nothing."""
    store = shared_dir(spark, "articles")
    for _ in range(2):
        pages = {
            fixed.SOURCE_A: _rendered(render.articles_a)(spark, sf),
            fixed.SOURCE_B: _rendered(render.articles_b)(spark, sf),
        }
        store_pages(spark, store, pages)
    return _canonical_row(read_store(spark, store))


# -- tree --------------------------------------------------------------------------------


def htm_nodes(spark, sf):
    nodes = node_table(page_trees(raw_pages(spark, sf), "page_id"))

    def count(cond: str, name: str) -> Column:
        return F.count_if(F.expr(cond)).alias(name)

    return nodes.groupBy("page_id").agg(
        count("tag = 'p'", "n_p"), count("tag = 'a'", "n_a"), count("tag = 'li'", "n_li"),
        count("kind = 'comment'", "n_comments"), count("tag = 'b'", "n_b"),
    )


def _on_pages(*columns: str) -> Query:
    return lambda spark, sf: raw_trees(spark, sf).selectExpr("page_id", *columns)


def _size(array: str) -> str:
    return f"CAST(size({array}) AS BIGINT)"


_TITLE = t.find_first("nodes", t.match("title"))
_LINK = t.find_first("nodes", t.match("a"))
_H1 = t.find_first("nodes", t.match("h1"))


def htm_find_all(spark, sf):
    links = t.find_all("nodes", lambda n: f"{t.match('a')(n)} AND {t.has_attr(n, 'href')}")
    return raw_trees(spark, sf).select("page_id", F.posexplode(F.expr(links)).alias("at", "a")).selectExpr(
        "page_id", "CAST(at AS BIGINT) AS k", f"{t.attr('a', 'href')} AS href"
    )


def htm_outermost(spark, sf):
    """Listing items counted as outermost hits: items nested in items do not count."""
    items = t.outermost("nodes", t.match(attrs={"class": fixed.B_LIST_ITEM}))
    trees = page_trees(_rendered(render.listing_b)(spark, sf), "page_id")
    return trees.selectExpr("page_id", f"{_size(items)} AS n_items")


def htm_subtree(spark, sf):
    """Paragraphs anywhere below the page item; none where a page has no item."""
    item = t.subtree("nodes", t.find_first("nodes", is_page_item))
    return trees_b(spark, sf).selectExpr(
        "page_id", f"greatest(coalesce({_size(t.find_all(item, t.match('p')))}, 0L), 0L) AS n_paragraphs"
    )


def _listing_nodes(spark, sf):
    return node_table(page_trees(_rendered(render.listing_b)(spark, sf), "page_id"))


def _is(tag: str) -> Column:
    return (F.col("kind") == "element") & (F.col("tag") == tag)


def htm_outermost_rows(spark, sf):
    """``htm_outermost`` on the node table."""
    nodes = _listing_nodes(spark, sf).select("page_id", "pre", "fin", "kind", "attrs")
    item = (F.col("kind") == "element") & (F.col("attrs")["class"] == fixed.B_LIST_ITEM)
    found = rows.outermost(nodes.where(item)).groupBy("page_id").agg(F.count("*").alias("n_items"))
    pages = nodes.where("pre = 0").select("page_id")
    return pages.join(found, "page_id", "left").select("page_id", F.coalesce("n_items", F.lit(0)).alias("n_items"))


def htm_subtree_rows(spark, sf):
    """Links and articles inside listing items, on the node table: once each, and the
    articles of every item, where those of nested items count for both."""
    nodes = _listing_nodes(spark, sf).select("page_id", "pre", "fin", "kind", "tag", "attrs")
    nodes = stored(nodes, "nodes")  # several uses of one parse
    items = nodes.where((F.col("kind") == "element") & (F.col("attrs")["class"] == fixed.B_LIST_ITEM))
    inside = rows.within(nodes.where(_is("a") | _is("article")), items).groupBy("page_id").agg(
        F.count_if(F.col("tag") == "a").alias("n_links"), F.count_if(F.col("tag") == "article").alias("n_articles")
    )
    each = rows.subtrees(nodes.where(_is("article")), items).groupBy("page_id").agg(F.count("*").alias("n_pairs"))
    return inside.join(each, "page_id")


def htm_outermost_until(spark, sf):
    """Listing items up to the first that is a video: the scan skips the inside of each
    item and gives up there."""
    is_item = t.match(attrs={"class": fixed.B_LIST_ITEM})
    items = t.outermost_until("nodes", is_item, t.match(attrs={"data-type": "Video"}))
    trees = page_trees(_rendered(render.listing_b)(spark, sf), "page_id")
    return trees.selectExpr("page_id", f"{_size(items)} AS n_items")


def htm_rule_dispatch(spark, sf):
    """Every claimed node of every page with its place and the rule that claimed it: by
    the rules of the page, and inside its main part by those of blocks."""

    def hits(level: str, array: str) -> str:
        made = f"transform({array}, (h, i) -> named_struct('level', '{level}', 'at', CAST(i AS BIGINT), 'rule', h.rule))"
        return f"coalesce({made}, array())"

    both = f"concat({hits('page', 'top')}, {hits('block', 'claimed')})"
    return parts_b(trees_b(spark, sf)).select("page_id", F.inline(F.expr(both)))


def htm_outer_html(spark, sf):
    link = t.find_all(
        "nodes", lambda n: f"{t.match('a')(n)} AND startswith({t.attr(n, 'href')}, 'https://x.example/')"
    )
    rendered = f"transform({link}, a -> struct({t.attr('a', 'href')} AS href, {t.outer_html('nodes', 'a')} AS html))"
    return (
        trees_a(spark, sf)
        .select("page_id", F.explode(F.expr(rendered)).alias("x"))
        .selectExpr(
            "page_id", r"CAST(regexp_extract(x.href, '/(\\d+)\\?', 1) AS BIGINT) AS line", "x.html AS html"
        )
    )


# -- listings ----------------------------------------------------------------------------


def idx_detik(spark, sf):
    return items_a(spark, sf).select(
        "page_id", _pos(), "article_link", "image_url", "title", "subtitle",
        seconds("published_at", "published_s"),
    )


def idx_liputan6(spark, sf):
    return items_b(spark, sf).select(
        "page_id", _pos(), "type", "title", "link", F.col("thumbnail.url").alias("thumb_url"),
        F.col("thumbnail.width").alias("thumb_w"), F.col("thumbnail.height").alias("thumb_h"),
        F.col("thumbnail.alt").alias("thumb_alt"), "summary", seconds("published_at", "published_s"),
    )


# -- articles --------------------------------------------------------------------------


def dtk_related(spark, sf):
    return art.unnested(articles_of_a(spark, sf), "related", "page_id").select(
        "page_id", _pos(), "item.title", "item.article_link"
    )


def lpt_related(spark, sf):
    return art.unnested(articles_of_b(spark, sf), "related", "page_id").select(
        "page_id", _pos(), "item.title", "item.article_link", F.col("item.thumbnail.url").alias("thumb_url"),
        F.col("item.thumbnail.width").alias("thumb_w"), F.col("item.thumbnail.height").alias("thumb_h"),
    )


def lpt_main(spark, sf):
    return parts_b(trees_b(spark, sf)).select("page_id", F.explode("inner.rule").alias("part"))


def lpt_content(spark, sf):
    inside = t.dispatch(t.subtree("nodes", "c"), CONTENT_RULES)
    parts = f"flatten(transform({t.nodes_of('inner', 'content')}, c -> {inside}))"
    return parts_b(trees_b(spark, sf)).select("page_id", F.explode(F.expr(f"transform({parts}, p -> p.rule)")).alias("part"))


def lpt_body(spark, sf):
    """Blocks of the body: those not made from the top image."""
    body = "CAST(size(contents) - if(get(contents, 0).image.url LIKE 'https://t.%', 1, 0) AS BIGINT)"
    return articles_of_b(spark, sf).where("kind = 'Article'").selectExpr("page_id", f"{body} AS n_blocks")


def _claimed_count(where: str, name: str) -> Query:
    return lambda spark, sf: parts_b(trees_b(spark, sf)).where("kind = 'Article'").selectExpr(
        "page_id", f"CAST(size(filter(claimed, h -> {where})) AS BIGINT) AS {name}"
    )


# -- relational ----------------------------------------------------------------------------


def _frontier_row(df: DataFrame, *more: Column) -> DataFrame:
    return df.select("source", "link", seconds("published_at", "published_s"), *more)


def rel_index_union(spark, sf):
    return _frontier_row(listed(spark, sf))


def rel_new_links(spark, sf):
    return _frontier_row(fr.new_links(listed(spark, sf), known(spark, sf)))


def rel_frontier_sort(spark, sf):
    """Newest first, with the place of each row in the order.

    Places come from the sorted partitions: rows are numbered inside each range
    partition and shifted by the sizes of the partitions before it.
    """
    ordered = fr.newest_first(listed(spark, sf)).withColumn("part", F.spark_partition_id()).withColumn(
        "row", F.monotonically_increasing_id()
    )
    ordered = stored(ordered, "sorted")
    # One row per partition: small whatever the table's size.
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")
    )
    # A row id counts up from 0 inside its partition, in its lower 33 bits.
    inside = F.col("row").bitwiseAND((1 << 33) - 1)
    return _frontier_row(
        ordered.join(F.broadcast(before), "part").withColumn("place", F.col("before") + inside + 1), F.col("place")
    )


def rel_frontier_take(spark, sf):
    """Top of a stored queue, and what stays in it."""
    queue = stored(fr.new_links(listed(spark, sf), known(spark, sf)), "queue")
    head, rest = fr.take_next(queue, 100)
    return _frontier_row(head, F.lit("next").alias("state")).unionByName(
        _frontier_row(rest, F.lit("rest").alias("state"))
    )


def rel_new_links_store(spark, sf):
    """Against a store in hash buckets behind its filters, filled in two appends."""
    store, there = LinkStore(spark, shared_dir(spark, "links")), known(spark, sf)
    for part in range(2):
        rows_ = there.where(F.pmod(F.crc32(F.col("link").cast("binary")), F.lit(2)) == part)
        store.add(rows_.selectExpr("'-' AS source", "link", "CAST(NULL AS TIMESTAMP) AS published_at"))
    return _frontier_row(store.unseen(listed(spark, sf)))


def rel_queue_rounds(spark, sf):
    """Three rounds: a third of the links is added, then the next 100 are taken."""
    items = stored(listed(spark, sf), "listed")
    turn = F.coalesce(F.pmod(F.expr("unix_seconds(published_at) DIV 60"), F.lit(3)), F.lit(0))
    queue, out = Queue(spark, shared_dir(spark, "queue")), []
    for number in range(3):
        queue.add(items.where(turn == number))
        out.append(_frontier_row(queue.take(100), F.lit(number + 1).alias("taken")))
    out.append(_frontier_row(queue.rest(), F.lit(0).alias("taken")))
    return reduce(DataFrame.unionByName, out)


def rel_hydrate(spark, sf):
    pages = _rendered(render.articles_b)(spark, sf)
    found = sites.articles_of(items_b(spark, sf), pages, fixed.SOURCE_B)
    return found.select("page_id", "link", "kind", "headline")


def _flat_blocks(spark, sf):
    return art.contents(canonical(spark, sf))


def rel_contents(spark, sf):
    block = _DIGEST.replace("{c}.", "")
    return _flat_blocks(spark, sf).selectExpr(
        "id", "CAST(pos AS BIGINT) AS pos", f"if(type IS NULL, NULL, {block}) AS block"
    )


def rel_typed_block(spark, sf):
    """Every block through the strict accessor of its own type."""
    return art.typed_payloads(_flat_blocks(spark, sf)).selectExpr(
        "id", "CAST(pos AS BIGINT) AS pos", "type", "text", "image.url AS img_url", "image.title AS img_title",
        "image.caption AS img_caption", "image.alt AS img_alt", "image.width AS img_w", "image.height AS img_h",
        "video.url AS vid_url", "video.embedded_url AS vid_embed", "video.title AS vid_title",
        "ref.headline AS ref_headline", "ref.article_link AS ref_link",
    )


def rel_block_json(spark, sf):
    """The JSON payload, read back by path."""
    blocks = art.block_variant(_flat_blocks(spark, sf))

    def path(p: str, to: str = "string") -> str:
        return f"try_variant_get(data, '{p}', '{to}')"

    first = ", ".join(
        f"if(schema_of_variant(data) = 'STRING', {path('$')}, NULL)" if p == "$" else path(p)
        for p in ("$", "$.headline", "$.url", "$.embedded_url")
    )
    return blocks.selectExpr(
        "id", "CAST(pos AS BIGINT) AS pos", "type", f"coalesce({first}) AS first_value",
        f"{path('$.article_link')} AS article_link", f"{path('$.width', 'int')} AS width",
    )


def rel_block_store(spark, sf):
    """Payloads stored as shredded VARIANT; two members read back by path."""
    store = shared_dir(spark, "blocks")
    write_blocks(art.block_variant(_flat_blocks(spark, sf)), store)
    got = read_blocks(spark, store, {"article_link": "$.article_link", "headline": "$.headline"})
    return got.select("id", _pos(), "type", "article_link", "headline")


def rel_related(spark, sf):
    return art.related_links(canonical(spark, sf)).select(
        "id", _pos(), "title", "article_link", F.col("thumbnail.url").alias("thumb_url")
    )


# -- streaming --------------------------------------------------------------------------------


def str_poll(spark, sf):
    """Two rounds of listing pages, the second listing everything of the first again."""
    drops, store, checkpoint = (shared_dir(spark, p) for p in ("drops", "frontier", "poll"))
    docs = render.documents(spark, sf, "page_id")
    labelled = docs.join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id"), "doc_id", "left_semi")
    for shown in (labelled, docs):
        for make, source in ((render.listing_a, fixed.SOURCE_A), (render.listing_b, fixed.SOURCE_B)):
            make(shown).select("page_id", F.lit(source).alias("source"), "url", "html").write.mode(
                "append"
            ).parquet(drops)
        poll(spark, drops, store, checkpoint, parts=spark.sparkContext.defaultParallelism).awaitTermination()
    return _frontier_row(frontier_rows(spark, store))


def str_dedup(spark, sf):
    """First sightings of links in the event stream (each event shows a user's page)."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    seen = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
        .select(
            F.lit(fixed.SOURCE_A).alias("source"),
            F.concat(F.lit("https://news.detik.com/berita/d-"), F.col("user_id").cast("string")).alias("link"),
            F.col("ts").cast("timestamp").alias("seen_at"),
        )
    )
    out, checkpoint = shared_dir(spark, "sightings"), shared_dir(spark, "dedup")
    query = (
        first_sightings(seen, "31 days").writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    if late := late_rows(query):
        raise ValueError(f"{late} sightings came later than the delay")
    return spark.read.schema("source STRING, link STRING, seen_at TIMESTAMP").parquet(out).select("source", "link")


def _link_of_user(name: str = "link") -> Column:
    return F.concat(F.lit("https://news.detik.com/berita/d-"), F.col("user_id").cast("string")).alias(name)


def str_sightings(spark, sf):
    """Events in two drops, the second out of time: first sightings, and late rows as rows."""
    shown, out, checkpoint = (shared_dir(spark, p) for p in ("shown", "sightings", "late"))
    events = spark.read.parquet(f"{sf}/events.parquet").select(
        F.lit(fixed.SOURCE_A).alias("source"), _link_of_user(), F.col("ts").cast("timestamp").alias("seen_at"),
        (F.col("event_id") % 3 == 0).alias("last"),
    )
    schema = "source STRING, link STRING, seen_at TIMESTAMP"
    for part in ("NOT last", "last"):
        events.where(part).drop("last").write.mode("append").parquet(shown)
        found = sightings(spark.readStream.schema(schema).parquet(shown), timedelta(days=36_500), "1 day")
        found.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(
            availableNow=True
        ).start(out).awaitTermination()
    return spark.read.schema(f"{schema}, late BOOLEAN").parquet(out).select(
        "link", F.unix_millis("seen_at").alias("seen_ms"), "late"
    )


def str_without_stored(spark, sf):
    """Links of the event stream that are not stored, each as often as it is shown: a join
    of the stream with a table.  Links of the labelled documents count as stored."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    there = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("user_id")).select(_link_of_user())
    out, checkpoint = shared_dir(spark, "fresh"), shared_dir(spark, "without")
    without_stored(stream.select("event_id", _link_of_user()), there).writeStream.format("parquet").option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("link STRING, event_id BIGINT").parquet(out).select("event_id", "link")


def all_queries() -> dict[str, Query]:
    a, b = articles_of_a, articles_of_b
    return {
        "src_pages": src_pages,
        "src_status_gate": src_status_gate,
        "src_channels": src_channels,
        "src_known_links": src_known_links,
        "snk_articles": snk_articles,
        "htm_nodes": htm_nodes,
        "htm_match": _on_pages(f"{_size(t.find_all('nodes', t.match('div', {'class': 'ad'})))} AS n_ads"),
        "htm_find_first": _on_pages(
            "url", f"{t.text('nodes', _TITLE)} AS title", f"{t.attr(_LINK, 'href')} AS first_link"
        ),
        "htm_find_all": htm_find_all,
        "htm_walk_until": _on_pages(
            _size(t.find_all(t.walk_until("nodes", t.match("h1")), t.match("a"))) + " AS links_before_h1"
        ),
        "htm_outermost": htm_outermost,
        "htm_subtree": htm_subtree,
        "htm_outermost_rows": htm_outermost_rows,
        "htm_subtree_rows": htm_subtree_rows,
        "htm_outermost_until": htm_outermost_until,
        "htm_rule_dispatch": htm_rule_dispatch,
        "htm_text": _on_pages(f"{t.text('nodes', _H1)} AS heading"),
        "htm_outer_html": htm_outer_html,
        "htm_attr": _on_pages(f"{t.attr(t.find_first('nodes', t.match('html')), 'lang')} AS lang"),
        "idx_detik": idx_detik,
        "idx_liputan6": idx_liputan6,
        "dtk_kind": _columns(a, "kind"),
        "dtk_author": _columns(a, "author"),
        "dtk_duration": _columns(a, "duration"),
        "dtk_jsonld": _columns(
            a, "description", "unix_seconds(published_at) AS published_s", "unix_seconds(updated_at) AS updated_s"
        ),
        "dtk_headline_image": _columns(
            a, "headline_image.url", "headline_image.title", "headline_image.alt", "headline_image.caption",
            where="headline_image IS NOT NULL",
        ),
        "dtk_main": _block_query(a, "kind = 'singlepage'", "type"),
        "dtk_published_from": _columns(a, "published_from"),
        "dtk_paragraph": _block_query(a, f"type = '{fixed.PARAGRAPH}'", "text"),
        "dtk_embedded_video": _block_query(
            a, "type = 'video' AND kind != 'video'", "video.embedded_url AS embedded_url"
        ),
        "dtk_section": _block_query(a, f"type = '{fixed.SECTION}'", "text"),
        "dtk_reference": _block_query(
            a, f"type = '{fixed.REFERENCE}'", "ref.headline AS headline", "ref.article_link AS article_link"
        ),
        "dtk_image": _block_query(a, "type = 'image' AND kind = 'singlepage'", *_IMAGE),
        "dtk_photo": _block_query(a, "kind = 'multiplefoto'", "type"),
        "dtk_photo_headline": _columns(a, "headline", where="kind = 'multiplefoto'"),
        "dtk_photo_slider": _block_query(a, "type = 'image' AND kind = 'multiplefoto'", *_IMAGE),
        "dtk_video": _block_query(
            a, "kind = 'video'", "type", "text", "video.url AS url", "video.embedded_url AS embedded_url",
            "video.title AS title", "video.description AS description", "video.duration AS duration",
            "video.thumbnail AS thumbnail",
        ),
        "dtk_related": dtk_related,
        "dtk_article": _record(a, "author", "published_from"),
        "lpt_headline": _columns(b, "headline"),
        "lpt_description": _columns(b, "description"),
        "lpt_published_at": _columns(b, "unix_seconds(published_at) AS published_s"),
        "lpt_updated_at": _columns(b, "unix_seconds(updated_at) AS updated_s"),
        "lpt_kind": _columns(b, "kind"),
        "lpt_main": lpt_main,
        "lpt_content": lpt_content,
        "lpt_top_image": _block_query(
            b, "type = 'image' AND image.url LIKE 'https://t.%'", "image.url AS url", "image.caption AS caption",
            "image.width AS width", "image.height AS height",
        ),
        "lpt_body": lpt_body,
        "lpt_page_item": _claimed_count("h.rule != 'top'", "n_claimed"),
        "lpt_skip_ads": _claimed_count("h.rule = 'skip'", "n_skipped"),
        "lpt_image": _block_query(
            b, "type = 'image' AND kind = 'Article' AND image.url LIKE 'https://i.%'", *_SIZED
        ),
        "lpt_section": _block_query(b, f"type = '{fixed.SECTION}'", "text"),
        "lpt_paragraph": _block_query(b, f"type = '{fixed.PARAGRAPH}'", "text"),
        "lpt_related": lpt_related,
        "lpt_photo_slider": _block_query(
            b, "kind = 'Photo'", "image.url AS url", "image.title AS title", "image.caption AS caption",
            "image.width AS width", "image.height AS height",
        ),
        "lpt_author": _columns(b, "author.name AS author_name", "author.profile_url AS author_url"),
        "lpt_article": _record(b, "author.name AS author_name", "author.profile_url AS author_url"),
        "rel_index_union": rel_index_union,
        "rel_new_links": rel_new_links,
        "rel_frontier_sort": rel_frontier_sort,
        "rel_frontier_take": rel_frontier_take,
        "rel_new_links_store": rel_new_links_store,
        "rel_queue_rounds": rel_queue_rounds,
        "rel_hydrate": rel_hydrate,
        "rel_canonical": lambda spark, sf: _canonical_row(canonical(spark, sf)),
        "rel_contents": rel_contents,
        "rel_typed_block": rel_typed_block,
        "rel_block_json": rel_block_json,
        "rel_block_store": rel_block_store,
        "rel_related": rel_related,
        "str_poll": str_poll,
        "str_dedup": str_dedup,
        "str_sightings": str_sightings,
        "str_without_stored": str_without_stored,
    }
