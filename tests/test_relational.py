"""Frontier, store and record operators on small tables."""

from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pageloom import fixed
from pageloom.operators import articles as art, frontier as fr, sized
from pageloom.plans.article_a import article_a
from pageloom.plans.article_b import article_b
from pageloom.plans.trees import page_trees
from pageloom.schema import ARTICLE, FRONTIER
from pageloom.session import shared_dir
from pageloom.plans.sites import articles_of
from pageloom.sources.channels import channel_pages, channels, with_base_url
from pageloom.sources.pages import PAGE_MIN, read_pages, spread, status_gate
from pageloom.sources.blocks import read_blocks, write_blocks
from pageloom.sources.store import known_links, read_store, write_articles
from tests.test_extract import news, page_b, single

A, B = fixed.SOURCE_A, fixed.SOURCE_B
DAY = datetime(2024, 1, 1)


def frontier(spark, *rows):
    return spark.createDataFrame(rows, FRONTIER)


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_new_links_once_per_source_and_latest(spark):
    items = frontier(
        spark, (A, "x", DAY), (A, "x", None), (A, "y", None), (B, "y", DAY), (A, "known", DAY), (A, None, DAY),
        (A, "x", datetime(2023, 1, 1)),
    )
    known = spark.createDataFrame([("known",), (None,)], "link STRING")
    assert tuples(fr.new_links(items, known)) == sorted([(A, "x", DAY), (A, "y", None), (B, "y", DAY)], key=str)


def test_order_and_take(spark):
    rows = [(A, "b", DAY), (A, "a", DAY), (B, "c", None), (A, "d", datetime(2025, 1, 1))]
    df = frontier(spark, *rows)
    assert [r.link for r in fr.newest_first(df).collect()] == ["d", "a", "b", "c"]
    head, rest = fr.take_next(df, 2)
    assert [r.link for r in head.collect()] == ["d", "a"]
    assert sorted(r.link for r in rest.collect()) == ["b", "c"]
    head, rest = fr.take_next(df, 10)
    assert head.count() == 4 and rest.count() == 0


def test_status_gate_loses_no_row(spark):
    rows = [(1, A, 200, "h"), (2, A, 404, "h"), (3, A, 500, "boom"), (4, B, 404, "h"), (5, B, 302, ""), (6, A, None, "x")]
    pages = spark.createDataFrame(rows, "page_id INT, source STRING, status INT, html STRING")
    ok, out = status_gate(pages)
    assert [r.page_id for r in ok.collect()] == [1]
    assert {r.page_id: r.reason for r in out.collect()} == {
        2: fixed.NOT_FOUND_A,
        3: fixed.FETCH_ERROR_A + "boom",
        4: fixed.FETCH_ERROR_B.replace("{status}", "404"),
        5: fixed.FETCH_ERROR_B.replace("{status}", "302"),
        6: fixed.FETCH_ERROR_A + "x",
    }


def test_channels(spark):
    dim = channels(spark)
    assert dim.count() == 22 and dim.select("name").distinct().count() == 22
    assert dim.select("base_url").distinct().count() == 21
    got = with_base_url(spark.createDataFrame([("Edu",), ("?",)], "name STRING"), "name")
    assert {r.name: r.base_url for r in got.collect()} == {"Edu": "https://www.detik.com/edu/indeks", "?": None}


@pytest.fixture(scope="module")
def records(spark):
    a = spark.createDataFrame(
        [(0, "a0", single("<p>x</p><h2>y</h2>").replace("<head>", "<head>" + news('"headline": "H"')))],
        "page_id BIGINT, url STRING, html STRING",
    )
    b = spark.createDataFrame(
        [(0, "b0", page_b('<p>z "q"</p>')), (1, "b1", page_b(""))], "page_id BIGINT, url STRING, html STRING"
    )
    return art.canonical(article_a(page_trees(a)), article_b(page_trees(b))).cache()


def test_canonical(spark, records):
    assert records.schema.simpleString() == spark.createDataFrame([], ARTICLE).schema.simpleString()
    got = {r.link: r for r in records.collect()}
    assert got["a0"].source == A and got["b0"].source == B and got["a0"].headline == "H"
    assert got["a0"].id == records.where("link = 'a0'").select(F.sha2(F.lit("a0"), 256)).first()[0]
    assert [c.pos for c in got["a0"].contents] == [0, 1]
    kinds = records.select(F.explode("contents.type")).distinct()
    assert {r[0] for r in kinds.collect()} <= {
        fixed.SECTION, fixed.PARAGRAPH, fixed.IMAGE, fixed.VIDEO, fixed.REFERENCE,
    }


def test_contents_and_payloads(records):
    blocks = art.contents(records)
    assert tuples(blocks.select("link", "pos", "text")) == sorted(
        [("a0", 0, "x"), ("a0", 1, "y"), ("b0", 0, 'z "q"'), ("b1", None, None)], key=str
    )
    assert [r.data for r in art.typed_blocks(blocks, fixed.SECTION).collect()] == ["y"]
    data = {(r.link, r.pos): r.data for r in art.block_json(blocks).collect()}
    assert data == {("a0", 0): '"x"', ("a0", 1): '"y"', ("b0", 0): '"z \\"q\\""'}
    assert art.block_variant(blocks).selectExpr("max(CAST(data AS STRING))").first()[0] == 'z "q"'
    whole = blocks.where("type IS NOT NULL")
    assert whole.select(art.strict_member(fixed.PARAGRAPH)).count() == 3
    with pytest.raises(Exception, match="block is not of type image"):
        whole.select(art.strict_member(fixed.IMAGE)).collect()


def test_store_is_idempotent_and_keeps_the_first(spark, records):
    store = shared_dir(spark, "store")
    assert known_links(spark, store).count() == 0
    write_articles(records, store)
    write_articles(records.withColumn("headline", F.lit("later")), store)
    kept = read_store(spark, store)
    assert kept.count() == 3 and kept.where("headline = 'later'").count() == 0
    assert known_links(spark, store).distinct().count() == 3
    assert tuples(kept.select("link", "source", "id")) == tuples(records.select("link", "source", "id"))
    doubled = shared_dir(spark, "store")
    write_articles(records.unionByName(records), doubled)
    assert read_store(spark, doubled).count() == 3


@pytest.mark.parametrize("limit", [sized.BROADCAST_BYTES, -1])
def test_pending_and_hydrate_on_both_join_ways(spark, monkeypatch, limit):
    """Small sides are broadcast; past the limit the other way gives the same."""
    monkeypatch.setattr(sized, "BROADCAST_BYTES", limit)
    pages = spark.createDataFrame(
        [(1, "u", "old", datetime(2024, 1, 1)), (2, "u", "new", datetime(2024, 1, 2)), (3, "v", "h", None), (4, "w", "h", None),
         (5, None, "h", None)],
        "page_id BIGINT, url STRING, html STRING, fetched_at TIMESTAMP",
    )
    known = spark.createDataFrame([("v",)], "link STRING")
    assert sorted(r.page_id for r in art.pending_pages(pages, known).collect()) == [2, 4]
    items = spark.createDataFrame(
        [("u", "Photo"), ("u", "Photo"), ("v", None), ("gone", "Article"), (None, "Article")], "link STRING, type STRING"
    )
    assert tuples(art.hydrate(items, pages)) == [(2, "u", "Photo", "new"), (3, "v", None, "h")]
    undated = pages.drop("fetched_at")
    assert tuples(art.hydrate(items.select("link"), undated)) == [(2, "u", None, "new"), (3, "v", None, "h")]


def test_related_edges(spark):
    body = (
        '<div id="bt_tkt"><article><a dtr-ttl="T" href="1"></a><a href="2"></a></article></div>'
        '<div class="detail__body-text itp_bodycontent"></div>'
    )
    pages = spark.createDataFrame(
        [(0, "u", f'<meta name="articletype" content="singlepage">{body}')], "page_id BIGINT, url STRING, html STRING"
    )
    edges = art.related_links(art.canonical_a(article_a(page_trees(pages))))
    assert tuples(edges.select("pos", "title", "article_link")) == [(0, "T", "1"), (1, None, "2")]


def test_hot_link_shrinks_before_the_shuffle(spark):
    """A link in most rows reaches the reducers as one row per task."""
    n = 40_000
    hot = spark.range(n, numPartitions=8).selectExpr(
        f"'{A}' AS source", "if(id % 3 = 0, concat('l', id), 'hot') AS link", "timestamp_seconds(id) AS published_at"
    )
    got = fr.distinct_links(hot)
    assert got.where("link = 'hot'").selectExpr("unix_seconds(published_at) AS s").first().s == n - 2
    assert got.count() == 1 + len(range(0, n, 3))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan


def test_channel_pages(spark):
    urls = ["https://news.detik.com/indeks", "https://news.detik.com/indeks?page=2", "https://news.detik.com/indeksx"]
    pages = spark.createDataFrame([(u,) for u in urls], "url STRING")
    assert [r.url for r in channel_pages(pages, "News").collect()] == urls[:2]


def test_articles_behind_items(spark):
    pages = spark.createDataFrame([(0, "a0", single("<p>x</p>"))], PAGE_MIN)
    items = spark.createDataFrame([("a0",), ("a0",), ("b",)], "article_link STRING")
    got = articles_of(items, pages, A).collect()
    assert [(r.link, r.contents[0].text) for r in got] == [("a0", "x")]


def test_compressed_text_pages(spark):
    path = shared_dir(spark, "gz")
    spark.createDataFrame([(1, "u", "<p>é</p>")], PAGE_MIN).write.option("compression", "gzip").json(path)
    assert [tuple(r) for r in read_pages(spark, path, fmt="json").collect()] == [(1, "u", "<p>é</p>")]


def test_spread_only_touches_small_inputs(spark):
    few, many = spark.range(100, numPartitions=2), spark.range(100, numPartitions=64)
    assert spread(few, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(many, "id") is many


def test_blocks_are_stored_shredded_and_read_by_path(spark, records):
    path = shared_dir(spark, "blocks")
    blocks = art.block_variant(art.contents(records))
    write_blocks(blocks, path)
    write_blocks(blocks.limit(0), path)
    got = read_blocks(spark, path, {"whole": "$", "url": "$.url"})
    want = blocks.selectExpr("id", "link", "pos", "type", "try_variant_get(data, '$', 'string') AS whole", "try_variant_get(data, '$.url', 'string') AS url")
    assert tuples(got) == tuples(want) and got.count() == 3
    images = spark.range(200).selectExpr(
        "CAST(id AS STRING) AS id", "'l' AS link", "1 AS pos", "'image' AS type",
        "parse_json(concat('{\"url\": \"u', id, '\", \"caption\": \"', repeat('long ', 50), id, '\"}')) AS data",
    )
    many = shared_dir(spark, "many")
    write_blocks(images.coalesce(1), many)
    footer = pq.read_schema(next(f for f in spark.read.parquet(many).inputFiles()).removeprefix("file://"))
    assert "typed_value" in str(footer.field("data").type)  # members have columns of their own
    urls = read_blocks(spark, many, {"url": "$.url"}).select("url")
    assert urls.distinct().count() == 200
    plan = urls._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema:")[1].splitlines()[0]
    assert "caption" not in schema and "variant" not in schema  # the path alone, as a plain member


