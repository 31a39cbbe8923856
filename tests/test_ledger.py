"""Batches and their ledger: a key is stored once, whoever writes and whatever dies."""

from pageloom import fixed
from pageloom.plans.ingest import store_pages
from pageloom.schema import PAGE_MIN
from pageloom.session import shared_dir
from pageloom.sources import files, store as st
from pageloom.sources.ledger import Ledger
from tests.test_extract import single

SCHEMA = "link STRING, by STRING"


def ledger(spark):
    return Ledger(spark, shared_dir(spark, "ledger"), SCHEMA)


def rows(spark, by, *links):
    return spark.createDataFrame([(x, by) for x in links], SCHEMA)


def fresh(new):
    return lambda there: new.join(there.select("link"), "link", "left_anti").select("link", "by")


def kept(book):
    return sorted((r.link, r.by) for r in book.rows().collect())


def test_a_batch_counts_once(spark):
    book = ledger(spark)
    assert kept(book) == [] and book.add(fresh(rows(spark, "x", "a", "b")), "1")
    assert not book.add(fresh(rows(spark, "again", "a", "b", "c")), "1")
    assert book.add(fresh(rows(spark, "y", "b", "c")), "2")
    assert kept(book) == [("a", "x"), ("b", "x"), ("c", "y")]


def test_interleaved_writers(spark):
    """Both look at the same ledger; the slower finds its number taken, several times."""
    book = ledger(spark)
    book.add(fresh(rows(spark, "old", "a")))

    def slow(there):
        other = Ledger(spark, book.path, SCHEMA)
        other.add(fresh(rows(spark, "fast", "b", "x")))
        other.add(fresh(rows(spark, "fast", "c")))
        return fresh(rows(spark, "slow", "a", "b", "c", "d"))(there)

    assert book.add(slow, "slow")
    assert kept(book) == [("a", "old"), ("b", "fast"), ("c", "fast"), ("d", "slow"), ("x", "fast")]
    assert len(book.lines()) == 4


def test_a_killed_batch_leaves_nothing(spark):
    book = ledger(spark)
    book.write(rows(spark, "dead", "a", "b"), "half")  # written, never listed
    assert kept(book) == []
    assert book.add(fresh(rows(spark, "next", "a", "b")), "1")
    assert kept(book) == [("a", "next"), ("b", "next")]


def test_the_same_batch_by_two_writers(spark):
    book = ledger(spark)

    def twice(there):
        assert Ledger(spark, book.path, SCHEMA).add(fresh(rows(spark, "first", "a")), "1")
        return fresh(rows(spark, "second", "a", "b"))(there)

    assert not book.add(twice, "1")
    assert kept(book) == [("a", "first")]


def test_pages_are_chosen_before_the_parse(spark):
    path = shared_dir(spark, "articles")
    pages = [(0, "a0", single("<p>x</p>")), (1, "a0", single("<p>later</p>")), (2, "a1", single("<p>y</p>")), (3, None, "")]
    frame = spark.createDataFrame(pages, PAGE_MIN)
    assert store_pages(spark, path, {fixed.SOURCE_A: frame}, "1")
    assert not store_pages(spark, path, {fixed.SOURCE_A: frame}, "1")
    assert store_pages(spark, path, {fixed.SOURCE_A: frame, fixed.SOURCE_B: frame.where("page_id = 9")}, "2")
    got = {r.link: r.contents[0].text for r in st.read_store(spark, path).collect()}
    assert got == {"a0": "later", "a1": "y"} and st.known_links(spark, path).count() == 2
    assert len(files.names(spark, f"{path}/data")) == 2
