"""Streams give what a batch gives, and a replay adds nothing."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pageloom import fixed
from pageloom.operators.frontier import new_links
from pageloom.session import shared_dir
from pageloom.streaming.dedup import first_sightings, late_rows, without_stored
from pageloom.streaming.poll import LISTING_PAGE, append_new, frontier_rows, listed, poll, unseen
from tests.test_extract import LINK, item, root


def listing(*links):
    return root(*[item(LINK.replace('href="l"', f'href="{x}"')) for x in links])


def drop(spark, path, *pages):
    rows = [(i, fixed.SOURCE_A, f"u{i}", html) for i, html in enumerate(pages)]
    spark.createDataFrame(rows, LISTING_PAGE).coalesce(1).write.mode("append").parquet(path)


def links(spark, store):
    return sorted(r.link for r in frontier_rows(spark, store).collect())


def test_poll_rounds_and_replay(spark):
    pages, store, checkpoint = (shared_dir(spark, n) for n in ("pages", "store", "cp"))
    drop(spark, pages, listing("a", "b"), listing("b", "c"))
    poll(spark, pages, store, checkpoint).awaitTermination()
    assert links(spark, store) == ["a", "b", "c"]
    drop(spark, pages, listing("c", "d"), "<p>no listing</p>")
    poll(spark, pages, store, checkpoint).awaitTermination()
    assert links(spark, store) == ["a", "b", "c", "d"]
    # nothing new, then everything again from scratch
    poll(spark, pages, store, checkpoint).awaitTermination()
    poll(spark, pages, store, shared_dir(spark, "cp"), max_files=1).awaitTermination()
    assert links(spark, store) == ["a", "b", "c", "d"]
    batch = spark.read.schema(LISTING_PAGE).parquet(pages)
    whole = new_links(listed(batch), spark.createDataFrame([], "link STRING"))
    assert sorted(r.link for r in whole.collect()) == links(spark, store)


@pytest.mark.parametrize("seeded", [False, True])
def test_unseen_asks_python_for_seeds_alone(spark, seeded):
    """Every source of a link's first trigger, with its latest time; a link that was seen
    needs no Python state call, and none does without seeds."""
    items, out, checkpoint = (shared_dir(spark, n) for n in ("items", "out", "cp"))
    schema, start = "source STRING, link STRING, published_at TIMESTAMP", datetime(2024, 1, 1)
    later = start + timedelta(hours=1)
    known = spark.createDataFrame([("old",), ("old",), (None,)], "link STRING") if seeded else None

    def run(*rows):
        spark.createDataFrame(rows, schema).repartition(4).write.mode("append").parquet(items)
        fresh = unseen(spark.readStream.schema(schema).parquet(items), known)
        plan = fresh._jdf.queryExecution().analyzed().toString()
        assert "Deduplicate" in plan and ("TransformWithState" in plan) == seeded
        fresh.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(
            out
        ).awaitTermination()
        got = [tuple(r) for r in spark.read.schema(schema).parquet(out).collect()]
        assert len(set(got)) == len(got)
        return set(got)

    first = {("a", "x", later), ("b", "x", None), (None, "y", start)}
    rows = [("a", "x", start), ("a", "x", later), ("a", "x", None), ("b", "x", None), (None, "y", start), ("a", None, start)]
    assert run(*rows) == first
    old = set() if seeded else {("a", "old", later)}
    assert run(("b", "x", later), ("c", "x", start), ("a", "old", later), ("a", "z", start)) == first | old | {("a", "z", start)}


def test_append_new_twice_is_the_same(spark):
    store = shared_dir(spark, "store")
    batch = spark.createDataFrame([(0, fixed.SOURCE_A, "u", listing("a", "b"))], LISTING_PAGE)
    append_new(batch, store)
    append_new(batch, store)
    assert links(spark, store) == ["a", "b"]


def test_first_sightings(spark):
    items, out, checkpoint = (shared_dir(spark, n) for n in ("items", "out", "cp"))
    start = datetime(2024, 1, 1)
    rows = [("s", f"l{i % 5}", start + timedelta(minutes=i)) for i in range(20)]
    schema = "source STRING, link STRING, seen_at TIMESTAMP"

    def run():
        stream = spark.readStream.schema(schema).parquet(items)
        stored = spark.createDataFrame([("l4",)], "link STRING")
        (
            without_stored(first_sightings(stream, "1 day"), stored).writeStream.format("parquet")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
        )
        return sorted(r.link for r in spark.read.schema(schema).parquet(out).collect())

    spark.createDataFrame(rows, schema).write.mode("append").parquet(items)
    assert run() == ["l0", "l1", "l2", "l3"]
    spark.createDataFrame(rows[:6] + [("s", "new", start)], schema).write.mode("append").parquet(items)
    assert run() == ["l0", "l1", "l2", "l3", "new"]


def test_stream_items_need_no_collect(spark):
    """The poll's batch function works lazily on whatever DataFrame it gets."""
    batch = spark.createDataFrame([(0, fixed.SOURCE_B, "u", "<p>")], LISTING_PAGE)
    assert listed(batch).agg(F.count("*")).first()[0] == 0


def test_late_rows_are_counted(spark):
    """Files out of time order: what the watermark leaves out is reported."""
    items, out, checkpoint = (shared_dir(spark, n) for n in ("items", "out", "cp"))
    schema = "source STRING, link STRING, seen_at TIMESTAMP"
    now = datetime(2024, 3, 1)
    found, late = set(), 0
    for link, at in (("new", now), ("newer", now + timedelta(minutes=1)), ("old", now - timedelta(days=9)),
                     ("late but in time", now - timedelta(hours=5))):
        spark.createDataFrame([("s", link, at)], schema).coalesce(1).write.mode("append").parquet(items)
        query = (
            first_sightings(spark.readStream.schema(schema).parquet(items), "1 day").writeStream.format("parquet")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        )
        query.awaitTermination()
        late += late_rows(query)
    found = {r.link for r in spark.read.schema(schema).parquet(out).collect()}
    assert found == {"new", "newer", "late but in time"} and late == 1
