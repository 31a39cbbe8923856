"""The link store, the lasting queue and seeded streams against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pageloom import fixed
from pageloom.operators import frontier as fr, queue as q
from pageloom.schema import FRONTIER
from pageloom.session import drop_stored, owned_by, shared_dir, stored
from pageloom.sources import files, links as ls
from pageloom.streaming.dedup import sightings
from pageloom.streaming.poll import FRONTIER_COLUMNS, LISTING_PAGE, frontier_rows, poll
from tests.test_plans import plan_of
from tests.test_stream import drop, links, listing

START = datetime(2024, 1, 1)


def items(spark, *links_, source="a", at=0):
    rows = [(source, link, START + timedelta(minutes=at + i)) for i, link in enumerate(links_)]
    return spark.createDataFrame(rows, FRONTIER)


def got(df):
    return sorted(tuple(r[c] for c in FRONTIER_COLUMNS) for r in df.collect())


# -- frontier ------------------------------------------------------------------------


def test_no_source_is_lost(spark):
    rows = [("a", "x", None), ("third", "x", START), (None, "y", START), ("third", "x", None), (None, "y", None),
            ("a", None, START), ("b", "known", START)]
    found = fr.new_links(spark.createDataFrame(rows, FRONTIER), spark.createDataFrame([("known",)], "link STRING"))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(
        map(str, [("a", "x", None), ("third", "x", START), (None, "y", START)])
    )
    head, rest = fr.take_next(found, 2)
    assert head.count() == 2 and [r.link for r in rest.collect()] == ["x"]


# -- link store ----------------------------------------------------------------------


def store_of(spark, buckets=8):
    return ls.LinkStore(spark, shared_dir(spark, "links"), buckets)


def test_store_gives_what_the_anti_join_gives(spark):
    store, rng, known = store_of(spark), random.Random(3), []
    for number in range(4):
        batch = items(spark, *[f"l{rng.randrange(400)}" for _ in range(150)], at=1000 * number)
        want = got(fr.new_links(batch, spark.createDataFrame(known or [("-",)], "link STRING")))
        fresh = store.add_unseen(batch)
        assert got(fresh) == want
        known += [(r[1],) for r in want]
    assert sorted(r.link for r in store.rows().collect()) == sorted(k[0] for k in known)
    assert store.unseen(items(spark, *[k[0] for k in known])).isEmpty()


def test_store_is_read_in_place(spark):
    """The plan has no exchange above the store's scan, and reads the batch's buckets."""
    store = store_of(spark, 16)
    store.add(items(spark, *[f"l{i}" for i in range(300)]))
    batch = items(spark, "l7", "new")
    there = sorted({r.bucket for r in store._bucketed(batch).collect()})
    found = store.known_among(batch)
    assert [r.link for r in found.collect()] == ["l7"]
    lines = plan_of(found).splitlines()
    at = next(i for i, line in enumerate(lines) if "LeftSemi" in line)
    scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line)
    assert at < scan and not any("Exchange" in line for line in lines[at:scan])
    assert "Bucketed: true" in lines[scan]
    read = {p.split("bucket=")[1].split("/")[0] for p in store.stored(there).inputFiles()}
    assert read == {str(b) for b in there} and len(read) <= 2


def test_filters_are_never_wrong_about_new_links(spark, monkeypatch):
    monkeypatch.setattr(ls, "BITS", 2)  # crowded: most answers are false alarms
    store = store_of(spark, 2)
    store.add(items(spark, *[f"l{i}" for i in range(200)]))
    asked = store.asked(items(spark, *[f"l{i}" for i in range(400)])).collect()
    assert all(r.maybe for r in asked if int(r.link[1:]) < 200)
    false_alarms = sum(r.maybe for r in asked if int(r.link[1:]) >= 200)
    assert 20 < false_alarms
    assert sorted(r.link for r in store.unseen(items(spark, *[f"l{i}" for i in range(400)])).collect()) == sorted(
        f"l{i}" for i in range(200, 400)
    )


def test_filters_spare_the_store(spark):
    store = store_of(spark)
    store.add(items(spark, *[f"l{i}" for i in range(2000)]))
    asked = store.asked(items(spark, *[f"n{i}" for i in range(2000)])).where("maybe").count()
    assert asked < 60
    assert store.known_among(items(spark).limit(0)).isEmpty() and store.stored([]).inputFiles() == []


def test_store_compacts_and_reopens(spark):
    store = store_of(spark, 4)
    for i in range(5):
        store.add(items(spark, *[f"l{j}" for j in range(40)], at=i))  # the same links each time
    assert set(store.file_counts().values()) == {5}
    want = got(store.rows())
    assert len(want) == 40 and store.stored().count() == 200
    assert store.compact(4) == 4 and store.compact(4) == 0
    assert set(store.file_counts().values()) == {1} and store.stored().count() == 40
    again = ls.LinkStore(spark, store.path, 99)
    assert again.buckets == 4 and got(again.rows()) == want
    assert again.unseen(items(spark, "l1", "x")).first().link == "x"
    assert all(len(r.filters) == 1 for r in again.filters().collect())


def test_store_bears_empty_and_null_links(spark):
    store = store_of(spark)
    store.add(items(spark).limit(0))
    store.add(spark.createDataFrame([("a", None, None), (None, "", None)], FRONTIER))
    assert got(store.rows()) == [(None, "", None)]
    assert [r.link for r in store.unseen(items(spark, "", "x")).collect()] == ["x"]


# -- queue ---------------------------------------------------------------------------


def order(row):
    source, link, at = row
    return (at is None, -(at - START).total_seconds() if at else 0, link, source is not None, source or "")


def test_rounds_equal_one_global_sort(spark):
    queue, rng, held = q.Queue(spark, shared_dir(spark, "queue"), block=7), random.Random(1), []
    for number in range(4):
        rows = {
            (rng.choice(["a", "b", None]), f"{number}-{i}", None if rng.random() < 0.1 else START + timedelta(minutes=rng.randrange(90)))
            for i in range(60)
        }
        queue.add(spark.createDataFrame(sorted(rows, key=str), FRONTIER).repartition(3))
        held = sorted([*held, *rows], key=order)
        for k in (0, 13, 30):
            head = [tuple(r[c] for c in FRONTIER_COLUMNS) for r in queue.take(k).collect()]
            assert sorted(head, key=order) == held[:k]
            held = held[k:]
        assert sorted(map(tuple, queue.rest().select(*FRONTIER_COLUMNS).collect()), key=order) == held
    queue.merge()
    assert len(queue._events()) == 1
    assert sorted(map(tuple, queue.take(500).collect()), key=order) == held
    assert queue.rest().isEmpty() and queue.take(3).isEmpty()


def test_take_reads_heads_only(spark):
    queue = q.Queue(spark, shared_dir(spark, "queue"), block=50)
    for number in range(3):
        queue.add(items(spark, *[f"{number}-{i}" for i in range(1000)], at=7 * number).coalesce(1))
    cursors = queue._cursors(queue._events())
    paths = queue.head_files(60, cursors)
    assert 3 <= len(paths) <= 6
    plan = plan_of(queue.head(60, cursors))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan and "Sort " not in plan
    queue.take(60)
    assert len(queue.head_files(60, queue._cursors(queue._events()))) <= 9


def test_empty_queue(spark):
    queue = q.Queue(spark, shared_dir(spark, "queue"))
    assert queue.take(5).isEmpty() and queue.rest().isEmpty()
    queue.add(items(spark).limit(0))
    assert queue.take(5).isEmpty() and queue.rest().columns == FRONTIER_COLUMNS


def test_a_round_is_logged_once(spark):
    queue = q.Queue(spark, shared_dir(spark, "queue"))
    queue.add(items(spark, "x"))
    with pytest.raises(ValueError, match="already"):
        queue._log(0, "add", {})


# -- streams -------------------------------------------------------------------------


def test_late_sightings_are_rows(spark):
    """Files out of time order, each a run of its own over the same checkpoint."""
    schema = "source STRING, link STRING, seen_at TIMESTAMP"
    path, out, checkpoint = (shared_dir(spark, n) for n in ("items", "out", "cp"))
    day = timedelta(days=1)
    shown = [
        ("x", START), ("x", START + day / 24), ("early", START - day / 2), ("late", START - 9 * day),
        ("x", START + day), ("far", START + 9 * day), ("x", START + 9 * day), ("x", START), ("none", None),
    ]
    for link, at in shown:
        spark.createDataFrame([("s", link, at)], schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        (
            sightings(stream, 2 * day, "1 day").writeStream.format("parquet")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
        )
    rows = [(r.link, r.seen_at, r.late) for r in spark.read.schema(schema + ", late BOOLEAN").parquet(out).collect()]
    assert sorted(rows) == sorted([
        ("x", START, False), ("early", START - day / 2, False), ("late", START - 9 * day, True),
        ("far", START + 9 * day, False), ("x", START + 9 * day, False), ("x", START, True),
    ])


def rows_scanned(plan, path):
    """Rows that the scans of ``path`` gave, in a plan that has run."""
    own = 0
    if "Scan parquet" in plan.nodeName() and path in plan.relation().location().rootPaths().mkString(","):
        own = plan.metrics().apply("numOutputRows").value()
    below = plan.children()
    return own + sum(rows_scanned(below.apply(i), path) for i in range(below.size()))


def test_poll_starts_from_what_is_stored_and_reads_it_no_more(spark):
    pages, store, checkpoint = (shared_dir(spark, n) for n in ("pages", "store", "cp"))
    spark.createDataFrame([(fixed.SOURCE_A, "old", None)], FRONTIER).write.parquet(f"{store}/before")
    arrived, scanned = [], []
    for number in range(10):
        drop(spark, pages, listing("old", f"n{number}", f"n{number + 1}"))
        query = poll(spark, pages, store, checkpoint)
        query.awaitTermination()
        arrived.append(sum(p.numInputRows for p in query.recentProgress))
        last = query._jsq.streamingQuery().lastExecution().executedPlan()
        scanned.append(rows_scanned(last, store))
    assert links(spark, store) == sorted(["old", *[f"n{i}" for i in range(11)]])
    assert scanned == [1] + 9 * [0] and len(set(arrived)) == 1


def test_a_batch_run_again_replaces_what_it_wrote(spark):
    pages, store, checkpoint = (shared_dir(spark, n) for n in ("pages", "store", "cp"))
    drop(spark, pages, listing("a", "b"))
    poll(spark, pages, store, checkpoint).awaitTermination()
    for name in files.names(spark, f"{checkpoint}/commits"):  # as if it had died before the commit
        files.remove(spark, f"{checkpoint}/commits/{name}")
    poll(spark, pages, store, checkpoint).awaitTermination()
    assert links(spark, store) == ["a", "b"]


def test_links_listed_everywhere_move_once_a_batch(spark):
    from pageloom.streaming.poll import _reduced

    rows = [("s", "hot", START), ("s", "hot", None), ("s", "cold", None)] * 50
    frame = spark.createDataFrame(rows, FRONTIER).coalesce(1)
    assert got(frame.mapInArrow(_reduced, FRONTIER))[-1] == ("s", "hot", START)
    assert frame.mapInArrow(_reduced, FRONTIER).count() <= 2 * 2


# -- shared folder -------------------------------------------------------------------


def test_each_owner_drops_its_own(spark):
    mine = stored(spark.range(3), "mine")
    with owned_by("other"):
        folder = shared_dir(spark, "theirs")
        spark.range(4).write.parquet(folder)
    assert drop_stored(spark, "other") == 1
    assert mine.count() == 3 and files.names(spark, folder) == []
