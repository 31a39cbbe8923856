import random
import re

import numpy as np
import pytest
import xxhash

from pageloom.llm import simhash, toxicity
from pageloom.llm.components import components
from pageloom.session import BATCH_BYTES


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(r.encode("utf-8"), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def roots(prints, bits=3):
    parent = list(range(len(prints)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(prints))]


def test_fingerprints_match_plain_counting(odd_rows):
    texts = [r[1] or "" for r in odd_rows] + ["A B c", "a b", "x y z w", "a " * 700]
    assert simhash.fingerprints(texts).tolist() == [fingerprint(t) for t in texts]


def test_links_keep_every_component(spark, monkeypatch):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    prints = set(seeds)
    for s in seeds[:10]:  # chains of changes, of one to four bits
        for _ in range(30):
            s ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            prints.add(s)
    dense = rng.getrandbits(64)  # many entries in one list
    prints |= {dense ^ sum(1 << b for b in rng.sample(range(24), 2)) for _ in range(150)}
    prints = sorted(prints)
    want = roots(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    fps = spark.createDataFrame([(x,) for x in signed], "fp BIGINT")
    for paired in (1024, 8):
        monkeypatch.setattr(simhash, "PAIRED", paired)
        found = {r.node: r.root for r in components(simhash.links(fps)).collect()}
        groups = {}
        for x, w in zip(signed, want, strict=True):
            groups.setdefault(w, set()).add(found.get(x, x))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_long_chain_has_one_root(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a BIGINT, b BIGINT")
    found = {r.node: r.root for r in components(edges).collect()}
    assert {found[i] for i in range(201)} == {0} and found[501] == found[500] == 500


def test_odd_rows(odd, odd_rows, clashing, none):
    got = sorted(
        ((r.doc_id, r.fp % (1 << 64)) for r in simhash.near_duplicates(odd).collect()), key=str
    )
    assert got == sorted(((r[0], fingerprint(r[1])) for r in odd_rows), key=str)
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.one_of_each(none).collect() == []
    kept = simhash.one_of_each(clashing)
    assert kept.columns == clashing.columns
    prints = [fingerprint(r[1]) for r in odd_rows]
    assert kept.count() == len(set(roots(prints)))
    # copies of one text: the least id stays, once
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1


def test_query_matches_brute_force(spark):
    from tests.conftest import SF_DIR

    docs = sorted(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect())
    prints = [fingerprint(r.text) for r in docs]
    want = [(d.doc_id, f"{p:016x}", docs[t].doc_id)
            for d, p, t in zip(docs, prints, roots(prints), strict=True)]
    assert sorted(map(tuple, simhash.query(spark, SF_DIR).collect())) == want


@pytest.mark.parametrize("copies", [1, 12])  # few rows go, most rows go
def test_texts_stay_where_they_are_if_keys_are_small(spark, copies):
    rng = random.Random(5)
    texts = [" ".join(str(rng.random()) for _ in range(20)) for _ in range(6)] + [None]
    rows = [(7 * c + i, x) for c in range(copies) for i, x in enumerate(texts)]
    rows += [(100, texts[0]), (None, texts[1]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # only measured tables are broadcast
    try:
        kept = simhash.one_of_each(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, kept.collect()))
    finally:
        spark.conf.set(limit, before)
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert got == list(enumerate(texts))


@pytest.mark.parametrize("small", [0, 700, 8 << 20])  # texts move, few stay, few go
def test_one_of_each_is_the_same_by_every_join(spark, monkeypatch, odd, odd_rows, small):
    prints = [fingerprint(r[1]) for r in odd_rows]
    best = {}
    for r, top in zip(odd_rows, roots(prints), strict=True):
        if top not in best or (r[0] is None, r[0] or 0) < (best[top] is None, best[top] or 0):
            best[top] = r[0]
    monkeypatch.setattr(simhash, "SMALL", small)
    many = odd
    for _ in range(3):  # repeated rows, more of them than rows that stay
        many = many.unionByName(odd)
    for docs in (odd, many):
        kept = simhash.one_of_each(docs).collect()
        assert sorted((r.doc_id for r in kept), key=str) == sorted(best.values(), key=str)
        assert {(r.doc_id, r.text) for r in kept} <= {r[:2] for r in odd_rows}


def test_workers_get_small_batches_of_texts(spark, none):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    labels = spark.createDataFrame([], "doc_id BIGINT, toxic INT")
    jobs = (lambda: simhash.near_duplicates(none), lambda: toxicity.fit(none, labels),
            lambda: toxicity.clean(none, toxicity.Model(None, 0.0, {})))
    for job in jobs:
        spark.conf.set(limit, str(64 << 20))
        job()
        assert int(spark.conf.get(limit)) == BATCH_BYTES
