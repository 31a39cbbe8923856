"""Hard negatives, nearest neighbours and whitening against brute force."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pageloom.llm import negatives, neighbours, whitening
from pageloom.llm.vectors import finite, matrix
from tests.conftest import SF_DIR

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"
NAN, INF = float("nan"), float("inf")


def odd_vectors():
    """Nulls, odd numbers, ties, repeated rows, short and empty vectors, large numbers."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.3, 8).astype(np.float32).tolist(), int(i % 3)) for i in range(0, 700, 5)]
    same = [0.5, -0.25, 0.125, 0.0, 0.5, 0.25, -0.5, 0.0]
    rows += [(i, same, 1) for i in (3, 900, 901, 902, 1000, 1100)]
    rows += [(900, same, 1), (1000, same, 1), (None, same, 1), (None, same, 2), (1200, [2 * c for c in same], 2)]
    rows += [(1300, None, 1), (1400, same, None), (1500, [None, *same[1:]], 1), (1600, [NAN, *same[1:]], 1)]
    rows += [(1700, [INF, *same[1:]], 2), (1800, [], 1), (1900, [0.0] * 8, 1), (2000, same[:3], 2), (2101, same[:5], 0)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_vectors(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF_DIR}/embeddings.parquet")


def clashing(df):
    names = ["row", "v", "x", "n", "list", "score", "rank", "query", "part", "at", "w", "block", "chunk",
             "other", "anchor", "positives", "segments", "turned", "index", "vector", "component"]
    return df.select("*", *[F.lit("x").alias(c) for c in names])


def plain(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def padded(vectors):
    dim = max(map(len, vectors), default=0)
    return np.array([[*v, *[0.0] * (dim - len(v))] for v in vectors], float).reshape(len(vectors), dim)


def text(rows):
    return sorted(map(str, map(tuple, rows)))


# -- helpers ---------------------------------------------------------------------------


def test_matrix_fills_short_rows_and_reads_slices():
    column = pa.array([[9.0], [1.0, 2.0], [], [3.0]]).slice(1)
    assert matrix(column, 3).tolist() == [[1, 2, 0], [0, 0, 0], [3, 0, 0]]
    assert matrix(column.slice(0, 0), 3).shape == (0, 3)


def test_finite(spark, odd):
    got = {r.vec_id for r in odd.where(~finite(F.col("embedding"))).collect()}
    assert got == {1300, 1500, 1600, 1700}


# -- hard negatives ----------------------------------------------------------------------


def negatives_by_hand(rows):
    kept = [(i, v, label) for i, v, label in rows if plain(v) and label is not None]
    ids = [r[0] for r in kept]
    labels = [(r[2] + 1) % 10 if r[0] is not None and r[0] % 7 == 0 else r[2] for r in kept]
    x = [[int(np.floor(256 * c)) for c in v] for v in padded([r[1] for r in kept]).tolist()]
    out = []
    for a, anchor in enumerate(ids):
        if anchor is None or anchor % 100:
            continue
        scores = [sum(p * q for p, q in zip(x[a], y, strict=True)) for y in x]
        order = sorted(
            (b for b in range(len(kept)) if b != a), key=lambda b: (-scores[b], ids[b] is None, ids[b] or 0)
        )
        for p in [b for b in order if labels[b] == labels[a]][:5]:
            band = [
                b for b in order
                if labels[b] != labels[a] and 30 * scores[p] <= 100 * scores[b] <= 90 * scores[p]
            ]
            out += [(anchor, ids[p], k, ids[b], scores[p], scores[b]) for k, b in enumerate(band[:10], 1)]
    return out


def test_negatives_equal_all_pairs(odd):
    want = text(negatives_by_hand(odd_vectors()))
    assert len(want) > 200
    assert text(negatives.mined(odd).collect()) == want
    assert text(negatives.mined(clashing(odd)).collect()) == want


def test_negatives_over_many_tiles(odd, monkeypatch):
    monkeypatch.setattr(negatives, "per_tile", lambda dim: 16)
    monkeypatch.setattr(negatives, "STEP", 5)
    assert text(negatives.mined(odd).collect()) == text(negatives_by_hand(odd_vectors()))


def test_negatives_equal_sql(given):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_DIR}/embeddings.parquet'")
    want = con.sql(negatives.oracle()).fetchall()
    assert len(want) >= 250 and text(negatives.mined(given).collect()) == text(want)


def test_scores_beyond_doubles_are_exact():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0], [2.0**40, 1.0], [-(2.0**40), 1.0]])
    assert negatives.exact(a, b).tolist() == [[2**60 + 3, 2**63 - 1, -(2**63)]]


def test_large_components_are_scored(spark):
    rows = [(0, [3e8, 1.0], 1), (1, [2e8, 1.0], 1), (2, [1e8, 1.0], 2), (3, [1e8, 2.0], 2)]
    got = negatives.mined(spark.createDataFrame(rows, SCHEMA)).collect()
    assert text(got) == text(negatives_by_hand([(i, np.float32(v).tolist(), n) for i, v, n in rows]))


def test_summaries_bound_scores_and_drop_pairs(monkeypatch):
    """Every cut's bounds hold the score, and on clustered vectors pairs go before scoring."""
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(0, 60, (50, 24)))
    scores = x @ x.T
    for starts in negatives.edges(24):
        mean, deviation = negatives.summary(x, starts)
        spread = deviation @ deviation.T + 1e-6
        assert (abs(scores - mean @ mean.T) <= spread).all()
    steps = np.repeat(rng.normal(0, 90, (400, 4)), 8, axis=1)  # nearly constant in segments
    x = np.floor(steps + rng.normal(0, 1, steps.shape))
    cuts = negatives.edges(32)
    segments = np.concatenate([p for s in cuts for p in negatives.summary(x, s)], axis=1)
    table = pa.table({
        "row": np.arange(400), "vec_id": pa.array(np.arange(400), pa.int64()), "label": np.zeros(400, int),
        "x": pa.array(list(x)), "segments": pa.array(list(segments)),
    })
    met: list[int] = []
    monkeypatch.setattr(negatives, "STEP", 50)
    low = np.full((20, 1), -negatives.FAR, np.int64)
    got = negatives.tile(table.slice(0, 20), table, low, -low - 1, 5, 32, True, met)
    assert got.num_rows == 100 and met[-1] < 0.6 * 20 * 400


# -- nearest neighbours --------------------------------------------------------------------


def neighbours_by_hand(rows):
    kept = [(i, v) for i, v, _ in rows if plain(v) and any(v)]
    v = padded([k[1] for k in kept])
    score = (v @ v.T) / np.sqrt(np.outer((v * v).sum(1), (v * v).sum(1)))
    return kept, score


def test_neighbours_of_an_odd_table(odd):
    """Every query and rank there is, and nine in ten as near as the true fifth."""
    kept, score = neighbours_by_hand(odd_vectors())
    np.fill_diagonal(score, -2)
    asked = [a for a, (i, _) in enumerate(kept) if i is not None and i % 50 == 0]
    fifth: dict = {}
    for a in asked:  # of rows with one id the lesser
        fifth[kept[a][0]] = min(fifth.get(kept[a][0], 2), np.sort(score[a])[-5])
    for table in (odd, clashing(odd)):
        got = neighbours.nearest(table).collect()
        assert sorted((r.query_id, r.rank) for r in got) == sorted((kept[a][0], k) for a in asked for k in range(1, 6))
        assert sum(r.score >= fifth[r.query_id] - 1e-9 for r in got) >= 0.9 * len(got)


def test_neighbours_probing_everything_are_exact(odd, monkeypatch):
    monkeypatch.setattr(neighbours, "RECALL", 1.0)
    monkeypatch.setattr(neighbours, "ERROR", 50.0)
    monkeypatch.setattr(neighbours, "probes_needed", lambda x, home, centres, rng: len(centres))
    monkeypatch.setattr(neighbours, "per_tile", lambda dim: 8)
    kept, score = neighbours_by_hand(odd_vectors())
    ids = [k[0] for k in kept]
    for r in neighbours.nearest(odd).where("rank = 5").collect():
        fifth = min(
            sorted((round(score[a, b], 9) for b in range(len(ids)) if b != a), reverse=True)[4]
            for a in range(len(ids)) if ids[a] == r.query_id
        )
        assert round(r.score, 9) == pytest.approx(fifth, abs=2e-9)


def test_recall_on_the_given_table(given):
    rows = [(r.vec_id, r.embedding, None) for r in given.collect()]
    kept, score = neighbours_by_hand(rows)
    ids = np.array([k[0] for k in kept])
    np.fill_diagonal(score, -2)
    place = {i: p for p, i in enumerate(ids)}
    got = neighbours.nearest(given).collect()
    asked = {i for i in ids if i % 50 == 0}
    assert {r.query_id for r in got} == asked and len(got) == 5 * len(asked)
    hits = sum(
        r.vec_id in ids[np.argsort(-score[place[r.query_id]])[:5]] for r in got
    )
    assert hits >= 0.9 * len(got)
    assert all(abs(r.score - score[place[r.query_id], place[r.vec_id]]) < 1e-14 for r in got)


def test_scan_abandons_early():
    """Close clusters: most candidates go before their last column block, none wrongly."""
    rng = np.random.default_rng(7)
    heart = rng.normal(size=(40, 64))
    v = np.repeat(heart, 25, axis=0) + rng.normal(0, 0.2, (1000, 64))
    turned = (neighbours.units(v) @ np.linalg.qr(rng.normal(size=(64, 64)))[0]).astype(np.float32)
    rows = pa.table({"row": np.arange(1000), "vec_id": pa.array(np.arange(1000)), "v": list(v), "turned": list(turned)})
    queries = rows.slice(0, 30).append_column("limit", pa.array([9.0] * 30))
    read: list[int] = []
    got = neighbours.scan(queries, rows, 64, read).to_pydict()
    score = neighbours.units(v[:30]) @ neighbours.units(v).T
    score[np.arange(30), np.arange(30)] = -2
    want = np.argsort(-score, axis=1)[:, :5]
    found = [r in want[q] for q, r in zip(got["query"], got["row"], strict=True)]
    assert len(found) == 150 and sum(found) >= 147
    assert sum(read[8::9]) < 0.3 * sum(read[0::9])


def test_equal_rows_and_scales_tie(spark):
    rows = [(i, [0.5, 1.0], 0) for i in (50, 7, 9, 8, 3, 4, 5)] + [(100, [1.0, 2.0], 0)]
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA)).where("query_id = 50").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [3, 4, 5, 7, 8] and {r.score for r in got} == {got[0].score}


def test_extreme_lengths(spark):
    rows = [(0, [1e300, 2e300], 0), (1, [1e-300, 2e-300], 0), (2, [-1e-300, 0.0], 0)]
    table = spark.createDataFrame(rows, SCHEMA.replace("FLOAT", "DOUBLE"))
    got = neighbours.nearest(table).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2]
    assert got[0].score == pytest.approx(1) and got[1].score == pytest.approx(-(5**-0.5))


# -- whitening ---------------------------------------------------------------------------


def whitened_by_hand(rows, k=32):
    kept = [(i, v) for i, v, _ in rows if plain(v)]
    x = (np.floor(64 * padded([v for _, v in kept])) + 1_000_000).astype(object)
    x = np.vectorize(int, otypes=[object])(x)
    n, total = len(x), x.sum(0)
    deviation = ((n * x - total) ** 2).sum(1)
    off = x.astype(float) - total.astype(float) / n
    values, vectors = np.linalg.eigh(off.T @ off / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return [i for i, _ in kept], deviation, off @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


@pytest.mark.parametrize("name", ["odd", "clashing", "given"])
def test_whitening_equals_numpy(name, odd, given):
    table = {"odd": odd, "clashing": clashing(odd), "given": given}[name]
    rows = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    ids, deviation, w, explained = whitened_by_hand(rows)
    k = w.shape[1]
    got = whitening.whitened(table).collect()
    assert len(got) == len(ids) * k and {r.n for r in got} == {len(ids)}
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    for c in range(k):
        own = [r for r in got if r.component == c + 1]
        assert own[0].explained == pytest.approx(explained[c], rel=1e-9)
        mine = sorted((str(r.vec_id), r.deviation, r.whitened) for r in own)
        best = min(
            max(abs(m[2] - h[2]) for m, h in zip(mine, hand, strict=True))
            for sign in (1, -1)
            for hand in [sorted((str(i), int(d), sign * x) for i, d, x in zip(ids, deviation, w[:, c], strict=True))]
        )
        assert best < 1e-6
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == sorted(
        (str(i), int(d)) for i, d in zip(ids, deviation, strict=True)
    )


def test_components_without_spread_are_null(spark):
    rows = [(i, [float(i), 1.0, 2.0 * i], 0) for i in range(5)]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).orderBy("vec_id", "component").collect()
    assert [r.component for r in got[:3]] == [1, 2, 3]
    assert got[0].explained == pytest.approx(1) and got[0].whitened is not None
    assert all(r.whitened is None for r in got if r.component > 1) and got[0].identity_error < 1e-9
    one = whitening.whitened(spark.createDataFrame(rows[:1], SCHEMA)).collect()
    assert len(one) == 3 and all(
        r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in one
    )


def test_deviation_that_64_bits_cannot_hold_is_null(spark):
    rows = [(0, [1e30], 0), (1, [-1e30], 0), (2, [0.0], 0)]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id: r.deviation for r in got} == {0: None, 1: None, 2: 0}


# -- empty tables ------------------------------------------------------------------------


@pytest.mark.parametrize("operator", [negatives.mined, neighbours.nearest, whitening.whitened])
def test_empty_tables_keep_their_columns(spark, odd, operator):
    columns = operator(odd).columns
    for rows in ([], [(0, None, 1), (100, [NAN], 1)], [(0, [], 1), (100, [], 1)]):
        got = operator(spark.createDataFrame(rows, SCHEMA))
        assert got.columns == columns and (got.isEmpty() or operator is negatives.mined)
