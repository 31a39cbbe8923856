import random
import zlib

import numpy as np
import pytest

from pageloom.llm import bitpack, packing
from pageloom.llm.tokens import Encoder, default_tokenizer
from tests.conftest import SF_DIR

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = ["", "a\nb\nc d e", "x \nBar y z", "x\n Bar y", "a\x01b c d", "a \x01b c", "q\n\nr s t u", "q\r\nr s t", " ", "  a", "a  b", "a\n b", " a b", "a b ", "foo\nbar baz\n", "x <|endoftext|> y z",
       "it's a 12 b's !! ?", "a \xa0 b", "a　 b c", "日本 語 x y", "a \x1c b", "tab\there is x",
       "a b\n c d e f g", "one", "\n\n", "a\x00 b c \x7f d"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return lambda text: t.encode(text, add_special_tokens=False).ids


def split(pair):
    ids, counts = pair
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_encoder_equals_tokenizer(plain):
    rng = random.Random(1)
    parts = ["a", " ", "  ", "\n", "don't", "x1", "é", "\xa0", "!?", "日", "the", "\t", "᠎"]
    texts = ODD + ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(400)]
    e = Encoder(default_tokenizer())
    assert split(e.encode(texts)) == [plain(t) for t in texts]
    e = Encoder(default_tokenizer(), kept=10)  # pieces are forgotten between calls
    for i in range(0, len(texts), 60):
        assert split(e.encode(texts[i : i + 60])) == [plain(t) for t in texts[i : i + 60]]
    assert [len(x) for x in e.encode([])] == [0, 0]


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 31, 32])
def test_bit_fields_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001).astype(np.uint32)
    packed = bitpack.pack(ids, bits)
    assert len(packed) == -(-1001 * bits // 8)
    for start, count in ((0, 1001), (0, 0), (5, 17), (1000, 1), (8, 8), (333, 555)):
        assert np.array_equal(bitpack.unpack(packed, bits, start, count), ids[start : start + count])


def expected(rows, plain, end):
    out, at = [], 0
    for doc_id, text in rows:
        own = [*plain(text or ""), end]
        out.append((doc_id, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    return out


def test_file_of_all_documents(spark, plain):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    rows = sorted(map(tuple, docs.collect()))
    want = expected(rows, plain, 0)
    path = bitpack.write(docs, default_tokenizer())
    assert sorted(map(tuple, bitpack.documents(spark, path).collect())) == want
    everything = [i for _, t in rows for i in [*plain(t or ""), 0]]
    for start, count in ((0, 5), (want[100][1] - 3, 4000), (len(everything) - 2, 2)):
        assert bitpack.ids_at(spark, path, start, count).tolist() == everything[start : start + count]


def test_file_of_odd_rows(spark, odd, clashing, none, odd_rows, plain):
    for docs in (odd, clashing):
        got = bitpack.documents(spark, bitpack.write(docs, default_tokenizer())).collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in got) == sorted(
            (r[0] is not None, r[0] or 0, len(plain(r[1] or "")) + 1) for r in odd_rows
        )
        got.sort(key=lambda r: r.start)
        assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
        ids = [(r.doc_id is not None, r.doc_id or 0) for r in got]
        assert ids == sorted(ids)
    assert bitpack.documents(spark, bitpack.write(none, default_tokenizer())).collect() == []


def check_pieces(pieces, tokens_of, length):
    """tokens_of: (doc_id, ids) of every row."""
    sequences, found = {}, []
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
        found.append((str(p.doc_id), p.start, p.length, p.ids_crc32, p.doc_tokens))
    want = [
        (str(d), a, len(ids[a : a + length]), zlib.crc32(np.array(ids[a : a + length], "<u4").tobytes()),
         len(ids))
        for d, ids in tokens_of for a in range(0, len(ids), length)
    ]
    assert sorted(found) == sorted(want)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *[p.length for p in own[:-1]]]).tolist()
        assert sum(p.length for p in own) <= length
    return len(sequences)


def test_packing_of_all_documents(spark, plain):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    own = [(r.doc_id, [*plain(r.text or ""), 1]) for r in docs.collect()]
    n = check_pieces(packing.query(spark, SF_DIR).collect(), own, 2048)
    assert n <= 1.03 * sum(len(x) for _, x in own) / 2048 + 1


def test_packing_of_odd_rows(odd, clashing, none, odd_rows, plain):
    own = [(r[0], [*plain(r[1] or ""), 1]) for r in odd_rows]
    for docs in (odd, clashing):
        check_pieces(packing.pack(docs, default_tokenizer(), 64).collect(), own, 64)
    assert packing.pack(none, default_tokenizer()).collect() == []


def test_sequences_hold_the_ids(spark, plain):
    rows = [(i, "word " * (3 * i % 50)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    pieces = packing.pack(docs, default_tokenizer(), 32)
    got = packing.sequences(pieces, docs, default_tokenizer()).collect()
    everything = sorted(i for _, t in rows for i in [*plain(t), 1])
    assert sorted(i for r in got for i in r.ids) == everything
    assert all(len(r.ids) <= 32 for r in got)


@pytest.mark.parametrize("demand", [
    [0] * 8, [5, 0, 0, 0, 0, 0, 0, 0], [0, 0, 7, 0, 0, 0, 0, 3], [3, 1, 4, 1, 5, 9, 2, 6],
])
def test_plan_takes_exactly_the_demand(demand):
    chosen = packing.plan(np.array(demand))
    assert sum((n * p for p, n in chosen), np.zeros(8, int)).tolist() == demand
    assert all((p * np.arange(1, 9)).sum() <= 8 for p, _ in chosen)


def test_columns_beat_first_fit():
    # first fit decreasing wastes room on these sizes: 6 + 4 fits, it takes 6 + 3
    demand = np.zeros(20, int)
    demand[[8, 6, 4]] = 30, 60, 60  # sizes 9, 7, 5: 9 + 5 + 5 and 7 + 7 + 5
    first = packing.first_fit(demand)[1].sum()
    patterns, amounts = packing.generate_columns(demand)
    assert amounts.sum() <= first + 1e-9
    assert np.allclose(amounts @ patterns, demand)
    value, _ = packing.knapsack(np.array([0.1, 0.3, 0.2]), 3)
    assert value == pytest.approx(0.4)
