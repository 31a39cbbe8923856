import hashlib
import random

from pyspark.sql import functions as F

from pageloom.llm import prefix_hash as ph
from tests.conftest import SF_DIR


def test_spans_and_extensions_match_slices():
    rng = random.Random(5)
    for _ in range(40):
        a = "".join(rng.choices("abé", k=rng.randint(1, 60)))
        b = a[rng.randint(0, len(a)) :] + "".join(rng.choices("abé", k=rng.randint(1, 60)))
        x, y = ph.PrefixHash(a), ph.PrefixHash(b)
        for _ in range(30):
            i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
            k = rng.randint(0, min(len(a) - i, len(b) - j))
            assert x.same(i, y, j, k) == (a[i : i + k] == b[j : j + k])
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            assert x.common(i, y, j) == n


def likeness(a, b):
    fa, fb = (ph.Fingerprint.of(ph.code_points(t)) for t in (a, b))
    assert fa.likeness(fb) == fb.likeness(fa)
    return fa.likeness(fb)


def from_strings(one, two):
    """The likeness of two fingerprint strings, read by hand: nothing but the strings."""

    def read(text):
        n, step, whole, spans, front, back, inner = text.split(".")
        cut = lambda x, k: [x[i : i + k] for i in range(0, len(x), k)]
        return int(n), int(step), whole, int(spans), cut(front, 8), cut(back, 8), cut(inner, 12)

    (n, p, w, s, f, b, i), (m, q, v, t, g, c, j) = read(one), read(two)
    if (n, w) == (m, v):
        return 1.0
    if not n or not m:
        return 0.0
    ends = 0
    for x, y in ((f, g), (b, c)):
        places = [k for k in range(max(p, q), min(n, m), max(p, q)) if x[k // p - 1] == y[k // q - 1]]
        ends += max(places, default=0)
    least = sorted({*i, *j})[:64]
    equal = len([x for x in least if x in i and x in j]) / max(1, len(least))
    inner = min(1.0, equal * (s + t) / (1 + equal) / max(s, t, 1))
    return max(min(ends, n, m, max(n, m) - 1) / max(n, m), inner)


def test_likeness_follows_the_common_part():
    rng = random.Random(2)
    a = "".join(rng.choices("abcdefgh", k=3000))
    other = "".join(rng.choices("abcdefgh", k=3000))
    assert likeness(a, a) == 1 and likeness("", "") == 1 and likeness("", "a") == 0
    assert likeness(a, other) < 0.05
    for share in (0.25, 0.5, 0.75, 0.9):
        cut = int(share * 3000)
        assert share - 0.07 < likeness(a, a[:cut] + other[cut:]) <= share + 0.07
        assert share - 0.07 < likeness(a, other[: 3000 - cut] + a[3000 - cut :]) <= share + 0.07
    assert likeness(a, a[:1500]) > 0.45


def test_likeness_counts_inner_spans():
    rng = random.Random(7)
    a = "".join(rng.choices("abcdefgh", k=3000))
    assert ph.Fingerprint.of(ph.code_points(a)).spans > 60
    near = a[:40] + "XY" + a[42:1500] + "inserted" + a[1500:2950] + a[2960:2980] + "Z" + a[2981:]
    assert likeness(a, near) > 0.85
    assert likeness(a, "Q" + a[1500:-1] + a[1:1500] + "R") > 0.85  # moved halves
    part = a[1000:1500]
    assert likeness(part * 3 + "S", "T" + part + a[2000:2999]) < 0.45  # a span counts once
    other = "".join(rng.choices("abcdefgh", k=60_000))
    long = "".join(rng.choices("abcdefgh", k=60_000))
    for share in (0.3, 0.6, 0.9):  # the sketch holds a fraction of the spans
        mixed = "Z".join((long if rng.random() < share else other)[k : k + 500] for k in range(0, 60_000, 500))
        same = sum(mixed[k : k + 500] == long[k - k // 501 : k - k // 501 + 500] for k in range(0, len(mixed), 501)) / 120
        assert abs(likeness(long, mixed) - same) < 0.2


def expected(rows):
    out = []
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        tail = len(text) // 4
        edited = text[: len(text) - tail] + after[:tail]
        digest = hashlib.sha256(edited.encode("utf-8")).hexdigest()
        prints = [str(ph.Fingerprint.of(ph.code_points(t))) for t in (text, edited, after)]
        near = [from_strings(prints[0], x) for x in prints[1:]]
        prints = prints[:2]
        out.append((doc_id, len(text), digest, *prints, *near))
    return out


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    want = expected(sorted((r.doc_id, r.text or "") for r in docs))
    assert sorted(map(tuple, ph.query(spark, SF_DIR).collect())) == want


def test_strings_tell_all():
    rng = random.Random(4)
    for n in (0, 1, 5, 40, 700, 9000):
        a = "".join(rng.choices("abcdefgh", k=n))
        b = a[: n // 2] + "x" + a[n // 2 :]
        one, two = (ph.Fingerprint.of(ph.code_points(t)) for t in (a, b))
        again = ph.Fingerprint.parsed(str(one))
        assert str(again) == str(one) and again.likeness(ph.Fingerprint.parsed(str(two))) == one.likeness(two)
        assert from_strings(str(one), str(two)) == one.likeness(two)


def test_many_rows_of_one_id_are_dealt_out(spark):
    rows = [(None if i % 3 else 5, f"text number {i} of many") for i in range(600)] + [(i, "x") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    dealt = ph.with_next(docs)
    sizes = [r[0] for r in dealt.where("NOT is_tail").groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()]
    assert sum(sizes) == 690 and max(sizes) < 350
    got = ph.fingerprint(docs).collect()
    assert len(got) == 690
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted(r.n_chars for r in got) == sorted(len(t) for _, t in order)


def test_odd_rows(spark, odd, clashing, none, odd_rows):
    for docs in (odd, clashing):
        got = ph.fingerprint(docs).collect()
        assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted(
            (str(r[0]), len(r[1] or "")) for r in odd_rows
        )
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    # equal rows: the first of the two is followed by the other or by the third of that id
    assert ph.fingerprint(none).collect() == []
    one = spark.createDataFrame([(9, "abcdefgh")], "doc_id BIGINT, text STRING")
    assert [tuple(r) for r in ph.fingerprint(one).collect()] == expected([(9, "abcdefgh")])
