"""Prefix polynomial hashes of texts, and fingerprints made of them.

``PrefixHash`` keeps, for every place of a text, the polynomial hash of all code
points before it, modulo two primes.  Two subtractions give the hash of any
span, so any two spans are compared in constant time and the longest common
extension of two places is found by binary search.

A fingerprint holds the hashes at up to ``MARKS`` evenly spaced places, read from
the front and from the back, the length, and the least ``INNER`` hashes of inner
spans with their number.  Spans are cut where a window of the text says so, so an
insertion moves no cut but the ones next to it.

The likeness of two texts follows from their fingerprints alone.  Binary search over
the places that both mark gives the longest common extension from either end, as a
share of the longer text; the least hashes of both give, as in any sketch by least
values, the share of inner spans in common.  The larger counts.  Equal texts have 1.
The error of the first is a mark's distance (a sixteenth of the text at most), that of
the second about one in the root of ``INNER``.

Size.  Documents are dealt out by ranges of ``doc_id`` in one exchange; the first
document of a range is also sent to the range before it, so every document meets
the next one and nothing is gathered.  Equal or null ids are one place in the order, and
follow each other by text hash; the hash is part of the range.  The driver sees the
bounds and the first row of each range.  A text takes some ten 8-byte numbers for each
code point while its fingerprint is made, one text at a time.

Cases.  A null text is the empty text; an empty text equals itself and is unlike
any other.  Null ``doc_id`` come first.  Rows of one ``doc_id`` follow each other
by text hash.  A single row is its own next document.  An empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.llm.common import empty_as, read, tasks, text_slices

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 1299721)
MARKS, INNER = 32, 64
#: Code points that decide a cut, about how many lie between cuts, and the shortest
#: span looked up (texts share shorter ones by chance).
WINDOW, BETWEEN, LEAST_SPAN = 12, 32, 16
OUT = (
    "doc_id BIGINT, n_chars BIGINT, edited_sha256 STRING, fingerprint STRING, "
    "edited_fingerprint STRING, near_edited DOUBLE, near_next DOUBLE"
)


class Powers:
    """Powers of the bases, as far as they were asked for."""

    def __init__(self, bases: tuple[int, ...] = BASES) -> None:
        self.bases = bases
        self.known = [np.ones(1, np.int64) for _ in PRIMES]

    def up_to(self, n: int) -> list[np.ndarray]:
        while len(self.known[0]) < n:
            for i, (p, b) in enumerate(zip(PRIMES, self.bases, strict=True)):
                old = self.known[i]
                self.known[i] = np.concatenate([old, old * pow(b, len(old), p) % p])
        return [k[:n] for k in self.known]


POWERS = Powers()
INVERSES = Powers(tuple(pow(b, -1, p) for b, p in zip(BASES, PRIMES, strict=True)))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def prefixes(codes: np.ndarray) -> list[np.ndarray]:
    """For each prime the hashes of all prefixes, the empty one first."""
    out = []
    for power, p in zip(POWERS.up_to(len(codes)), PRIMES, strict=True):
        out.append(np.concatenate([[0], np.cumsum((codes + 1) * power % p) % p]))
    return out


class PrefixHash:
    """Span equality and longest common extensions over whole texts."""

    def __init__(self, text: str):
        self._set(code_points(text))

    @classmethod
    def of(cls, codes: np.ndarray) -> PrefixHash:
        made = cls.__new__(cls)
        made._set(codes)
        return made

    def _set(self, codes: np.ndarray) -> None:
        self.n, self.sums = len(codes), prefixes(codes)

    def same(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        """Whether ``length`` code points from ``i`` here and ``j`` there are equal."""
        for mine, theirs, base, p in zip(self.sums, other.sums, BASES, PRIMES, strict=True):
            a = int(mine[i + length] - mine[i]) * pow(base, j, p)
            b = int(theirs[j + length] - theirs[j]) * pow(base, i, p)
            if (a - b) % p:
                return False
        return True

    def common(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common extension to the right of ``i`` and ``j``."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.same(i, other, j, mid):
                low = mid
            else:
                high = mid - 1
        return low


    def before(self, i: int, other: PrefixHash, j: int, most: int) -> int:
        """Length of the longest common extension to the left, up to ``most``."""
        low, high = 0, most
        while low < high:
            mid = (low + high + 1) // 2
            if self.same(i - mid, other, j - mid, mid):
                low = mid
            else:
                high = mid - 1
        return low


def inner_spans(codes: np.ndarray, sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the spans between cuts; a hash does not tell the place."""
    n = len(codes)
    if n < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    window = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        window = window * np.uint64(0x9E3779B97F4A7C15) + codes[k : n - WINDOW + 1 + k].astype(np.uint64)
    mixed = (window ^ (window >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    cuts = np.flatnonzero((mixed >> np.uint64(40)) % np.uint64(BETWEEN) == 0) + WINDOW
    cuts = np.concatenate([[0], cuts[cuts < n], [n]])
    long = np.diff(cuts) >= LEAST_SPAN
    starts, ends = cuts[:-1][long], cuts[1:][long]
    one, two = (
        (s[ends] - s[starts]) % p * back[starts] % p
        for s, p, back in zip(sums, PRIMES, INVERSES.up_to(n), strict=True)
    )
    return starts, (one << 31) | two


def spacing(n: int) -> int:
    """The least power of two that cuts ``n`` places into at most ``MARKS`` parts."""
    step = 1
    while step * MARKS < n:
        step *= 2
    return step


#: Bits of a mark and of an inner hash in a fingerprint.
MARK_BITS, INNER_BITS = 32, 48


class Fingerprint:
    """What is kept of one text.

    ``front[k]`` is the hash of its first ``(k + 1) step`` code points (the last of all
    of them), ``back[k]`` the same from the end; ``whole`` is all bits of the last,
    ``spans`` the number of different inner spans and ``inner`` the least of their hashes.
    """

    def __init__(self, n: int, step: int, whole: int, spans: int, front: list[int], back: list[int], inner: list[int]):
        self.n, self.step, self.whole, self.spans = n, step, whole, spans
        self.front, self.back, self.inner = front, back, inner

    @classmethod
    def of(cls, codes: np.ndarray) -> Fingerprint:
        n, step = len(codes), spacing(len(codes))
        sums = prefixes(codes)
        places = np.append(np.arange(step, n, step), n) if n else np.empty(0, np.int64)
        front, back = (
            (s[0][places] << 31) | s[1][places] for s in (sums, prefixes(codes[::-1]))
        )
        spans = np.unique(inner_spans(codes, sums)[1] & ((1 << INNER_BITS) - 1))
        low = (1 << MARK_BITS) - 1
        whole = int(front[-1]) if n else 0
        return cls(n, step, whole, len(spans), (front & low).tolist(), (back & low).tolist(), spans[:INNER].tolist())

    @classmethod
    def parsed(cls, text: str) -> Fingerprint:
        """Of the string that ``str`` gives."""
        n, step, whole, spans, *parts = text.split(".")
        sizes = [MARK_BITS // 4, MARK_BITS // 4, INNER_BITS // 4]
        lists = [[int(x[i : i + k], 16) for i in range(0, len(x), k)] for x, k in zip(parts, sizes, strict=True)]
        return cls(int(n), int(step), int(whole, 16), int(spans), *lists)

    def __str__(self) -> str:
        widths = (MARK_BITS // 4, MARK_BITS // 4, INNER_BITS // 4)
        lists = zip((self.front, self.back, self.inner), widths, strict=True)
        parts = ["".join(f"{m:0{w}x}" for m in x) for x, w in lists]
        return ".".join([str(self.n), str(self.step), f"{self.whole:016x}", str(self.spans), *parts])

    def likeness(self, other: Fingerprint) -> float:
        if self.n == other.n and self.whole == other.whole:
            return 1.0
        if not self.n or not other.n:
            return 0.0
        longer = max(self.n, other.n)
        ends = sum(self._extension(other, side) for side in ("front", "back"))
        ends = min(ends, min(self.n, other.n), longer - 1)
        return max(ends / longer, self._inner_share(other))

    def _extension(self, other: Fingerprint, side: str) -> int:
        """Longest common extension from one end, to the last place that both mark."""
        mine, theirs, step = getattr(self, side), getattr(other, side), max(self.step, other.step)
        a, b = step // self.step, step // other.step
        low, high = 0, (min(self.n, other.n) - 1) // step
        while low < high:
            mid = (low + high + 1) // 2
            if mine[mid * a - 1] == theirs[mid * b - 1]:
                low = mid
            else:
                high = mid - 1
        return low * step

    def _inner_share(self, other: Fingerprint) -> float:
        """Share of the inner spans of the text with more of them that the other has."""
        mine, theirs = set(self.inner), set(other.inner)
        both = sorted(mine | theirs)[:INNER]
        if not both:
            return 0.0
        jaccard = sum(x in mine and x in theirs for x in both) / len(both)
        common = jaccard * (self.spans + other.spans) / (1 + jaccard)
        return min(common / max(self.spans, other.spans), 1.0)


def row(doc_id: int | None, text: str, own: Fingerprint, after: str, following: Fingerprint):
    """The result row of one document, given the text of the next."""
    tail = len(text) // 4
    edited = text[: len(text) - tail] + after[:tail]
    new = Fingerprint.of(code_points(edited))
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    near = own.likeness(new), own.likeness(following)
    return doc_id, len(text), digest, str(own), str(new), *near


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(doc_id, is_tail, text)`` in order; the tails hold the next range's first."""
    held, closed, out = None, False, []

    def made() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
        columns = [
            pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)
        ]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in OUT.split(", ")])

    for part, texts in text_slices(batches):
        ids, tails = part.column(0).to_pylist(), part.column(1).to_pylist()
        for doc_id, is_tail, text in zip(ids, tails, texts, strict=True):
            if closed:
                break
            own = Fingerprint.of(code_points(text))
            if held is not None:
                out.append(row(*held, text, own))
            held, closed = (doc_id, text, own), is_tail
        if out:
            yield made()
            out = []


def with_next(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, is_tail, text)``, each partition a range in ascending order,
    closed by the row that follows its last."""
    spark = docs.sparkSession
    n = tasks(spark)
    least = -(1 << 63)
    keyed = docs.select(
        "doc_id", F.coalesce("doc_id", F.lit(least)).cast("bigint").alias("place"),
        F.xxhash64(empty_as()).alias("key"), "text",
    )
    shares = F.lit([i / n for i in range(1, n)] or [0.5])
    cuts = keyed.agg(F.percentile_approx("place", shares, max(10_000, 10 * n))).first()[0]
    bounds, times = np.unique(np.array(cuts or [], np.int64), return_counts=True)
    # an id that is several bounds has as many ranges of its own, by text hash
    parts = np.concatenate([[0], np.where(times > 1, times, 0)])
    offsets = np.cumsum(parts + 1) - parts - 1

    @F.pandas_udf("int")
    def range_of(place: pd.Series, key: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, place.to_numpy(), side="right")
        share = (key.to_numpy().astype(np.float64) + 2.0**63) / 2.0**64
        hot = (at > 0) & (np.append(bounds, 0)[at - 1] == place.to_numpy()) & (parts[at] > 0)
        inside = np.where(hot, np.minimum(share * parts[at], np.maximum(parts[at] - 1, 0)).astype(int), parts[at])
        return pd.Series((offsets[at] + inside).astype(np.int32))

    ranged = keyed.withColumn("range", range_of("place", "key"))
    firsts = ranged.groupBy("range").agg(F.min(F.struct("place", "key")).alias("f")).collect()  # one for each task
    filled = sorted((r.range, r.f.place, r.f.key) for r in firsts)
    tails = [(filled[i - 1][0], place, key) for i, (_, place, key) in enumerate(filled)]  # the first follows the last
    tails = F.broadcast(spark.createDataFrame(tails, "range INT, place BIGINT, key BIGINT"))
    copies = keyed.join(tails, ["place", "key"]).withColumn("is_tail", F.lit(True))
    columns = ["range", "is_tail", "place", "key", "doc_id", "text"]
    both = ranged.withColumn("is_tail", F.lit(False)).select(*columns).unionByName(copies.select(*columns))
    dealt = both.repartitionById(int(offsets[-1] + parts[-1]) + 1, F.col("range"))
    return dealt.sortWithinPartitions("is_tail", "place", "key").select(
        "doc_id", "is_tail", "text"
    )


def fingerprint(docs: DataFrame) -> DataFrame:
    """One row per document with its own, its edited text's and likeness columns."""
    return with_next(docs).mapInArrow(_rows, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(read(spark, sf_dir))
