"""Quality rules: a base rule, then robust multivariate outliers.

Counts of a text's words, lines and characters are turned into a vector of
transformed statistics.  For every language and source the minimum covariance
determinant estimate is found: the mean and covariance of the share ``COVERED``
of vectors that lie closest together.  Documents too far from the mean of their
group, by Mahalanobis distance, are rejected.

The estimate is found by concentration steps from two starts (medians and median
deviations; plain mean and covariance), all groups at once: distances from the
present estimate, the closest share by a histogram of distances, its moments.  Each
step is one aggregation over the narrow vectors of all documents that passed the
base rule; the start with the smaller determinant wins.

Size.  Histogram cells carry the moments, so rows are reduced before the only
shuffle and a group that holds a third of all rows costs as much as any other.
Groups stay in tables; nothing is gathered per group or on the driver.  Groups of
fewer than ``LEAST_ROWS`` are pooled by language, then in one pool; if even that
is too small the base rule alone decides.

Cases.  A null or empty text has no words and fails the base rule.  Null languages
or sources are values like any other.  A statistic without spread in its group is
given the spread in ``FLOORS``.  Rows may repeat and are counted as often.  An
empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pageloom.llm import text_stats
from pageloom.llm.common import WORD_SLICE_CHARS, per_text, read, stored

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Share of a group that the estimate covers, steps, and rows a group needs.
COVERED, STEPS, LEAST_ROWS = 0.75, 6, 60
#: Chance that a vector of a normal group is rejected.
ALPHA = 1e-6
#: Cells of the histogram for each doubling of the distance.
CELLS = 8
#: Transformed statistics (see ``statistics``) and the least spread (standard deviation) of each.
FLOORS = {
    "word_length": 0.05, "symbols": 0.25, "dup_lines": 0.35, "repeats": 0.35, "stops": 0.25,
    "capitals": 0.3,
}
P = len(FLOORS)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def statistics() -> list[Column]:
    """The vector, in the order of ``FLOORS``."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return [
        F.log(chars / words),
        F.log(0.05 + F.col("n_symbols") / words),
        F.log(0.1 + F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.log(0.1 + F.col("n_repeat_words") / words),
        F.log(0.05 + F.col("n_stops") / words),
        F.log(0.02 + F.col("n_upper") / chars),
    ]


def base_failed() -> Column:
    repeats = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    return (F.col("n_words") < MIN_WORDS) | repeats


def chi_square(p: int, share: float) -> float:
    """The value below which a chi-square variable of ``p`` degrees has ``share``."""

    def below(x: float) -> float:  # regularised lower gamma, by its series
        a, z = p / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= z / n
            total += term
        return total * math.exp(a * math.log(z) - z - math.lgamma(a)) if z else 0.0

    low, high = 0.0, 20.0 * p + 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < share else (low, mid)
    return high


# -- groups -------------------------------------------------------------------------


def _key() -> Column:
    parts = [F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in ("lang", "source")]
    return F.to_json(F.array(*parts))


def with_pool(stats: DataFrame) -> DataFrame:
    """``stats`` with ``pool``, the group whose estimate a row is measured by."""
    sizes = stats.where(~F.col("base_failed")).groupBy("lang", "source").count()
    small = F.col("count") < LEAST_ROWS
    lang = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))
    by_lang = sizes.where(small).groupBy(lang.alias("of")).agg(F.sum("count").alias("pooled"))
    pools = sizes.withColumn("of", lang).join(by_lang, "of", "left").select(
        _key().alias("key"),
        F.when(~small, F.concat(F.lit("g"), _key()))
        .when(F.col("pooled") >= LEAST_ROWS, F.concat(F.lit("l"), "of"))
        .otherwise("all").alias("pool"),
    )
    return stats.withColumn("key", _key()).join(pools, "key", "left").drop("key")


# -- concentration ------------------------------------------------------------------


def _estimates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Moments of groups to means, inverse covariances and log determinants."""
    floors = np.diag(np.square(list(FLOORS.values())))
    for frame in frames:
        rows = []
        for r in frame.itertuples(index=False):
            n = r.n
            mean = np.array([getattr(r, f"s{i}") for i in range(P)]) / n
            cov = np.zeros((P, P))
            for i, j in PAIRS:
                cov[i, j] = cov[j, i] = getattr(r, f"q{i}_{j}") / n - mean[i] * mean[j]
            cov += floors
            inverse = np.linalg.inv(cov)
            flat = [inverse[i, j] * (1 if i == j else 2) for i, j in PAIRS]
            rows.append((r.pool, r.start, mean.tolist(), flat, float(np.linalg.slogdet(cov)[1])))
        yield pd.DataFrame(rows, columns=["pool", "start", "m", "q", "logdet"])


MODEL = "pool STRING, start INT, m ARRAY<DOUBLE>, q ARRAY<DOUBLE>, logdet DOUBLE"


def distance() -> Column:
    """Squared Mahalanobis distance of ``x0..`` from the estimate ``m, q``."""
    d = [F.col(f"x{i}") - F.col("m")[i] for i in range(P)]
    total = F.lit(0.0)
    for k, (i, j) in enumerate(PAIRS):
        total = total + d[i] * d[j] * F.col("q")[k]
    return F.greatest(total, F.lit(0.0))


def _cell(d: Column) -> Column:
    return F.floor(F.log2(d + 1e-6) * CELLS).cast("int")


def _moments() -> list[Column]:
    x = [F.col(f"x{i}") for i in range(P)]
    return [
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.sum(x[i]).alias(f"s{i}") for i in range(P)],
        *[F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i, j in PAIRS],
    ]


def _closest(cells: DataFrame) -> DataFrame:
    """The cells of each group, from the smallest distance, that make up its share."""
    w = Window.partitionBy("pool", "start")
    run = w.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(run), F.lit(0.0))
    return cells.withColumns({"before": before, "all": F.sum("n").over(w)}).where(
        F.col("before") < COVERED * F.col("all")
    )


def concentrate(vectors: DataFrame, model: DataFrame) -> DataFrame:
    """One step: the estimate of the share closest to ``model``."""
    cells = (
        vectors.join(model.select("pool", "start", "m", "q"), "pool")
        .groupBy("pool", "start", _cell(distance()).alias("cell")).agg(*_moments())
    )
    summed = [F.sum(c).alias(c) for c in cells.columns[3:]]
    return _closest(cells).groupBy("pool", "start").agg(*summed).mapInPandas(_estimates, MODEL)


def starts(vectors: DataFrame) -> DataFrame:
    """Two first estimates of each group."""
    plain = vectors.groupBy("pool", F.lit(0).alias("start")).agg(*_moments())
    plain = plain.mapInPandas(_estimates, MODEL)
    middle = vectors.groupBy("pool").agg(
        F.array(*[F.percentile_approx(f"x{i}", 0.5, 1000) for i in range(P)]).alias("m")
    )
    off = vectors.join(middle, "pool").groupBy("pool").agg(
        F.first("m").alias("m"),
        *[
            F.percentile_approx(F.abs(F.col(f"x{i}") - F.col("m")[i]), 0.5, 1000).alias(f"d{i}")
            for i in range(P)
        ],
    )
    floors = list(FLOORS.values())
    # 1.4826: the median deviation of a normal variable to its standard deviation
    inverse = [
        1 / ((1.4826 * F.col(f"d{i}")) ** 2 + floors[i] ** 2) if i == j else F.lit(0.0)
        for i, j in PAIRS
    ]
    robust = off.select(
        "pool", F.lit(1).alias("start"), "m", F.array(*inverse).alias("q"),
        F.lit(0.0).alias("logdet"),
    )
    return plain.unionByName(robust)


def estimate(vectors: DataFrame) -> DataFrame:
    """``(pool, m, q, scale)``: the estimate of each group, and the factor that its
    distances are divided by to fit a chi-square variable."""
    sizes = vectors.groupBy("pool").count().where(F.col("count") >= LEAST_ROWS)
    vectors = stored(vectors.join(sizes.select("pool"), "pool", "left_semi"), "vectors")
    model = stored(starts(vectors), "estimate")
    for _ in range(STEPS):
        model = stored(concentrate(vectors, model), "estimate")
    least = F.min(F.struct("logdet", "start", "m", "q")).alias("b")
    best = model.groupBy("pool").agg(least).select("pool", "b.start", "b.m", "b.q")
    best = stored(best, "estimate")
    cells = (
        vectors.join(best, "pool")
        .groupBy("pool", "start", _cell(distance()).alias("cell"))
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    edge = _closest(cells).groupBy("pool").agg(F.max("cell").alias("edge"))
    covered = F.pow(F.lit(2.0), (F.col("edge") + 1) / CELLS)
    scale = F.greatest(F.lit(1.0), covered / chi_square(P, COVERED))
    return best.join(edge, "pool").select("pool", "m", "q", scale.alias("scale"))


def judge(docs: DataFrame) -> DataFrame:
    """Counts, verdicts and ``distance`` (null where no estimate applies) of every row."""
    ddl = ", ".join(f"{c} BIGINT" for c in text_stats.COLUMNS)
    counts = per_text(
        docs, ["doc_id", "lang", "source"], ddl, text_stats.counted, WORD_SLICE_CHARS
    )
    stats = stored(counts.withColumn("base_failed", base_failed()), "counts")
    pooled = with_pool(stats).withColumns({f"x{i}": x for i, x in enumerate(statistics())})
    passed = pooled.where(~F.col("base_failed")).select("pool", *[f"x{i}" for i in range(P)])
    model = stored(estimate(passed), "estimate")
    measured = pooled.join(model, "pool", "left").withColumn(
        "distance", F.sqrt(distance() / F.col("scale"))
    )
    far = F.coalesce(F.col("distance") > math.sqrt(chi_square(P, 1 - ALPHA)), F.lit(False))
    return measured.withColumn("kept", ~F.col("base_failed") & ~far)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "distance",
    )
