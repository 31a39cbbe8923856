"""Toxicity by a small convolutional text classifier, thresholds by language.

A word's embedding is the sum of the rows that the word and its first letters are
hashed to, so inflected forms share most of it.  Filters of several widths run
over the embeddings, each filter's largest response in the text is kept, and a
logistic unit turns these into a score.  The network is trained in numpy on the
driver, with Adam, on a bounded sample of labelled texts; everything else covers
whole texts of all documents.  A convolution is a sum of one product for each
place in the filter, so products are made once for each distinct word.

The score never sees labels, language, source or ``doc_id``.  Scores are moved on
the logistic scale so that 0.5 is the best cut over all languages; then for each
language with enough labelled texts a threshold of its own is set (``flagged`` uses
it, ``predicted`` the common 0.5).  All cuts are set on the whole texts of all
labelled rows the network was not fitted to: Spark scores them and counts logits in
steps of ``1 / STEPS`` by language and label, which bounds what the driver sees at
any size.  The counts are weighted back to the shares of all labelled rows, as
fitted rows are missing from one label more than from the other.

Cases.  A null, empty or wordless text scores by the bias alone.  A null language
has the common threshold.  Without labels of both kinds every score is the share
of label 1 (0 without labels).  Rows may repeat.  An empty table gives an empty
result.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.llm.common import (
    SLICE_CHARS, per_text, read, run_of, sample_by_class, slices, stored
)
from pageloom.operators.sized import is_small
from pageloom.session import keep_batches_small

#: Rows of the embedding table and their width; filter widths and filters of each.
ROWS, WIDTH, SPANS, FILTERS = 1 << 14, 12, (1, 2, 3), 8
#: Bounds of the training sample: texts of each label, and code points taken of a text
#: (a run that starts at a place drawn from its hash).
PER_CLASS, CHARS = 4000, 8000
EPOCHS, BATCH, RATE, SEED = 8, 64, 0.015, 7
#: Networks trained from different starts; the best on the texts left out is kept.
TRIES = 4
#: Labelled texts of both kinds a language needs for a threshold of its own, half of
#: them left out of the fit.
LEAST_LABELLED = 40
#: Logits are counted in so many steps a unit; cuts are set between steps.
STEPS = 64
#: Bytes of punctuation and digits are breaks between words.
BREAKS = bytes(
    b if b >= 128 or chr(b).isalpha() or chr(b) == "'" else 32 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(BREAKS).split()


def buckets(words: list[bytes]) -> np.ndarray:
    """Rows ``(words, 3)`` of the table: the word, its first four and six bytes."""
    crc = zlib.crc32
    rows = [(crc(w), crc(w[:4], 4), crc(w[:6], 6)) for w in words]
    return np.array(rows, np.int64).reshape(-1, 3) % ROWS


class Network:
    """Embedding table, filters ``(span, place, width, filter)`` and output unit."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.1, (ROWS, WIDTH)).astype(np.float32)
        self.filters = [
            rng.normal(0, (1 / (k * WIDTH)) ** 0.5, (k, WIDTH, FILTERS)).astype(np.float32)
            for k in SPANS
        ]
        self.shift = [np.zeros(FILTERS, np.float32) for _ in SPANS]
        self.out = rng.normal(0, 0.1, FILTERS * len(SPANS)).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.table, *self.filters, *self.shift, self.out, self.bias]

    def pooled(self, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids=None):
        """Largest responses ``(texts, filters)`` and where they were found.

        ``rows`` are table rows of the words of all texts in one run, or of the
        distinct words if ``ids`` says which of them the run consists of.  A span
        that reaches past its text's end is read as zeros there.
        """
        table = self.table[rows].sum(1)
        training = ids is None
        ids = np.arange(len(rows)) if training else ids
        full = np.flatnonzero(sizes)
        n = len(ids)
        left = np.repeat(starts + sizes, sizes) - np.arange(n)  # words to the text's end
        values = np.zeros((len(starts), FILTERS * len(SPANS)), np.float32)
        places = np.full(values.shape, -1, np.int64)
        for s, span in enumerate(SPANS):
            total = np.tile(self.shift[s], (n, 1))
            for k in range(span):
                part = (table @ self.filters[s][k])[ids[k:]]
                if k:
                    part[left[: n - k] <= k] = 0
                total[: n - k] += part
            if len(full):
                block = slice(FILTERS * s, FILTERS * (s + 1))
                most = np.maximum.reduceat(total, starts[full], axis=0)
                values[full, block] = np.maximum(most, 0)
                if training:
                    for i, t in enumerate(full):
                        own = total[starts[t] : starts[t] + sizes[t]]
                        at = own.argmax(0)
                        places[t, block] = np.where(most[i] > 0, starts[t] + at, -1)
        return values, places

    def logits(self, values: np.ndarray) -> np.ndarray:
        return (values * self.out).sum(1) + self.bias[0]

    def fit_batch(self, rows, starts, sizes, labels, weights) -> list[np.ndarray]:
        """Gradients of the weighted log loss, in the order of ``parameters``."""
        values, places = self.pooled(rows, starts, sizes)
        p = 1 / (1 + np.exp(-self.logits(values)))
        error = ((p - labels) * weights / weights.sum()).astype(np.float32)
        grads = [np.zeros_like(x) for x in self.parameters()]
        d_table, rest = grads[0], grads[1:]
        ends = starts + sizes
        for s, span in enumerate(SPANS):
            for f in range(FILTERS):
                col = FILTERS * s + f
                hit = np.flatnonzero(places[:, col] >= 0)
                d = error[hit] * self.out[col]
                rest[len(SPANS) + s][f] = d.sum()
                for k in range(span):
                    at = places[hit, col] + k
                    ok = at < ends[hit]
                    own = rows[at[ok]]
                    rest[s][k, :, f] += (self.table[own].sum(1) * d[ok, None]).sum(0)
                    np.add.at(d_table, own, (d[ok, None] * self.filters[s][k][:, f])[:, None])
        rest[-2][:] = (values * error[:, None]).sum(0)
        rest[-1][:] = error.sum()
        return grads


def flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    ids = np.concatenate(lists).astype(np.int64) if lists else np.empty((0, 3), np.int64)
    return ids, np.cumsum(sizes) - sizes, sizes


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = SEED) -> Network:
    """Adam over shuffled batches; both labels weigh the same in total."""
    net, rng = Network(seed), np.random.default_rng(seed)
    ones = max(labels.mean(), 1e-9)
    weights = np.where(labels == 1, 0.5 / ones, 0.5 / max(1 - ones, 1e-9))
    first = [np.zeros_like(x) for x in net.parameters()]
    second = [np.zeros_like(x) for x in net.parameters()]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            chosen = order[i : i + BATCH]
            batch = flat([texts[j] for j in chosen])
            grads = net.fit_batch(*batch, labels[chosen], weights[chosen])
            step += 1
            rate = RATE * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for x, g, m, v in zip(net.parameters(), grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= rate * m / (np.sqrt(v) + 1e-8)
    return net


def ranking(scores: np.ndarray, labels: np.ndarray) -> float:
    """Share of pairs of unlike labels that the scores put in the right order."""
    ranks = pd.Series(scores).rank().to_numpy()
    ones = labels == 1
    n, m = int(ones.sum()), int((~ones).sum())
    return (ranks[ones].sum() - n * (n + 1) / 2) / max(1, n * m)


def best_cut(high: np.ndarray, low: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> float:
    """The cut between two neighbouring steps with the best F1 of label 1.

    Of each step the greatest and the least logit and the weights of both labels.
    """
    order = np.argsort(-high, kind="stable")
    high, low, ones, zeros = (x[order] for x in (high, low, ones, zeros))
    f1 = 2 * np.cumsum(ones) / (np.cumsum(ones + zeros) + ones.sum())
    i = int(f1.argmax())
    return float((low[i] + (high[i + 1] if i + 1 < len(high) else low[i] - 1)) / 2)


class Model:
    """A trained network, the common cut and the cuts by language (on logits)."""

    def __init__(self, network: Network | None, cut: float, by_language: dict[str, float]):
        self.network, self.cut, self.by_language = network, cut, by_language

    def logits(self, texts: list[str]) -> np.ndarray:
        if self.network is None:
            return np.zeros(len(texts))
        lists = [words_of(t) for t in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        words = np.empty(sizes.sum(), object)
        words[:] = [w for x in lists for w in x]
        codes, distinct = pd.factorize(words)
        rows = buckets(list(distinct))
        starts = np.cumsum(sizes) - sizes
        values, _ = self.network.pooled(rows, starts, sizes, codes)
        return self.network.logits(values).astype(float)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(self.cut - self.logits(texts)))

    def threshold(self, language: str | None) -> float:
        """On the scale of scores."""
        return 1 / (1 + np.exp(self.cut - self.by_language.get(language, self.cut)))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def step_counts(docs: DataFrame, known: DataFrame, network: Network) -> pd.DataFrame:
    """``(lang, toxic, n, high, low)`` of every filled step of the logits of ``known``.

    Languages without ``LEAST_LABELLED / 2`` rows of both labels come as one, "".
    """
    model = Model(network, 0.0, {})

    def logits(rows: DataFrame, keep: list[str]) -> DataFrame:
        return per_text(
            rows, keep, "logit DOUBLE", lambda texts: {"logit": model.logits(texts)}, SLICE_CHARS
        )

    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    if is_small(known):
        judged = logits(rows.join(F.broadcast(known), "doc_id"), ["lang", "toxic"])
    else:  # texts stay where they are, all of them are scored
        judged = logits(rows, ["doc_id", "lang"]).join(known, "doc_id")
    steps = judged.groupBy("lang", "toxic", F.floor(F.col("logit") * STEPS).alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.max("logit").alias("high"), F.min("logit").alias("low")
    )
    steps = stored(steps, "steps")
    ones, zeros = (F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0)) for t in (1, 0))
    large = steps.groupBy("lang").agg(ones.alias("ones"), zeros.alias("zeros"))
    large = large.where((F.least("ones", "zeros") >= LEAST_LABELLED / 2) & (F.col("lang") != ""))
    named = F.col("lang").isin([r.lang for r in large.select("lang").collect()])
    few = steps.withColumn("lang", F.when(named, F.col("lang")).otherwise(""))
    few = few.groupBy("lang", "toxic", "step").agg(
        F.sum("n").alias("n"), F.max("high").alias("high"), F.min("low").alias("low")
    )
    return few.toArrow().to_pandas()


def cuts_of(steps: pd.DataFrame, fitted: pd.DataFrame) -> tuple[float, dict[str, float]]:
    """The common cut and those by language.

    ``fitted`` is ``(lang, toxic)`` of the rows that are missing from ``steps``:
    each language and label weighs as much as all its rows.
    """
    names = {*steps.lang} - {""}
    fitted = fitted.assign(lang=fitted.lang.where(fitted.lang.isin(names), ""))
    missing = fitted.groupby(["lang", "toxic"]).size()
    there = steps.groupby(["lang", "toxic"]).n.sum()
    weight = 1 + missing.reindex(there.index, fill_value=0) / there
    n = steps.n * weight.reindex(pd.MultiIndex.from_frame(steps[["lang", "toxic"]])).to_numpy()
    steps = steps.assign(step=np.floor(steps.low * STEPS), one=n * steps.toxic, zero=n - n * steps.toxic)

    def cut(own: pd.DataFrame) -> float:
        by = own.groupby("step").agg({"high": "max", "low": "min", "one": "sum", "zero": "sum"})
        return best_cut(*(by[c].to_numpy() for c in by.columns))

    return cut(steps), {name: cut(steps[steps.lang == name]) for name in sorted(names)}


def left_out(rows: pd.DataFrame) -> np.ndarray:
    """Which rows ``(doc_id, lang, toxic)`` of the sample are not fitted.

    A quarter of each language and label, by a hash of ``doc_id``; of
    ``LEAST_LABELLED`` rows or more so many as a threshold needs.
    """
    drawn = rows.assign(at=[zlib.crc32(f"cut {i}".encode()) for i in rows.doc_id])
    groups = drawn.groupby(["lang", "toxic"]).at
    size = groups.transform("size")
    count = np.where(size >= LEAST_LABELLED, np.maximum(size // 4, LEAST_LABELLED // 2), size // 4)
    return (groups.rank(method="max") <= count).to_numpy()


def fit(docs: DataFrame, labels: DataFrame, usable: Callable[[], F.Column] | None = None) -> Model:
    """Trains on a bounded sample of labelled rows (``usable`` ones, if given).

    About three of four sampled texts are fitted, the others choose the network;
    all labelled rows that are not fitted set the cuts.
    """
    spark = docs.sparkSession
    keep_batches_small(spark)
    known = labels.where("toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int"))
    if usable:
        known = known.where(usable())
    known = stored(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "known")
    chosen = sample_by_class(known, "toxic", "doc_id", PER_CLASS)
    sample = (
        docs.select("doc_id", run_of("text", CHARS).alias("text"), "lang")
        .join(F.broadcast(chosen), "doc_id")  # at most 4 * PER_CLASS rows
        .limit(4 * PER_CLASS).orderBy("doc_id")
    )
    rows, texts = [], []
    for r in sample.toLocalIterator():  # texts go as soon as their words are rows
        rows.append((r.doc_id, r.lang or "", r.toxic))
        texts.append(buckets(words_of(r.text or "")).astype(np.uint16))  # ROWS fit
    y = np.array([toxic for _, _, toxic in rows], float)
    if not 0 < y.sum() < len(y):
        share = y.mean() if len(y) else 0.0
        share = min(max(share, 1e-12), 1 - 1e-12)
        return Model(None, -float(np.log(share / (1 - share))), {})
    gone = pd.DataFrame({
        "doc_id": [i for i, _, _ in rows], "lang": [lang for _, lang, _ in rows], "toxic": y.astype(int),
    })
    fitted = ~left_out(gone)
    if len({*y[fitted]}) < 2 or len({*y[~fitted]}) < 2:
        fitted[:] = True
    checked = ~fitted if not fitted.all() else fitted
    learned = [t for t, f in zip(texts, fitted, strict=True) if f]
    own = [t for t, c in zip(texts, checked, strict=True) if c]
    best = None
    for i in range(TRIES):
        net = train(learned, y[fitted], SEED + i)
        pieces = (own[j : j + BATCH] for j in range(0, len(own), BATCH))
        logits = np.concatenate([net.logits(net.pooled(*flat(x))[0]) for x in pieces]).astype(float)
        quality = ranking(logits, y[checked])
        if best is None or quality > best[0]:
            best = quality, net
    _, net = best
    if fitted.all():  # too few rows to leave any out
        return Model(net, *cuts_of(step_counts(docs, known, net), gone[:0]))
    ids = sorted({i for (i, _, _), f in zip(rows, fitted, strict=True) if f})
    seen = spark.createDataFrame([(i,) for i in ids], known.select("doc_id").schema)
    left = stored(known.join(F.broadcast(seen), "doc_id", "left_anti"), "left")
    return Model(net, *cuts_of(step_counts(docs, left, net), gone[fitted]))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` and ``score`` for every row."""
    return per_text(
        docs, keep, "score DOUBLE", lambda texts: {"score": model.scores(texts)}, SLICE_CHARS
    )


def threshold(model: Model, language: str = "lang") -> F.Column:
    """The threshold of a row's language, as a column."""
    out = F.lit(float(model.threshold(None)))
    for name in sorted(model.by_language):
        out = F.when(F.col(language) == name, float(model.threshold(name))).otherwise(out)
    return out


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that reach the threshold of their language.

    Only texts go to Python and only scores come back.
    """
    keep_batches_small(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        parts = [
            model.scores(own) for own in slices([t or "" for t in texts], SLICE_CHARS)
        ]
        return pd.Series(np.concatenate([np.empty(0), *parts]))

    return docs.where(scored("text") < threshold(model))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir)
    model = fit(docs, read(spark, sf_dir, "labels"), lambda: ~held_out())
    scored = score(docs, model, ["doc_id", "lang"])
    return scored.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        (F.col("score") >= threshold(model)).cast("int").alias("flagged"),
    )
