"""Language identification by a linear-chain conditional random field.

Every word of a text is labelled.  A word's features are its affixes, its
character n-grams, itself, and the language of the lexicon it stands in; words
follow each other by learned transitions, so a word that could be of several
languages is read in its context and a text may switch.  Forward-backward gives
each word's posterior; a text's language is the one with the largest sum.

A word without blanks of any length, as in scripts that use none, is cut into pieces of
``PIECE`` characters, all of which are read and labelled.

The field is fitted in numpy on the driver, by AdaGrad on the exact likelihood,
to a bounded sample of labelled texts.  As labels are of whole texts, training
sequences are joined from runs of different texts, which shows switches.
Prediction covers whole texts of all documents; a distinct word's features are
looked up once and kept by the worker.

The prediction never sees ``lang``, ``source`` or ``doc_id``.

Cases.  A null text, or one without a letter, is ``und`` with score 0.  Equal sums
go to the first language in order.  Without labelled texts all is ``und``.  Rows
may repeat.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pageloom.llm.common import (
    WORD_SLICE_CHARS, per_text, read, run_of, sample_by_class, worker_cache,
)

UNKNOWN = "und"
#: Rows of the feature table, and characters of a piece of a word.
ROWS, PIECE = 1 << 15, 24
#: Bounds of the sample: texts of each language, code points taken of a text.
PER_CLASS, CHARS = 500, 1500
#: Words of a training sequence and least words of a run in it.
LENGTH, LEAST_RUN = 48, 4
EPOCHS, BATCH, RATE, SEED = 3, 128, 0.2, 11
#: Words of the sample that a lexicon needs to have seen, and its least share.
LEXICON_COUNT, LEXICON_SHARE = 3, 0.95
#: Distinct words whose potentials a worker keeps before it starts afresh.
KEPT = 300_000
BREAKS = bytes(
    b if b >= 128 or chr(b).isalpha() or chr(b) == "'" else 32 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    words = text.lower().encode("utf-8", "surrogatepass").translate(BREAKS).split()
    if all(len(w) <= PIECE for w in words):
        return words
    return [p for w in words for p in (pieces(w) if len(w) > PIECE else (w,))]


def pieces(word: bytes) -> list[bytes]:
    """A long word cut every ``PIECE`` characters."""
    w = word.decode("utf-8", "surrogatepass")
    return [w[i : i + PIECE].encode("utf-8", "surrogatepass") for i in range(0, len(w), PIECE)]


def has_letter(word: bytes) -> bool:
    return any(c.isalpha() for c in word.decode("utf-8", "surrogatepass"))


def features(word: bytes, lexicon: dict[bytes, int]) -> list[int]:
    """Rows of the feature table: the word, its lexicon, its affixes and all n-grams."""
    w = word.decode("utf-8", "surrogatepass")
    n = len(w)
    names = [f"={w}", f"lexicon {lexicon.get(word, -1)}"]
    names += [f"<{w[:k]}" for k in (1, 2, 3, 4) if k <= n]
    names += [f"{w[-k:]}>" for k in (1, 2, 3, 4) if k <= n]
    names += [w[i : i + 2] for i in range(n - 1)]
    names += [w[i : i + 3] for i in range(n - 2)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % ROWS for x in names]


class Rows:
    """Feature rows of many words, one word after another."""

    def __init__(self, lists: list[list[int]]):
        self.sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.fromiter((r for x in lists for r in x), np.int64, int(self.sizes.sum()))

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, starts and sizes of the chosen words, in their order."""
        sizes = self.sizes[words]
        starts = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(self.starts[words] - starts, sizes)
        return self.flat[at], starts, sizes


class Field:
    """Languages, feature weights, transitions and start weights."""

    def __init__(self, languages: list[str], lexicon: dict[bytes, int]):
        k = len(languages)
        self.languages, self.lexicon = languages, lexicon
        self.weights = np.zeros((ROWS, k))
        self.moves = np.zeros((k, k))
        self.first = np.zeros(k)

    def scores(self, lists: list[list[int]]) -> np.ndarray:
        """Log potentials of words given by their feature rows, one at least each."""
        rows = Rows(lists)
        return np.add.reduceat(self.weights[rows.flat], rows.starts, axis=0)

    def marginals(self, potentials: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Posterior of every word by forward-backward, over whole sequences.

        ``potentials`` holds the sequences one after another.  All sequences that
        are long enough take a step together.
        """
        k = len(self.languages)
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        starts = (np.cumsum(lengths) - lengths)[order]
        steps = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # sequences past step t
        local = np.exp(potentials - potentials.max(1, keepdims=True))
        moves = np.exp(self.moves)
        forward = np.empty_like(local)
        now = np.exp(self.first)[None, :].repeat(len(sizes), 0)
        for t in range(steps):
            at = starts[: active[t]] + t
            now = (now[: active[t]] @ moves if t else now[: active[t]]) * local[at]
            now /= now.sum(1, keepdims=True)
            forward[at] = now
        after = np.ones((len(sizes), k))
        for t in range(steps - 1, -1, -1):
            m = active[t]
            at = starts[:m] + t
            own = after[:m]
            forward[at] *= own
            back = (own * local[at]) @ moves.T
            after[:m] = back / back.sum(1, keepdims=True)
        return forward / forward.sum(1, keepdims=True)

    def fit(self, table: Rows, words: np.ndarray, labels: np.ndarray) -> None:
        """One AdaGrad pass over sequences ``(sequence, place)`` of words of ``table``.

        The gradient of the log likelihood is observed minus expected counts, of
        features and of moves, by forward-backward.
        """
        k = len(self.languages)
        n = words.shape[1]
        eye = np.eye(k)
        for i in range(0, len(words), BATCH):
            own, gold = words[i : i + BATCH], labels[i : i + BATCH]
            b = len(own)
            rows, starts, sizes = table.of(own.ravel())
            scores = np.add.reduceat(self.weights[rows], starts, axis=0).reshape(b, n, k)
            local = np.exp(scores - scores.max(2, keepdims=True))
            moves = np.exp(self.moves)
            a, z = np.empty((n, b, k)), np.empty((n, b, 1))
            now = np.exp(self.first) * local[:, 0]
            for t in range(n):
                if t:
                    now = (a[t - 1] @ moves) * local[:, t]
                z[t] = now.sum(1, keepdims=True)
                a[t] = now / z[t]
            d_moves = np.zeros((k, k))
            after = np.ones((b, k))
            post = np.empty((b, n, k))
            for t in range(n - 1, -1, -1):
                post[:, t] = a[t] * after
                if t:
                    right = after * local[:, t] / z[t]
                    d_moves -= moves * (a[t - 1].T @ right)
                    after = right @ moves.T
            post /= post.sum(2, keepdims=True)
            d_local = (eye[gold] - post) / b
            np.add.at(d_moves, (gold[:, :-1], gold[:, 1:]), 1)
            d_first = d_local[:, 0].sum(0)
            d_weights = np.zeros_like(self.weights)
            flat_d = d_local.reshape(-1, k)
            for lang in range(k):
                d_weights[:, lang] = np.bincount(rows, np.repeat(flat_d[:, lang], sizes), ROWS)
            steps = (d_weights, d_moves / b, d_first)
            for x, d, s in zip((self.weights, self.moves, self.first), steps, self.sums, strict=True):
                s += d * d
                x += RATE * d / np.sqrt(s + 1e-8)

    def train(self, texts: list[list[bytes]], labels: list[int], seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.sums = [np.zeros_like(x) for x in (self.weights, self.moves, self.first)]
        known: dict[bytes, int] = {}
        coded = [[known.setdefault(w, len(known)) for w in t] for t in texts]
        table = Rows([features(w, self.lexicon) for w in known])
        for _ in range(EPOCHS):
            self.fit(table, *joined_runs(coded, labels, rng))
        del self.sums


def joined_runs(texts: list, labels: list[int], rng) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of ``LENGTH`` words joined from runs of texts in random order."""
    runs = []
    for text, label in zip(texts, labels, strict=True):
        at = 0
        while at < len(text):
            size = int(rng.integers(LEAST_RUN, LENGTH + 1))
            runs.append((text[at : at + size], label))
            at += size
    order = rng.permutation(len(runs))
    words = [w for i in order for w in runs[i][0]]
    gold = [runs[i][1] for i in order for _ in runs[i][0]]
    if words and len(words) < LENGTH:
        words, gold = (x * (LENGTH // len(words) + 1) for x in (words, gold))
    n = len(words) // LENGTH
    shape = (n, LENGTH)
    return (
        np.array(words[: n * LENGTH], np.int64).reshape(shape),
        np.array(gold[: n * LENGTH], np.int64).reshape(shape),
    )


def lexicon_of(texts: list[list[bytes]], labels: list[int], k: int) -> dict[bytes, int]:
    """The words that the sample shows often enough and nearly always in one language."""
    seen: dict[bytes, Counter] = {}
    for text, label in zip(texts, labels, strict=True):
        for w in text:
            seen.setdefault(w, Counter())[label] += 1
    out = {}
    for w, counts in seen.items():
        label, most = counts.most_common(1)[0]
        if most >= LEXICON_COUNT and most >= LEXICON_SHARE * counts.total():
            out[w] = label
    return out


class Potentials:
    """Log potentials of words met before; lives as long as the worker."""

    def __init__(self, field: Field):
        self.field = field
        self.place: dict[bytes, int] = {}
        self.table = np.empty((0, len(field.languages)))
        self.letters = np.empty(0, bool)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(potentials, has a letter)`` of distinct words."""
        if len(self.place) > KEPT:
            self.__init__(self.field)
        known = len(self.place)
        at = np.fromiter(
            (self.place.setdefault(w, len(self.place)) for w in words), np.int64, len(words)
        )
        new = [words[i] for i in np.flatnonzero(at >= known).tolist()]
        if new:
            lists = [features(w, self.field.lexicon) for w in new]
            self.table = np.concatenate([self.table, self.field.scores(lists)])
            letters = np.fromiter(map(has_letter, new), bool, len(new))
            self.letters = np.concatenate([self.letters, letters])
        return self.table[at], self.letters[at]


def predict(field: Field, name: str, texts: list[str]) -> dict:
    """``lang_pred`` and ``score`` of whole texts."""
    kept = worker_cache(f"crf {name}", lambda: Potentials(field))
    lists = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    words = np.empty(sizes.sum(), object)
    words[:] = [w for x in lists for w in x]
    codes, distinct = pd.factorize(words)
    k = len(field.languages)
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if k and len(codes):
        table, letters = kept.of(list(distinct))
        owner = np.repeat(np.arange(len(texts)), sizes)
        real = letters[codes]
        codes, owner = codes[real], owner[real]
        counts = np.bincount(owner, minlength=len(texts))
        full = np.flatnonzero(counts)
        if len(full):
            post = field.marginals(table[codes], counts[full])
            starts = np.cumsum(counts[full]) - counts[full]
            mean = np.add.reduceat(post, starts, axis=0) / counts[full][:, None]
            best = mean.argmax(1)
            scores[full] = np.minimum(mean[np.arange(len(full)), best], 1.0)
            for i, b in zip(full.tolist(), best.tolist(), strict=True):
                langs[i] = field.languages[b]
    return {"lang_pred": langs, "score": scores}


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def fit(labelled: DataFrame) -> Field:
    """A field fitted to a bounded sample of ``labelled(doc_id, text, lang)``."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.select("doc_id", "lang", run_of("text", CHARS).alias("text"))
    sample = sorted(
        (r.lang, r.text) for r in sample_by_class(rows, "lang", "doc_id", PER_CLASS).collect()
    )
    languages = sorted({lang for lang, _ in sample})
    texts = [[w for w in words_of(t) if has_letter(w)] for _, t in sample]
    labels = [languages.index(lang) for lang, _ in sample]
    field = Field(languages, lexicon_of(texts, labels, len(languages)))
    if any(texts):
        field.train(texts, labels)
    return field


def label_words(field: Field, text: str) -> list[tuple[str, str, float]]:
    """Every word of a text with its language and posterior."""
    words = [w for w in words_of(text) if has_letter(w)]
    if not words or not field.languages:
        return []
    lists = [features(w, field.lexicon) for w in words]
    post = field.marginals(field.scores(lists), np.array([len(words)]))
    best = post.argmax(1)
    return [
        (w.decode("utf-8", "surrogatepass"), field.languages[b], float(p[b]))
        for w, b, p in zip(words, best, post, strict=True)
    ]


def identify(docs: DataFrame, field: Field, keep: list[str]) -> DataFrame:
    """``keep``, ``lang_pred`` and ``score`` for every row."""
    name = f"{zlib.crc32(field.weights.tobytes())}"
    return per_text(
        docs, keep, "lang_pred STRING, score DOUBLE",
        lambda texts: predict(field, name, texts), 2 * WORD_SLICE_CHARS,
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir)
    field = fit(docs.where(~held_out()))
    found = identify(docs, field, ["doc_id"])
    held = F.coalesce(held_out(), F.lit(False)).alias("held_out")
    return found.select("doc_id", held, "lang_pred", "score")
