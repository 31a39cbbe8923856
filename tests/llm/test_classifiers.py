import itertools
import random
import zlib

import numpy as np
import pandas as pd

from pageloom.llm import crf, toxicity
from tests.conftest import SF_DIR


def small_field(seed=0):
    rng = np.random.default_rng(seed)
    field = crf.Field(["aa", "bb", "cc"], {})
    field.moves, field.first = rng.normal(size=(3, 3)), rng.normal(size=3)
    return field, rng


def test_marginals_match_all_paths():
    field, rng = small_field()
    lengths = np.array([4, 1, 5, 2])
    local = rng.normal(size=(lengths.sum(), 3))
    got = field.marginals(local, lengths)
    at = 0
    for n in lengths:
        own, post = local[at : at + n], np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            s = field.first[path[0]] + sum(own[t, y] for t, y in enumerate(path))
            s += sum(field.moves[a, b] for a, b in itertools.pairwise(path))
            for t, y in enumerate(path):
                post[t, y] += np.exp(s)
        assert np.allclose(got[at : at + n], post / post.sum(1, keepdims=True))
        at += n


def test_step_is_the_gradient_of_the_likelihood(monkeypatch):
    field, rng = small_field(1)
    monkeypatch.setattr(crf, "RATE", 1.0)
    table = crf.Rows([rng.integers(0, crf.ROWS, size=rng.integers(2, 30)).tolist() for _ in range(9)])
    words = rng.integers(0, 9, size=(2, 6))
    rows = [[table.of(np.array([w]))[0] for w in own] for own in words]
    gold = rng.integers(0, 3, size=(2, 6))

    def loss(moves):
        total = 0.0
        for r, y in zip(rows, gold, strict=True):
            local = np.array([field.weights[x].sum(0) for x in r])
            a = field.first + local[0]
            for t in range(1, 6):
                a = np.logaddexp.reduce(a[:, None] + moves, axis=0) + local[t]
            s = field.first[y[0]] + local[range(6), y].sum() + moves[y[:-1], y[1:]].sum()
            total += s - np.logaddexp.reduce(a)
        return total / 2

    before = field.moves.copy()
    numeric = np.zeros((3, 3))
    for i, j in np.ndindex(3, 3):
        e = np.zeros((3, 3))
        e[i, j] = 1e-5
        numeric[i, j] = (loss(before + e) - loss(before - e)) / 2e-5
    field.sums = [np.zeros_like(x) for x in (field.weights, field.moves, field.first)]
    field.fit(table, words, gold)
    # AdaGrad's first step divides each entry by its own size
    assert np.allclose(field.moves - before, numeric / np.sqrt(numeric**2 + 1e-8), atol=1e-4)


def test_languages_are_found_on_texts_held_out(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = crf.query(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def plain_prediction(field, text):
    """One text, word by word: a sum over features, and all moves, without batches."""
    words = [w for w in crf.words_of(text or "") if crf.has_letter(w)]
    if not words:
        return "und", 0.0
    local = [sum(field.weights[r] for r in crf.features(w, field.lexicon)) for w in words]
    forward = [field.first + local[0]]
    for own in local[1:]:
        forward.append(np.logaddexp.reduce(forward[-1][:, None] + field.moves, axis=0) + own)
    back = [np.zeros(len(field.languages))]
    for own in local[:0:-1]:
        back.append(np.logaddexp.reduce(field.moves + own + back[-1], axis=1))
    logs = np.array(forward) + np.array(back[::-1])
    post = np.exp(logs - np.logaddexp.reduce(logs, axis=1)[:, None])
    mean = post.mean(0)
    return field.languages[int(mean.argmax())], float(mean.max())


def test_languages_are_those_of_one_text_after_the_other(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    field = crf.fit(docs.where(~crf.held_out()))
    got = {r.doc_id: (r.lang_pred, r.score) for r in crf.identify(docs, field, ["doc_id"]).collect()}
    for r in docs.collect():
        lang, score = plain_prediction(field, r.text)
        assert got[r.doc_id][0] == lang and abs(got[r.doc_id][1] - score) < 1e-6


def test_every_character_of_a_word_counts():
    word = "abcdefghijklmnop"
    changed = [word[:i] + "z" + word[i + 1 :] for i in range(len(word))]
    own = set(crf.features(word.encode(), {})[1:])  # without the word itself
    assert all(set(crf.features(w.encode(), {})[1:]) - own for w in changed)
    run = "\u0e01\u0e02\u0e03" * 4000
    cut = crf.words_of("ab " + run + " cd")
    assert b"".join(cut).decode() == "ab" + run + "cd" and max(len(w.decode()) for w in cut) == crf.PIECE


def test_an_unbroken_text_is_labelled_whole(spark):
    rows = [(i, "abcab" * 300 if i % 2 else "xyzxy" * 300, "aa" if i % 2 else "xx") for i in range(40)]
    field = crf.fit(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING"))
    labels = crf.label_words(field, "abcab" * 800 + "xyzxy" * 1200)
    text = "".join(w for w, _, _ in labels)
    assert len(text) == 10_000
    share = sum(len(w) for w, lang, _ in labels if lang == "xx") / 10_000
    assert 0.58 < share < 0.62


def test_switches_are_labelled_by_word(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    field = crf.fit(docs)
    by = {r.lang: r.text for r in docs.where("n_chars > 300").orderBy("doc_id").collect()}
    a, b = sorted(by)[:2]
    words = " ".join(by[a].split()[:30]), " ".join(by[b].split()[:30])
    labels = [lang for _, lang, _ in crf.label_words(field, " ".join(words))]
    assert labels[:25].count(a) > 18 and labels[-25:].count(b) > 18


def test_language_of_odd_rows(spark, odd, clashing, none, odd_rows):
    field = crf.fit(odd)
    assert field.languages == ["de", "en"]
    for docs in (odd, clashing):
        got = crf.identify(docs, field, ["doc_id"]).collect()
        assert len(got) == len(odd_rows)
        assert sum(r.lang_pred == "und" and r.score == 0 for r in got) == 4
    assert crf.identify(none, field, ["doc_id"]).collect() == []
    empty = crf.fit(none)
    assert {r.lang_pred for r in crf.identify(odd, empty, ["doc_id"]).collect()} == {"und"}


def test_network_gradient():
    net = toxicity.Network(3)
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, toxicity.ROWS, (n, 3)) for n in (1, 2, 5, 9)]
    batch = toxicity.flat(texts)
    y, w = np.array([0, 1, 1, 0.0]), np.array([1.0, 2, 1, 1])

    def loss():
        p = 1 / (1 + np.exp(-net.logits(net.pooled(*batch)[0]).astype(float)))
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()

    grads = net.fit_batch(*batch, y, w)
    for x, g in zip(net.parameters(), grads, strict=True):
        flat_x, flat_g = x.reshape(-1), g.reshape(-1)
        for i in np.argsort(-np.abs(flat_g))[:3]:
            old, step = flat_x[i], 2e-3
            flat_x[i] = old + step
            up = loss()
            flat_x[i] = old - step
            down = loss()
            flat_x[i] = old
            assert abs((up - down) / (2 * step) - flat_g[i]) < 0.05 * abs(flat_g[i]) + 2e-4


def test_products_by_distinct_word_are_the_same():
    net, rng = toxicity.Network(1), np.random.default_rng(2)
    rows = rng.integers(0, toxicity.ROWS, (6, 3))
    ids = rng.integers(0, 6, 20)
    starts, sizes = np.array([0, 7, 7, 15]), np.array([7, 0, 8, 5])
    one, _ = net.pooled(rows, starts, sizes, ids)
    two, _ = net.pooled(rows[ids], starts, sizes)
    assert np.allclose(one, two, atol=1e-6) and (one[1] == 0).all()


def toxic_tables(spark, n=600):
    rng = random.Random(1)
    words = ["blue", "tree", "walk", "river", "stone", "quiet", "paper", "light"]
    bad = ["nastyword", "vileword", "nastywords"]
    rows, labels = [], []
    for i in range(n):
        own = rng.choices(words, k=rng.randint(5, 40))
        toxic = int(rng.random() < 0.3)
        if toxic:
            own.insert(rng.randrange(len(own)), rng.choice(bad))
        rows.append((i, " ".join(own), rng.choice(["en", "de", None])))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    return docs, spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT"), labels


def test_toxic_texts_are_found_on_texts_held_out(spark):
    docs, labels, rows = toxic_tables(spark)
    model = toxicity.fit(docs, labels, lambda: ~toxicity.held_out())
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    held = [(got[i], t) for i, _, t in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == bool(t) for s, t in held) >= 0.95 * len(held)
    kept = {r.doc_id for r in toxicity.clean(docs, model).collect()}
    assert sum((i in kept) == (not t) for i, _, t in rows) >= 0.95 * len(rows)


def test_toxicity_of_odd_rows(spark, odd, clashing, none, odd_rows):
    docs, labels, _ = toxic_tables(spark, 200)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(clashing, model, ["doc_id"]).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.clean(clashing, model)
    assert kept.columns == clashing.columns
    assert toxicity.clean(none, model).collect() == []
    for known in (labels.limit(0), labels.where("toxic = 0")):
        flat = toxicity.fit(docs, known)
        assert {r.score < 0.01 for r in toxicity.score(odd, flat, ["doc_id"]).collect()} == {True}


def test_query_on_the_tables(spark):
    got = toxicity.query(spark, SF_DIR).collect()
    assert len(got) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert all(r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def uneven_tables(spark):
    """Of 3500 texts 100 are toxic by a word of their own, and 100 of 400 by another."""
    rng = random.Random(6)
    words = ["blue", "tree", "walk", "river", "stone", "quiet", "paper", "light"]
    rows, labels = [], []
    for i in range(3500):
        own = rng.choices(words, k=rng.randint(5, 20))
        kind = "vileword" if i % 35 == 0 else "mildword" if i % 35 in (3, 11, 19, 27) else None
        if kind:
            own.insert(rng.randrange(len(own)), kind)
        toxic = int(kind == "vileword" or (kind == "mildword" and i % 35 == 11))
        rows.append((i, " ".join(own), "en"))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    return docs, spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT"), rows


def test_cut_follows_the_shares_of_all_labels(spark, monkeypatch):
    docs, labels, rows = uneven_tables(spark)
    # the sample has all 200 toxic texts and as many of 3300 clean ones
    monkeypatch.setattr(toxicity, "PER_CLASS", 200)
    model = toxicity.fit(docs, labels)
    scores = model.scores([t for _, t, _ in rows])
    flagged = {w: [s >= 0.5 for s, r in zip(scores, rows, strict=True) if w in r[1]] for w in ("vileword", "mildword")}
    assert np.mean(flagged["vileword"]) > 0.95
    assert np.mean(flagged["mildword"]) < 0.1  # three in four are clean


def test_cuts_weigh_languages_and_labels_as_all_rows():
    steps = pd.DataFrame(
        [("", 1, 2, 3.0, 3.0), ("", 1, 2, 1.0, 1.0), ("", 0, 9, 1.0, 1.0), ("", 0, 99, -1.0, -1.0)],
        columns=["lang", "toxic", "n", "high", "low"],
    )
    none = pd.DataFrame({"lang": [], "toxic": []})
    assert toxicity.cuts_of(steps, none) == (2.0, {})
    # twelve times as many toxic rows: clean rows between them matter less
    fitted = pd.DataFrame({"lang": [""] * 44, "toxic": [1] * 44})
    assert toxicity.cuts_of(steps, fitted) == (0.0, {})


def test_languages_with_enough_labels_have_thresholds(spark):
    """Of each label 50 texts of one language and 30 of another, among many of a third."""
    rng = random.Random(8)
    words = ["blue", "tree", "walk", "river", "stone", "quiet", "paper", "light"]
    rows, labels = [], []
    for lang, n in (("aa", 50), ("bb", 30), ("cc", 300)):
        for toxic in (0, 1):
            for _ in range(n):
                own = rng.choices(words, k=rng.randint(5, 20)) + ["nastyword"] * toxic
                rows.append((len(rows), " ".join(own), lang))
                labels.append((len(labels), 1, toxic))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    known = spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT")
    assert sorted(toxicity.fit(docs, known).by_language) == ["aa", "cc"]


def test_cuts_are_set_on_whole_texts(spark):
    net = toxicity.Network(3)
    text = "blue tree " * 3000 + "river stone"
    docs = spark.createDataFrame([(1, text, "en"), (2, None, "en")], "doc_id BIGINT, text STRING, lang STRING")
    known = spark.createDataFrame([(1, 1), (2, 0)], "doc_id BIGINT, toxic INT")
    got = toxicity.step_counts(docs, known, net)
    want = toxicity.Model(net, 0.0, {}).logits([text, ""])
    assert np.allclose(sorted(got.high), sorted(want), atol=1e-5) and got.n.tolist() == [1, 1]
