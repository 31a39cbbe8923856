import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import hilbert, mcd, mixing, templates, text_stats
from pageloom.llm.common import running_totals, sample_by_class
from tests.conftest import SF_DIR
from tests.llm.conftest import SCHEMA


def duck(sql):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    return sorted(con.sql(sql).fetchall())


# -- helpers ------------------------------------------------------------------------


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 30), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "a INT, b INT, c BIGINT")
    got = running_totals(df, ["a", "b"], {"before": "c"}).collect()
    total, want = 0, {}
    for a, b, c in sorted(rows):
        want[(a, b)] = total
        total += c
    assert {(r.a, r.b): r.before for r in got} == want


def test_sample_is_bounded_and_repeats(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 100 == 0).alias("rare"))
    picks = [sorted(r.id for r in sample_by_class(df, "rare", "id", 300).collect()) for _ in "ab"]
    assert picks[0] == picks[1] and 400 <= len(picks[0]) <= 600
    assert sum(i % 100 == 0 for i in picks[0]) == 200


# -- statistics and outliers ----------------------------------------------------------


def counts_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if runs[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered))


def test_counts_match_plain_counting(odd_rows):
    rng = random.Random(4)
    texts = [r[1] or "" for r in odd_rows] + ["a a a a", "# <b>\n\n# <b>\n \n ", "\x1c \x85 \xa0"]
    texts += ["".join(rng.choices(["a ", "b ", "c ", "\n", "#", "\t"], k=60)) for _ in range(200)]
    for limit in (1, 7, len(texts)):
        got = []
        for i in range(0, len(texts), limit):
            part = text_stats.counted(texts[i : i + limit])
            got += list(zip(*(part[c].tolist() for c in text_stats.COLUMNS[:5]), strict=True))
        assert got == [counts_of(t) for t in texts]


def test_chi_square_values():
    for p, share, value in ((1, 0.95, 3.841), (2, 0.5, 1.386), (6, 0.75, 7.841), (10, 0.99, 23.209)):
        assert mcd.chi_square(p, share) == pytest.approx(value, abs=2e-3)


def test_estimate_withstands_outliers(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(0, 1, (800, mcd.P)) * 2 + np.arange(mcd.P)
    bad = rng.normal(25, 0.5, (200, mcd.P))
    rows = [("g", *map(float, v)) for v in np.vstack([good, bad])]
    names = [f"x{i}" for i in range(mcd.P)]
    df = spark.createDataFrame(rows, ", ".join(["pool STRING", *[f"{n} DOUBLE" for n in names]]))
    (model,) = mcd.estimate(df).collect()
    assert np.abs(np.array(model.m) - np.arange(mcd.P)).max() < 0.5
    inverse = np.zeros((mcd.P, mcd.P))
    for k, (i, j) in enumerate(mcd.PAIRS):
        inverse[i, j] = inverse[j, i] = model.q[k] / (1 if i == j else 2)
    d = lambda x: np.einsum("ij,jk,ik->i", x - model.m, inverse, x - model.m)
    assert np.sqrt(d(bad)).min() > 3 * np.sqrt(np.quantile(d(good), 0.99))
    # one more step by hand: the estimate reproduces the moments of its own closest share
    both = np.vstack([good, bad])
    near = both[d(both) <= np.quantile(d(both), mcd.COVERED)]
    assert np.abs(near.mean(0) - model.m).max() < 0.25


def test_verdicts_on_the_tables(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = mcd.query(spark, SF_DIR).collect()
    for r in got:
        want = counts_of(docs[r.doc_id].text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    judged = [(labels[r.doc_id], r.kept) for r in got if r.doc_id in labels and not r.base_failed]
    assert sum(k for q, k in judged if q) >= 0.98 * sum(q for q, _ in judged)


def test_bad_texts_that_pass_the_base_rule_are_rejected(spark):
    """Of a table with enough rows a group for estimates: keeping all would fail here."""
    folder = "/root/testdata/sf0.01"
    got = mcd.query(spark, folder).where("NOT base_failed")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    judged = got.join(labels, "doc_id").groupBy("quality").agg(
        F.count("*").alias("n"), F.count_if("kept").alias("kept")
    )
    by = {r.quality: (r.n, r.kept) for r in judged.collect()}
    assert by[1][1] >= 0.98 * by[1][0] > 100
    assert by[0][1] <= 0.2 * by[0][0] and by[0][0] > 10


def test_verdicts_on_odd_rows(odd, clashing, none, odd_rows):
    for docs in (odd, clashing):
        got = mcd.judge(docs).select("doc_id", "n_words", "kept", "base_failed").collect()
        assert sorted((str(r.doc_id), r.n_words) for r in got) == sorted(
            (str(d), counts_of(t or "")[0]) for d, t, *_ in odd_rows
        )
        assert all(r.kept != r.base_failed for r in got)  # too few rows for an estimate
    assert mcd.judge(none).count() == 0


# -- shards ---------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "bits"), [(1, 3), (2, 4), (3, 4), (4, 2)])
def test_curve_visits_neighbours(n, bits):
    table = hilbert.curve_table(n, bits)
    assert sorted(table) == list(range(1 << n * bits))
    point = {v: k for k, v in enumerate(table)}
    mask = (1 << bits) - 1
    for i in range(len(table) - 1):
        p, q = point[i], point[i + 1]
        assert sum(abs((p >> bits * k & mask) - (q >> bits * k & mask)) for k in range(n)) == 1


def test_shards_match_sql(spark):
    assert sorted(map(tuple, hilbert.query(spark, SF_DIR).collect())) == duck(hilbert.oracle())


def test_shards_of_odd_rows(odd, clashing, none, odd_rows):
    for docs in (odd, clashing):
        got = hilbert.shard(docs, shards=4, keep=("doc_id", "text")).collect()
        assert len(got) == len(odd_rows)
        counts = collections.Counter(r.shard for r in got)
        assert max(counts.values()) - min(counts.values()) <= 1
        for s, n in counts.items():
            assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
        for r in got:
            data = (r.text or "").encode()
            assert (r["size"], r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    assert hilbert.shard(none).collect() == []


def test_shards_are_written_in_order(spark, odd, tmp_path):
    hilbert.write(odd.withColumn("shard", F.lit("own")), str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == odd.count() and back.select("shard").distinct().count() == 4


# -- lines ------------------------------------------------------------------------------


def test_lines_match_sql(spark):
    assert sorted(map(tuple, templates.query(spark, SF_DIR).collect())) == duck(templates.oracle())


def test_recurring_templates_are_dropped(spark):
    passage = "this passage of many words stands in several documents and is found by the tree"
    rows = [
        (1, f"first own line here\n{passage}\nOrder 12 shipped to house 7 on day 3 at noon ok"),
        (2, f"{passage}\nsecond own line here\nOrder 99 shipped to house 1 on day 8 at noon ok"),
        (3, f"third own line here\n{passage.replace('several', 'some')}\nshort one"),
        (4, "short one\nfourth own line which nobody else has in any text of these"),
        (5, f"{passage}\n{passage}"),
    ]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = {r.doc_id: (r.text, r._llm_dropped) for r in templates.dedup(docs).collect()}
    assert got[1] == (rows[0][1], 0)
    assert got[2] == ("second own line here", 2)
    assert got[3] == ("third own line here\nshort one", 1)  # a variant of the line of most documents
    assert got[4] == (rows[3][1], 0)
    assert got[5] == ("", 2)


def test_short_lines_need_many_documents(spark):
    rows = [(i, f"all rights reserved\nown {'x' * i} line of the document with number") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = {r.doc_id: r._llm_dropped for r in templates.dedup(docs).collect()}
    assert got[0] == 0 and all(got[i] >= 1 for i in range(1, 12))
    few = templates.dedup(docs.where("doc_id < 9").select("doc_id", F.lit("all rights reserved").alias("text")))
    assert all(r._llm_dropped == 0 for r in few.collect())


def greedy(rows):
    """Anchors of one leaf, one after the other."""
    left, out = sorted(rows, key=lambda r: (-r[1].bit_length(), hashlib.md5(r[0].encode()).hexdigest())), {}
    while left:
        model = left[0][0].split(" ")
        alike = [r[0] for r in left if sum(map(str.__eq__, r[0].split(" "), model)) >= 0.8 * len(model)]
        out |= {m: left[0][0] for m in alike[1:]}
        left = [r for r in left if r[0] not in alike]
    return out


def variants_of(spark, lines):
    """The long lines of a list, one document each, that are alike to an anchor."""
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id BIGINT, text STRING").cache()
    rows = templates.parsed(docs).cache()
    left = templates.several(rows, templates.counted(rows))
    got = templates.parsed_leaves(left)[0].join(left, "line").select("masked").collect()
    assert len({r.masked for r in got}) == len(got)
    return {r.masked for r in got}


@pytest.mark.parametrize("paired", [1, 4, templates.PAIRED])
def test_anchors_are_those_of_one_after_the_other(spark, monkeypatch, paired):
    monkeypatch.setattr(templates, "PAIRED", paired)  # by groups alone, or by pairs
    rng = random.Random(3)
    sizes = {5: "abcd", 7: "abc", 8: "abcdef", 10: "abc", 12: "abc", 23: "ab"}
    lines = {"we all know " + " ".join(rng.choices(sizes[n], k=n - 3)) for n in sizes for _ in range(40)}
    heart = rng.choices("abcdefgh", k=27)  # a crowd: one line with a word or two changed, many times
    for _ in range(60):
        near = heart.copy()
        for _ in range(rng.randint(0, 2)):
            near[rng.randrange(27)] = rng.choice("xyz")
        lines.add("we all know " + " ".join(near))
    rows = [(i, line) for line in sorted(lines) for i in rng.sample(range(50), rng.randint(1, 4))]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    docs = docs.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    parsed = templates.parsed(docs).cache()
    left = templates.several(parsed, templates.counted(parsed)).cache()
    times = collections.Counter(line for _, line in rows)
    want = {}
    for n in (*sizes, 30):
        want |= greedy([(x, times[x]) for x in lines if len(x.split()) == n])
    variants, anchored = templates.parsed_leaves(left)
    gone = {r.masked for r in variants.join(left, "line").select("masked").collect()}
    assert gone == {x for x in want if len(x.split()) >= 8} and len(gone) > 50
    name = {r.line: r.masked for r in left.collect()}
    short = {name[r.line]: name[r.anchor] for r in anchored.collect()}
    assert {a: b for a, b in short.items() if a != b} == {a: b for a, b in want.items() if len(a.split()) < 8}
    assert len(short) > 20


def test_rounds_compare_the_texts_of_open_lines_alone(spark, monkeypatch):
    """A crowd that the first round settles is not moved again for the few lines left."""
    moved, alike = [], templates.alike

    def counting(pairs, left):
        moved.append(left.count())
        return alike(pairs, left)

    monkeypatch.setattr(templates, "alike", counting)
    word = lambda i, c: c * 3 + "".join(chr(97 + int(d)) for d in str(i))  # noqa: E731  digits would be masked
    crowd = [f"we all know {word(i, 'x')} is what it is here today" for i in range(300)]
    chain = [f"they said that {a} {b} of the {c} {d}" for a, b, c, d in itertools.product("xyz", repeat=4)]
    got = variants_of(spark, crowd + chain)
    want = greedy([(x, 1) for x in crowd]) | greedy([(x, 1) for x in chain])
    assert got == set(want) and len(got) > 299
    assert moved[0] == len(crowd + chain) and len(moved) > 1 and max(moved[1:]) <= len(chain)


def jobs_of(spark, work):
    group = f"counted-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_common_opening_ends_soon(spark):
    """5,000 lines that share a leaf and a block and are not alike, in as many jobs as 500;
    with lines that are alike among them."""
    other = [f"breaking news from {a} {b} of the house" for a, b in (("rome", "sun"), ("rome", "rain"), ("oslo", "rain"))]

    def lines(n):
        word = lambda i, c: c * 3 + "".join(chr(97 + int(d)) for d in str(i))  # noqa: E731  digits would be masked
        return [f"breaking news from {word(i, 'x')} {word(i, 'y')} of the house" for i in range(n)] + other

    few, jobs_few = jobs_of(spark, lambda: variants_of(spark, lines(500)))
    many, jobs_many = jobs_of(spark, lambda: variants_of(spark, lines(5000)))
    assert few == many == set(greedy([(x, 1) for x in other]))
    assert jobs_many <= jobs_few + 8 and jobs_many < 200


def test_lines_of_one_variable_field_are_no_pairs(spark):
    """A field with thousands of values: one template, found without comparing pairs."""
    words = ["".join(p) for p in itertools.product("abcdefgh", repeat=4)]
    got, jobs = jobs_of(spark, lambda: variants_of(spark, [f"the user is called {w} here and now" for w in words]))
    assert len(got) == len(words) - 1 and jobs < 200


def test_a_crowd_of_near_copies_ends_soon(spark):
    """One long line a thousand times, with words changed anywhere, among lines of its leaf."""
    rng = random.Random(6)
    words = ["".join(p) for p in itertools.product("abcdef", repeat=3)]
    hearts = [["we", "all", "know", *rng.choices(words, k=57)] for _ in range(3)]
    lines = [f"we all know {' '.join(rng.choices(words, k=57))}" for _ in range(50)]
    for heart in hearts:
        for _ in range(400):
            near = heart.copy()
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(3, 60)] = rng.choice(words) + "z"
            lines.append(" ".join(near))
    lines = list(dict.fromkeys(lines))
    got, jobs = jobs_of(spark, lambda: variants_of(spark, lines))
    assert got == set(greedy([(x, 1) for x in lines])) and len(got) == len(lines) - 53 and jobs < 250


def test_short_lines_with_a_field_recur(spark):
    words = ["".join(p) for p in itertools.product("abcd", repeat=2)][:12]
    rows = [(i, f"please log in now {w}\nown {w} line of document {w * 3} with {w * 2} words") for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = {r.doc_id: r.text for r in templates.dedup(docs).collect()}
    assert "log in" in got[0] and all("log in" not in got[i] for i in range(1, 12))
    few = templates.dedup(docs.where("doc_id < 9")).collect()
    assert all("log in" in r.text for r in few)


def test_lines_of_odd_rows(odd, clashing, none, odd_rows):
    for docs in (odd, clashing):
        got = templates.dedup(docs)
        assert got.columns == [*docs.columns, "_llm_lines", "_llm_dropped"]
        rows = got.collect()
        assert len(rows) == len(odd_rows)
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in odd_rows)
        assert sum(r.text is None for r in rows) == 2
    assert templates.dedup(none).collect() == []


def test_texts_of_lines_that_can_be_alike_to_none_are_not_kept(spark, monkeypatch):
    """Of other lines only hashes are stored and moved, also where nothing is broadcast."""
    word = lambda i, c: c * 3 + "".join(chr(97 + int(d)) for d in str(i))  # noqa: E731  digits would be masked
    lone = [f"{word(i, 'x')} {word(i, 'y')} {word(i, 'z')} is a line of its own leaf" for i in range(300)]
    near = [f"we all know that {word(i, 'u')} is what it is here" for i in range(20)]
    rows = [(i, "\n".join([lone[i], *near[i : i + 1], "end"])) for i in range(300)] + [(None, lone[0]), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3).cache()
    want = sorted(map(str, templates.dedup(docs).collect()))
    kept, stored = {}, templates.stored

    def counting(df, purpose):
        table = stored(df, purpose)
        kept[purpose] = 0 if "string" not in dict(df.dtypes).values() else table.count()
        return table

    monkeypatch.setattr(templates, "stored", counting)
    monkeypatch.setattr("pageloom.operators.sized.stored", counting)
    monkeypatch.setattr(templates, "SMALL", 0)
    assert sorted(map(str, templates.dedup(docs).collect())) == want
    assert kept["lines"] == 0 and kept["several"] == max(kept.values()) == len(near)
    assert sum("is what it is" in x for x in want) == 1 and sum(lone[0] in x for x in want) == 1


@pytest.mark.parametrize("most", [1 << 13, templates.MOST_BITS])
def test_no_key_is_missed(spark, monkeypatch, most):
    """Neither with bits enough nor with fewer bits than keys."""
    monkeypatch.setattr(templates, "MOST_BITS", most)
    keys = spark.range(0, 20_000).select(F.xxhash64("id").alias("key"))
    rows = spark.range(0, 40_000).select("id", F.xxhash64("id").alias("key"))
    got = {r.id for r in templates.likely(rows, "key", keys).collect()}
    assert got >= set(range(20_000)) and (most < 20_000 or len(got) < 21_500)
    assert templates.likely(rows, "key", keys.limit(0)).count() == 0


def test_a_text_is_split_once_for_all_its_drops(spark):
    """Not again for each run of lines that stay."""
    word = lambda i, c: c * 3 + "".join(chr(97 + int(d)) for d in str(i))
    line = lambda i: f"{word(i, 'x')} {word(i, 'y')} {word(i, 'z')} is a line of its own leaf"
    rows = [(1, "\n".join(map(line, range(0, 600, 2)))), (2, "\n".join(map(line, range(600))))]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").cache()
    got = templates.dedup(docs)
    made = got._jdf.queryExecution().optimizedPlan().toString().split("_llm_key")[0]
    assert made.count("split(text") == 2  # for the lines that stay, and for their count
    by_id = {r.doc_id: (r.text, r._llm_lines, r._llm_dropped) for r in got.collect()}
    assert by_id[2] == ("\n".join(map(line, range(1, 600, 2))), 600, 300) and by_id[1] == (rows[0][1], 300, 0)


def test_masks_and_counts_of_odd_lines(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choices("ab 12é 日\t🙂\r<", k=rng.randint(0, 30))) for _ in range(400)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id BIGINT, text STRING")
    got = {r.doc_id: (r.masked, r.n) for r in templates.parsed(docs).collect()}
    want = {i: (re.sub(templates.FIELD, templates.MARK, x), x.count(" ") + 1) for i, x in enumerate(lines)}
    assert got == {i: x for i, x in want.items() if x[1] >= templates.SHORT} and len(got) > 100


# -- mixing ----------------------------------------------------------------------------


def brute_rates(p, n, targets, least, steps=3000):
    natural = p.T @ n
    r = np.ones(len(n))
    for _ in range(steps):
        r = np.maximum(least, r - p @ ((p.T @ (n * r) - targets) / natural))
    return r


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    n = rng.integers(1, 400, 300)
    rows = [(i, i, int(n[i]), *map(float, p[i])) for i in range(300)]
    members = spark.createDataFrame(
        rows, "doc_id BIGINT, text_key BIGINT, tokens BIGINT, p0 DOUBLE, p1 DOUBLE, p2 DOUBLE"
    )
    natural = p.T @ n
    for scale, least in (([1.5, 0.8, 0.7], 0.0), ([2.0, 1.0, 1.2], 1.0)):
        targets = natural * scale
        names = ["a", "b", "c"]
        named = dict(zip(names, targets.tolist(), strict=True))
        solved = mixing.solve(members, names, named, least).orderBy("doc_id")
        got = np.array([r.rate for r in solved.collect()])
        want = brute_rates(p, n, targets, least)
        miss = lambda r: (((p.T @ (n * r) - targets) / targets) ** 2).sum()
        assert got.min() >= least and miss(got) <= miss(want) + 3e-3


def test_memberships_match_plain_bayes(spark):
    rng = random.Random(2)
    sets = {"x": ["red", "blue", "green"], "y": ["red", "one", "two"]}
    rows = [(i, d, " ".join(rng.choices(w, k=9))) for i, (d, w) in enumerate(list(sets.items()) * 20)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, domain STRING, text STRING")
    model = mixing.learn(docs.select("domain", "text"))
    got = {r.doc_id: (r.p0, r.p1) for r in mixing.memberships(docs, model).collect()}
    counts = {d: collections.Counter(w for _, e, t in rows if e == d for w in t.split()) for d in sets}
    for i, _, text in rows:
        logs = []
        for d in sets:
            total = counts[d].total()
            s = sum(np.log((counts[d][w] + 1) / (total + mixing.BUCKETS)) for w in text.split())
            logs.append(np.log((total + 1) / (360 + 2)) + s / 3)
        e = np.exp(np.array(logs) - max(logs))
        assert np.allclose(got[i], e / e.sum())


def test_any_number_of_domains(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 4)
    rng = random.Random(8)
    rows = [(i, f"d{i % 200:03}", f"w{i % 200} w{i % 200} shared {rng.choice('abc')}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, domain STRING, text STRING")
    got = mixing.rated(docs, docs.select("domain", "text")).collect()
    named = {i: d for i, d, _ in rows}
    assert len({r.domain for r in got}) > 190  # words of a few domains share a bucket
    assert sum(r.domain == named[r.doc_id] for r in got) > 0.95 * len(rows)
    assert all(r.rate >= 0 for r in got)


def test_mixing_of_the_tables(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 12)
    got = mixing.query(spark, SF_DIR).collect()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.collect())
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = mixing.labelled(docs, labels)
    kept = mixing.mixed(docs, rows, 1.0, mixing.at_least_natural)
    assert kept.select("doc_id").distinct().count() == docs.count()


def test_mixing_of_odd_rows(spark, odd, clashing, none, odd_rows, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 6)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id BIGINT, quality INT")
    rows = mixing.labelled(odd, labels)
    for docs in (odd, clashing):
        assert mixing.rated(docs, rows).count() == len(odd_rows)
        kept = mixing.mixed(docs, rows, 1.0, mixing.at_least_natural)
        assert kept.columns == docs.columns and kept.count() >= len(odd_rows)
    assert mixing.rated(none, rows).collect() == []
    no_labels = mixing.rated(odd, mixing.labelled(none, labels))
    assert {(r.domain, r.rate) for r in no_labels.collect()} == {("all", 1.0)}


def test_schema_is_as_documents(odd):
    assert odd.columns == [x.split()[0] for x in SCHEMA.split(", ")]
