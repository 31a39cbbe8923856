import zlib

import numpy as np
import pytest

import corpus_pipeline
from pageloom.llm import mixing, toxicity
from pageloom.llm.common import stored
from tests.conftest import SF_DIR
from tests.llm.test_simhash import fingerprint, roots


def by_id(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_one_by_one(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, seen = docs.columns, [by_id(docs)]
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF_DIR), name)
        assert docs.columns == columns
        frames.append(docs)
        seen.append(by_id(docs))

    every, clean, lines, single, mixed = seen
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    model = toxicity.fit(frames[0], labels)
    scores = toxicity.score(frames[0], model, ["doc_id", "lang"]).collect()
    assert set(clean) == {r.doc_id for r in scores if r.score < model.threshold(r.lang)}
    marked = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert len(marked & set(clean)) >= 0.9 * len(marked)

    assert set(lines) == set(clean)
    for i, text in lines.items():  # what is left is there in order
        left = iter((clean[i] or "").split("\n"))
        assert text == "" or all(any(x == y for y in left) for x in text.split("\n"))

    ids = sorted(lines)
    tops = roots([fingerprint(lines[i]) for i in ids])
    assert sorted(single) == sorted({ids[t] for t in tops})
    assert all(single[i] == lines[i] for i in single)

    assert mixed == single and frames[4].count() >= len(single)

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(corpus_pipeline.default_tokenizer())
    want = []
    for r in frames[4].collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        for a in range(0, len(ids), 2048):
            data = np.array(ids[a : a + 2048], "<u4").tobytes()
            want.append((r.doc_id, a, len(data) // 4, zlib.crc32(data)))
    pieces = corpus_pipeline.pack(spark, frames[4], SF_DIR)
    got = pieces.select("doc_id", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("name", ["odd", "none", "clashing"])
def test_stages_take_odd_tables(spark, name, request, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 3)
    monkeypatch.setattr(toxicity, "TRIES", 1)
    docs = request.getfixturevalue(name)
    for stage_name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stored(stage(spark, docs, SF_DIR), stage_name)
        assert docs.columns == columns
    pieces = corpus_pipeline.pack(spark, docs, SF_DIR)
    assert (pieces.count() > 0) == (name != "none")


def test_entry_lists_every_operator():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
