"""The pipeline's stages, each against plain code on its own input."""

import random

import numpy as np
import pytest
from test_operators import ODD, SCHEMA, brute_dedup

import corpus_pipeline
from brindle.llm import similar

STAGES = [f for _, f in corpus_pipeline.STAGES]


def brute_similar(data):
    """Smallest id of each component of texts that share 0.8 of their 5-word shingles, over all pairs."""
    sets = []
    for _, t in data:
        words = (t or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                high, low = max(label[i], label[j]), min(label[i], label[j])
                label = [low if x == high else x for x in label]
    least = {}
    for (i, _), k in zip(data, label, strict=True):
        least[k] = min(least.get(k, i), i)
    return list(least.values())


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    stages = [f for _, f in corpus_pipeline.STAGES]
    extra = spark.createDataFrame([(900_001, "12 34 56", "en", "src1", 8), (900_002, None, None, None, None), (900_003, docs.first().text, "en", "src1", 9)], docs.schema)
    docs = docs.unionByName(extra)

    told = stages[0](spark, docs, sf_dir)
    ids = {r.doc_id for r in told.select("doc_id").collect()}
    assert told.columns == columns and ids == {r.doc_id for r in docs.select("doc_id").collect()} - {900_001, 900_002}

    single = stages[1](spark, told, sf_dir)
    want = sorted(r[0] for r in brute_dedup([tuple(r) for r in told.select("doc_id", "text").collect()]) if r[3])
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == want

    apart = stages[2](spark, single, sf_dir)
    want = brute_similar([tuple(r) for r in single.select("doc_id", "text").collect()])
    assert apart.columns == columns and sorted(r.doc_id for r in apart.collect()) == sorted(want)

    mixed = stages[3](spark, apart, sf_dir)
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} == set(want)

    packed = stages[4](spark, mixed, sf_dir).collect()
    lengths = {}
    for r in packed:
        lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
    assert max(lengths.values()) <= 2048 and np.mean(list(lengths.values())) > 0.97 * 2048

    assert len(corpus_pipeline.run(spark, sf_dir).columns) == 7


@pytest.mark.parametrize("together", [1024, 3])
def test_near_copies_of_a_few_edits_go(spark, monkeypatch, together):
    """Against all pairs of 5-word shingle sets, at a similarity of 0.8 and above and just below it; also with clusters of many blocks."""
    monkeypatch.setattr(similar, "TOGETHER", together)
    rng = random.Random(3)
    data = []
    for k in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        data.append(words)
        for edits in (1, 3, 4, 5, 6, 8):
            other = list(words)
            for at in rng.sample(range(200), edits):
                other[at] = f"x{rng.randrange(10**6)}"
            data.append(other)
    want = set(brute_similar([(i, " ".join(w)) for i, w in enumerate(data)]))
    made = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(data)], "doc_id long, text string").repartition(5)
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, made, "").collect()}
    assert 40 < len(want) < len(data) - 40 and got == want


def test_stages_on_odd_and_empty_tables(spark):
    """Nulls in every column, repeated rows and ids, blank and long texts, extra columns; and tables without a row."""
    extra = [(None, None, None, None), (None, "no id here", "en", "b"), (None, "another text without an id at all", None, None), (4, "one id with a second text", "en", "b")]
    odd = spark.createDataFrame([*ODD, *extra], SCHEMA).selectExpr("*", "length(text) AS n_chars", "'x' AS _stay", "1 AS Key", "2 AS block").repartition(3)
    for name, docs in (("odd", odd), ("empty", odd.limit(0))):
        for stage in STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
            assert docs.columns == odd.columns and (name == "odd") == bool(docs.count())
        texts = {r.text for r in docs.collect()}
        packed = STAGES[-1](spark, docs, "").collect()
        assert len({(r.doc_id, r.piece) for r in packed}) <= len(packed) and (name == "odd") == bool(packed)
        if name == "odd":
            assert {"no id here", "another text without an id at all", "one id with a second text", "the same text"} <= texts
            assert "12345 67890" not in texts and len([r for r in docs.collect() if r.text == "the same text"]) >= 1
