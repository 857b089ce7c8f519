"""Blocks of postings: a block's terms of a bucket are one row, diacritics and ties are those of the scan, and a block gives its best documents only."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brindle.operators import keyword_blocks, search, stored_index
from brindle.sources import stores


def test_an_index_has_a_row_for_a_bucket_of_a_block(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(300))) for i in range(40)], "id long, text string").coalesce(1)
    path = str(tmp_path / "index")
    stored_index.update(spark, path, docs)
    (folder,) = stores.folders(spark, path)
    rows = spark.read.parquet(f"{folder}/index")
    assert rows.count() <= stored_index.BUCKETS + 1 and rows.select(F.sum(F.size("terms"))).first()[0] >= 40 * 300
    asked = spark.createDataFrame([(1, "W7x3 w8x4 nothing"), (2, "absent")], "question int, text string")
    assert sorted((r.question, r.id, r.place) for r in stored_index.search(spark, path, asked).collect()) == [(1, 7, 1), (1, 8, 2)]


def test_counts_of_a_block():
    terms, sizes, slots, tfs, lengths = keyword_blocks.counted(pa.array(["école ecole x", "", " x x "]), search.marks())
    found = {t: (slots[e - n : e].tolist(), tfs[e - n : e].tolist()) for t, n, e in zip(terms.to_pylist(), sizes, np.cumsum(sizes), strict=True)}
    assert found == {"ecole": ([0], [2]), "x": ([0, 2], [1, 2])} and lengths.tolist() == [3, 0, 2]
    assert [(a, b) for a, b in keyword_blocks.cut_up(pa.array(["a"] * 5000))] == [(0, 4096), (4096, 5000)]


def test_ties_go_by_id_once_rounded():
    scores = np.array([2.0, 1.0000001, 1.0000002, 1.0, 0.0, 0.5])
    assert keyword_blocks._best(scores, pa.array([9, 5, 7, 3, 1, 2]), 3).tolist() == [0, 3, 1]


def test_repeated_ids_and_no_documents(spark, tmp_path):
    asked = spark.createDataFrame([(1, "apple")], "question int, text string")
    docs = spark.createDataFrame([(1, "apple"), (1, "apple"), (2, None), (3, "pear")], "id long, text string")
    stored_index.update(spark, str(tmp_path / "a"), docs)
    assert [r.id for r in stored_index.search(spark, str(tmp_path / "a"), asked).collect()] == [1]
    assert stored_index.documents(spark, str(tmp_path / "a")).count() == 3
    assert search.bm25(docs.limit(0), asked, "id").count() == 0
    stored_index.update(spark, str(tmp_path / "b"), docs.limit(0))
    assert stored_index.search(spark, str(tmp_path / "b"), asked).count() == 0
