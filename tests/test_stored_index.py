"""The stored index: adds, replacements and removals rank as a rebuild and as the scan do; a crash leaves the old state."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from brindle.operators import search, stored_index
from brindle.sources import stores


def ranking(df):
    return sorted(tuple(r) for r in df.select("question", "id", "score", "place").collect())


def test_updates_rank_as_a_rebuild(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    questions = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.col("item_id").alias("question"), "text")
    changed = docs.where("id % 10 = 3").withColumn("text", F.concat(F.lit("wholly new words "), F.left("text", F.lit(50))))
    path = str(tmp_path / "index")
    stored_index.update(spark, path, docs.where("id % 4 <> 1"))
    stored_index.update(spark, path, docs.where("id % 4 = 1").unionByName(docs.where("id < 20")))  # some are there already
    assert ranking(stored_index.search(spark, path, questions)) == ranking(search.bm25(docs, questions, "id"))
    stored_index.update(spark, path, changed, docs.where("id % 10 = 7").select("id"))
    final = docs.where("id % 10 not in (3, 7)").unionByName(changed)
    want = ranking(search.bm25(final, questions, "id"))
    assert ranking(stored_index.search(spark, path, questions)) == want
    again = str(tmp_path / "again")
    stored_index.update(spark, again, final)
    assert ranking(stored_index.search(spark, again, questions)) == want
    assert stored_index.documents(spark, path).count() == final.count()
    back = docs.where("id = 7")  # removed before
    stored_index.update(spark, path, back)
    assert stored_index.documents(spark, path).where("id = 7").count() == 1


def test_a_crash_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    stores.replace(spark.range(3), path)
    with monkeypatch.context() as m:
        m.setattr(stores, "point", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            stores.replace(spark.range(9), path)
    assert stores.read(spark, path).count() == 3
    stores.replace(stores.read(spark, path).where("id > 0"), path)  # made of what it replaces
    assert sorted(r.id for r in stores.read(spark, path).collect()) == [1, 2]
    assert stores.sweep(spark, path) == 2 and stores.read(spark, path).count() == 2
    with pytest.raises(FileNotFoundError):
        stores.read(spark, str(tmp_path / "none"))


def test_json_stores(spark, tmp_path):
    for name, text in (("a", '{"id": 1, "name": "x", "more": 2}'), ("b", '[{"id": 2}, {"id": 3, "name": "z"}]'), ("c", '{"id": 4, "name"'), ("d", '{"id": "no number"}')):
        (tmp_path / f"{name}.json").write_text(text)
    good, bad = stores.read_json(spark, str(tmp_path), StructType([StructField("id", LongType()), StructField("name", StringType())]))
    assert sorted((r.id, r.name) for r in good.collect()) == [(1, "x"), (2, None), (3, "z")]
    assert sorted(r.file[-6:] for r in bad.collect()) == ["c.json", "d.json"]
