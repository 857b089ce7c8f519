"""A stored index for keyword search (T05, T11): postings by bucket of their term and block of documents, and deltas instead of rewriting.

Texts are read once, when they come. An update is a batch: the postings and lengths of its documents, and the ids that it replaces or
removes; an id's rows of earlier batches then no longer count. A batch becomes part of the index by one rename of its pointer, so a
search sees all of an update or nothing. A search reads the buckets of the terms that are asked for, and no text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import keyword_blocks
from brindle.operators.search import CANDIDATES, marks, question_terms
from brindle.sources import stores

BUCKETS = 64
#: The bucket of the rows that tell a block's documents.
OF_BLOCK = -1
POSTINGS = ("terms", "sizes", "slots", "tfs")
#: Rows of a slim table up to which it is broadcast; they are counted first.
FEW_ROWS = 1 << 18


def _bucket(term, buckets: int):
    return F.pmod(F.crc32(F.col(term)), F.lit(buckets)).cast("int")


def _schema(kind: str) -> str:
    return f"bucket int, block long, terms array<string>, sizes array<int>, slots array<int>, tfs array<int>, ids array<{kind}>, hashes array<string>, lengths array<int>"


def _index(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """A batch's rows; kind is the type of ids. A batch that adds no document has no file that tells its columns."""
    return spark.read.schema(_schema(kind)).parquet(f"{folder}/index")


def _read(spark: SparkSession, path: str, what: str) -> DataFrame | None:
    """Rows of all batches with their number; what is index or gone."""
    found = None
    for number, folder in enumerate(stores.folders(spark, path)):
        rows = spark.read.parquet(f"{folder}/gone") if what == "gone" else _index(spark, folder, spark.read.parquet(f"{folder}/gone").schema["id"].dataType.simpleString())
        rows = rows.withColumn("batch", F.lit(number))
        found = rows if found is None else found.unionByName(rows)
    return found


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= FEW_ROWS else table


def _valid(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Rows (id, batch, ...) of ids that no later batch replaced or removed."""
    gone = _read(spark, path, "gone").groupBy("id").agg(F.max("batch").alias("last"))
    return rows.join(_few(gone), "id", "left").where(F.col("last").isNull() | (F.col("batch") >= F.col("last"))).drop("last")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, sha256, length, batch, block, slot) of what is indexed."""
    rows = _read(spark, path, "index").where(F.col("bucket") == OF_BLOCK)
    each = rows.select("batch", "block", F.posexplode(F.arrays_zip("ids", "hashes", "lengths")).alias("slot", "x"))
    return _valid(spark, path, each.select(F.col("x.ids").alias("id"), F.col("x.hashes").alias("sha256"), F.col("x.lengths").cast("long").alias("length"), "batch", "block", "slot"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, sha256, length) of what is indexed."""
    return _documents(spark, path).select("id", "sha256", "length")


def _indexed(marks: dict, buckets: int):
    """A function of batches (id, words, sha256): for each block a row of its documents, and one of each bucket's terms and postings."""

    def run(batches):
        block, names = TaskContext.get().partitionId() << 32, ["bucket", "block", *POSTINGS, "ids", "hashes", "lengths"]
        for batch in batches:
            for a, b in keyword_blocks.cut_up(batch.column(1)):
                ids, words, hashes = (batch.column(i).slice(a, b - a) for i in range(3))
                *found, lengths = keyword_blocks.counted(words, marks)
                of = np.fromiter((zlib.crc32(t.encode()) % buckets for t in found[0].to_pylist()), np.int32, len(found[0]))
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32()]
                names_of, sizes, slots, tfs = keyword_blocks.in_order(*found, np.argsort(of, kind="stable"))
                there, terms_in = np.unique(of, return_counts=True)
                postings_in = np.bincount(of, found[1], minlength=buckets).astype(np.int64)[there]
                listed = [keyword_blocks.lists(pa.array(x).cast(t), n) for x, t, n in zip((names_of, sizes, slots, tfs), kinds, (terms_in, terms_in, postings_in, postings_in), strict=True)]
                none = [pa.nulls(len(there), pa.list_(t)) for t in (ids.type, pa.string(), pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(np.full(len(there), block)), *listed, *none], names)
                own = [keyword_blocks.lists(pa.array(x), [b - a]) for x in (ids, hashes, lengths)]
                yield pa.RecordBatch.from_arrays([pa.array([OF_BLOCK], pa.int32()), pa.array([block]), *[pa.nulls(1, pa.list_(t)) for t in kinds], *own], names)
                block += 1

    return run


def _once(docs: DataFrame) -> DataFrame:
    """One row of each id. Texts are shuffled only if an id comes again."""
    again = docs.groupBy("id").count().where("count > 1").limit(1)
    return docs.dropDuplicates(["id"]) if again.count() else docs


def update(spark: SparkSession, path: str, docs: DataFrame, removed: DataFrame | None = None, id_col: str = "id", text_col: str = "text", buckets: int = BUCKETS) -> None:
    """Add documents, replace those whose text has changed, and take out those whose ids are removed (id).

    A document that is there with the same text is passed over. Of rows of one id in docs, one counts. A task writes the blocks of its own
    documents, so no posting is shuffled.
    """
    before = stores.folders(spark, path)
    own = _once(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))).withColumn("sha256", F.sha2("text", 256))
    if before:
        own = own.join(_few(documents(spark, path).select("id", "sha256")), ["id", "sha256"], "left_anti")
    folder, kind = stores.new_folder(path), own.schema["id"].dataType.simpleString()
    rows = own.select("id", keyword_blocks.spaced(F.col("text")).alias("words"), "sha256").mapInArrow(_indexed(marks(), buckets), _schema(kind))
    rows.write.partitionBy("bucket").option("parquet.block.size", keyword_blocks.ROW_GROUP).parquet(f"{folder}/index")
    gone = _index(spark, folder, kind).where(F.col("bucket") == OF_BLOCK).select(F.explode("ids").alias("id"))
    gone = gone if removed is None else gone.unionByName(removed.select("id")).distinct()
    gone.write.parquet(f"{folder}/gone")
    stores.point(spark, path, [*before, folder])


def search(spark: SparkSession, path: str, questions: DataFrame, top: int = CANDIDATES, buckets: int = BUCKETS) -> DataFrame:
    """T05 from the index: the best documents of each question (question, text): (question, id, score, place), as search.bm25() ranks them."""
    asked = question_terms(questions)
    wanted = asked.select("term", _bucket("term", buckets).alias("bucket")).distinct().collect()
    terms, index = [r.term for r in wanted], _read(spark, path, "index")

    def kept(batches):
        values = pa.array(terms, pa.string())
        for batch in batches:
            for i in range(len(batch)):
                named, *rest = (batch.column(c)[i].values for c in range(2, 6))
                some = np.flatnonzero(pc.is_in(named, value_set=values).to_numpy(zero_copy_only=False))
                if len(some):
                    listed = keyword_blocks.in_order(named, *(x.to_numpy() for x in rest), some)
                    yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], batch.column(1)[i : i + 1], *[keyword_blocks.lists(x, [len(x)]) for x in listed]], ["batch", "block", *POSTINGS])

    hits = index.where(F.col("bucket").isin(sorted({r.bucket for r in wanted}))).select("batch", "block", *POSTINGS)
    hits = hits.mapInArrow(kept, "batch int, block long, terms array<string>, sizes array<int>, slots array<int>, tfs array<int>")
    docs = _documents(spark, path).select("batch", "block", "slot", "id", "length")

    def packed(hits: pa.Table, docs: pa.Table) -> pa.Table:
        """A block's postings of documents that still count."""
        docs = docs.sort_by("slot")
        held, ids = docs["slot"].to_numpy(), docs["id"].combine_chunks()
        named, sizes, slots, tfs = (hits[c].combine_chunks().flatten() for c in POSTINGS)
        sizes, slots, tfs = sizes.to_numpy(), slots.to_numpy(), tfs.to_numpy()
        at = np.searchsorted(held, slots)
        there = np.append(held, -1)[at] == slots
        left = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[there], minlength=len(sizes))
        some = np.flatnonzero(left)
        return pa.Table.from_batches([keyword_blocks.packed_row(ids, docs["length"].to_numpy(), named.take(pa.array(some)), left[some], at[there], tfs[there])])

    key = ("batch", "block")
    blocks = hits.groupBy(*key).cogroup(docs.groupBy(*key)).applyInArrow(packed, keyword_blocks.packed_type(index.schema["ids"].dataType.elementType.simpleString()))
    return keyword_blocks.ranked(blocks, asked, top)
