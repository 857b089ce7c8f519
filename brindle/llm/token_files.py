"""Token-ID output (operator 9): one array of ids per segment with Elias-Fano document boundaries.

A segment is the bytes of one file: magic, number of ids and bytes per id, the Elias-Fano coded document starts (and the end), then
the ids, little-endian, in 2 bytes each if the vocabulary allows. Segments follow one another in ascending doc_id order; executors
can't write to a common file, so a data set is a table of segments (part, ids before it in its part, doc ids, segment bytes) that any
Spark writer stores. A part is a range of ids that one task writes; where it starts in the whole array follows from the parts' sizes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm import elias_fano
from brindle.llm.base import bucket_of, new_path, parts, range_buckets
from brindle.llm.tokens import default_path, encoded

MAGIC = b"TIDS"
HEAD = struct.Struct("<4sQB")
SEGMENT_IDS = 1 << 21
#: Documents whose boundaries are decoded at once.
READ = 1 << 10
SCHEMA = "part int, before long, n_ids long, doc_ids binary, null_ids int, segment binary"


def pack(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The bytes of a segment."""
    wide = 4 if len(ids) and int(ids.max()) > 0xFFFF else 2
    return HEAD.pack(MAGIC, len(ids), wide) + elias_fano.encode(np.append(0, np.cumsum(lengths))) + ids.astype(f"<u{wide}").tobytes()


class Segment:
    """Random access to the documents of a segment."""

    def __init__(self, data: bytes):
        magic, self.n_ids, wide = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        self.bounds = elias_fano.Reader(data, HEAD.size)
        self.ids = np.frombuffer(data, f"<u{wide}", self.n_ids, self.bounds.end)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


def write(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all documents as segments under path, ordered by id, then text; null ids come first, a null text is empty.

    Texts are dealt once, by ranges of the id, and encoded in order; a task holds one segment and a slice of text.
    """
    spark, vocabulary = docs.sparkSession, tokenizer or default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cuts = range_buckets(rows, "doc_id", parts(spark))
    bucket = F.coalesce(bucket_of("doc_id", cuts), F.lit(0)) if cuts else F.lit(0)
    dealt = rows.withColumn("part", bucket.cast("int")).repartitionById(max(1, len(cuts)), F.col("part")).sortWithinPartitions("part", "doc_id", "text")

    def segments(batches):
        held, lengths, names, part, before = [], [], [], 0, 0
        for batch in batches:
            doc_ids, where = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            for a, ids, n in encoded(batch.column(1), vocabulary):
                own = where[a : a + len(n)]
                for x in np.split(np.arange(len(n)), np.flatnonzero(np.diff(own)) + 1):
                    if held and (own[x[0]] != part or sum(map(len, held)) >= SEGMENT_IDS):
                        yield _row(part, before, held, lengths, names)
                        before = before + sum(map(len, held)) if own[x[0]] == part else 0
                        held, lengths, names = [], [], []
                    part = int(own[x[0]])
                    begin = int(n[: x[0]].sum())
                    held.append(ids[begin : begin + int(n[x].sum())])
                    lengths.append(n[x])
                    names.append(doc_ids.slice(a + int(x[0]), len(x)))
        if held:
            yield _row(part, before, held, lengths, names)

    dealt.mapInArrow(segments, SCHEMA).write.parquet(path)


def _row(part: int, before: int, held: list, lengths: list, names: list) -> pa.RecordBatch:
    ids, own = np.concatenate(held), pa.chunked_array(names, pa.int64())
    nulls = own.null_count
    known = own.drop_null().to_numpy()
    row = [[part], [before], [len(ids)], [known.astype("<i8").tobytes()], [nulls], [pack(ids, np.concatenate(lengths))]]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], ["part", "before", "n_ids", "doc_ids", "null_ids", "segment"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    stored = spark.read.schema(SCHEMA).parquet(path)
    totals = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    # One row per part, and no more parts than write() had partitions: small enough to broadcast whatever the size of the data.
    placed = stored.join(F.broadcast(first), "part").withColumn("base", F.col("before") + F.col("ahead"))

    def documents(batches):
        for batch in batches:
            for names, nulls, data, base in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                segment = Segment(data)
                own = pa.concat_arrays([pa.nulls(nulls, pa.int64()), pa.array(np.frombuffer(names, "<i8"), pa.int64())])
                for first in range(0, len(own), READ):
                    some = own.slice(first, READ)
                    bounds = segment.bounds.range(first, first + len(some) + 1)
                    crc = [zlib.crc32(segment.ids[a:b].astype("<u4")) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    columns = [some, pa.array(bounds[:-1] + base, pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("doc_ids", "null_ids", "segment", "base").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the documents to the shared folder and read the files back.

    A null text is the end id alone; null ids come first; repeated rows and ties of the id are written as often as they are there, by
    text. A very long text is one document of a segment of its own size. Other columns play no part. Empty input gives no rows.
    """
    path = new_path(docs.sparkSession, "token-files")
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path)
