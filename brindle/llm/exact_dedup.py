"""Exact dedup (operator 10): counting quotient filters find repeated fingerprints, only those documents are compared byte by byte."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import quotient_filter
from brindle.llm.base import cut, few, fresh, parts

#: Fingerprints that a task holds before it emits its filters.
HELD = 1 << 20


def normalised(text: F.Column) -> F.Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def repeated_fingerprints(fingerprints: DataFrame, column: str, ranges: int) -> DataFrame:
    """(fingerprint, n) of the values of a 64-bit column that occur more than once.

    Each task builds one counting quotient filter per range of the high bits; the filters of a range meet in one task and merge by
    sorted remainders. A value that is repeated a million times in a partition is still one slot, so hot values don't weigh more.
    """
    bits = max(1, int(ranges - 1).bit_length())

    def build(batches):
        held: list[np.ndarray] = []

        def filters():
            values = np.concatenate(held)
            held.clear()
            values = values[np.argsort(values)]
            bounds = np.searchsorted(values >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
            own = [(i, quotient_filter.build(values[a:b] << np.uint64(bits))) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int32()), pa.array([f for _, f in own], pa.binary())], ["part", "filter"])

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            if sum(map(len, held)) >= HELD:
                yield filters()
        if sum(map(len, held)):
            yield filters()

    def merge(group: pa.Table) -> pa.Table:
        part = np.uint64(group["part"][0].as_py())
        values, counts = quotient_filter.merge(group["filter"].to_pylist())
        values = (values >> np.uint64(bits)) | (part << np.uint64(64 - bits))
        values, counts = values[counts > 1], counts[counts > 1]
        return pa.table({"fingerprint": pa.array(values.view(np.int64)), "n": pa.array(counts, pa.int64())})

    built = fingerprints.select(F.col(column).cast("long")).mapInArrow(build, "part int, filter binary")
    return built.groupBy("part").applyInArrow(merge, "fingerprint long, n long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, by equality of the normalised texts.

    Of equal texts the row with the smallest id stays (a null id counts as the largest; of rows with the same id and text every one
    is marked kept). A null text is an empty text, and empty texts are copies of one another. Empty input gives no rows. Other columns
    are ignored, and texts of any length are taken whole.

    Only texts whose fingerprint is repeated leave their task, each once per task that has it: equal texts are summed before the shuffle.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("body"))
    base = base.withColumn("fingerprint", F.xxhash64("body"))
    slim = cut(base.select("doc_id", "fingerprint", F.sha2("body", 256).alias("text_sha256")))
    repeated = cut(repeated_fingerprints(slim, "fingerprint", max(16, parts(spark))).select("fingerprint"))
    # Byte verification: documents with a repeated fingerprint meet by their whole text.
    groups = base.join(few(repeated), "fingerprint", "left_semi").groupBy("fingerprint", "body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = cut(groups.filter("group_size > 1").select("fingerprint", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size"))
    out = slim.join(few(groups), ["fingerprint", "text_sha256"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, whatever their names; of rows that share id and text one stays.

    Nulls, blank texts and ties as in exact_groups(). Only one row per group of copies meets the documents again.
    """
    kept = exact_groups(docs, id_col, text_col).filter("kept and group_size > 1")
    kept = cut(kept.groupBy("text_sha256").agg(F.first("keep_id").alias("keep_id"), F.count("*").alias("n")))
    own_id, own_sha, sha, keep_id, n = fresh(docs, "own_id", "own_sha", "sha", "keep_id", "n")
    marked = docs.withColumns({own_id: F.col(id_col).cast("long"), own_sha: F.sha2(normalised(F.col(text_col)), 256)})
    named = few(kept.select(F.col("text_sha256").alias(sha), F.col("keep_id").alias(keep_id), F.col("n").alias(n)))
    met = marked.join(named, F.col(own_sha) == F.col(sha), "left").filter(F.col(sha).isNull() | F.col(own_id).eqNullSafe(F.col(keep_id)))
    if kept.filter("n > 1").isEmpty():
        return met.select(*docs.columns)
    several = F.coalesce(F.col(n), F.lit(1)) > 1
    return met.filter(~several).select(*docs.columns).unionByName(met.filter(several).dropDuplicates([own_sha]).select(*docs.columns))


SQL = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
WINDOW w AS (PARTITION BY body)
"""
