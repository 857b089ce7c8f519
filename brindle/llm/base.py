"""What the operators share: the folder that driver and executors share, cut lineage, size-checked broadcasts, text slices of bounded size."""

from __future__ import annotations

import ctypes
import string
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task works on at once.
SLICE_BYTES = 4 << 20
#: Rows of a slim table (a few dozen bytes each) up to which it is broadcast; beyond, the join shuffles.
FEW_ROWS = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one of our own only where none is set and all runs in one process (local tests)."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="brindle-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh place in the shared folder."""
    return f"{shared_dir(spark)}/brindle-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder, so that no lost executor brings the work back."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame) -> DataFrame:
    """df, broadcast if it is small. Its rows are counted, so it should be stored already."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that df doesn't have, case ignored."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowered(text: F.Column) -> F.Column:
    """A text with A-Z in lower case, and nothing else changed.

    lower() does the same, and quicker, unless there is a capital beyond ASCII.
    """
    other_capital = text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^\x00-\x7F]]")
    return F.when(other_capital, F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


def texts_of(array: pa.Array) -> pa.Array:
    """Nulls become empty texts."""
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    return pc.fill_null(array.cast(pa.large_string()), "")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of texts, between ASCII white space, and the number of words of each text; a blank text has none."""
    trimmed = pc.ascii_trim_whitespace(texts)
    split, blank = pc.ascii_split_whitespace(trimmed), pc.equal(pc.binary_length(trimmed), 0)
    words = split.flatten()
    return words.filter(pc.not_equal(words, "")), np.diff(split.offsets.to_numpy()) - blank.to_numpy(zero_copy_only=False)


def release() -> None:
    """Give memory that this Python worker has freed back to the system: it may wait for its next task while the JVM needs that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim:
        trim(0)


def tidy(f: Callable) -> Callable:
    """f, a function on the batches of a partition, with release() at its end."""

    def run(batches):
        yield from f(batches)
        release()

    return run


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most so many bytes, or one row."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, stop
        at = stop


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + shift


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shifts and odd multipliers); the same on every machine."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; an empty run sums to 0."""
    total = np.concatenate((np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)))
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def range_buckets(df: DataFrame, key: str, wanted: int) -> list[int]:
    """Cut points: at most `wanted` values of the integer column key, ascending, the first its minimum.

    One scan of that column. Bucket i holds cut[i] <= key < cut[i + 1], so the cut is the smallest key of its bucket.
    """
    steps = [i / wanted for i in range(1, wanted)]
    accuracy = F.lit(max(10_000, 50 * wanted))  # the error in ranks is a fiftieth of a bucket
    found = df.agg(F.min(key).alias("low"), F.percentile_approx(key, steps, accuracy).alias("cuts") if steps else F.array().alias("cuts")).first()
    return sorted({found.low, *(found.cuts or [])} - {None})


def bucket_of(key: str, cuts: list[int]) -> F.Column:
    """Which bucket of range_buckets() a key falls in, found in two steps: among every so many cuts, then among those in between."""
    step = max(1, round(len(cuts) ** 0.5))
    below = lambda points: F.size(F.filter(points, lambda c: c <= F.col(key)))
    points = F.array(*[F.lit(c).cast("long") for c in cuts])
    coarse = F.greatest(below(F.array(*[F.lit(c).cast("long") for c in cuts[::step]])) - 1, F.lit(0)) * step
    return F.greatest(coarse + below(F.slice(points, coarse + 1, F.lit(step))) - 1, F.lit(0))


def keep_first(docs: DataFrame, slim: DataFrame, id_col: str, sha: F.Column) -> DataFrame:
    """The first row of each label of slim (doc_id, sha, label, a row per document), by id and then text, with all columns of docs.

    Null ids go after all others. A row is known by its id and its text, so unrelated rows without an id, or with one id, all stay; of
    rows that share both, one does. Only the keys of rows that go, or that are there several times, meet the documents again.
    """
    keys = slim.groupBy("label", "doc_id", "sha").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")
    first = keys.groupBy("label").agg(F.min(order).alias("x"), F.sum("n").alias("rows")).filter("rows > 1").select("label", "x")
    stays = F.col("doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("sha") == F.col("x.sha"))
    marks = cut(keys.join(first, "label").select("doc_id", "sha", "n", stays.alias("stays")).filter("n > 1 or not stays"))
    own_id, own_sha, mark_id, mark_sha, stay = fresh(docs, "own_id", "own_sha", "mark_id", "mark_sha", "stay")
    marked = docs.withColumns({own_id: F.col(id_col).cast("long"), own_sha: sha})
    named = few(marks.select(F.col("doc_id").alias(mark_id), F.col("sha").alias(mark_sha), F.col("stays").alias(stay)))
    met = marked.join(named, F.col(own_id).eqNullSafe(F.col(mark_id)) & (F.col(own_sha) == F.col(mark_sha)), "left")
    kept = met.filter(F.col(stay).isNull()).select(*docs.columns)
    if marks.filter("stays").isEmpty():
        return kept
    return kept.unionByName(met.filter(stay).dropDuplicates([own_id, own_sha]).select(*docs.columns))
