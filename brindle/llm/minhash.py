"""Document fingerprints (operator 5): one-permutation MinHash with optimal densification, stored as packed low-order bits.

The hashes of a text's 5-word shingles are dealt to BINS bins by their high bits and each bin keeps its least hash, so every shingle is
hashed once. An empty bin takes the value of the bin that a fixed random walk from it first finds filled (Shrivastava, 2017: the walk
differs per bin, which makes the variance the least possible). Of each bin 4 bits are stored. Two unrelated bins agree in them with
probability 1/16, and the likeness corrects for it: (share of equal bins - 1/16) / (1 - 1/16).
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.base import bucket_of, mix, parts, range_buckets, slices, split_words, spread, texts_of

BINS = 512
BITS = 4
SHINGLE = 5
#: Steps of the random walks that are tabled; a walk that finds nothing by then goes on to the next filled bin.
WALK = 8 * BINS
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Scripts that are written without spaces (South-East Asian ones, kana, ideographs): each of their characters counts as a word.
UNSPACED = "([\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\U00020000-\U0002FA1F])"


@functools.cache
def _walk() -> np.ndarray:
    """Step t of the walk of each bin: [WALK, BINS]."""
    n = np.arange(WALK * BINS, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    return (mix(n) % np.uint64(BINS)).astype(np.int64).reshape(WALK, BINS)


def shingle_hashes(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all texts, and their number by text; a text of fewer words has one shingle, without words none."""
    if pc.any(pc.match_substring_regex(texts, UNSPACED)).as_py():
        texts = pc.replace_substring_regex(texts, UNSPACED, r" \1 ")
    every, n_words = split_words(pc.utf8_lower(texts))
    coded = every.dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    flat = own[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
    first = np.cumsum(n_words) - n_words
    padded = np.concatenate((flat, np.zeros(size, np.uint64)))
    n = np.where(n_words == 0, 0, np.maximum(1, n_words - size + 1))
    at, length = spread(first, n), np.repeat(np.minimum(n_words, size), n)
    code = length.astype(np.uint64)
    for k in range(size):
        word = np.where(k < length, padded[at + k], np.uint64(0)) if (length < size).any() else padded[at + k]
        code = (code * np.uint64(0x9E3779B97F4A7C15)) ^ (word + np.uint64(k))
        code ^= code >> np.uint64(29)
    return mix(code), n


def sketches(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Low-order bits of each text's densified bins, [texts, BINS], and whether a text has any word."""
    hashes, n = shingle_hashes(texts)
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), n)
    shift = BINS.bit_length() - 1
    place = row * np.uint64(BINS) + (hashes >> np.uint64(64 - shift))
    order = np.sort((place << np.uint64(32)) | ((hashes >> np.uint64(8)) & np.uint64(0xFFFFFFFF)))
    place = order >> np.uint64(32)
    least = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
    bins = np.full(len(texts) * BINS, EMPTY)
    bins[place[least].astype(np.int64)] = order[least] & np.uint64(0xFFFFFFFF)
    bins = bins.reshape(len(texts), BINS)
    filled, some = bins != EMPTY, n > 0
    doc, at = np.nonzero(~filled & some[:, None])
    dense = bins.copy()
    for step in range(WALK):
        if not len(doc):
            break
        to = _walk()[step][at]
        hit = filled[doc, to]
        dense[doc[hit], at[hit]] = bins[doc[hit], to[hit]]
        doc, at = doc[~hit], at[~hit]
    for d, a in zip(doc, at, strict=True):
        own = np.flatnonzero(filled[d])
        dense[d, a] = bins[d, own[np.searchsorted(own, a) % len(own)]]
    dense[~some] = 0
    return (mix(dense) & np.uint64((1 << BITS) - 1)).astype(np.uint8), some


def packed(sketch: np.ndarray) -> list[str]:
    """Hexadecimal digits of the packed bits: one digit per bin."""
    both = (sketch[:, 0::2] << 4) | sketch[:, 1::2]
    return [x.tobytes().hex() for x in both]


def unpacked(digits: list[str]) -> np.ndarray:
    both = np.frombuffer(bytes.fromhex("".join(digits)), np.uint8).reshape(len(digits), BINS // 2)
    return np.stack((both >> 4, both & 15), axis=2).reshape(len(digits), BINS)


def likeness(x: np.ndarray, y: np.ndarray, x_some: np.ndarray, y_some: np.ndarray) -> np.ndarray:
    """Estimated share of common shingles, corrected for bits that agree by chance; two texts without words are alike, one is not."""
    chance = 2.0**-BITS
    found = np.clip(((x == y).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return np.where(x_some & y_some, found, (x_some == y_some).astype(float))


def _edited(text: str, after: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def fingerprint_all(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document follows in ascending order of (doc_id, text); null ids come first, a null text is empty, the last document's next
    is the first. Texts are dealt once, by ranges of the id; the first row of each range is dealt to the range before it too. Repeated
    rows follow one another. Texts of any length count whole. Other columns play no part. Empty input gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Null ids go before all others: they take the place of the least long in the order.
    rows = rows.withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63))))
    cuts = range_buckets(rows, "at", parts(spark))
    n = max(1, len(cuts))
    bucket = bucket_of("at", cuts) if cuts else F.lit(0)
    lead = F.col("at").isin(*cuts) if cuts else F.lit(False)
    here = F.struct(F.col("bucket"), F.lit(False).alias("extra"))
    before = F.struct(F.pmod(F.col("bucket") + n - 1, F.lit(n)).alias("bucket"), F.lit(True).alias("extra"))
    both = rows.withColumn("bucket", bucket.cast("int")).withColumn("to", F.explode(F.when(lead, F.array(here, before)).otherwise(F.array(here))))
    dealt = both.select(F.col("to.bucket").alias("bucket"), F.col("to.extra").alias("extra"), "doc_id", "at", "text")
    dealt = dealt.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "extra", "at", "text")

    def follow(batches):
        """Each row is done when the next one is known; the first extra row of a bucket ends it, further ones are left out."""
        wait: list | None = None  # doc_id, text
        where = None

        def slice_of(rows, last):
            nonlocal wait
            chain = ([wait] if wait else []) + rows
            wait = None if last else chain[-1]
            return chain

        for batch in batches:
            buckets, extras = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            ids, texts = batch.column(2), texts_of(batch.column(3))
            for a, b in slices(texts, 2 << 20):
                own = list(zip(ids.slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist(), strict=True))
                for x in np.split(np.arange(a, b), np.flatnonzero(np.diff(buckets[a:b] * 2 + extras[a:b])) + 1):
                    some = [own[i - a] for i in x]
                    if extras[x[0]]:
                        if where == buckets[x[0]] and wait:
                            chain = slice_of(some[:1], True)
                            yield _done(chain)
                        continue
                    if where != buckets[x[0]]:
                        wait, where = None, buckets[x[0]]
                    chain = slice_of(some, False)
                    if len(chain) > 1:
                        yield _done(chain)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("bucket", "extra", "doc_id", "text").mapInArrow(follow, schema)


def _done(chain: list[tuple[int | None, str]]) -> pa.RecordBatch:
    """Results of all rows of a chain but the last, which is the next of the one before it."""
    texts = [t for _, t in chain]
    edited = [_edited(t, after) for t, after in zip(texts[:-1], texts[1:], strict=True)]
    own, some = sketches(pa.array(texts, pa.large_string()))
    other, other_some = sketches(pa.array(edited, pa.large_string()))
    names = packed(own[:-1])
    columns = [
        pa.array([i for i, _ in chain[:-1]], pa.int64()),
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array(names),
        pa.array(packed(other)),
        pa.array(likeness(own[:-1], other, some[:-1], other_some)),
        pa.array(likeness(own[:-1], own[1:], some[:-1], some[1:])),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
