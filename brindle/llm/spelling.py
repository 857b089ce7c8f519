"""Spelling variant grouping (operator 12): words that one inserted, deleted or replaced letter apart, by bands of letter parities.

A word's mask has a bit for each letter, set if the letter occurs an odd number of times. One edit flips at most two bits, so of three
bands of the mask at least one stays equal. Words are joined on equal bands with a length filter: the longer word's length is part of the
key. So is the half of the longer word that the edit leaves untouched, first or last, which keeps the lists of a band short in a large
vocabulary and loses no pair. A pair that meets more than once counts where it meets first. What is left has one or two different
parities, and is verified by edit distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.base import cut, few, lowered, tidy

#: Runs of letters.
RUN = "[A-Za-zÀ-ÿ]+"
#: The letters of lower-cased runs, each with a bit of its own; every third one belongs to one band.
LETTERS = "".join(map(chr, (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))))
BANDS = 3
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: One in so many runs of a document loses a letter, chosen by its checksum.
DAMAGED = 97
#: A form is so many times as frequent as its variant, at least.
TIMES = 2


def damaged(doc_id: F.Column, run: F.Column, one_in: int = DAMAGED) -> F.Column:
    """The run, without its code point h % length if one_in divides h, the crc32 of '<doc_id>:<run>'."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of whole texts, long and frequent enough. Counted in each task before anything is shuffled."""
    runs = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(lowered(F.coalesce(F.col(text_col), F.lit(""))), F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.select(damaged(F.col("doc_id"), F.col("run")).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def parities(words: pa.Array) -> np.ndarray:
    """Bands of the letter parities of words that aren't empty, [words, 3]."""
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4")
    place = np.zeros(0x100, np.int64)
    place[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
    place = place[points]
    starts = np.cumsum(length) - length
    bits = np.int64(1) << (place // BANDS)
    out = [np.bitwise_xor.reduceat(np.where(place % BANDS == b, bits, 0), starts) if len(starts) else np.zeros(0, np.int64) for b in range(BANDS)]
    return np.column_stack(out)


def _masked(words: DataFrame) -> DataFrame:
    def mask(batches):
        for batch in batches:
            bands = parities(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(bands[:, b]) for b in range(BANDS))], ["word", "n", "m0", "m1", "m2"])

    return words.select("word", "n").mapInArrow(tidy(mask), "word string, n long, m0 long, m1 long, m2 long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words (word, n) that differ by one code point, once; a is the longer one, or the later of equal length."""
    masked = cut(_masked(words))
    size = F.length("word")

    def keyed(longest, prefix: str) -> DataFrame:
        """A row for each length of the longer word, half and band."""
        keys = []
        for length in longest:
            half = F.floor(length / 2).cast("int")
            halves = (F.substring(F.col("word"), F.lit(1), half), F.substring(F.col("word"), size - length + half + 1, length - half))
            for side, text in enumerate(halves):
                keys += [F.struct(F.lit(side * BANDS + band).alias("kind"), F.xxhash64(F.lit(side * BANDS + band), length, text, f"m{band}").alias("key")) for band in range(BANDS)]
        return masked.select(*[F.col(c).alias(prefix + c) for c in masked.columns], F.inline(F.array(*keys)).alias(f"{prefix}kind", f"{prefix}key"))

    a, b = keyed([size], "a_"), keyed([size, size + 1], "b_")
    same_length = F.length("a_word") == F.length("b_word")
    shorter = F.length("a_word") == F.length("b_word") + 1
    flips = sum((F.bit_count(F.col(f"a_m{i}").bitwiseXOR(F.col(f"b_m{i}"))) for i in range(1, BANDS)), F.bit_count(F.col("a_m0").bitwiseXOR(F.col("b_m0"))))
    half = F.floor(F.length("a_word") / 2).cast("int")
    first_half = F.substring(F.col("a_word"), F.lit(1), half) == F.substring(F.col("b_word"), F.lit(1), half)
    band, side = F.col("a_kind") % BANDS, F.floor(F.col("a_kind") / BANDS)
    equal = [F.col(f"a_m{i}") == F.col(f"b_m{i}") for i in range(BANDS)]
    met_before = (side == 1) & first_half | (band >= 1) & equal[0] | (band == 2) & equal[1]
    right = same_length & (flips == 2) & (F.col("a_word") > F.col("b_word")) | shorter & (flips == 1)
    near = (F.col("a_key") == F.col("b_key")) & (F.col("a_kind") == F.col("b_kind")) & right & ~met_before
    met = a.join(b, near).filter(F.levenshtein("a_word", "b_word", 1) == 1)
    return met.select(F.col("a_word").alias("a"), F.col("a_n").alias("n_a"), F.col("b_word").alias("b"), F.col("b_n").alias("n_b"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each word's chain. Forms grow in frequency, so chains have no circles and a logarithmic length; each round doubles what a step covers."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        step = few(now.select(F.col("word").alias("root"), F.col("root").alias("next")))
        then = cut(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if then.filter("moved").isEmpty():
            return then.select("word", "root")
        now = then.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    form is the near word of largest n (ties: the smallest in code-point order) if that n is at least `times` the word's, else null, as is
    form_n; root is the end of the chain of forms, the word itself without a form. Null texts have no words, a null id counts as an empty
    one; repeated rows count again. Other columns play no part. Without words there are no rows.
    """
    words = cut(vocabulary(docs, id_col, text_col, least_length, least_count))
    pairs = cut(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    joined = words.join(best, "word", "left")
    enough = -F.col("best.m") >= times * F.col("n")
    formed = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n")))
    ends = roots(formed.filter("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
