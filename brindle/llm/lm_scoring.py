"""LM scoring (operator 2): cross-entropy difference of matched n-gram models that share one vocabulary (Moore and Lewis, 2010).

The vocabulary is every word of the corpus. Target (labelled good) and background (all other documents) have the same order, vocabulary
and smoothing. A pair's probability is smoothed towards the word's (Dirichlet prior), and the word's towards the uniform one. The larger
model's counts are scaled to the size of the other, so that neither wins by having seen more. The models are fitted twice, over the
texts whose hash is even and over the others, and each text is scored by the fit that did not see it or its copies. A document's score
is the mean over its tokens of background loss minus target loss, in nats: above 0, the text looks more like the target.

Words and pairs are counted one by one under keys of 64 bits, in tables that grow with the input and never meet in one place. Documents
are dealt over slices; a slice counts its distinct keys and sends them to ranges of keys; a range adds them up and answers each slice
with what the other fold counted for its keys. A frequent pair is one key per slice, however many documents have it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.base import mix, slices, split_words, sums, texts_of

PRIOR = 64.0
#: Bytes of text of a slice, and bytes of text whose keys one range takes.
SLICE = 6 << 20
RANGE = 8 << 20
#: Distinct words that a task holds before it emits them.
HELD = 1 << 19
#: What a slice sends to the ranges.
COUNTED = {"slice": pa.int64(), "fold": pa.int32(), "part": pa.int32(), "keys": pa.binary(), "n": pa.binary()}


def _flat_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    words, per_text = split_words(pc.ascii_lower(texts))
    return words.dictionary_encode(), per_text


def _hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key of each word and of the pair that ends at it, which words begin a text, and words per text."""
    coded, per_text = _flat_words(texts)
    words = _hash(coded.dictionary.cast(pa.large_binary()).to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
    first = np.zeros(len(words), bool)
    first[(np.cumsum(per_text) - per_text)[per_text > 0]] = True
    return words, mix(mix(np.roll(words, 1)) + words * np.uint64(0x9E3779B97F4A7C15)), first, per_text


def _distinct(words: np.ndarray, pairs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the place of each word and then of each pair among them."""
    return np.unique(np.concatenate((words, pairs[~first])), return_inverse=True)


def _packed_keys(keys: np.ndarray, base: int) -> bytes:
    """Steps between ascending keys from base on, each in as many bytes as the largest needs."""
    steps = np.diff(keys, prepend=np.uint64(base)).astype("<u8")
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    return steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked_keys(body: bytes, n: int, base: int) -> np.ndarray:
    steps = np.zeros((n, 8), np.uint8)
    steps[:, : len(body) // n] = np.frombuffer(body, np.uint8).reshape(n, -1)
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64) + np.uint64(base)


def _packed_counts(counts: np.ndarray) -> bytes:
    """Counts of both models, [2, n], by planes of bytes."""
    return zlib.compress(counts.astype("<u4").reshape(-1).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked_counts(body: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(body), np.uint8).reshape(4, -1).T).reshape(-1).view("<u4").reshape(2, -1)


def vocabulary_size(docs: DataFrame) -> int:
    """Distinct words over all documents."""

    def distinct(batches):
        held = np.zeros(0, np.uint64)
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in slices(texts):
                coded, _ = _flat_words(texts.slice(a, b - a))
                held = np.union1d(held, _hash(coded.dictionary.cast(pa.large_binary()).to_pylist()))
                if len(held) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64))], ["word"])
                    held = held[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64))], ["word"])

    return docs.select("text").mapInArrow(distinct, "word long").distinct().count()


def totals(rows: DataFrame, good: DataFrame) -> np.ndarray:
    """Words of background and target, [fold, model]."""

    @F.arrow_udf("long")
    def size(texts: pa.Array) -> pa.Array:
        texts = texts_of(texts)
        return pa.array(np.concatenate([np.zeros(0, np.int64), *(split_words(texts.slice(a, b - a))[1] for a, b in slices(texts))]), pa.int64())

    # The documents meet their labels by one shuffle at every size: the labels grow with the documents.
    slim = rows.select("doc_id", "fold", size("text").alias("n")).join(good.hint("merge"), "doc_id", "left")
    out = np.zeros((2, 2))
    for r in slim.groupBy("fold", F.col("good").isNotNull().cast("int").alias("target")).agg(F.sum("n").alias("n")).collect():
        out[r.fold, r.target] = r.n
    return out


def _losses(words: np.ndarray, pairs: np.ndarray, first: np.ndarray, per_text: np.ndarray, seen: np.ndarray, size: int, total: np.ndarray) -> np.ndarray:
    """Mean loss per word under background and target, [texts, 2]; 0 without words. seen: counts of the fit by distinct key, [2, keys]."""
    _, place = _distinct(words, pairs, first)
    at, pair_at = place[: len(words)], np.zeros(len(words), np.int64)
    pair_at[~first] = place[len(words) :]
    out = np.zeros((len(words), 2))
    scale = np.maximum(1, total).min() / np.maximum(1, total)
    for k in (0, 1):
        counts = seen[k] * scale[k]
        alone = (counts[at] + 1) / (total[k] * scale[k] + size)
        pair = (counts[pair_at] + PRIOR * alone) / (counts[np.roll(at, 1)] + PRIOR)
        out[:, k] = -np.log(np.where(first, alone, np.minimum(pair, 1.0)))
    return sums(out, per_text) / np.maximum(1, per_text)[:, None]


def score_all(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_tokens, target_loss, background_loss, score.

    Target documents are those labelled quality 1; without any, both models are what the smoothing gives. A null or blank text has no
    tokens, losses and score 0. A document labelled twice counts once; repeated rows count and are scored as often as they are there.
    Texts of any length count whole. Other columns play no part. Empty input gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").bitwiseAND(F.lit(1)).cast("int").alias("fold"))
    good = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("good")).distinct()
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size, total = vocabulary_size(rows), totals(rows, good)
    n_slices, bits = 1 + n_bytes // SLICE, int(n_bytes // RANGE).bit_length()
    slice_of = lambda key: F.pmod(key, F.lit(n_slices)).alias("slice")
    dealt = rows.select(slice_of(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))), "doc_id", "text", "fold")
    marks = good.select(slice_of(F.xxhash64("doc_id")), "doc_id")

    def by_fold(docs: pa.Table):
        texts, folds = texts_of(docs["text"]), docs["fold"].to_numpy()
        for f in (0, 1):
            own = np.flatnonzero(folds == f)
            yield f, own, _keys(texts.take(pa.array(own)))

    def count(docs: pa.Table, marks: pa.Table) -> pa.Table:
        if not len(docs):
            return pa.table({c: pa.array([], t) for c, t in COUNTED.items()})
        target = pc.fill_null(pc.is_in(docs["doc_id"], value_set=marks["doc_id"].combine_chunks()), False).to_numpy().astype(bool) & docs["doc_id"].is_valid().to_numpy()
        out = []
        for f, own, (words, pairs, first, per_text) in by_fold(docs):
            keys, place = _distinct(words, pairs, first)
            of = np.repeat(target[own], per_text)
            of = np.concatenate((of, of[~first]))
            n = np.stack([np.bincount(place[of == k], minlength=len(keys)) for k in (False, True)])
            bounds = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1)) if bits else [0, len(keys)]
            out += [(docs["slice"][0].as_py(), f, p, _packed_keys(keys[a:b], p << (64 - bits)), _packed_counts(n[:, a:b])) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
        return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(COUNTED.items())})

    def add(group: pa.Table) -> pa.Table:
        base, folds = group["part"][0].as_py() << (64 - bits), group["fold"].to_pylist()
        counts = [_unpacked_counts(n.as_py()) for n in group["n"]]
        lengths = [n.shape[1] for n in counts]
        keys, place = np.unique(np.concatenate([_unpacked_keys(x.as_py(), m, base) for x, m in zip(group["keys"], lengths, strict=True)]), return_inverse=True)
        seen, ends = np.zeros((2, 2, len(keys)), np.uint32), np.cumsum(lengths)
        for f, e, m, n in zip(folds, ends, lengths, counts, strict=True):
            seen[f][:, place[e - m : e]] += n  # a slice has a key once
        answers = [_packed_counts(seen[1 - f][:, place[e - m : e]]) for f, e, m in zip(folds, ends, lengths, strict=True)]
        return group.select(["slice", "fold", "part"]).append_column("seen", pa.array(answers, pa.binary()))

    def score(docs: pa.Table, seen: pa.Table) -> pa.Table:
        n, loss = np.zeros(len(docs), np.int64), np.zeros((len(docs), 2))
        if len(docs):
            answers = sorted(zip(seen["fold"].to_pylist(), seen["part"].to_pylist(), seen["seen"].to_pylist(), strict=True), key=lambda r: r[:2])
            for f, own, (words, pairs, first, per_text) in by_fold(docs):
                found = np.concatenate([np.zeros((2, 0)), *(_unpacked_counts(x) for g, _, x in answers if g == f)], axis=1)
                n[own] = per_text
                if len(words):
                    loss[own] = _losses(words, pairs, first, per_text, found, size, total[1 - f])
        return pa.table({"doc_id": docs["doc_id"].cast(pa.int64()), "n_tokens": n, "target_loss": loss[:, 1], "background_loss": loss[:, 0]})

    counted = dealt.groupBy("slice").cogroup(marks.groupBy("slice")).applyInArrow(count, "slice long, fold int, part int, keys binary, n binary")
    seen = counted.groupBy("part").applyInArrow(add, "slice long, fold int, part int, seen binary")
    scored = dealt.groupBy("slice").cogroup(seen.groupBy("slice")).applyInArrow(score, "doc_id long, n_tokens long, target_loss double, background_loss double")
    return scored.withColumn("score", F.col("background_loss") - F.col("target_loss"))
