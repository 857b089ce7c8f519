"""Language ID (operator 6): bit-sliced Bloom filters map an n-gram to the bit mask of all languages that contain it.

Training counts the letter n-grams of each labelled language over all training rows. A language contains an n-gram that makes up at
least LEAST_SHARE of its n-grams, unless it is much rarer there than in the language that has it most. That bounds what a filter holds
(1 / LEAST_SHARE n-grams) whatever the size of the corpus, and no ranking is needed. The filters of all languages are one table whose
slot holds one bit per language (a slice of 64 languages per plane), so that two look-ups and an AND answer for all languages at once.
A document's n-grams are counted per language by their mask bits; a count's expected false positives, n * rate, are taken off, and the
language with the largest corrected count decides.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.base import cut, fresh, mix, release, slices, sums, texts_of, tidy

SIZES = (2, 3, 4)
#: Least share of a language's n-grams that puts one into its filter, and the least share of the largest relative frequency.
LEAST_SHARE = 1e-5
RELATIVE = 0.2
#: Slots of the table; 2 slots per n-gram, so at most a fifth is set for a language.
SLOTS = 1 << 20
#: Languages there may be: a plane of 8 MB per 64 is broadcast.
LANGUAGES = 512
UNKNOWN = "und"
#: Bytes of text that a task works on at once: the arrays of a slice are many times as large, and two tasks share an executor.
SLICE = 1 << 20


@dataclass
class LanguageModel:
    """languages in the order of their bits; planes[p, slot] holds the bits of languages 64p to 64p + 63; rates by language."""

    languages: list[str]
    planes: np.ndarray
    rates: np.ndarray
    usual: int


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes of all words, words per text, and the distinct words in lower case."""
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), np.diff(split.offsets.to_numpy()), [w.lower() for w in coded.dictionary.to_pylist()]


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of the runs of letters of each word, padded by a boundary: (hash, word number), and each word's number of letters."""
    line = np.frombuffer(("\n".join([*words, ""])).encode("utf-32-le", "surrogatepass"), "<u4")
    number = np.cumsum(line == 10) - (line == 10)
    letter = _letters()[line]
    marks = np.concatenate(([0], np.where(letter, line, 0), [0, 0, 0])).astype(np.uint64)
    hashes, owners = [], []
    for size in SIZES:
        n = len(line)
        code = np.full(n, np.uint64(size))
        for k in range(size):
            code = code * np.uint64(0x110001) + marks[k : k + n]
        inner = letter if size < 4 else letter & np.append(letter[1:], False)
        at = np.flatnonzero(inner)  # starts one before a letter; the inner places are letters
        hashes.append(mix(code[at]))
        owners.append(number[at])
    return np.concatenate(hashes), np.concatenate(owners), np.bincount(number[letter], minlength=len(words))


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64), ((hashes >> np.uint64(32)) & np.uint64(SLOTS - 1)).astype(np.int64)


def gram_counts(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows whose language is known."""

    def count(batches):
        for batch in batches:
            texts, langs = texts_of(batch.column(0)), batch.column(1)
            for a, b in slices(texts, SLICE):
                codes, per_text, words = _words(texts.slice(a, b - a))
                hashes, owners, _ = _grams(words)
                own = langs.slice(a, b - a).dictionary_encode()
                of_word = np.repeat(own.indices.to_numpy(zero_copy_only=False), per_text)
                grams, place = np.unique(hashes, return_inverse=True)
                for k, lang in enumerate(own.dictionary.to_pylist()):
                    weight = np.bincount(codes[of_word == k], minlength=len(words))
                    n = np.bincount(place, weights=weight[owners], minlength=len(grams)).astype(np.int64)
                    some = n > 0
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * int(some.sum()), pa.string()), pa.array(grams[some].view(np.int64)), pa.array(n[some])], ["lang", "gram", "n"])

    known = rows.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return known.mapInArrow(tidy(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", least: float = LEAST_SHARE, relative: float = RELATIVE) -> LanguageModel:
    """Learn from all rows with a language. At most 1 / least numbers per language reach the driver, one language at a time."""
    counts = cut(gram_counts(rows, text_col, lang_col))  # asked three times below
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counts.join(totals, "lang").withColumn("share", F.col("n") / F.col("total")).filter(F.col("share") >= least)
    most = share.groupBy("gram").agg(F.max("share").alias("most"))
    kept = share.join(most, "gram").filter(F.col("share") >= relative * F.col("most")).groupBy("lang", "total").agg(F.collect_list("gram").alias("grams"))
    kept = cut(kept)
    n = kept.count()
    if n > LANGUAGES:
        raise ValueError(f"{n} values of {lang_col} are more than the {LANGUAGES} languages that a model may have")
    languages, sizes, planes, fills = [], [], np.zeros((max(1, -(-n // 64)), SLOTS), np.uint64), []
    for k, row in enumerate(kept.orderBy("lang").toLocalIterator()):
        bit = np.uint64(1 << (k % 64))
        for slot in _slots(np.array(row.grams, np.int64).view(np.uint64)):
            planes[k // 64][slot] |= bit
        fills.append(np.count_nonzero(planes[k // 64] & bit) / SLOTS)
        languages.append(row.lang)
        sizes.append(row.total)
    usual = max(range(n), key=lambda k: (sizes[k], -k)) if n else -1
    return LanguageModel(languages, planes, np.array(fills) ** 2, usual)


def predict(texts: pa.Array, model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: und and 0 without a letter; else the share that the language has of all corrected counts."""
    texts, names, scores = texts_of(texts), [], []
    for a, b in slices(texts, SLICE):
        codes, per_text, words = _words(texts.slice(a, b - a))
        hashes, owners, letters = _grams(words)
        x, y = _slots(hashes)
        counts = np.zeros((len(words), len(model.languages)), np.int64)
        for p, plane in enumerate(model.planes):
            masks = plane[x] & plane[y]
            for k in range(64 * p, min(64 * p + 64, len(model.languages))):
                counts[:, k] = np.bincount(owners, weights=(masks >> np.uint64(k % 64)) & np.uint64(1), minlength=len(words))
        n = np.bincount(owners, minlength=len(words))
        of_text = sums(np.column_stack((counts, n, letters))[codes], per_text)
        corrected = np.maximum(0, (of_text[:, :-2] - of_text[:, -2:-1] * model.rates) / (1 - model.rates))
        if not model.languages:
            names += [UNKNOWN] * (b - a)
            scores.append(np.zeros(b - a))
            continue
        best, total = corrected.argmax(axis=1), corrected.sum(axis=1)
        best[total == 0] = model.usual
        known = of_text[:, -1] > 0
        names += [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
        scores.append(np.where(known & (total > 0), corrected.max(axis=1) / np.maximum(total, 1e-9), 0.0))
    return names, np.concatenate(scores) if scores else np.zeros(0)


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "language") -> DataFrame:
    """Add a struct column (lang, score). The model has a fixed size, whatever it was trained on."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def identify(texts: pa.Array) -> pa.Array:
        names, scores = predict(texts, shared.value)
        release()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return docs.withColumn(out, identify(F.col(text_col)))


def held_out(id_col: str = "doc_id") -> F.Column:
    """One row in five, by the id alone; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def identify_all(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, by a model that saw no held-out row.

    Null texts and texts without a letter get und and 0; without any labelled row every document does. Texts of any length count whole.
    Of languages with equal counts the first by name is taken, and the one with most training text where nothing counts. Repeated rows
    get the same answer, and train as often as they are there. Other columns play no part. Empty input gives no rows.
    """
    rows = docs.select("doc_id", F.col("text"), F.col("lang"), held_out().alias("held_out"))
    model = train(rows.filter(~F.col("held_out")))
    return with_language(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told, with all their columns, whatever their names: those without a letter go, null texts too.

    No others go, nor if no row has a language. Repeated rows and rows without an id stay as they are. Empty input gives no rows.
    """
    model = train(docs.filter(~held_out()))
    if not model.languages:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    (found,) = fresh(docs, "found_language")
    return with_language(docs, model, out=found).filter(F.col(f"{found}.lang") != UNKNOWN).select(*docs.columns)
