"""Keyword search (BM25), search by meaning (vectors), and their fusion."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from brindle.functions.values import keywords
from brindle.operators import keyword_blocks

CANDIDATES = 30
RRF = 60
DIMENSIONS = 64
#: Questions of a block of a search by meaning: what is broadcast at once.
BLOCK = 1024
#: Vectors that a block is multiplied with at once.
SLICE = 2048


@functools.cache
def _marked_letters() -> tuple[str, str]:
    """Small letters that are a letter and a diacritic (Latin, Greek, Cyrillic), and their letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x500), *range(0x1E00, 0x2000))]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(map(unicodedata.combining, d[1:])) and c.islower()]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def folded(c: Column) -> Column:
    """Lower case, without diacritics."""
    low = F.lower(c)
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, *_marked_letters())).otherwise(low)


def marks() -> dict[int, int]:
    """What folded() replaces, for Python's translate()."""
    return str.maketrans(*_marked_letters())


def tokens(c: Column) -> Column:
    """Runs of letters and digits, lower-cased and without diacritics."""
    return F.regexp_extract_all(folded(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def question_terms(questions: DataFrame) -> DataFrame:
    """(question, term): the words that the questions (question, text) are searched by."""
    return questions.select("question", F.explode(F.array_distinct(tokens(F.array_join(keywords(F.col("text")), " ")))).alias("term"))


def bm25(docs: DataFrame, questions: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = CANDIDATES) -> DataFrame:
    """The best documents of each question (question, text): (question, id, score, place); any of its keywords may match.

    Texts are read once. Blocks of documents keep their postings of the words that are asked for, and each gives its best ones. Ids must
    be unique. The words asked for are sent to all tasks.
    """
    asked = question_terms(questions)
    wanted = [r.term for r in asked.select("term").distinct().collect()]
    words = docs.select(F.col(id_col).alias("id"), keyword_blocks.spaced(F.col(text_col)).alias("words"))
    return keyword_blocks.ranked(keyword_blocks.packed(words, marks(), wanted), asked, top)


def words_contained(docs: DataFrame, question: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How many of a question's keywords a text contains, more first, ties by id."""
    body = F.lower(F.col(text_col))
    n = F.size(F.filter(keywords(question), lambda w: F.contains(body, w)))
    return docs.select(F.col(id_col).alias("id"), n.cast("long").alias("contained"))


def stand_in_vector(c: Column, dimensions: int = DIMENSIONS) -> Column:
    """A deterministic stand-in for an embedding: words counted in buckets by md5, brought to unit length."""
    buckets = F.transform(tokens(c), lambda w: F.conv(F.substring(F.md5(w), F.lit(31), F.lit(2)), 16, 10).cast("int") % dimensions)
    counts = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(counts, lambda x: x / norm)).otherwise(counts)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _nearest(questions: list, top: int):
    """A function of Arrow batches (id, own): (question, id, score) of the vectors that may be among the nearest `top` of a question.

    A product of matrices finds them: what is 0.000001 below the best `top` seen in one slice so far can't be among them. Their scores
    are then summed in the order of the dimensions, as dot() does.
    """

    def run(batches):
        sizes: dict[int, list[int]] = {}
        for at, (_, vector) in enumerate(questions):
            sizes.setdefault(len(vector), []).append(at)
        asked = {n: (np.array([questions[i][1] for i in at], dtype=float).reshape(len(at), n), np.array(at)) for n, at in sizes.items()}
        least = np.full(len(questions), -np.inf)
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(1)), -1).to_numpy(zero_copy_only=False)
            for n, (matrix, numbers) in asked.items():
                rows = np.flatnonzero(lengths == n)
                for start in range(0, len(rows), SLICE):
                    part = rows[start : start + SLICE]
                    own = batch.column(1).take(pa.array(part)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(part), n)
                    scores = matrix @ own.T
                    if len(part) >= top:
                        kth = np.partition(np.where(np.isnan(scores), -np.inf, scores), len(part) - top, axis=1)[:, len(part) - top]
                        least[numbers] = np.maximum(least[numbers], kth)
                    floor = least[numbers] - 1.1e-6 - 1e-9 * np.abs(np.where(np.isinf(least[numbers]), 0, least[numbers]))
                    q, v = np.nonzero(~(scores < floor[:, None]))
                    exact = np.zeros(len(q))
                    for i in range(n):
                        exact += matrix[q, i] * own[v, i]
                    yield numbers[q], batch.column(0).take(pa.array(part[v])), exact

    return run


def by_meaning(vectors: DataFrame, questions: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = CANDIDATES, block: int = BLOCK) -> DataFrame:
    """The nearest vectors of each question (question, vector): (question, id, score, place). Others of another length are left out,
    as are vectors with a gap.

    Every vector is compared with every question. Questions are brought to the tasks in blocks of about `block`, dealt by hash, so what
    is sent at once has one size however many there are; a task keeps what may be among the top rows before anything is shuffled.
    """
    blocks = max(1, -(-questions.count() // block))
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    dealt = questions.where(whole("vector")).select("question", "vector", F.pmod(F.xxhash64("question"), F.lit(blocks)).alias("block"))
    own = vectors.where(whole(vector_col)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("own"))
    kinds = {"question": questions.schema["question"].dataType, "id": vectors.schema[id_col].dataType}
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "id"))
    found = []
    for number in range(blocks):
        asked = [(r.question, r.vector) for r in dealt.where(F.col("block") == number).collect()]
        names, nearest = pa.array([q for q, _ in asked], to_arrow_type(kinds["question"])), _nearest(asked, top)

        def run(batches, names=names, nearest=nearest):
            for q, ids, scores in nearest(batches):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), ids, pa.array(scores)], ["question", "id", "score"])

        scored = own.mapInArrow(run, f"question {kinds['question'].simpleString()}, id {kinds['id'].simpleString()}, score double")
        scored = scored.withColumn("score", F.round("score", 6))
        found.append(scored.withColumn("place", place.cast("long")).where(F.col("place") <= top))
    return functools.reduce(DataFrame.unionByName, found)


def fuse(words: DataFrame, meaning: DataFrame, top: int = 6) -> DataFrame:
    """Reciprocal-rank fusion of two rankings (question, id, place): (question, id, score, matched_by, place)."""
    a = words.select("question", "id", F.col("place").alias("w"))
    b = meaning.select("question", "id", F.col("place").alias("m"))
    both = a.join(b, ["question", "id"], "full_outer")
    part = lambda c: F.coalesce(1 / (F.lit(RRF) + F.col(c)), F.lit(0.0))
    fused = part("w") + part("m")
    by = F.when(F.col("w").isNotNull() & F.col("m").isNotNull(), "both").when(F.col("w").isNotNull(), "words").otherwise("meaning")
    order = Window.partitionBy("question").orderBy(F.desc(F.round(fused, 12)), F.col("w").isNull(), F.coalesce("w", "m"), "id")
    ranked = both.select("question", "id", F.round(fused * 1000, 2).alias("score"), by.alias("matched_by"), F.row_number().over(order).cast("long").alias("place"))
    return ranked.where(F.col("place") <= top)
