"""Ranked lexical search (operator 13): the best documents of each item, by a threshold-seeded join of postings.

A document's score for an item sums an impact w * ((10^9 tf) div (1000 tf + 8 m)) over the item's terms that it holds. In blocks of items:
1. one scan of the texts stores each document's postings of terms that are asked for, its length, and so N, L and document frequencies;
2. each term's TOP largest impacts are stored: the kth of them is reached by TOP documents by that term alone, so the largest kth impact of
   an item's terms lower-bounds its kth score; the largest impact bounds what the term can add;
3. with an item's terms in falling order of their bounds, the longest suffix whose bounds sum to less than the threshold is pruned: a
   document with pruned terms only can't enter the ranking. The other postings generate candidates; a candidate whose sum and the
   suffix's bound don't reach the threshold goes, the others are rescored with all of the item's terms. What reaches it is ranked.
Texts and postings stay where they lie; terms' and items' TOP rows are all that is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.base import cut, lowered, new_path, slices, spread, sums, texts_of, tidy

TOP = 10
#: Maximal runs of digits, letters and what lies beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms of items, repeats among items included, that a block has at most (or one item has): they go to all tasks at once.
BLOCK_TERMS = 1 << 18
#: Rows of (document, item) that a task holds at once, or those of one document.
PAIRS_AT_ONCE = 1 << 21

#: What a byte becomes: A-Z small, other characters of terms themselves, all else a blank.
_BYTES = np.full(256, ord(" "), np.uint8)
for _first, _last, _shift in (("0", "9", 0), ("a", "z", 0), ("A", "Z", 32)):
    _range = np.arange(ord(_first), ord(_last) + 1)
    _BYTES[_range] = _range + _shift
_BYTES[128:] = np.arange(128, 256)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of texts, one after another, and the number of each text's terms."""
    texts = pa.concat_arrays([texts_of(texts)])  # starts at its buffers' beginning
    if not len(texts):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    bounds, data = texts.buffers()[1], texts.buffers()[2]
    ends = np.frombuffer(bounds, np.int64)[: len(texts) + 1]
    plain = _BYTES[np.frombuffer(data, np.uint8)[: ends[-1]]] if data is not None else np.zeros(0, np.uint8)
    blank = pa.Array.from_buffers(pa.large_string(), len(texts), [None, bounds, pa.py_buffer(plain)])
    split = pc.ascii_split_whitespace(blank)
    words, counts = split.flatten(), np.diff(split.offsets.to_numpy())
    full = pc.not_equal(words, "")
    return words.filter(full), sums(full.to_numpy(zero_copy_only=False).astype(np.int64), counts)


def _store(docs: DataFrame, vocabulary: pa.Array, path: str) -> None:
    """Write (doc_id, n, terms, tfs) of (doc_id, text): the places in the vocabulary of a document's terms, ascending, and their counts."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def count(batches):
        for batch in batches:
            ids, texts = batch.column(0), texts_of(batch.column(1))
            for a, b in slices(texts):
                words, n = terms_of(texts.slice(a, b - a))
                place = pc.fill_null(pc.index_in(words, value_set=shared.value), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(b - a), n)[place >= 0]
                keys, tf = np.unique(doc * len(shared.value) + place[place >= 0], return_counts=True)
                owner, place = np.divmod(keys, max(len(shared.value), 1))
                ends = np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (place.astype(np.int32), tf.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])

    docs.mapInArrow(tidy(count), "doc_id long, n long, terms array<int>, tfs array<long>").write.parquet(path)
    shared.unpersist()


def impacts(w: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """w * ((10^9 tf) div (1000 tf + 8 m)) with m = 10 + (90 n N) div L, in whole numbers."""
    if len(n) and 90 * int(n.max()) * documents >= 1 << 63:
        m = np.array([10 + 90 * int(x) * documents // length for x in n], np.int64)  # beyond 64 bits
    else:
        m = 10 + 90 * n * documents // max(length, 1)
    return w * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df.astype(np.float64) + 1))).astype(np.int64)


def _postings(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of each row; document row, term and tf of each posting."""
    lists = batch.column(2)
    each = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return each, np.repeat(np.arange(len(batch)), each), lists.flatten().to_numpy().astype(np.int64), batch.column(3).flatten().to_numpy()


def first_of(group: np.ndarray, top: int, *order: np.ndarray) -> np.ndarray:
    """Rows that are among the first `top` of their group, by the orders (first one first)."""
    if not len(group):
        return np.zeros(0, np.int64)
    sort = np.lexsort((*reversed(order), group))
    ordered = group[sort]
    begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    place = np.arange(len(sort)) - np.repeat(begins, np.diff(np.append(begins, len(sort))))
    return sort[place < top]


def term_bounds(stored: DataFrame, w: np.ndarray, documents: int, length: int, top: int = TOP) -> DataFrame:
    """(term, best, kth): a term's largest impact, and the one that `top` documents reach (0 with fewer documents)."""
    shared = stored.sparkSession.sparkContext.broadcast(w)

    def largest(batches):
        terms, values = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            each, _, term, tf = _postings(batch)
            n = np.repeat(batch.column(1).to_numpy(), each)
            terms, values = np.append(terms, term), np.append(values, impacts(shared.value[term], tf, n, documents, length))
            keep = first_of(terms, top, -values)
            terms, values = terms[keep], values[keep]
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(values)], ["term", "impact"])

    found = stored.filter(F.size("terms") > 0).mapInArrow(tidy(largest), "term long, impact long")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))
    ranked = found.withColumn("place", place).filter(F.col("place") <= top)
    return ranked.groupBy("term").agg(F.max("impact").alias("best"), F.coalesce(F.max(F.when(F.col("place") == top, F.col("impact"))), F.lit(0).cast("long")).alias("kth"))


class Plan:
    """The items of a block: thresholds, pruned suffixes and their bounds, and items by kept term and by pruned term."""

    def __init__(self, item: np.ndarray, term: np.ndarray, items: int, w: np.ndarray, best: np.ndarray, kth: np.ndarray):
        self.w, self.least = w, np.zeros(items, np.int64)
        np.maximum.at(self.least, item, kth[term])
        order = np.lexsort((term, best[term], item))  # rising bounds: a suffix is a beginning here
        item, term = item[order], term[order]
        total = np.cumsum(best[term])
        starts = np.searchsorted(item, np.arange(items))
        before = np.concatenate(([0], total))[starts]
        pruned = total - before[item] < self.least[item]
        self.rest = np.zeros(items, np.int64)  # what the pruned terms can add at most
        np.add.at(self.rest, item[pruned], best[term[pruned]])
        self.pruned_terms, self.pruned_ends = term[pruned], np.searchsorted(item[pruned], np.arange(items + 1))
        kept_item, kept_term = item[~pruned], term[~pruned]
        by_term = np.argsort(kept_term, kind="stable")
        self.items, self.item_ends = kept_item[by_term], np.searchsorted(kept_term[by_term], np.arange(len(w) + 1))

    def scores(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Documents, items and exact scores that reach the thresholds, of postings ordered by document and term."""
        fan = np.diff(self.item_ends)[term]
        ends = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) + 1  # ends of documents
        load, at = np.cumsum(fan)[ends - 1] if len(ends) else ends, 0
        while at < len(ends):
            before = load[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(load, before + PAIRS_AT_ONCE, side="right")))
            rows = slice(ends[at - 1] if at else 0, ends[stop - 1])
            yield self._some(doc[rows], term[rows], impact[rows], fan[rows])
            at = stop

    def _some(self, doc, term, impact, fan):
        items = len(self.least)
        item = self.items[spread(self.item_ends[term], fan)]
        pair, where = np.unique(np.repeat(doc, fan) * items + item, return_inverse=True)
        score = np.zeros(len(pair), np.int64)
        np.add.at(score, where, np.repeat(impact, fan))
        item = pair % items
        may = score + self.rest[item] >= np.maximum(self.least[item], 1)
        pair, score, item = pair[may], score[may], item[may]
        # The pruned terms of what is left, looked up among the document's own.
        n = np.diff(self.pruned_ends)[item]
        wanted = self.pruned_terms[spread(self.pruned_ends[item], n)]
        own = doc * len(self.w) + term
        key = np.repeat(pair // items, n) * len(self.w) + wanted
        place = np.minimum(np.searchsorted(own, key), len(own) - 1)
        score = score + sums(np.where(own[place] == key, impact[place], 0), n)
        good = score >= np.maximum(self.least[item], 1)
        return pair[good] // items, item[good], score[good]


def _ranked(stored: DataFrame, plan: Plan, documents: int, length: int, top: int) -> DataFrame:
    """(item, doc_id, score): the first `top` of each item among the documents of a task."""
    shared = stored.sparkSession.sparkContext.broadcast(plan)

    def rank(batches):
        plan = shared.value
        held = [np.zeros(0, np.int64)] * 4  # item, score, whether the id is null, id
        for batch in batches:
            each, doc, term, tf = _postings(batch)
            none, ids = batch.column(0).is_null().to_numpy(zero_copy_only=False), pc.fill_null(batch.column(0), 0).to_numpy()
            impact = impacts(plan.w[term], tf, np.repeat(batch.column(1).to_numpy(), each), documents, length)
            for doc_row, item, score in plan.scores(doc, term, impact):
                held = [np.append(x, y) for x, y in zip(held, (item, score, none[doc_row], ids[doc_row]), strict=True)]
                keep = first_of(held[0], top, -held[1], held[2], held[3])
                held = [x[keep] for x in held]
        item, score, none, ids = held
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=none.astype(bool)), pa.array(score)], ["item", "doc_id", "score"])

    return stored.filter(F.size("terms") > 0).mapInArrow(tidy(rank), "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The `top` best documents of each item: item_id, rank, doc_id, score. Equal scores by ascending id, a null id last.

    Null and empty texts have no terms; an item without terms that documents hold has no rows. Rows are taken one by one: repeated
    documents are ranked each, repeated items give repeated results. Other columns play no part. Empty tables give no rows.
    """
    spark = docs.sparkSession
    words = F.array_distinct(F.regexp_extract_all(lowered(F.coalesce(F.col(item_text_col), F.lit(""))), F.lit(TERM), F.lit(0)))
    asked = items.select(F.col(item_col).alias("item_id"), F.monotonically_increasing_id().alias("row"), words.alias("terms")).filter(F.size("terms") > 0)
    before = F.coalesce(F.sum(F.size("terms")).over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    asked = cut(asked.withColumn("part", F.shiftright("row", 33)).withColumn("block", F.struct("part", F.floor(before / block_terms).alias("at"))))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = []
    for (block,) in asked.select("block").distinct().orderBy("block").collect():
        own = asked.filter((F.col("block.part") == block.part) & (F.col("block.at") == block.at)).select("row", "terms").toArrow()
        words = own["terms"].combine_chunks()
        vocabulary = pc.unique(words.flatten())
        item = np.repeat(np.arange(len(own)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        term = pc.index_in(words.flatten(), value_set=vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
        path = new_path(spark, "postings")
        _store(texts, vocabulary, path)
        stored = spark.read.parquet(path)
        sizes = stored.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        df = np.zeros(len(vocabulary), np.int64)
        for row in stored.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toLocalIterator():
            df[row.term] = row.df
        w, best, kth = weights(df, sizes.documents), np.zeros_like(df), np.zeros_like(df)
        for row in term_bounds(stored, w, sizes.documents, sizes.length, top).toLocalIterator():
            best[row.term], kth[row.term] = row.best, row.kth
        ranked = _ranked(stored, Plan(item, term, len(own), w, best, kth), sizes.documents, sizes.length, top)
        names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(own))), "row": own["row"]}))
        found.append(cut(ranked.join(F.broadcast(names), "item").select("row", "doc_id", "score")))
    if not found:
        return items.filter("1 = 0").select(F.col(item_col).alias("item_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = every.withColumn("rank", place.cast("int")).filter(F.col("rank") <= top)
    return best.join(asked.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = rf"""
WITH asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
sizes AS (SELECT count(*) AS total, sum(len(w))::BIGINT AS length FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, term, len(any_value(w))::BIGINT AS n, count(*)::BIGINT AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(total) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, sizes GROUP BY term),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * total) // length))))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term), sizes GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
