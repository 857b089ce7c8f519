"""Benchmark decontamination (operator 11): a prefix-filtered set join of item windows with document windows of the same size.

An item's windows are its runs of WINDOW consecutive words (a shorter item is one window). A window's set are its shingles of SHINGLE
words with their places; it occurs in a document where a run of as many words has all of them at the same places, so the least overlap is
the whole set, and the necessary prefix of a window is its one rarest shingle. Steps:
- every place of a document where a shingle of any item stands is found in one scan (by hash, then by the words themselves);
- shingles are ordered by their number in the whole corpus; windows with a shingle that no document has can't occur (length filter);
- places of a window's rarest shingle give candidates, if the whole window fits into the document around it (positional filter);
- a candidate is verified by all other shingles at their places.
Only hits are shuffled, not texts. All of it is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.base import FEW_ROWS, cut, few, lowered

WINDOW = 10
SHINGLE = 5
#: Words of a text after A-Z are lower-cased: digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: F.Column) -> F.Column:
    return F.regexp_extract_all(lowered(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _joined(words: F.Column, start: F.Column, length) -> F.Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


def _hash(words: F.Column, i, k: int) -> F.Column:
    return F.xxhash64(*[F.get(words, i + j) for j in range(k)])


def _hashes(words: F.Column, n: F.Column, k: int) -> F.Column:
    return F.transform(F.sequence(F.lit(0), n - k), lambda i: _hash(words, i, k))


def item_windows(items: DataFrame, item_col: str, text_col: str, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(window, item), (token, shingle, size), and (window, length, offset, token): each distinct window, and each distinct shingle, once."""
    named = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("words"))
    named = cut(named.filter(F.size("words") > 0).select("item", F.array_join("words", " ").alias("body")).distinct())
    bodies = cut(named.select("body").distinct())
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    placed = bodies.select("body", F.split("body", " ").alias("words")).select("body", "words", F.explode(starts).alias("at"))
    placed = placed.select("body", _joined(F.col("words"), F.col("at"), F.lit(window)).alias("text"))
    windows = cut(placed.select("text").distinct().select("text", F.monotonically_increasing_id().alias("window")))
    # Items with one text meet as one body, so that copies of an item don't multiply its windows.
    owners = placed.join(windows, "text").select("window", "body").distinct().join(named, "body").select("window", "item")

    split = windows.select("window", F.split("text", " ").alias("words")).withColumn("size", F.least(F.size("words"), F.lit(shingle)))
    pieces = F.transform(F.sequence(F.lit(0), F.size("words") - F.col("size")), lambda i: _joined(F.col("words"), i, F.col("size")))
    parts = split.select("window", F.size("words").alias("length"), "size", F.posexplode(pieces).alias("offset", "shingle"))
    tokens = cut(parts.select("shingle", "size").distinct().select("shingle", "size", F.monotonically_increasing_id().alias("token")))
    return cut(owners.distinct()), tokens, cut(parts.join(tokens, ["shingle", "size"]).select("window", "length", "offset", "token"))


def places(docs: DataFrame, tokens: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(row, doc_id, n_words, pos, token): for each document one row without pos, and one for each place where a token's shingle stands."""
    sizes = sorted(r.size for r in tokens.select(F.col("size").alias("size")).distinct().collect())  # at most `shingle` numbers
    by_size = [F.when(F.col("size") == k, _hash(F.split("shingle", " "), F.lit(0), k)) for k in range(1, shingle + 1)]
    index = tokens.select(F.coalesce(*by_size).alias("key"), "shingle", "token")
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    split = split.withColumn("n", F.size("words"))
    none = F.array().cast("array<bigint>")
    hashed = [F.when(F.col("n") >= k, _hashes(F.col("words"), F.col("n"), k)).otherwise(none) for k in sizes]
    # The first element stands for the document itself. Its key is the row, so that these are dealt evenly where the join shuffles.
    keyed = split.select("*", F.posexplode(F.concat(F.array("row"), *hashed)).alias("i", "own"))
    pos, length, start = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(1)
    for k in sizes:  # element i belongs to the first size whose range holds it
        stop = start + F.greatest(F.col("n") - (k - 1), F.lit(0))
        here = (F.col("i") >= start) & (F.col("i") < stop)
        pos, length, start = F.when(here, F.col("i") - start).otherwise(pos), F.when(here, F.lit(k)).otherwise(length), stop
    keyed = keyed.select("row", "doc_id", "n", "i", "own", "words", pos.alias("pos"), length.alias("length"))
    piece = _joined(F.col("words"), F.col("pos"), F.col("length"))
    if tokens.count() <= FEW_ROWS:
        met = keyed.join(F.broadcast(index), (F.col("own") == F.col("key")) & (F.col("i") > 0) & (piece == F.col("shingle")), "left")
    else:  # rows that are shuffled carry their shingle instead of all words
        keyed = keyed.withColumn("piece", piece).drop("words")
        met = keyed.join(index, (F.col("own") == F.col("key")) & (F.col("i") > 0) & (F.col("piece") == F.col("shingle")), "left")
    first = F.col("i") == 0
    return met.filter(first | F.col("token").isNotNull()).select("row", F.when(first, F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_words"), F.when(~first, F.col("pos")).alias("pos"), "token")


def occurrences(hits: DataFrame, parts: DataFrame) -> DataFrame:
    """(row, window, start, length): all occurrences of windows, of hits (row, n_words, pos, token) and parts (window, length, offset, token)."""
    counted = hits.groupBy("token").agg(F.count("*").alias("n"))
    ranked = parts.join(few(cut(counted)), "token", "left")
    rarest = F.min(F.struct("n", "token", "offset")).alias("rarest")
    prefix = ranked.groupBy("window", "length").agg(rarest, F.count("*").alias("need"), F.count("n").alias("there")).filter("there = need")
    prefix = cut(prefix.select("window", "length", "need", "rarest.token", "rarest.offset"))
    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    candidates = hits.join(few(prefix), "token").filter(fits).select("row", "window", "length", "need", start.alias("start"))
    wanted = candidates.join(few(parts.select("window", "offset", "token")), "window")
    wanted = wanted.select("row", "window", "length", "need", "start", (F.col("start") + F.col("offset")).alias("pos"), "token")
    held = wanted.join(hits.select("row", "pos", "token"), ["row", "pos", "token"])
    return held.groupBy("row", "window", "start", "length", "need").agg(F.count("*").alias("n")).filter("n = need").select("row", "window", "start", "length")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_words, spans (first, after: words from 0) of hit words, items (sorted ids as strings).

    Null texts have no words; an item without words has no window. Items that share an id are one item, a null id is the id ''. Rows are
    taken one by one, so repeated rows give repeated results. Other columns play no part. Empty documents give no rows, empty items no spans.
    """
    owners, tokens, parts = item_windows(items, item_col, item_text_col, window, shingle)
    marks = cut(places(docs, tokens, id_col, text_col, shingle))
    hits = marks.filter("token is not null").select("row", "n_words", "pos", "token")
    found = cut(occurrences(hits, parts))
    ranges = found.groupBy("row", "start").agg(F.max(F.col("start") + F.col("length")).alias("stop"))
    order = Window.partitionBy("row").orderBy("start")
    reached = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = ranges.withColumn("new", F.when(F.col("start") <= reached, 0).otherwise(1)).withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = begun.groupBy("row", "span").agg(F.min("start").alias("first"), F.max("stop").alias("after"))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first", "after"))).alias("spans"))
    met = found.select("row", "window").distinct().join(few(owners), "window").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = marks.filter("pos is null").select("row", "doc_id", "n_words").join(spans, "row", "left").join(met, "row", "left")
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,after:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def judge(docs: DataFrame, items: DataFrame, **columns) -> DataFrame:
    """leaks() as one row of numbers per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["after"] - x["first"])
    return leaks(docs, items, **columns).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, array_to_string(w[k + 1:k + 10], ' ') AS piece, least(len(w), 10) AS size FROM
  (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
own AS (SELECT doc_id, k, size, array_to_string(w[k + 1:k + size], ' ') AS piece FROM
  (SELECT doc_id, w, size, unnest(range(greatest(len(w) - size + 1, 0))) AS k FROM d, sizes)),
met AS (SELECT doc_id, item_id, k, o.size FROM own o JOIN windows v ON o.piece = v.piece AND o.size = v.size),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + size)) AS at FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
