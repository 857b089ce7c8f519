"""What a question gets with it: parts of long files, passages within a budget, whole files and passages, blanks in batches, pages read."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import texts, values
from brindle.operators import chunk
from brindle.operators.budget import estimate

#: Characters of a token in a part, the smallest part, what a passage and a whole file cost beyond their texts,
#: blanks of a request, passages of a file, pieces of a file's start.
PART_CHARS, LEAST_PART = 3.2, 2000
PASSAGE_COST, FILE_COST = 16, 24
BATCH, PER_FILE, FROM_START = 12, 40, 8


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _filled(lengths: pd.Series, size: pd.Series) -> pd.Series:
    """The part of each piece: a new one begins where the next piece, two line ends included, would go over the size."""

    def number(row, most):
        part, used, out = 0, 0, []
        for n in row:
            if used and used + n > most:
                part, used = part + 1, 0
            used += n + 2 * (used > 0)
            out.append(part)
        return out

    return pd.Series([number(*x) for x in zip(lengths, size, strict=True)])


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _taken(costs: pd.Series, room: pd.Series) -> pd.Series:
    """Which of the costs are taken in turn; one that doesn't fit what is left is skipped, and smaller ones after it may still fit."""

    def take(row, left):
        out = []
        for n in row:
            out.append(n <= left)
            left -= n if n <= left else 0
        return out

    return pd.Series([take(*x) for x in zip(costs, room, strict=True)])


def parts(sections: DataFrame, part_tokens: int) -> DataFrame:
    """Files (name, section, label, text) in parts of about so many tokens: (name, part, label, text); no row for an empty file.

    Only the pieces' lengths of a file come together to be dealt; their texts meet again part by part.
    """
    size = max(LEAST_PART, int(part_tokens * PART_CHARS))
    cut = chunk.chunks(sections.select("name", "section", "label", "text"), size=size, overlap=0)
    order = F.array_sort(F.collect_list(F.struct("section", "position", F.length("piece").alias("n"))))
    dealt = cut.groupBy("name").agg(order.alias("o")).withColumn("p", _filled(F.transform("o", lambda x: x["n"]), F.lit(size)))
    places = dealt.select("name", F.explode(F.arrays_zip("o", "p")).alias("x")).select("name", "x.o.section", "x.o.position", F.col("x.p").alias("part"))
    joined = cut.join(places, ["name", "section", "position"]).groupBy("name", "part").agg(F.array_sort(F.collect_list(F.struct("section", "position", "label", "piece"))).alias("o"))
    labels = F.filter(F.transform("o", lambda x: x["label"]), lambda x: x != "")
    return joined.select("name", "part", label_span(labels).alias("label"), F.array_join(F.transform("o", lambda x: x["piece"]), "\n\n").alias("text"))


def label_span(labels: Column) -> Column:
    """The labels of a part as one: pages 3-7, one label that all share, or the first to the last."""
    numbers = F.transform(labels, lambda x: F.regexp_replace(x, "^page ", ""))
    first, last = F.try_element_at(numbers, F.lit(1)), F.try_element_at(numbers, F.lit(-1))
    pages = F.when(first == last, F.concat(F.lit("page "), first)).otherwise(F.concat(F.lit("pages "), first, F.lit("-"), last))
    words = F.when(F.size(F.array_distinct(labels)) == 1, F.try_element_at(labels, F.lit(1))).otherwise(F.concat_ws(" to ", F.try_element_at(labels, F.lit(1)), F.try_element_at(labels, F.lit(-1))))
    return F.when(F.size(labels) == 0, "").when(F.forall(numbers, lambda x: x.rlike(r"^\d+$")), pages).otherwise(words)


def search_mode(made_by: Column, model: Column, with_vectors: Column) -> tuple[Column, Column]:
    """(stale, mode). Vectors of another model than the one in use can't be compared, so words alone are searched."""
    stale = F.coalesce(made_by, F.lit("")).isin("", model) == F.lit(False)
    return stale, F.when(~stale & (with_vectors > 0), "meaning and words").otherwise("words")


def within(hits: DataFrame, limit: int) -> DataFrame:
    """Hits (question, place, text) from the best down as far as their tokens go; the best one always stays."""
    down = Window.partitionBy("question").orderBy("place")
    used = F.sum(estimate(F.col("text")) + PASSAGE_COST).over(down.rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumns({"used": used, "first": F.row_number().over(down) == 1}).where(F.col("first") | (F.col("used") <= limit)).drop("used", "first")


def context_block(hits: DataFrame, start: int = 1) -> DataFrame:
    """One row per question: (question, block, sources). hits: (question, place, document, label, matched_by, text).

    Passages are numbered from start in the order of their places; a source carries the start of its passage.
    """
    n = (F.row_number().over(Window.partitionBy("question").orderBy("place")) + start - 1).cast("long")
    where = F.concat_ws(", ", "document", F.nullif("label", F.lit("")))
    shown = F.when(F.length("text") > 600, F.concat(F.regexp_replace(F.left("text", F.lit(600)), r"\s+$", ""), F.lit(" …"))).otherwise(F.col("text"))
    line = F.concat(F.lit("["), F.col("n"), F.lit("] "), where, F.lit("\n"), "text")
    rows = hits.withColumn("n", n).select("question", F.struct("n", line.alias("line"), F.struct("n", "document", "label", "matched_by", shown.alias("text")).alias("source")).alias("x"))
    found = rows.groupBy("question").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return found.select("question", F.array_join(F.transform("x", lambda x: x["line"]), "\n\n").alias("block"), F.transform("x", lambda x: x["source"]).alias("sources"))


def ranked_pieces(files: DataFrame, questions: DataFrame, size: int = chunk.SIZE, overlap: int = chunk.OVERLAP) -> DataFrame:
    """Pieces of files (chat, position, name, text) for the chat's question (chat, question): (chat, position, name, depth, text).

    Pieces with more of the question's words come first; a file without any gives its first pieces.
    """
    cut = chunk.chunks(files.select("chat", F.col("position").alias("file"), "name", "text"), size=size, overlap=overlap).withColumnRenamed("position", "at")
    asked = cut.join(questions, "chat", "left")
    body = F.lower("piece")
    hits = F.size(F.filter(values.keywords(F.coalesce("question", F.lit(""))), lambda w: F.contains(body, w)))
    by_file = Window.partitionBy("chat", "file")
    ranked = asked.withColumn("hits", hits).withColumns({"best": F.max("hits").over(by_file), "depth": F.row_number().over(by_file.orderBy(F.desc("hits"), "at"))})
    kept = ((F.col("hits") > 0) & (F.col("depth") <= PER_FILE)) | ((F.col("best") == 0) & (F.col("depth") <= FROM_START))
    return ranked.where(kept).select("chat", F.col("file").alias("position"), "name", "depth", F.col("piece").alias("text"))


def files_context(files: DataFrame, hits: DataFrame, limit: int) -> DataFrame:
    """What a chat's files (chat, position, name, text) give within a budget: (chat, position, name, kind, depth, text).

    All files whole if they fit together. Else those of up to a quarter of the budget while half of it lasts, in the files' order, and
    of the others passages (chat, position, name, depth, text), one of each file in turn, as many as fit. Costs alone come together.
    """
    sized = files.withColumn("cost", estimate(F.col("text")) + FILE_COST)
    lists = sized.groupBy("chat").agg(F.array_sort(F.collect_list(F.struct("position", "cost"))).alias("o"))
    total = F.aggregate("o", F.lit(0).cast("long"), lambda s, x: s + x["cost"])
    small = F.filter("o", lambda x: x["cost"] <= limit * 0.25)
    lists = lists.withColumns({"all": total <= limit, "small": small}).withColumn("t", _taken(F.transform("small", lambda x: x["cost"]), F.lit(limit * 0.5)))
    some = F.transform(F.filter(F.arrays_zip("small", "t"), lambda x: x["t"]), lambda x: x["small"])
    whole = lists.select("chat", "all", F.when(F.col("all"), F.col("o")).otherwise(some).alias("w"))
    used = whole.select("chat", "all", F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + x["cost"]).alias("used"))
    places = whole.select("chat", F.explode("w").alias("x")).select("chat", "x.position")
    rest = hits.join(places, ["chat", "position"], "left_anti").withColumn("cost", estimate(F.col("text")) + PASSAGE_COST)
    turns = rest.groupBy("chat").agg(F.array_sort(F.collect_list(F.struct("depth", "position", "cost"))).alias("o")).join(used.where(~F.col("all")), "chat")
    turns = turns.withColumn("t", _taken(F.transform("o", lambda x: x["cost"]), (F.lit(limit) - F.col("used")).cast("double")))
    chosen = turns.select("chat", F.explode(F.filter(F.arrays_zip("o", "t"), lambda x: x["t"])).alias("x")).select("chat", "x.o.depth", "x.o.position")
    passages = rest.join(chosen, ["chat", "depth", "position"], "left_semi").select("chat", "position", "name", F.lit("passage").alias("kind"), "depth", "text")
    given = files.join(places, ["chat", "position"], "left_semi").select("chat", "position", "name", F.lit("whole").alias("kind"), F.lit(0).alias("depth"), "text")
    return given.unionByName(passages)


def proposals(fields: DataFrame, answers: DataFrame) -> DataFrame:
    """Of the answers (doc, id, chunk, value) the first that says something, for each field (doc, id): (doc, id, chunk, value)."""
    said = answers.withColumn("value", values.answer(F.col("value"))).where("value <> ''")
    first = said.groupBy("doc", "id").agg(F.min("chunk").alias("chunk"), F.min_by("value", "chunk").alias("value"))
    return fields.select("doc", "id").join(first, ["doc", "id"])


def blank_requests(fields: DataFrame, found: DataFrame, chunks: int, size: int = BATCH) -> DataFrame:
    """The requests (doc, batch, chunk, ids): fields (doc, id, position) in batches, later chunks only for those still empty."""
    batch = F.floor((F.row_number().over(Window.partitionBy("doc").orderBy("position", "id")) - 1) / size).cast("long")
    waits = fields.withColumn("batch", batch).join(found.select("doc", "id", F.col("chunk").alias("until")), ["doc", "id"], "left")
    asked = waits.withColumn("chunk", F.explode(F.sequence(F.lit(1), F.coalesce(F.col("until").cast("int"), F.lit(chunks)))))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: x["id"])
    return asked.groupBy("doc", "batch", "chunk").agg(ids.alias("ids"))


def with_origin(found: DataFrame, texts_of: DataFrame) -> DataFrame:
    """proposals with where they come from; texts_of: (doc, sources, instructions)."""
    both = found.join(texts_of, "doc", "left")
    return both.withColumn("origin", texts.origin(F.col("value"), F.col("sources"), F.col("instructions"))).drop("sources", "instructions")


def pages_read(pages: DataFrame) -> DataFrame:
    """What is kept of a file's pages (file, page, outcome), one row per file: (file, status, kept, failed, unreadable).

    Outcomes: rows, none (no invoice on it), unusable, unreadable, unavailable. The first page whose reader is gone stops the file: what
    was read before stays, and the file fails if that is nothing. Unusable and unreadable pages are listed, and the file goes on.
    """
    stop = F.min(F.when(F.col("outcome") == "unavailable", F.col("page")))
    marked = pages.join(pages.groupBy("file").agg(stop.alias("stop")), "file").where(F.col("stop").isNull() | (F.col("page") <= F.col("stop")))
    of = lambda name: F.array_sort(F.collect_list(F.when(F.col("outcome") == name, F.col("page"))))
    found = marked.groupBy("file").agg(of("rows").alias("kept"), of("unusable").alias("failed"), of("unreadable").alias("unreadable"), F.first("stop").alias("stop"))
    nothing = (F.size("kept") == 0) & (F.size("failed") == 0) & (F.size("unreadable") == 0)
    status = F.when(F.col("stop").isNotNull(), F.when(F.size("kept") > 0, "stopped").otherwise("failed")).when(nothing, "nothing found").otherwise("done")
    return found.select("file", status.alias("status"), "kept", "failed", "unreadable")
