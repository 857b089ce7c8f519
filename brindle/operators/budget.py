"""Token estimates and budgets, and choosing what fits them."""

from __future__ import annotations

import re
from collections import Counter
from contextlib import contextmanager
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.sources import stores

PER_MESSAGE, PER_IMAGE = 8, 800
LEAST_ANSWER, MOST_ANSWER = 1024, 4096
#: What a Python task holds of texts to be noted: bytes that Spark sends it at once, and texts that are Python objects at once.
BATCH_BYTES, TOGETHER = 4 << 20, 64
#: A sentence, or a piece of a long one up to where a word ends; and the words by which sentences are weighed.
SENTENCE = re.compile(r"[^.!?。\n]{1,200}(?![^\s.!?。\n])[.!?。]*|[^.!?。\n]{200}")
WEIGHTY = re.compile(r"[^\W\d_]{4,}")


def estimate(c: Column) -> Column:
    """Tokens of a text, on the high side: 3.8 ASCII characters, 2.2 digits or 1.5 other characters each, and a tenth more."""
    digits = F.length(F.regexp_replace(c, "[^0-9]+", ""))
    plain = F.length(F.regexp_replace(c, r"[^\x00-\x7F]+", ""))
    tokens = ((plain - digits) / 3.8 + digits / 2.2 + (F.length(c) - plain) / 1.5) * 1.1
    return F.when(F.length(c) > 0, F.floor(tokens) + 1).otherwise(0).cast("long")


def message_tokens(content: Column, images: Column | None = None, calls: Column | None = None) -> Column:
    """A message with its template, pictures and tool calls."""
    total = estimate(F.coalesce(content, F.lit(""))) + PER_MESSAGE
    if images is not None:
        total = total + PER_IMAGE * F.greatest(F.coalesce(F.size(images), F.lit(0)), F.lit(0))
    return total + estimate(F.coalesce(calls, F.lit(""))) if calls is not None else total


def reserve(context: Column, wanted: Column | None = None) -> Column:
    """Tokens kept for the answer."""
    usual = F.least(F.greatest(F.floor(context / 5), F.lit(LEAST_ANSWER)), F.lit(MOST_ANSWER))
    if wanted is not None:
        asked = F.greatest(F.lit(256), F.least(wanted, F.floor(context / 2)))
        usual = F.when(wanted > 0, asked).otherwise(usual)
    return F.least(usual, F.floor(context / 2)).cast("long")


def prompt(context: Column, wanted: Column | None = None) -> Column:
    return F.greatest(F.lit(256), context - reserve(context, wanted)).cast("long")


def shares(tokens: Column, passages: Column, files: Column) -> tuple[Column, Column]:
    """The parts of a prompt for passages and for files."""
    for_passages = F.when(passages & files, tokens * 0.25).when(passages, tokens * 0.45).otherwise(0)
    for_files = F.when(passages & files, tokens * 0.4).when(files, tokens * 0.6).otherwise(0)
    return F.floor(for_passages).cast("long"), F.floor(for_files).cast("long")


def leading(rows: DataFrame, group: str, order: str, cost: str, limit: int) -> DataFrame:
    """Rows of each group in order until the first that doesn't fit; the first row always stays."""
    upto = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # Costs aren't negative, so the running sum never comes back under the limit.
    marked = rows.withColumns({"_used": F.sum(cost).over(upto), "_place": F.row_number().over(Window.partitionBy(group).orderBy(order))})
    return marked.where((F.col("_used") <= limit) | (F.col("_place") == 1)).drop("_used", "_place")


def skipping(items: Column, limit: Column) -> Column:
    """Of an array of struct(cost, ...), what fits one after another; what doesn't fit is left out and later ones are tried."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.filter(items, lambda x: F.lit(False)).alias("kept"))

    def step(s, x):
        fits = s["used"] + x["cost"] <= limit
        return F.struct(F.when(fits, s["used"] + x["cost"]).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["kept"], F.array(x))).otherwise(s["kept"]).alias("kept"))

    return F.aggregate(items, start, step, lambda s: s["kept"])


def fair_shares(lengths: Column, limit: Column) -> Column:
    """Room for each of several texts (array of lengths): the shortest first, what one leaves passes on to the others."""
    order = F.array_sort(F.transform(lengths, lambda n, i: F.struct(n.alias("n"), i.alias("i"))))
    count = F.size(lengths)
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("seen"), F.array().cast("array<struct<i:int,room:bigint>>").alias("rooms"))

    def step(s, x):
        room = F.least(x["n"].cast("long"), F.floor((limit - s["used"]) / (count - s["seen"])))
        return F.struct((s["used"] + room).alias("used"), (s["seen"] + 1).alias("seen"), F.concat(s["rooms"], F.array(F.struct(x["i"].alias("i"), room.alias("room")))).alias("rooms"))

    rooms = F.aggregate(order, start, step, lambda s: s["rooms"])
    return F.transform(F.array_sort(rooms), lambda x: x["room"])


def choose_files(files: Column, budget: Column) -> Column:
    """Of an array of struct(name, cost): all whole if they fit; else those up to a quarter each, while half the budget lasts."""
    costs = F.aggregate(files, F.lit(0).cast("long"), lambda s, f: s + f["cost"])
    small = F.filter(files, lambda f: f["cost"] <= budget * 0.25)
    some = skipping(F.transform(small, lambda f: F.struct(f["cost"].alias("cost"), f["name"].alias("name"))), F.floor(budget * 0.5).cast("long"))
    return F.when(costs <= budget, F.transform(files, lambda f: f["name"])).otherwise(F.transform(some, lambda f: f["name"]))


def fit_turns(messages: DataFrame, limit: int) -> DataFrame:
    """(conv_id, turn, role, text) of what is sent of each conversation, in at most about `limit` tokens: see histories.fit()."""
    from brindle.operators import histories

    return histories.fit(messages, limit).select("conv_id", "turn", "role", "text")


def running(rows: DataFrame, group: str, order: str, cost: str, width: int = 1024) -> DataFrame:
    """rows with `upto`, the running sum of cost by an integer order within each group, and `total`, the group's sum.

    Sums are taken of ranges of the order first; only these, one row for so many, are walked through group by group, and rows range by range.
    """
    ranged = rows.withColumn("_range", F.floor(F.col(order) / width))
    sums = ranged.groupBy(group, "_range").agg(F.sum(cost).alias("_sum"))
    by_group = Window.partitionBy(group)
    before = F.sum("_sum").over(by_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col(group).alias("_group"), F.col("_range").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_sum").over(by_group).alias("total"))
    within = F.sum(cost).over(Window.partitionBy(group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    here = F.col(group).eqNullSafe(F.col("_group")) & F.col("_range").eqNullSafe(F.col("_of"))  # rows without a group or a place are some, too
    return ranged.withColumn("upto", within).join(sums, here).withColumn("upto", F.col("_before") + F.col("upto")).drop("_range", "_before", "_group", "_of")


def gist(text: str, room: int) -> str:
    """What a stand-in for a model says of a text, all of which it reads: the sentences whose words are the most frequent ones of the text,
    in the text's order, as many as have room, and one at least."""
    sentences = [x for x in map(str.strip, SENTENCE.findall(text)) if x]
    words = [WEIGHTY.findall(x.lower()) for x in sentences]
    counts = Counter(chain.from_iterable(words))
    weight = [sum(counts[w] for w in own) / (len(own) + 3) for own in words]  # as if it had three words more, lest a single word be the best sentence
    kept, used = [], 0
    for i in sorted(range(len(sentences)), key=lambda i: -weight[i]):
        if not kept or used + len(sentences[i]) <= room:
            kept.append(i)
            used += len(sentences[i]) + 1
    return " ".join(sentences[i] for i in sorted(kept))


def _mapped(rows: DataFrame, f) -> DataFrame:
    """rows with their text replaced by f's result."""

    def run(batches):
        for batch in (whole.slice(at, TOGETHER) for whole in batches for at in range(0, len(whole), TOGETHER)):
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, "text", pa.array([f(t) for t in batch.column(i).to_pylist()], pa.string(), from_pandas=True))

    return rows.mapInArrow(run, rows.schema)


@contextmanager
def _small_batches(spark: SparkSession):
    """What runs within gets its rows in batches of about BATCH_BYTES or of one row, so that a task's memory doesn't grow with the texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    usual = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, usual)


def _kept(rows: DataFrame, f, cache: str, model: str, size: int, blocks: int) -> DataFrame:
    """rows with their text replaced by f's result, out of a table by content: what is there isn't worked out again.

    The key is the hash of model, size and text. What is missing is worked out once per text, in blocks that are stored one by one, so
    that a run that is killed goes on where it was.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("_key", F.sha2(F.concat_ws("|", F.lit(model), F.lit(size), F.coalesce("text", F.lit(""))), 256))
    missing = keyed.select("_key", "text").dropDuplicates(["_key"])
    if stores.folders(spark, cache):
        missing = missing.join(stores.read(spark, cache).select("_key"), "_key", "left_anti")
    for block in range(0 if missing.isEmpty() else blocks):
        folder = stores.new_folder(cache)
        missing.where(F.pmod(F.xxhash64("_key"), F.lit(blocks)) == block).transform(_mapped, f).withColumnRenamed("text", "made").write.parquet(folder)
        stores.point(spark, cache, [*stores.folders(spark, cache), folder])
    if not stores.folders(spark, cache):
        return rows
    return keyed.join(stores.read(spark, cache), "_key").withColumn("text", F.col("made")).drop("_key", "made")


def summarised(parts: DataFrame, note, combine, limit: int, group_tokens: int, rounds: int | None = None, cache: str | None = None, model: str = "", blocks: int = 8) -> DataFrame:
    """Notes of the parts of files (name, part, text), combined group by group until a file's notes fit the limit.

    note and combine are callables on one text each, run in Arrow batches of bounded size; rounds are jobs, not rows, on the driver. They go
    on until all files fit, or after the given number of rounds, or one that made the notes of what is left neither fewer nor shorter:
    nothing is cut off then. With the path of a cache, results are kept there by model, group size and text, and are not worked out twice,
    nor again after a run was killed.
    """

    spark = parts.sparkSession

    def made(rows: DataFrame, f, what: str) -> DataFrame:
        """A round's results with their costs, stored, as the next round reads them more than once."""
        folder = stores.new_folder(f"{stores.shared_dir(spark)}/notes")
        with _small_batches(spark):
            found = _mapped(rows, f) if cache is None else _kept(rows, f, cache, f"{model}|{what}", group_tokens, blocks)
            found.withColumn("cost", estimate(F.col("text"))).write.parquet(folder)
        return spark.read.parquet(folder)

    notes = made(parts.select("name", F.col("part").cast("long").alias("part"), "text"), note, "note")
    done, before, turn = [], None, 0
    while True:
        fits = F.col("total") <= limit
        files = notes.groupBy("name").agg(F.sum("cost").alias("total"), F.count("*").alias("n"))
        fit, *left = files.agg(F.count_if(fits), F.sum(F.when(~fits, F.col("n"))), F.sum(F.when(~fits, F.col("total")))).first()
        if left[0] is None or turn == rounds or (before is not None and left >= before):
            return reduce(DataFrame.unionByName, [*done, notes.drop("cost")])
        sized = running(notes, "name", "part", "cost")
        if fit:
            done.append(sized.where(fits).select("name", "part", "text"))
        lines = F.array_sort(F.collect_list(F.struct("part", "text")))
        groups = sized.where(~fits).groupBy("name", F.floor((F.col("upto") - 1) / group_tokens).cast("long").alias("part"))
        notes = made(groups.agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n\n").alias("text")), combine, "combine")
        before, turn = left, turn + 1
