"""Histories that fit a model's context (C04): the system's words and the current turn stay, shortened if they must be; then the newest of what came before.

Which messages can matter is told by running sums: of a long history only the newest ones, up to the first that goes beyond the limit,
and they alone meet in one row. Trimming them depends on what was trimmed before, so that is a fold over a conversation's few messages.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.budget import PER_MESSAGE, message_tokens

#: Tool results of this turn that were read already: longer ones are cut to so many tokens.
LONG_RESULT, SHORT_RESULT = 600, 500
#: Times that the largest message gives way, the tokens it keeps at least, and what is taken beyond what is needed.
TRIMS, LEAST, SPARE = 12, 300, 64
#: An older message is kept in part if so few newer ones are and so much room is left.
FEW_KEPT, ROOM, MARK = 2, 400, 32


def tokens_of(text: str) -> int:
    """budget.estimate() of one text."""
    digits = len(re.findall("[0-9]", text))
    plain = sum(map(str.isascii, text)) - digits
    return int((plain / 3.8 + digits / 2.2 + (len(text) - plain - digits) / 1.5) * 1.1) + 1 if text else 0


def cut_middle(text: str, tokens: int) -> str:
    """values.cut_middle() of one text."""
    have = tokens_of(text)
    if have <= tokens:
        return text
    keep = max(int(len(text) * tokens / have) - 80, 0)
    head, tail = int(keep * 0.6), int(keep * 0.4)
    return f"{text[:head]}\n\n[... {len(text) - head - tail:,} characters left out here to fit the model's context ...]\n\n{text[len(text) - tail :] if tail else ''}"


class Message:
    """A message and its tokens; `more` are those of pictures and tool calls, which no cut takes away."""

    def __init__(self, row: dict):
        self.row, self.more, self.cut = row, row["tokens"] - PER_MESSAGE - tokens_of(row["text"]), False
        self.tokens = row["tokens"]

    def shorten(self, tokens: int) -> None:
        self.row["text"], self.cut = cut_middle(self.row["text"], tokens), True
        self.tokens = tokens_of(self.row["text"]) + PER_MESSAGE + self.more


def fitted(messages: list[dict], limit: int) -> list[dict]:
    """What is sent of a conversation that is too long: messages with part head, history or current, by turn."""
    head, history, current = ([Message(m) for m in messages if m["part"] == part] for part in ("head", "history", "current"))
    fixed = head + current
    total = lambda: sum(m.tokens for m in fixed)
    for m in current[:-1]:
        if m.row["role"] == "tool" and m.tokens > LONG_RESULT and total() > limit:
            m.shorten(SHORT_RESULT)
    for _ in range(TRIMS):
        over, largest = total() - limit, max(fixed, key=lambda m: m.tokens, default=None)
        target = max(LEAST, largest.tokens - over - SPARE) if largest else 0
        if over <= 0 or largest is None or target >= largest.tokens:
            break
        largest.shorten(target)
    room, kept = limit - total(), []
    for m in reversed(history):
        fits = m.tokens <= room
        if not fits and len(kept) < FEW_KEPT and room > ROOM:
            m.shorten(room - PER_MESSAGE - MARK)
            kept.insert(0, m)
        if not fits:
            break
        kept.insert(0, m)
        room -= m.tokens
    while kept and kept[0].row["role"] != "user":
        kept.pop(0)  # a conversation begins with the user
    return [{"turn": m.row["turn"], "role": m.row["role"], "text": m.row["text"], "shortened": m.cut} for m in head + kept + current]


def fit(messages: DataFrame, limit: int) -> DataFrame:
    """(conv_id, turn, role, text) to what is sent: (conv_id, turn, role, text, shortened, dropped), in at most about `limit` tokens.

    Columns images (an array) and calls (tool calls as text) count too where there are any. dropped is how many older messages of the
    conversation are left out. A conversation that fits stays as it is; one without a user's message keeps its last message as the current turn.
    """
    extra = [F.col(c) if c in messages.columns else None for c in ("images", "calls")]
    rows = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), message_tokens(F.col("text"), *extra).alias("tokens"))
    asked, spoken = F.when(F.col("role") == "user", F.col("turn")), F.when(F.col("role") != "system", F.col("turn"))
    sizes = rows.groupBy("conv_id").agg(F.sum("tokens").alias("all_tokens"), F.min(spoken).alias("begins"), F.coalesce(F.max(asked), F.max("turn")).alias("asked"))
    marked = rows.join(sizes, "conv_id")
    whole = marked.where(F.col("all_tokens") <= limit)
    head = (F.col("role") == "system") & F.coalesce(F.col("turn") < F.col("begins"), F.lit(True))
    part = F.when(head, "head").when(F.col("turn") >= F.col("asked"), "current").otherwise("history")
    long = marked.where(F.col("all_tokens") > limit).withColumn("part", part)
    newer = Window.partitionBy("conv_id", "part").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("newer", F.coalesce(F.sum("tokens").over(newer), F.lit(0)))
    counts = long.where("part = 'history'").groupBy("conv_id").agg(F.count("*").alias("older"))
    near = long.where((F.col("part") != "history") | (F.col("newer") <= limit))
    lists = near.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "tokens", "part"))).alias("messages")).join(counts, "conv_id", "left")
    kinds = {f.name: f.dataType.simpleString() for f in messages.schema}

    def fold(batches):
        for batch in batches:
            found = [fitted(m, limit) for m in batch.column(1).to_pylist()]
            turn = batch.schema.field(1).type.value_type.field(0).type
            sent = pa.list_(pa.struct([("turn", turn), ("role", pa.string()), ("text", pa.string()), ("shortened", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, sent), batch.column(2)], ["conv_id", "sent", "older"])

    schema = f"conv_id {kinds['conv_id']}, sent array<struct<turn:{kinds['turn']},role:string,text:string,shortened:boolean>>, older long"
    kept = lists.select("conv_id", "messages", "older").mapInArrow(fold, schema)
    history = F.size(F.filter("sent", lambda m: m["turn"].isNotNull())).cast("long")
    fixed = near.where("part <> 'history'").groupBy("conv_id").agg(F.count("*").alias("fixed"))
    cut = kept.join(fixed, "conv_id", "left").withColumn("dropped", F.coalesce("older", F.lit(0)) - (history - F.coalesce("fixed", F.lit(0))))
    return whole.select("conv_id", "turn", "role", "text", F.lit(False).alias("shortened"), F.lit(0).cast("long").alias("dropped")).unionByName(cut.select("conv_id", F.inline("sent"), "dropped"))
