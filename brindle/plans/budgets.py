"""Queries of token budgets and routing, over conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.catalog import table
from brindle.operators import budget, histories, routing
from brindle.plans.book import Book

BOOK = Book()
query = BOOK.query

_ASCII = r"length(regexp_replace({0}, '[^\x00-\x7F]', '', 'g'))"
_DIGITS = "length(regexp_replace({0}, '[^0-9]', '', 'g'))"


def _estimate(c: str) -> str:
    a, n = _ASCII.format(c), _DIGITS.format(c)
    return f"(CASE WHEN length({c}) > 0 THEN floor((({a} - {n}) / 3.8::DOUBLE + {n} / 2.2::DOUBLE + (length({c}) - {a}) / 1.5::DOUBLE) * 1.1::DOUBLE)::BIGINT + 1 ELSE 0 END)"


@query("C01_estimate", f"SELECT doc_id, {_estimate('text')} AS tokens FROM documents")
def estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", budget.estimate(F.col("text")).alias("tokens"))


@query("C02_conversation_tokens", f"SELECT conv_id, sum({_estimate('text')} + 8)::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def conversation_tokens(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(budget.message_tokens(F.col("text"))).alias("tokens"))


_RESERVE = "least(CASE WHEN w > 0 THEN greatest(256, least(w, c // 2)) ELSE least(greatest(c // 5, 1024), 4096) END, c // 2)"


@query("C03_budgets", f"SELECT c AS context, w AS wanted, {_RESERVE}::BIGINT AS reserve, greatest(256, c - {_RESERVE})::BIGINT AS prompt FROM (SELECT (o_orderkey * 7) % 140000 + 512 AS c, (o_orderkey * 13) % 9000 - 3000 AS w FROM orders)")
def budgets(spark, d):
    context, wanted = (F.col("o_orderkey") * 7) % 140000 + 512, (F.col("o_orderkey") * 13) % 9000 - 3000
    rows = table(spark, d, "orders").select(context.alias("context"), wanted.alias("wanted"))
    c, w = F.col("context"), F.col("wanted")
    return rows.select("context", "wanted", budget.reserve(c, w).alias("reserve"), budget.prompt(c, w).alias("prompt"))


@query("C05_shares", "SELECT n, p, f, CASE WHEN p AND f THEN n * 25 // 100 WHEN p THEN n * 45 // 100 ELSE 0 END AS passages, CASE WHEN p AND f THEN n * 40 // 100 WHEN f THEN n * 60 // 100 ELSE 0 END AS files FROM (SELECT p_partkey * 20 AS n, p_size % 2 = 0 AS p, p_size % 3 = 0 AS f FROM part)")
def shares(spark, d):
    rows = table(spark, d, "part").select((F.col("p_partkey") * 20).alias("n"), (F.col("p_size") % 2 == 0).alias("p"), (F.col("p_size") % 3 == 0).alias("f"))
    passages, files = budget.shares(F.col("n"), F.col("p"), F.col("f"))
    return rows.select("n", "p", "f", passages.alias("passages"), files.alias("files"))


@query(
    "C06_leading",
    """SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER w AS used, row_number() OVER w AS place FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE used <= 900 OR place = 1""",
)
def leading(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("cost"))
    return budget.leading(rows, "conv_id", "turn", "cost", 900).select("conv_id", "turn")


@query(
    "C07_skipping",
    """WITH RECURSIVE lines AS (SELECT o_orderkey AS k, l_linenumber AS i, (l_quantity)::BIGINT AS cost, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_quantity) AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    walk AS (SELECT k, r, CASE WHEN cost <= 90 THEN cost ELSE 0 END AS used, CASE WHEN cost <= 90 THEN 1 ELSE 0 END AS kept FROM lines WHERE r = 1
      UNION ALL SELECT l.k, l.r, CASE WHEN w.used + l.cost <= 90 THEN w.used + l.cost ELSE w.used END, w.kept + CASE WHEN w.used + l.cost <= 90 THEN 1 ELSE 0 END FROM walk w JOIN lines l ON l.k = w.k AND l.r = w.r + 1)
    SELECT k AS orderkey, max(kept)::BIGINT AS kept, max(used)::BIGINT AS used FROM walk GROUP BY k""",
)
def skipping(spark, d):
    """Which lines of an order fit 90 pieces one after another."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("i"), F.col("l_quantity").cast("long").alias("cost")).alias("x"))
    items = lines.groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.array_sort(F.collect_list("x")).alias("items"))
    kept = budget.skipping(F.transform("items", lambda x: F.struct(x["cost"].alias("cost"), x["i"].alias("i"))), F.lit(90))
    done = items.select("orderkey", kept.alias("kept"))
    return done.select("orderkey", F.size("kept").cast("long").alias("kept"), F.aggregate("kept", F.lit(0).cast("long"), lambda s, x: s + x["cost"]).alias("used"))


@query(
    "C09_fair_shares",
    """WITH RECURSIVE t AS (SELECT conv_id AS k, turn, length(text)::BIGINT AS n, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS r, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations),
    walk AS (SELECT k, turn, r, c, least(n, 1500 // c) AS room, least(n, 1500 // c) AS used FROM t WHERE r = 1
      UNION ALL SELECT t.k, t.turn, t.r, t.c, least(t.n, (1500 - used) // (t.c - t.r + 1)), used + least(t.n, (1500 - used) // (t.c - t.r + 1)) FROM walk w JOIN t ON t.k = w.k AND t.r = w.r + 1)
    SELECT k AS conv_id, string_agg(room::VARCHAR, ',' ORDER BY turn) AS rooms FROM walk GROUP BY k""",
)
def fair_shares(spark, d):
    lengths = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda x: x["n"]).alias("lengths"))
    return lengths.select("conv_id", F.array_join(budget.fair_shares(F.col("lengths"), F.lit(1500)).cast("array<string>"), ",").alias("rooms"))


@query("C04_fit_turns")
def fit_turns(spark, d):
    return histories.fit(table(spark, d, "conversations"), 600)


@query(
    "C08_choose_files",
    f"""WITH RECURSIVE t AS (SELECT conv_id, turn, {_estimate('text')} AS cost, sum({_estimate('text')}) OVER (PARTITION BY conv_id) AS total FROM conversations), small AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM t WHERE total > 400 AND cost <= 100),
    walk AS (SELECT conv_id, turn, r, cost <= 200 AS kept, CASE WHEN cost <= 200 THEN cost ELSE 0 END AS used FROM small WHERE r = 1
      UNION ALL SELECT s.conv_id, s.turn, s.r, w.used + s.cost <= 200, CASE WHEN w.used + s.cost <= 200 THEN w.used + s.cost ELSE w.used END FROM walk w JOIN small s ON s.conv_id = w.conv_id AND s.r = w.r + 1)
    SELECT conv_id, turn AS name FROM walk WHERE kept UNION ALL SELECT conv_id, turn FROM t WHERE total <= 400""",
)
def choose_files(spark, d):
    """A conversation's turns as its files: those that are given whole within 400 tokens."""
    files = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("name"), budget.estimate(F.col("text")).alias("cost")))).alias("files"))
    return files.select("conv_id", F.explode(budget.choose_files(F.col("files"), F.lit(400))).alias("name"))


@query("C10_notes")
def notes(spark, d):
    """Documents as files of parts; the stand-in for a model reads a whole text and keeps the sentences that say most, a quarter of a part
    and half of notes, until a file's notes fit."""
    parts = table(spark, d, "documents").select(F.col("source").alias("name"), F.col("doc_id").alias("part"), "text")
    return budget.summarised(parts, lambda t: budget.gist(t or "", len(t or "") // 4), lambda t: budget.gist(t, len(t) // 2), 2000, 4000)


@query("C11_stable_part", "SELECT conv_id, '<rules>' || string_agg(role || ': ' || CASE WHEN length(text) > 400 THEN '[file text]' ELSE text END, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def stable_part(spark, d):
    shown = F.when(F.length("text") > 400, "[file text]").otherwise(F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), shown).alias("line"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.concat(F.lit("<rules>"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("prompt"))


@query(
    "C13_redacted_history",
    """SELECT conv_id, turn, CASE WHEN bool_or(contains(text, 'file') OR length(text) > 400) OVER (PARTITION BY conv_id ORDER BY turn) AND role = 'assistant' THEN '[left out]' ELSE text END AS text FROM conversations""",
)
def redacted_history(spark, d):
    from pyspark.sql import Window

    attached = F.bool_or(F.contains("text", F.lit("file")) | (F.length("text") > 400)).over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(attached & (F.col("role") == "assistant"), "[left out]").otherwise(F.col("text")).alias("text"))


_HARD = routing.HARD.removeprefix("(?iU)").replace("'", "''")
_EVERYDAY = routing.EVERYDAY.removeprefix("(?iU)").replace("'", "''")
_EXPERT = routing.EXPERT.removeprefix("(?iU)").replace("'", "''")


@query(
    "R02_hard_and_follow_up",
    rf"""SELECT conv_id, turn, hard, NOT hard AND len(regexp_extract_all(text, '\S+')) <= 8 AS follow_up, expert, everyday FROM (SELECT *,
        regexp_matches(text, '{_HARD}', 'i') OR length(text) > 800 OR conv_id % 7 = 0 AS hard, regexp_matches(text, '{_EXPERT}', 'i') AS expert, regexp_matches(text, '{_EVERYDAY}', 'i') AS everyday FROM conversations)""",
)
def hard_and_follow_up(spark, d):
    """Every seventh conversation stands for one with files."""
    found = routing.features(table(spark, d, "conversations"), F.col("conv_id") % 7 == 0)
    return found.select("conv_id", "turn", "hard", "follow_up", "expert", "everyday")


def _messages(spark, d):
    """Conversations with attachments and answering models that stand for those of a chat."""
    route = F.when(F.col("role") == "assistant", F.element_at(F.array(*map(F.lit, ("heavy", "default", "code"))), (F.col("conv_id") % 3 + 1).cast("int")))
    return table(spark, d, "conversations").withColumns({"has_files": (F.col("conv_id") % 7 == 0) & (F.col("turn") == 1), "has_images": (F.col("conv_id") % 11 == 0) & (F.col("turn") == 1), "route": route})


@query("R03_routes")
def routes(spark, d):
    return routing.route(_messages(spark, d))


@query("R04_first_available")
def first_available(spark, d):
    models = spark.createDataFrame([("heavy", "h1", True, 0, False), ("heavy", "h2", True, 1, True), ("default", "d1", True, 0, True), ("code", "c1", False, 0, True), ("code", "c2", True, 1, True)], "route string, model string, local boolean, position int, available boolean")
    return routing.first_available(routing.route(_messages(spark, d)).select("conv_id", "route"), models)


_JUDGED = "(SELECT quality AS expected, (n_chars > 1000)::INT AS predicted FROM labels JOIN documents USING (doc_id))"


def _judged(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("predicted"))
    return table(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("expected")).join(docs, "doc_id").select("expected", "predicted")


@query("R05_accuracy", f"SELECT expected, count(*) AS questions, count(*) FILTER (WHERE expected = predicted) AS correct, round(avg((expected = predicted)::INT::DOUBLE), 4) AS accuracy FROM {_JUDGED} GROUP BY expected")
def accuracy(spark, d):
    return routing.report(_judged(spark, d))


@query("A12_confusion", f"SELECT expected, count(*) FILTER (WHERE predicted = 0) AS \"0\", count(*) FILTER (WHERE predicted = 1) AS \"1\" FROM {_JUDGED} GROUP BY expected")
def confusion(spark, d):
    return routing.confusion(_judged(spark, d), [0, 1])


@query("P10_intents", r"SELECT conv_id, turn, regexp_matches(text, '(?i)(whole|entire|all of the) (file|document|text)|summar') AS whole_file, regexp_matches(text, '(?i)\b(chart|graph|plot|pie)\b') AS chart, regexp_matches(text, '(?i)\b(remember|forget)\b') AS memory FROM conversations")
def intents(spark, d):
    text = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", text.rlike("(?i)(whole|entire|all of the) (file|document|text)|summar").alias("whole_file"), text.rlike(r"(?i)\b(chart|graph|plot|pie)\b").alias("chart"), text.rlike(r"(?i)\b(remember|forget)\b").alias("memory"))
