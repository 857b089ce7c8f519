"""Queries of memories, charts, document blocks, sections and streams' batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.catalog import table
from brindle.functions.values import MEMORY_STOP_WORDS
from brindle.operators import blanks, blocks, edits, charts, memories
from brindle.plans.book import Book
from brindle.sources import files, sheets
from brindle.streaming import streams

BOOK = Book()
query = BOOK.query


def _memories(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select(F.concat(F.lit("scope"), F.col("conv_id") % 5).alias("scope"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text", F.col("turn").alias("added"))


_MEMORIES = "(SELECT 'scope' || conv_id % 5 AS scope, conv_id * 100 + turn AS id, text, turn AS added FROM conversations WHERE role = 'user')"


@query(
    "M02_match_score",
    rf"""SELECT id, round(len(list_intersect(stems, ['tion', 'ther', 'that', 'erin'])) / 4::DOUBLE, 4) AS score FROM (SELECT id, list_transform(list_filter(
        regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{3,}}'), lambda w: w NOT IN ({", ".join(f"'{w}'" for w in MEMORY_STOP_WORDS)})), lambda w: substr(w, 1, 4)) AS stems FROM {_MEMORIES})""",
)
def match_score(spark, d):
    return _memories(spark, d).select("id", F.round(memories.match_score(F.col("text"), F.lit("tional thereupon thatched erinwh")), 4).alias("score"))


@query("M01_added")
def memories_added(spark, d):
    store = _memories(spark, d)
    return memories.added(store.where("id % 2 = 0"), store.withColumn("text", F.upper("text")))


@query("M03_forgetting")
def forgetting(spark, d):
    store = _memories(spark, d)
    requests = store.where("added <= 2").select(F.col("id").alias("request"), "scope", F.col("text").alias("wanted"))
    return memories.forgetting(store, requests)


@query(
    "M04_prompt_lines",
    f"""SELECT scope, string_agg('- ' || text, chr(10) ORDER BY added, id) AS lines FROM (SELECT *, sum(length(text) + 3) OVER (PARTITION BY scope ORDER BY added DESC, id DESC ROWS UNBOUNDED PRECEDING) AS used FROM {_MEMORIES}) WHERE used - 1 <= 2000 GROUP BY scope""",
)
def prompt_lines(spark, d):
    return memories.prompt_lines(_memories(spark, d), 2000)


@query("M05_counts", f"SELECT scope, count(*) AS n FROM {_MEMORIES} GROUP BY scope")
def memory_counts(spark, d):
    return _memories(spark, d).groupBy("scope").agg(F.count("*").alias("n"))


@query("M06_switches", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 = 0 ELSE true END AS charts, o_orderkey % 5 = 0 AS memory FROM orders")
def switches(spark, d):
    k = F.col("o_orderkey")
    given = F.create_map(F.lit("charts"), F.when(k % 3 == 0, k % 2 == 0), F.lit("memory"), k % 5 == 0, F.lit("unknown"), F.lit(True))
    found = memories.switches({"charts": True, "memory": False}, given)
    return table(spark, d, "orders").select("o_orderkey", F.element_at(found, "charts").alias("charts"), F.element_at(found, "memory").alias("memory"))


@query(
    "G01_chart_series",
    """SELECT name, list(label ORDER BY label) AS labels, list(round(value, 1) ORDER BY label) AS "values" FROM (SELECT o_orderpriority AS label, o_orderstatus AS name, sum(o_totalprice) AS value FROM orders GROUP BY ALL) GROUP BY name""",
)
def chart_series(spark, d):
    found = charts.series(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice")
    return found.select("name", "labels", F.transform("values", lambda v: F.round(v, 1)).alias("values"))


@query("S16_capped_sections", "SELECT conv_id AS name, turn, least(length(text), 700 - before)::BIGINT AS kept FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations) WHERE before < 700")
def capped_sections(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("name"), F.col("turn").alias("position"), "text")
    return files.capped_sections(rows, 700).select("name", F.col("position").alias("turn"), F.length("text").cast("long").alias("kept"))


@query("S18_tidy_layout", r"SELECT page_id, length(regexp_replace(regexp_replace(html, ' {7,}', '      ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))::BIGINT AS n FROM pages")
def tidy_layout(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(files.tidy_layout(F.col("html"))).cast("long").alias("n"))


@query("F04_column_types", "SELECT 'INTEGER' AS size, 'REAL' AS price, 'TEXT' AS code, 'DATE' AS day, 'TEXT' AS name")
def column_types(spark, d):
    """Types told from the first thousand values of five columns written as texts."""
    rows = table(spark, d, "part").orderBy("p_partkey").limit(1000).select(F.col("p_size").cast("string").alias("size"), F.concat(F.lit("Rs. "), F.format_number(F.col("p_retailprice") + 0.5, 2)).alias("price"), F.concat(F.lit("0"), "p_partkey").alias("code"), F.date_format(F.date_add(F.lit("2026-01-01"), F.col("p_size")), "d/M/yyyy").alias("day"), F.col("p_name").alias("name"))
    return rows.agg(*[sheets.column_type(F.collect_list(c)).alias(c) for c in rows.columns])


@query("S20_markdown_blocks")
def markdown_blocks(spark, d):
    """Documents as Markdown: every seventh line a heading, every fifth a list item."""
    text = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 7 == 0, F.concat(F.lit("## "), x)).when(i % 5 == 0, F.concat(F.lit("- "), x)).otherwise(x)), "\n")
    return blocks.markdown_blocks(table(spark, d, "documents").select("doc_id", text.alias("text")), "doc_id")


_TEMPLATE = ("Dear {{customer_name}},", "Account of # is held by ____ and ______", "Due DD/MM/YYYY, see [1], [2, 3] and [Order No]", "Phone:", "Signed: {{x}} [customer name] {{Customer  Name}} ..... 7")


@query(
    "D01_blanks",
    """SELECT c_custkey AS id, field, how, replace(label, '#', c_name) AS label, current, spots FROM customer, (VALUES
      (1, 'placeholder', 'Customer name', '{{customer_name}}', 3), (2, 'blank', 'Account of # is held by', '____', 1), (3, 'blank', 'and', '______', 1), (4, 'sample', 'Due', 'DD/MM/YYYY', 1),
      (5, 'placeholder', 'Order No', '[Order No]', 1), (6, 'label', 'Phone', '', 1), (7, 'placeholder', 'X', '{{x}}', 1)) AS t(field, how, label, current, spots)""",
)
def blanks_found(spark, d):
    """A letter to each customer as five lines: a placeholder that comes three times, citations and dots before a number that are none."""
    line = F.posexplode(F.array(*[F.replace(F.lit(x), F.lit("#"), F.col("c_name")) for x in _TEMPLATE])).alias("position", "text")
    found = blanks.fields(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), line))
    return found.select("id", "field", "how", "label", "current", F.size("spots").alias("spots"))


@query("D12_contents")
def contents(spark, d):
    return blocks.outline(markdown_blocks(spark, d))


_LINES = "(SELECT doc_id, i, a[i + 1] AS text, len(a) AS n FROM (SELECT doc_id, a, unnest(range(len(a))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)))"


def _line_blocks(spark, d):
    """Documents as blocks: each line one, every seventh a heading."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("position", "text"))
    head = F.col("position") % 7 == 0
    return lines.withColumns({"type": F.when(head, "heading").otherwise("text"), "level": F.when(head, 1).otherwise(0)})


def _same_edits(spark, d, **columns):
    """The same edits for each document, given as columns of a list each."""
    n = len(columns["op"])
    each = F.array(*[F.struct(F.lit(i).alias("seq"), *[(F.array(*map(F.lit, v[i])).cast("array<int>") if isinstance(v[i], list) else F.lit(v[i])).alias(c) for c, v in columns.items()]) for i in range(n)])
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.inline(each))


@query(
    "D06_replace_section",
    f"""WITH l AS {_LINES}, kept AS (SELECT doc_id, i AS a, 0 AS b, CASE WHEN i % 7 = 0 THEN 'heading' ELSE 'text' END AS type, text FROM l WHERE i % 7 = 0 OR i > 14
      UNION ALL SELECT DISTINCT doc_id, 0, 1, 'text', 'Rewritten' FROM l UNION ALL SELECT DISTINCT doc_id, 0, 2, 'list', 'point' FROM l UNION ALL SELECT doc_id, 7, 1, 'text', 'Short' FROM l WHERE i = 7)
    SELECT doc_id AS id, (row_number() OVER (PARTITION BY doc_id ORDER BY a, b) - 1)::INT AS position, type, text FROM kept""",
)
def replace_section(spark, d):
    """The first two sections of each document written anew; the third edit isn't at a heading."""
    given = _same_edits(spark, d, op=["replace_section"] * 3, blocks=[[0], [7], [8]], text=["Rewritten\n- point", "Short", "never"])
    return edits.blocks_of(edits.edit_documents(_line_blocks(spark, d), given)).select("id", "position", "type", "text")


@query(
    "D05_edit_log",
    f"""WITH l AS {_LINES}, d AS (SELECT doc_id, max(n) AS n, sum((length(text) - length(replace(text, 'the', ''))) // 3) FILTER (i = 0 OR i > 2) AS found FROM l GROUP BY doc_id)
    SELECT doc_id AS id, seq::INT AS seq, said IN ('1', '2') OR (seq = 4 AND found > 0) AS applied, said FROM (SELECT *, CASE seq
      WHEN 0 THEN CASE WHEN n > 2 THEN '2' ELSE 'no such block' END WHEN 1 THEN CASE WHEN n > 2 THEN 'removed before' WHEN n = 2 THEN '1' ELSE 'no such block' END
      WHEN 2 THEN '2' WHEN 3 THEN 'no such operation' WHEN 4 THEN CASE WHEN found > 0 THEN found::BIGINT::VARCHAR ELSE 'not found' END ELSE 'no such table' END AS said
      FROM d, unnest(range(6)) AS t(seq))""",
)
def edit_log(spark, d):
    given = _same_edits(spark, d, op=["delete", "replace_text", "insert", "paint", "find_replace", "delete_row"], blocks=[[1, 2], [1], [0], [0], [], []], text=[None, "again", "a\nb", None, None, None], find=[None, None, None, None, "the", None], put=[None, None, None, None, "THE", None], match_case=[None, None, None, None, True, None], row=[None, None, None, None, None, 1])
    return edits.log_of(edits.edit_documents(_line_blocks(spark, d), given)).select("id", "seq", "applied", "said")


@query("D03_filled", "SELECT s_suppkey, 'Dear ' || s_name || ', your balance is ' || s_acctbal::BIGINT || ' {{unknown}}' AS letter FROM (SELECT s_suppkey, s_name, trunc(s_acctbal) AS s_acctbal FROM supplier)")
def filled(spark, d):
    given = F.create_map(F.lit("name"), F.col("s_name"), F.lit("balance"), F.col("s_acctbal").cast("long").cast("string"))
    return table(spark, d, "supplier").select("s_suppkey", blocks.fill(F.lit("Dear {{name}}, your balance is {{balance}} {{unknown}}"), given).alias("letter"))


@query("D07_find_and_replace", "SELECT p_partkey, replace(p_name, 'a', 'AA') AS name, (length(p_name) - length(replace(p_name, 'a', '')))::BIGINT AS n FROM part")
def find_and_replace(spark, d):
    text, n = blocks.found_and_replaced(F.col("p_name"), "a", "AA")
    return table(spark, d, "part").select("p_partkey", text.alias("name"), n.alias("n"))


@query("X01_retention", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-05 00:00:00' - INTERVAL 24 HOUR")
def retention(spark, d):
    return streams.kept(table(spark, d, "events"), "ts", F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), 24).select("event_id")


@query("X05_assembled", "SELECT user_id AS session, event_type AS part, string_agg(event_id::VARCHAR || ';', '' ORDER BY event_id) AS text FROM events GROUP BY ALL")
def assembled(spark, d):
    pieces = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("part"), F.col("event_id").alias("offset"), F.concat("event_id", F.lit(";")).alias("text"))
    return streams.assembled(pieces.unionByName(pieces))


@query("X06_sessions", """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM
    (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def session_starts(spark, d):
    return streams.sessions(table(spark, d, "events"))


@query("extra_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    """An extra of the engine: tumbling windows by event time."""
    return streams.windowed_counts(table(spark, d, "events"))
