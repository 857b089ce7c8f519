"""Queries of what a question gets with it, of template blanks and tables, and of small functions on texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.catalog import table
from brindle.functions import texts, values
from brindle.operators import blocks, context, invoice, search, tools
from brindle.plans import budgets, invoicing, searching
from brindle.plans.book import Book
from brindle.sources import sheets

BOOK = Book()
query = BOOK.query

LIMIT = 3000
#: Characters of a part of 1,250 tokens.
PART = 4000


@query(
    "T04_parts",
    f"""WITH RECURSIVE s AS (SELECT conv_id, turn, trim(text) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
    walk AS (SELECT conv_id, turn, r, t, 0 AS part, length(t) AS used FROM s WHERE r = 1
      UNION ALL SELECT s.conv_id, s.turn, s.r, s.t, CASE WHEN w.used + length(s.t) > {PART} THEN w.part + 1 ELSE w.part END, CASE WHEN w.used + length(s.t) > {PART} THEN length(s.t) ELSE w.used + length(s.t) + 2 END
      FROM walk w JOIN s ON s.conv_id = w.conv_id AND s.r = w.r + 1)
    SELECT conv_id AS name, part, CASE WHEN min(turn) = max(turn) THEN 'page ' || min(turn) ELSE 'pages ' || min(turn) || '-' || max(turn) END AS label, string_agg(t, chr(10) || chr(10) ORDER BY turn) AS text FROM walk GROUP BY conv_id, part""",
)
def parts(spark, d):
    """Conversations as files whose sections are their turns."""
    sections = table(spark, d, "conversations").select(F.col("conv_id").alias("name"), F.col("turn").alias("section"), F.concat(F.lit("page "), F.col("turn")).alias("label"), "text")
    return context.parts(sections, 1250)


_VECTORS = "(SELECT source, count(*) AS passages, count(vec_id) AS with_vectors, CASE min(doc_id) % 3 WHEN 0 THEN '' WHEN 1 THEN 'm1' ELSE 'm2' END AS made_by FROM documents LEFT JOIN embeddings ON doc_id * 2 = vec_id GROUP BY source)"


@query("T10_search_mode", f"SELECT source, with_vectors, made_by = 'm2' AS stale, CASE WHEN made_by <> 'm2' AND with_vectors > 0 THEN 'meaning and words' ELSE 'words' END AS mode FROM {_VECTORS}")
def search_mode(spark, d):
    """Sources as workspaces; their index was made by the model in use, another one, or none."""
    vectors = table(spark, d, "embeddings").select("vec_id")
    docs = table(spark, d, "documents").select("source", "doc_id", (F.col("doc_id") * 2).alias("vec_id")).join(vectors.withColumn("has", F.lit(1)), "vec_id", "left")
    by = F.element_at(F.array(*map(F.lit, ("", "m1", "m2"))), (F.min("doc_id") % 3 + 1).cast("int"))
    rows = docs.groupBy("source").agg(F.count("has").alias("with_vectors"), by.alias("made_by"))
    stale, mode = context.search_mode(F.col("made_by"), F.lit("m1"), F.col("with_vectors"))
    return rows.select("source", "with_vectors", stale.alias("stale"), mode.alias("mode"))


@query(
    "T14_context_block",
    f"""{searching._BM25}, shown AS (SELECT question, place, doc_id, source, text, sum({budgets._estimate('text')} + 16) OVER (PARTITION BY question ORDER BY place) AS used FROM words JOIN documents ON id = doc_id),
    kept AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY place) + 2 AS n FROM shown WHERE used <= {LIMIT} OR place = 1)
    SELECT question, string_agg('[' || n || '] ' || doc_id || ', ' || source || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS block,
      list(n || ' ' || CASE WHEN length(text) > 600 THEN regexp_replace(substr(text, 1, 600), '\\s+$', '') || ' …' ELSE text END ORDER BY n) AS sources FROM kept GROUP BY question""",
)
def context_block(spark, d):
    """The best documents of each benchmark item by BM25, within 3,000 tokens, numbered from 3."""
    docs = table(spark, d, "documents")
    found = search.bm25(docs, searching._questions(spark, d))
    hits = found.join(docs.select(F.col("doc_id").alias("id"), "source", "text"), "id").select("question", "place", F.col("id").cast("string").alias("document"), F.col("source").alias("label"), F.lit("words").alias("matched_by"), "text")
    made = context.context_block(context.within(hits, LIMIT), start=3)
    return made.select("question", "block", F.transform("sources", lambda s: F.concat_ws(" ", s["n"], s["text"])).alias("sources"))


@query("C08_files_context")
def files_context(spark, d):
    """A conversation's turns as its files, the newest first, for the last question asked."""
    turns = table(spark, d, "conversations")
    files = turns.where("role <> 'user'").select(F.col("conv_id").alias("chat"), (-F.col("turn")).alias("position"), F.concat(F.lit("turn "), "turn").alias("name"), "text")
    questions = turns.where("role = 'user'").groupBy(F.col("conv_id").alias("chat")).agg(F.max_by("text", "turn").alias("question"))
    return context.files_context(files, context.ranked_pieces(files, questions, 200, 40), 400)


_CUSTOMERS = "(SELECT o_custkey AS doc, o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE (o_orderkey % 4 + 1)::INT END AS chunk FROM orders)"


def _blanks(spark, d):
    """A customer's orders as the blanks of a template; part 1, 2, 3 or none of the sources answers one."""
    fields = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("position"))
    part = F.explode(F.sequence(F.lit(1), F.lit(3)))
    said = F.when(F.col("chunk") - 1 < F.col("id") % 4, F.element_at(F.array(*map(F.lit, ("N/A", "", "not found"))), F.col("chunk"))).when(F.col("id") % 4 == 3, "--").otherwise(F.concat(F.lit('"part '), "chunk", F.lit('"')))
    return fields, fields.select("doc", "id", part.alias("chunk")).withColumn("value", said)


@query("C12_blank_requests", f"SELECT doc, batch, c::INT AS chunk, list(id ORDER BY id) AS ids FROM (SELECT *, ((row_number() OVER (PARTITION BY doc ORDER BY id) - 1) // 12)::BIGINT AS batch FROM {_CUSTOMERS}), range(1, 4) t(c) WHERE c <= coalesce(chunk, 3) GROUP BY ALL")
def blank_requests(spark, d):
    fields, answers = _blanks(spark, d)
    return context.blank_requests(fields, context.proposals(fields, answers), 3)


@query("C12_proposals", f"SELECT doc, id, chunk, 'part ' || chunk AS value FROM {_CUSTOMERS} WHERE chunk IS NOT NULL")
def proposals(spark, d):
    return context.proposals(*_blanks(spark, d))


_OUTCOME = "['rows', 'none', 'rows', 'unusable', 'rows', 'unreadable', 'rows', 'none', 'rows', 'unavailable'][((conv_id * 7 + turn * 3) % 10 + 1)::INT]"


@query(
    "I21_pages_read",
    f"""WITH p AS (SELECT conv_id AS file, turn AS page, {_OUTCOME} AS o FROM conversations), s AS (SELECT *, min(CASE WHEN o = 'unavailable' THEN page END) OVER (PARTITION BY file) AS stop FROM p)
    SELECT file, CASE WHEN stop IS NOT NULL THEN CASE WHEN count(*) FILTER (o = 'rows') > 0 THEN 'stopped' ELSE 'failed' END WHEN count(*) FILTER (o <> 'none') = 0 THEN 'nothing found' ELSE 'done' END AS status,
      coalesce(list(page ORDER BY page) FILTER (o = 'rows'), []) AS kept, coalesce(list(page ORDER BY page) FILTER (o = 'unusable'), []) AS failed, coalesce(list(page ORDER BY page) FILTER (o = 'unreadable'), []) AS unreadable
    FROM s WHERE stop IS NULL OR page <= stop GROUP BY file, stop""",
)
def pages_read(spark, d):
    """Turns as pages; what came of one follows from its numbers."""
    outcomes = F.array(*map(F.lit, ("rows", "none", "rows", "unusable", "rows", "unreadable", "rows", "none", "rows", "unavailable")))
    outcome = F.element_at(outcomes, ((F.col("conv_id") * 7 + F.col("turn") * 3) % 10 + 1).cast("int"))
    return context.pages_read(table(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("page"), outcome.alias("outcome")))


@query("I13_balance_notes", f"SELECT file, printf('Taxable value %.2f + tax %.2f = %.2f, but the total is %.2f: another charge, or a misread figure', net, t, net + t, total) AS note FROM (SELECT *, CASE WHEN k % 7 = 0 THEN 2 * tax ELSE tax END AS t, net + tax + CASE WHEN k % 5 = 0 THEN 100 ELSE 0 END AS total, NOT (k % 7 = 0 AND abs(tax - CASE WHEN k % 5 = 0 THEN 100 ELSE 0 END) <= 1.01) AND k % 7 = 0 AND k % 5 <> 0 AND tax > 0 AS one FROM {invoicing._KEPT}) WHERE t > 0 AND NOT one AND abs(net + t - total) > 1.01")
def balance_notes(spark, d):
    rows = invoice.balance(invoice.taxes(invoice.total(invoice.texts(invoicing.records(spark, d)))))
    noted = invoice.balance_note(invoice.apart(rows)).where("TotalTaxAmount <> ''")
    return noted.select("file", F.explode(F.map_values("notes")).alias("note")).distinct()


@query("K05_summary", f"SELECT file, 'INV-' || k AS InvoiceId, c_name AS CustomerName, coalesce(n, 0)::BIGINT AS Lines, 'Invoice' AS DocumentType FROM {invoicing._KEPT}")
def summary(spark, d):
    rows = invoice.items(invoice.texts(invoicing.records(spark, d)))
    return invoice.summary(rows).select("file", "InvoiceId", "CustomerName", "Lines", "DocumentType")


@query("P13_not_items", r"SELECT o_orderkey, len(list_filter([o_orderpriority, 'Grand Total', 'CGST @ 9%', 'Round-off', 'total ' || o_orderstatus], lambda x: NOT regexp_full_match(trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')), 'grand total|cgst .*|round off')))::BIGINT AS items FROM orders")
def not_items(spark, d):
    """Lines that are totals or taxes are no items."""
    from brindle.functions.values import plain

    lines = F.array("o_orderpriority", F.lit("Grand Total"), F.lit("CGST @ 9%"), F.lit("Round-off"), F.concat(F.lit("total "), "o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", F.size(F.filter(lines, lambda x: ~plain(x).rlike(invoice.NOT_ITEMS))).cast("long").alias("items"))


@query("P12_answering_model", "SELECT s_suppkey AS id FROM supplier WHERE s_acctbal > 0 AND s_nationkey <> 3 AND (s_suppkey = 7 OR s_suppkey % 3 = 0) ORDER BY s_suppkey <> 7, s_suppkey LIMIT 1")
def answering_model(spark, d):
    """Suppliers as models: those of one nation are remote, every third is known to use tools, of others nothing is known."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("position"), F.when(F.col("s_nationkey") == 3, "cloud").otherwise("local").alias("provider"), (F.col("s_acctbal") > 0).alias("available"), F.when(F.col("s_suppkey") % 3 == 0, F.lit(True)).alias("tools"))
    return tools.answering_model(rows, 7).select("id")


@query("D02_cell_labels", """SELECT doc, "table", "row", col, CASE WHEN "row" > 1 THEN 'supplier ' || doc || ' - head ' || col WHEN col > 1 THEN 'head ' || (col - 1) ELSE '' END AS label FROM
    (SELECT s_suppkey AS doc, 1 AS "table", r::INT AS "row", c::INT AS col, CASE WHEN r = 1 THEN 'head ' || c WHEN c = 1 THEN 'supplier ' || s_suppkey || ':' WHEN (s_suppkey + r + c) % 2 = 0 THEN '' ELSE 'x' END AS t FROM supplier, range(1, 4) a(r), range(1, 5) b(c)) WHERE t = '' AND col > 2
    UNION ALL SELECT s_suppkey, 1, r::INT, 2, 'supplier ' || s_suppkey FROM supplier, range(2, 4) a(r) WHERE (s_suppkey + r) % 2 = 0""")
def cell_labels(spark, d):
    """A table of three rows and four columns per supplier, with a heading row, a first column that ends in colons, and empty cells."""
    number = lambda n, name: F.explode(F.sequence(F.lit(1), F.lit(n))).alias(name)
    cells = table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc"), F.lit(1).alias("table"), number(3, "row")).select("*", number(4, "col"))
    text = F.when(F.col("row") == 1, F.concat(F.lit("head "), "col")).when(F.col("col") == 1, F.concat(F.lit("supplier "), "doc", F.lit(":"))).when((F.col("doc") + F.col("row") + F.col("col")) % 2 == 0, "").otherwise("x")
    return blocks.cell_labels(cells.withColumn("text", text))


_BLOCKS = "(SELECT p_brand AS id, p_partkey AS position, ['heading', 'page_break', 'text', 'table', 'page_break', 'page_break', 'list'][p_size % 7 + 1] AS type, p_name AS text FROM part)"


def _blocks(spark, d):
    kinds = F.array(*map(F.lit, ("heading", "page_break", "text", "table", "page_break", "page_break", "list")))
    return table(spark, d, "part").select(F.col("p_brand").alias("id"), F.col("p_partkey").alias("position"), F.element_at(kinds, F.col("p_size") % 7 + 1).alias("type"), F.col("p_name").alias("text"))


@query("D09_selected", f"SELECT id, position, 'body' AS target FROM {_BLOCKS} WHERE type NOT IN ('heading', 'table') UNION ALL SELECT id, position, 'headings' FROM {_BLOCKS} WHERE type = 'heading' UNION ALL SELECT id, position, 'ids' FROM {_BLOCKS} WHERE position IN (3, 5)")
def selected(spark, d):
    found = [blocks.selected(_blocks(spark, d), t, ids).select("id", "position", F.lit(t).alias("target")) for t, ids in (("body", None), ("headings", None), ("ids", [3, 5]))]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("D13_page_breaks", f"SELECT id, position, type FROM (SELECT *, lag(type) OVER (PARTITION BY id ORDER BY position) AS before FROM {_BLOCKS}) WHERE type <> 'page_break' OR before <> 'page_break'")
def page_breaks(spark, d):
    return blocks.without_empty_pages(_blocks(spark, d)).select("id", "position", "type")


@query("D10_slot_fields", "SELECT p_brand AS doc, p_partkey AS position, base || CASE WHEN r > 1 THEN '_' || r ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, base ORDER BY p_partkey) AS r FROM (SELECT *, 'size_' || p_size % 5 AS base FROM part))")
def slot_fields(spark, d):
    labels = table(spark, d, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("position"), F.lit("field").alias("role"), F.concat(F.lit(" Size: "), F.col("p_size") % 5).alias("name"))
    return blocks.slot_fields(labels)


@query("D10_slot_groups", """SELECT doc, instance, list(position ORDER BY position) FILTER (name = 'line') AS lines, min(position) AS start, max(position) AS "end", bool_and(true) AS apart FROM
    (SELECT l_orderkey AS doc, 1 + (n - 1) // 3 AS instance, n AS position, CASE WHEN n % 3 = 1 THEN 'head' ELSE 'line' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem) WHERE c >= 3) GROUP BY doc, instance""")
def slot_groups(spark, d):
    """An order's lines in items of three: a heading and up to two lines; orders of fewer than three lines have no list."""
    from pyspark.sql import Window

    by_order = Window.partitionBy("l_orderkey")
    n = F.row_number().over(by_order.orderBy("l_linenumber", "l_partkey"))
    rows = table(spark, d, "lineitem").select("l_orderkey", n.alias("n"), F.count("*").over(by_order).alias("of")).where("of >= 3")
    labels = rows.select(F.col("l_orderkey").alias("doc"), F.col("n").cast("long").alias("position"), F.lit("group_item").alias("role"), F.when(F.col("n") % 3 == 1, "Head").otherwise("Line").alias("name"), F.lit("Lines").alias("group"), F.floor((F.col("n") - 1) / 3 + 1).cast("long").alias("instance"))
    return blocks.slot_groups(labels).select("doc", "instance", F.try_element_at("lists", F.lit("line")).alias("lines"), "start", "end", "apart")


@query("S11_sheet_texts", r"""SELECT conv_id AS sheet, string_agg(line || CASE WHEN r = 1 THEN chr(10) || '| --- | --- | --- |' ELSE '' END, chr(10) ORDER BY turn) AS text FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r,
    '| ' || role || ' | ' || trim(translate(text, '|' || chr(10), '/ ')) || ' | ' || CASE WHEN w THEN turn::VARCHAR ELSE '' END || ' |' AS line FROM (SELECT *, turn % 2 = 1 AS w FROM conversations)) GROUP BY conv_id""")
def sheet_texts(spark, d):
    """Conversations as sheets: role, text, and on every second row its turn and blank cells after it."""
    blank = F.lit(" ")
    cells = F.array("role", "text", F.when(F.col("turn") % 2 == 1, F.col("turn").cast("string")), blank, F.lit(None).cast("string"))
    return sheets.sheet_texts(table(spark, d, "conversations").select(F.col("conv_id").alias("sheet"), F.col("turn").alias("position"), cells.alias("cells")))


@query("F15_numeric_cells", r"SELECT p_partkey, n, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true ELSE false END AS numeric FROM (SELECT *, p_size::VARCHAR AS n FROM part)")
def numeric_cells(spark, d):
    n = F.col("p_size").cast("string")
    forms = F.array(F.concat(F.lit("**€ "), n, F.lit("**")), F.concat(n, F.lit(" mln")), F.concat(F.lit("no. "), n), F.concat(F.lit("-$"), n, F.lit(",50")), F.concat(n, F.lit(" parts")))
    return table(spark, d, "part").select("p_partkey", n.alias("n"), texts.numeric_cell(F.element_at(forms, (F.col("p_partkey") % 5 + 1).cast("int"))).alias("numeric"))


@query("F16_flags_and_numbers", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS number FROM orders")
def flags_and_numbers(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", texts.flag(F.when(k % 3 == 0, " Yes").when(k % 3 == 1, "FALSE").otherwise("perhaps")).alias("flag"), texts.whole_number(F.concat(F.lit(" "), k, F.when(k % 2 == 0, "").otherwise(".5"))).alias("number"))


@query("F17_themes", "SELECT o_orderkey, ['red', 'green', 'blue', 'grey', 'white'][((o_orderdate::DATE - DATE '0001-01-01') + 1) % 5 + 1] AS theme FROM orders")
def themes(spark, d):
    return table(spark, d, "orders").select("o_orderkey", texts.theme_of(F.col("o_orderdate").cast("date"), F.array(*map(F.lit, ("red", "green", "blue", "grey", "white")))).alias("theme"))


_PLAIN = r"trim(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(
    "F36_origins",
    f"""SELECT conv_id, turn, CASE WHEN v = '' THEN '' WHEN contains(s, v) THEN 'source' WHEN contains(i, v) THEN 'prompt' ELSE 'model' END AS origin FROM (SELECT conv_id, turn, {_PLAIN.format("upper(substr(text, 1, 12))")} AS v,
      {_PLAIN.format("lag(text) OVER w")} AS s, {_PLAIN.format("first(text) OVER w")} AS i FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""",
)
def origins(spark, d):
    """Is the start of a turn in the turn before it, or in the first one?"""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumns({"before": F.lag("text").over(order), "first": F.first("text").over(order)})
    return rows.select("conv_id", "turn", texts.origin(values.upper_each(F.left("text", F.lit(12))), F.col("before"), F.col("first")).alias("origin"))


@query("F45_file_names", r"""SELECT conv_id, turn, left(CASE WHEN s = '' THEN 'document' ELSE s END, 72) AS slug, trim(left(CASE WHEN h = '' THEN 'Document' ELSE h END, 90), ' .-') AS name FROM (SELECT conv_id, turn, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '-', 'g'), '-') AS s,
    trim(regexp_replace(regexp_replace(trim(text), '[\\/:*?"<>|\r\n\t]+', ' ', 'g'), '\s{2,}', ' ', 'g'), ' .-') AS h FROM conversations)""")
def file_names(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", texts.title_slug(F.col("text")).alias("slug"), texts.file_name(F.col("text")).alias("name"))


@query("F54_defaults", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'size 10' END AS size, 'Arial' AS font FROM orders")
def defaults(spark, d):
    given = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("size"), "o_orderstatus"))
    found = texts.merged_map(F.create_map(*map(F.lit, ("size", "size 10", "font", "Arial"))), given)
    return table(spark, d, "orders").select("o_orderkey", F.element_at(found, "size").alias("size"), F.element_at(found, "font").alias("font"))


@query("F55_nested_paths", "SELECT o_orderkey, 'status' AS path, o_orderstatus AS value FROM orders UNION ALL SELECT l_orderkey, 'lines.' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) - 1) || '.flag', l_returnflag FROM lineitem")
def nested_paths(spark, d):
    """Orders with their lines as JSON, walked to their texts; numbers and blanks are no texts."""
    line = F.struct("l_linenumber", "l_partkey", F.col("l_returnflag").alias("flag"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    value = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.lit(" ").alias("blank"), "lines"))
    rows = table(spark, d, "orders").join(lines, "o_orderkey", "left").select("o_orderkey", F.explode(texts.leaves(value)).alias("x"))
    return rows.select("o_orderkey", "x.path", "x.value")


@query("W16_right_to_left", "SELECT p_partkey, '<' || substr(p_name, 2, 1) || '##' || substr(p_name, 5) AS text FROM part")
def right_to_left(spark, d):
    span = lambda start, end, put: F.struct(F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(put).alias("put"))
    return table(spark, d, "part").select("p_partkey", texts.replaced_at(F.col("p_name"), F.array(span(0, 1, "<"), span(2, 4, "##"))).alias("text"))
