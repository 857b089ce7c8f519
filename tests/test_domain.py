"""Chunks, search, budgets, routing, memories, charts, documents and invoices on small cases with known answers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from brindle.functions import values
from brindle.operators import blocks, budget, charts, chunk, corpus, invoice, memories, routing, search

# --- chunks and search -------------------------------------------------------


def test_chunks_of_numbered_sentences():
    text = " ".join(f"This is sentence number {i}." for i in range(400))
    found = chunk.pieces(text, 500, 100)
    assert len(found) > 5 and all(len(p) <= 500 for p in found)
    last = re.findall(r"This is sentence number \d+\.", found[0])[-1]
    assert last in found[1] and all(p[0].isalnum() for p in found)


@pytest.mark.parametrize("seed", range(20))
def test_chunks_cover_the_text(seed):
    rng = random.Random(seed)
    # Numbers differ, so that a piece has one place in the text only.
    text = "".join(rng.choice([str(rng.randrange(10**6, 10**7)), " ", "\n\n", ". ", str(rng.randrange(10**30, 10**31)), "é"]) for _ in range(rng.randrange(400)))
    found, at = chunk.pieces(text, 60, 15), 0
    tidy = re.sub(r"[ \t]+\n", "\n", text).strip()
    for p in found:
        place = tidy.find(p, max(0, at - 16))
        assert place >= 0 and not tidy[at:place].strip() and len(p) <= 60
        at = max(at, place + len(p))
    assert not tidy[at:].strip()


def test_search_and_fusion(spark):
    docs = spark.createDataFrame([(1, "Sick leave is twelve days a year."), (2, "The hotel limit per night is 4000."), (3, "Lunch is at noon.")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "How many days of sick leave?"), (2, "hotel limit per night"), (3, "qwxyz")], "question int, text string")
    best = {r.question: r.id for r in search.bm25(docs, asked).where("place = 1").collect()}
    assert best == {1: 1, 2: 2}
    ranking = lambda rows: spark.createDataFrame(rows, "question int, id int, place long")
    fused = search.fuse(ranking([(1, 7, 1), (1, 8, 2)]), ranking([(1, 8, 1), (1, 9, 2)]))
    got = [(r.id, r.matched_by, r.score) for r in fused.orderBy("place").collect()]
    assert got == [(8, "both", 32.52), (7, "words", 16.39), (9, "meaning", 16.13)]


def test_vectors_of_another_length_are_left_out(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [1.0])], "vec_id int, embedding array<double>")
    asked = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(7)], "question int, vector array<double>")
    for block in (2, 1000):
        got = sorted((r.question, r.id, r.score, r.place) for r in search.by_meaning(vectors, asked, block=block).collect())
        assert got == sorted(x for q in range(7) for x in ((q, 1, 1.0, 1), (q, 2, 0.6, 2)))
    assert search.by_meaning(vectors, asked.limit(0)).count() == 0


def test_index_updates(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "name string, text string")
    assert sorted(tuple(r) for r in corpus.upsert(old, spark.createDataFrame([("b", "z"), ("c", "w")], "name string, text string")).collect()) == [("a", "x"), ("b", "z"), ("c", "w")]
    index = old.withColumn("sha256", F.sha2("text", 256))
    assert [r.name for r in corpus.fresh(index, spark.createDataFrame([("a", "x"), ("b", "new")], "name string, text string")).collect()] == ["b"]


# --- budgets -----------------------------------------------------------------


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_budgets(spark):
    assert one(spark, budget.reserve(F.lit(8192)), budget.prompt(F.lit(8192))) == (1638, 6554)
    words, digits, other = one(spark, *[budget.estimate(F.lit(t)) for t in ("word word word word!", "12345678901234567890", "ಮಾನವ ಮಾನವ ಮಾನವ ಮಾನ ")])
    assert words < digits < other and one(spark, budget.estimate(F.lit(""))) == (0,)
    costs = F.array(*[F.struct(F.lit(c).alias("cost"), F.lit(i).alias("i")) for i, c in enumerate((40, 70, 50, 10), 1)])
    assert [x.i for x in one(spark, budget.skipping(costs, F.lit(100)))[0]] == [1, 3, 4]
    assert one(spark, budget.fair_shares(F.array(F.lit(900), F.lit(100)), F.lit(500)))[0] == [400, 100]


def test_histories_fit(spark):
    rows = [(1, 2 * i + k, ("user", "assistant")[k], "word " * 400) for i in range(12) for k in (0, 1)] + [(1, 24, "user", "the last question"), (2, 0, "user", "word " * 40_000)]
    kept = budget.fit_turns(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), 3000).withColumn("n", budget.message_tokens(F.col("text"))).orderBy("turn").collect()
    first = [r for r in kept if r.conv_id == 1]
    assert sum(r.n for r in first) <= 3000 and first[0].role == "user" and first[-1].text == "the last question" and len(first) > 2
    (huge,) = (r for r in kept if r.conv_id == 2)
    assert huge.n <= 3100 and huge.text.startswith("word") and huge.text.endswith("word ") and "left out" in huge.text


# --- routing, memories, charts, documents ------------------------------------


def test_routes(spark):
    rows = [
        (1, 1, "user", "hello there", False, False, None),
        (2, 1, "user", "write a python function for binary search", False, False, None),
        (3, 1, "user", "look at this", False, True, None),
        (4, 1, "user", "prove the equation", False, False, None),
        (4, 2, "assistant", "done", False, False, "heavy"),
        (4, 3, "user", "and then?", False, False, None),
        (5, 1, "user", "here is a file", True, False, None),
        (5, 2, "assistant", "ok", False, False, "default"),
        (5, 3, "user", "fix this python bug", False, False, None),
        (6, 1, "user", "there are race conditions in my rust microservices", False, False, None),
    ]
    messages = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, has_files boolean, has_images boolean, route string")
    got = {r.conv_id: (r.route, r.source) for r in routing.route(messages).collect()}
    assert got == {1: ("default", "rules"), 2: ("code", "rules"), 3: ("image", "image"), 4: ("heavy", "sticky"), 5: ("heavy", "rules"), 6: ("expert", "rules")}


def test_memories(spark):
    schema = "scope string, id long, text string, added int"
    store = spark.createDataFrame([("a", 1, "Payroll closing date is the 25th", 1), ("b", 2, "Office opening time is nine", 1), ("b", 3, "Office opening time in May is ten", 2)], schema)
    new = spark.createDataFrame([("a", 4, "payroll  CLOSING date is the 25th", 3), ("a", 5, "  ", 3), ("a", 6, "x" * 600, 3), ("a", 7, "likes tea", 3), ("a", 8, "Likes tea", 4)], schema)
    assert sorted(r.id for r in memories.added(store, new).collect()) == [1, 2, 3, 7]
    asked = spark.createDataFrame([(1, "a", "payroll closing dates"), (2, "b", "office opening time"), (3, "a", "nothing of this")], "request int, scope string, wanted string")
    got = {r.request: (r.decision, r.id) for r in memories.forgetting(store, asked).collect()}
    assert got[1] == ("remove", 1) and got[2] == ("ask", None) and got[3] == ("none", None)


def test_charts(spark):
    rows = spark.createDataFrame([("Pune", "share", 60.0), ("Mysuru", "share", 40.0)], "city string, name string, value double")
    spec = charts.build(charts.series(rows, "city", "name", "value"), "pie")
    assert spec["labels"] == ["Mysuru", "Pune"] and spec["series"] == [{"name": "share", "values": [40, 60]}]
    uneven = charts.series(spark.createDataFrame([("x", "a", 1.0), ("y", "b", 2.0)], "l string, n string, v double"), "l", "n", "v")
    for kind in ("bar", "radar"):
        with pytest.raises(charts.ChartError):
            charts.build(uneven, kind)
    with pytest.raises(charts.ChartError):
        charts.build(charts.series(spark.createDataFrame([("x", "a", 1.0), ("x", "b", 2.0)], "l string, n string, v double"), "l", "n", "v"), "pie")


def test_document_blocks(spark):
    text = "# Title\n\nDear {{name}}, see [1] and [Your city].\n- item\n> quote\n```\n# code\n```\n---\n## Part\nDate: ____"
    found = blocks.markdown_blocks(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), "id")
    rows = found.orderBy("position").collect()
    assert [r.type for r in rows] == ["heading", "text", "list", "quote", "code", "rule", "heading", "text"]
    assert [r.label for r in blocks.blanks(found).orderBy("position", "n").collect()] == ["name", "Your city", ""]
    assert blocks.outline(found).first().contents == "Title\n  Part"
    edits = spark.createDataFrame([(1, rows[1].position, "replace", "Hi"), (1, rows[2].position, "delete", None), (1, rows[3].position, "insert", "more")], "id int, position int, op string, text string")
    got = [r.text for r in blocks.edited(found, edits).orderBy("position").collect()]
    assert got == ["Title", "Hi", "quote", "more", rows[4].text, rows[5].text, "Part", "Date: ____"]


# --- invoices ----------------------------------------------------------------

BLANK = {f: "" for f in invoice.FIELDS if f not in ("TotalTaxAmount", "Currency")}


def record(page=1, lines=(("desk", "2", "100.00", "200.00", ""),), unsure=(), page_text="", **given):
    full = {"file": "a.pdf", "page": page, "kind": "invoice", "page_text": page_text, "TotalInWords": "", "TotalTax": "", "Items": list(lines), "unsure": list(unsure)} | BLANK
    return full | {"InvoiceId": "A-1", "InvoiceDate": "05/03/2026", "InvoiceTotal": "200.00", "VendorName": "Asha & Co", "CustomerName": "Ravi Ltd"} | given


def cleaned(spark, *records):
    fields = list(records[0])
    types = {"page": "int", "Items": "array<struct<Description:string,Qty:string,UnitPrice:string,Amount:string,HSNSAC:string>>", "unsure": "array<string>"}
    df = spark.createDataFrame([tuple(r[f] for f in fields) for r in records], ", ".join(f"{f} {types.get(f, 'string')}" for f in fields))
    return invoice.clean(df, 2026)


def test_invoice_checks(spark):
    cases = [
        record(page=1),
        record(page=2, lines=()),
        record(page=3, VendorName="Ravi Ltd."),
        record(page=4, DueDate="01/02/2026"),
        record(page=5, InvoiceDate="05/03/2019"),
        record(page=6, CGSTAmount="36.00", SGSTAmount="36.00", TaxableValue="200.00", InvoiceTotal="236.00"),
        record(page=7, CGSTAmount="200.00", Discount="9%", IGSTAmount="0.00"),
        record(page=8, TotalInWords="Sixty One Thousand Nine Hundred Fifty Only", InvoiceTotal=""),
        record(page=9, kind="letter"),
        record(page=10, DueDate="net 30 days", unsure=["VendorName"]),
    ]
    got = {r.page: r for r in cleaned(spark, *cases).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8, 10}
    assert got[1].Items[0].level == "ok" and got[1].InvoiceTotal_level == "ok" and got[1].confidence > 0.8
    assert len(got[2].Items) == 1 and got[2].Items[0].level == "empty"
    assert got[3].VendorName_level == got[3].CustomerName_level == "check" and got[3].confidence < got[1].confidence
    assert got[4].DueDate_level == "check" and got[5].InvoiceDate_level == "check"
    assert (got[6].IGSTAmount, got[6].CGSTAmount, got[6].SGSTAmount, got[6].IGSTAmount_level) == ("36.00", "", "", "read")
    assert (got[7].CGSTAmount, got[7].Discount, got[7].IGSTAmount) == ("", "", "")
    assert (got[8].InvoiceTotal, got[8].InvoiceTotal_level) == ("61950.00", "check")
    assert got[10].DueDate == "" and got[10].DueDate_level == "empty" and got[10].VendorName_level == "check"


def test_invoice_pages_merge_and_flatten(spark):
    same = record(page=2, InvoiceId="A 1", InvoiceTotal="236.00", lines=(("chair", "1", "36.00", "36.00", ""),))
    rest = record(page=3, InvoiceId="", InvoiceDate="", VendorName="", CustomerName="", InvoiceTotal="500.00")
    other = record(page=4, InvoiceId="B-2")
    rows = cleaned(spark, record(), same, rest, other)
    merged = sorted((r.first_page, r.pages, r.InvoiceId, r.n_items) for r in invoice.merged(rows).collect())
    assert merged == [(1, 3, "A-1", 3), (4, 1, "B-2", 1)]
    sheet = invoice.flattened(cleaned(spark, record(lines=(("desk", "1", "100", "100", ""), ("lamp", "1", "100", "100", "")))), repeat_details=False)
    lines = sheet.orderBy("line").collect()
    assert [(r.line, r.InvoiceId, r.InvoiceTotal, r.Description) for r in lines] == [(0, "A-1", "200.00", "desk"), (1, "", "", "lamp")]
    assert invoice.totals(sheet).first().InvoiceTotal == 200.0


def test_formula_marks_are_neutralised(spark):
    cells = spark.createDataFrame([("=1",), ("@a",), ("+x",), ("-5",)], "c string").select(values.formula_safe(F.col("c")).alias("c"))
    assert [r.c for r in cells.collect()] == ["'=1", "'@a", "'+x", "-5"]


@pytest.mark.parametrize("together", [1024, 3])
def test_near_match_gives_every_pair(spark, tmp_path, monkeypatch, together):
    """All pairs of parts with near texts, those of one text too, also if the parts of a text lie in several blocks."""
    from brindle.plans import relational

    monkeypatch.setattr(relational, "PARTS_TOGETHER", together)
    rng = random.Random(9)
    rows = [(i, rng.choice(["B1", "B2", None]), rng.choice([1, 2]), "".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 2, 5, 7])))) for i in range(300)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    alike = lambda x, y: x[1] is not None and x[1:3] == y[1:3] and len(x[3]) == len(y[3]) and sum(a != b for a, b in zip(x[3], y[3], strict=True)) <= 2
    found = relational.near_match(spark, str(tmp_path))
    assert found.columns == ["a", "b"]
    assert sorted(map(tuple, found.collect())) == [(x[0], y[0]) for i, x in enumerate(rows) for y in rows[i + 1 :] if alike(x, y)]


def test_by_meaning_keeps_the_nearest_in_slices(spark):
    """Ties at the last place, vectors of other lengths, gaps, and more vectors than a slice, against plain code."""
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(4)]) for i in range(5000)] + [(5000 + i, [9.0] * 3) for i in range(5)] + [(6000, [9.0, None, 9.0, 9.0]), (6001, None)]
    asked = [(i, [rng.random() for _ in range(4)]) for i in range(6)] + [(7, [1.0, 2.0, 3.0]), (8, [1.0, None, 1.0, 1.0])]
    own, questions = spark.createDataFrame(rows, "vec_id long, embedding array<float>"), spark.createDataFrame(asked, "question int, vector array<double>")
    got = {}
    for r in search.by_meaning(own.coalesce(2), questions, top=7, block=3).orderBy("question", "place").collect():
        got.setdefault(r.question, []).append((r.id, r.score))
    for question, vector in asked[:7]:
        found = [(i, round(sum(x * y for x, y in zip(v, vector, strict=True)), 6)) for i, v in rows if v and None not in v and len(v) == len(vector)]
        assert got[question] == sorted(found, key=lambda x: (-x[1], x[0]))[:7]
    assert 8 not in got
    plan = search.by_meaning(own, questions)._jdf.queryExecution().toString()
    assert "Join" not in plan  # pairs that are rows one by one, as they were before, take 5,538 s at 6 GB
