"""Parts, contexts, slots, notes, sheets and tools, held against plain code or against results written out."""

import json
import random

from pyspark.sql import functions as F

from brindle.functions import texts, values
from brindle.operators import blocks, chunk, context, invoice, tools
from brindle.sources import sheets


def estimated(spark, found):
    from brindle.operators.budget import estimate

    rows = spark.createDataFrame([(t,) for t in sorted(found)], "text string").select("text", estimate(F.col("text")).alias("n")).collect()
    return {r.text: r.n for r in rows}


def made_text(rng, most):
    return " ".join(rng.choice(("red", "green", "river", "stone", "cloud", "2041")) for _ in range(rng.randint(1, most)))


def test_parts_equal_a_plain_fill(spark):
    rng = random.Random(5)
    sections = [(f"f{k}", i, f"page {i}" if k % 2 else rng.choice(("", "head", "tail")), made_text(rng, 900)) for k in range(6) for i in range(rng.randint(1, 9))]
    sections += [("empty", 0, "page 0", ""), ("null", 0, "page 0", None)]
    got = {(r.name, r.part): (r.label, r.text) for r in context.parts(spark.createDataFrame(sections, "name string, section int, label string, text string"), 100).collect()}
    want = {}
    for name in sorted({s[0] for s in sections}):
        part, bits, labels = 0, [], []

        def close():
            numbers = [x.removeprefix("page ") for x in labels]
            pages = labels and all(n.isdigit() for n in numbers)
            shown = ("" if not labels else ("page " + numbers[0] if numbers[0] == numbers[-1] else f"pages {numbers[0]}-{numbers[-1]}") if pages else labels[0] if len(set(labels)) == 1 else f"{labels[0]} to {labels[-1]}")
            want[name, part] = (shown, "\n\n".join(bits))

        for _, _, label, text in (s for s in sections if s[0] == name):
            for piece in chunk.pieces(text, 2000, 0):
                if bits and len("\n\n".join(bits)) + len(piece) > 2000:
                    close()
                    part, bits, labels = part + 1, [], []
                bits.append(piece)
                labels += [label] if label else []
        if bits:
            close()
    assert got == want and len(want) > 12


def test_files_of_a_chat_equal_a_plain_choice(spark):
    rng = random.Random(9)
    files = [(chat, place, f"f{place}", made_text(rng, 250)) for chat in range(12) for place in range(rng.randint(1, 6))]
    asked = [(chat, "where is the river" if chat % 3 else "nothing of it") for chat in range(12)]
    data = spark.createDataFrame(files, "chat int, position int, name string, text string")
    hits = context.ranked_pieces(data, spark.createDataFrame(asked, "chat int, question string"), 300, 0).persist()
    ranked = [tuple(r) for r in hits.select("chat", "position", "depth", "text").collect()]
    cost = estimated(spark, {f[3] for f in files} | {h[3] for h in ranked})
    for limit in (60, 300, 900):
        got = {tuple(r) for r in context.files_context(data, hits, limit).select("chat", "position", "kind", "depth", "text").collect()}
        want = set()
        for chat in range(12):
            own = [f for f in files if f[0] == chat]
            if sum(cost[f[3]] + 24 for f in own) <= limit:
                want |= {(chat, f[1], "whole", 0, f[3]) for f in own}
                continue
            used, whole = 0, set()
            for f in own:
                n = cost[f[3]] + 24
                if n <= limit / 4 and used + n <= limit / 2:
                    used, whole = used + n, whole | {f[1]}
                    want.add((chat, f[1], "whole", 0, f[3]))
            for depth, place, text in sorted((h[2], h[1], h[3]) for h in ranked if h[0] == chat and h[1] not in whole):
                if used + cost[text] + 16 <= limit:
                    used += cost[text] + 16
                    want.add((chat, place, "passage", depth, text))
        assert got == want


def test_pieces_with_the_words_come_first_and_a_start_stands_in(spark):
    files = [(1, 0, "a", "stone " * 30 + "river " * 30), (1, 1, "b", "cloud " * 60)]
    found = context.ranked_pieces(spark.createDataFrame(files, "chat int, position int, name string, text string"), spark.createDataFrame([(1, "the river")], "chat int, question string"), 100, 0).collect()
    assert all("river" in r.text for r in found if r.name == "a") and len([r for r in found if r.name == "b"]) == 4


def test_a_hit_over_the_limit_stays_alone(spark):
    hits = spark.createDataFrame([(1, 1, "word " * 400), (1, 2, "word"), (2, 1, "word"), (2, 2, "word " * 400), (2, 3, "word")], "question int, place int, text string")
    assert sorted((r.question, r.place) for r in context.within(hits, 100).collect()) == [(1, 1), (2, 1)]


def test_blanks_and_origins(spark):
    fields = spark.createDataFrame([("d", f"f{i:02}", i) for i in range(14)], "doc string, id string, position int")
    answers = spark.createDataFrame([("d", "f00", 2, "Rome"), ("d", "f00", 1, " n/a "), ("d", "f13", 1, '"Oslo"'), ("d", "f13", 2, "Bonn"), ("d", "f05", 1, None)], "doc string, id string, chunk int, value string")
    found = context.proposals(fields, answers)
    assert sorted(map(tuple, found.collect())) == [("d", "f00", 2, "Rome"), ("d", "f13", 1, "Oslo")]
    asked = {(r.batch, r.chunk): len(r.ids) for r in context.blank_requests(fields, found, 3).collect()}
    assert asked == {(0, 1): 12, (0, 2): 12, (0, 3): 11, (1, 1): 2, (1, 2): 1, (1, 3): 1}
    about = spark.createDataFrame([("d", "All roads lead to ROME.", "Write of Oslo")], "doc string, sources string, instructions string")
    assert {r.value: r.origin for r in context.with_origin(found, about).collect()} == {"Rome": "source", "Oslo": "prompt"}


def test_small_functions(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    assert one(texts.quoted(F.lit("\"a\" 'bc' it's - no"))) == "“a” ‘bc’ it’s — no"
    assert one(texts.quoted(F.lit("“a” - \"b\""))) == "“a” - \"b\""
    assert one(texts.title_slug(F.lit("  Été à Paris!"))) == "ete-a-paris" and one(texts.title_slug(F.lit(None).cast("string"))) == "document"
    assert one(texts.file_name(F.lit(' a/b: "c"  d. '))) == "a b c d" and one(texts.file_name(F.lit("?"))) == "Document"
    assert one(texts.numeric_cell(F.lit("**12,5 %**"))) and not one(texts.numeric_cell(F.lit("12 men")))
    assert one(texts.whole_number(F.lit("1.5"))) is None and one(texts.whole_number(F.lit(" -7 "))) == -7
    assert one(texts.theme_of(F.lit("2026-07-01").cast("date"), F.array().cast("array<string>"))) is None
    found = one(texts.leaves(F.lit('{"a": [{"b": "x"}, " ", 3], "c": {"d": ["y"]}, "e": null}')))
    assert [(r.path, r.value) for r in found] == [("a.0.b", "x"), ("c.d.0", "y")]
    assert one(texts.leaves(F.lit("no json"))) == [] and one(texts.leaves(F.lit('["z"]')))[0].path == ".0"
    assert one(texts.merged_map(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("3")))) == {"a": "2", "b": "3"}


def test_slots(spark):
    rows = [("d", 0, "field", "Full Name", None, None), ("d", 1, "field", "full name", None, None), ("d", 2, "field", " ", None, None)]
    rows += [("d", 3, "group_item", "title", "Jobs", 1), ("d", 4, "group_item", "point", "Jobs", 1), ("d", 5, "group_item", "point", "Jobs", 1), ("d", 6, "group_item", "title", "Jobs", 2), ("d", 7, "group_item", "point", "Jobs", 2)]
    rows += [("d", 8, "group_item", "x", "Mixed", 1), ("d", 10, "group_item", "y", "Mixed", 1), ("d", 9, "group_item", "x", "Mixed", 2)]
    labels = spark.createDataFrame(rows, "doc string, position int, role string, name string, group string, instance int")
    assert sorted((r.position, r.name) for r in blocks.slot_fields(labels).collect()) == [(0, "full_name"), (1, "full_name_2")]
    found = {(r.group, r.instance): r for r in blocks.slot_groups(labels).collect()}
    assert found["jobs", 1].fields == {"title": 3} and found["jobs", 1].lists == {"point": [4, 5]} and found["jobs", 2].lists == {"point": [7]}
    assert found["jobs", 1].apart and (found["jobs", 2].start, found["jobs", 2].end) == (6, 7)
    assert not found["mixed", 1].apart and not found["mixed", 2].apart


def test_labels_of_cells(spark):
    rows = [("d", 1, 1, 1, "Name:"), ("d", 1, 1, 2, ""), ("d", 1, 2, 1, "Town"), ("d", 1, 2, 2, " ")]
    rows += [("d", 2, r, c, ("" if r > 1 and c > 1 else "" if (r, c) == (3, 1) else f"h{c}" if r == 1 else f"row{r}")) for r in (1, 2, 3) for c in (1, 2, 3)]
    found = {tuple(r)[1:4]: r.label for r in blocks.cell_labels(spark.createDataFrame(rows, "doc string, table int, row int, col int, text string")).collect()}
    assert found[1, 1, 2] == "Name" and found[1, 2, 2] == "Town"
    assert found[2, 2, 3] == "row2 - h3" and found[2, 3, 2] == "h2 (row 2)" and found[2, 3, 1] == "h1 (row 2)"


def test_invoice_exports(spark):
    amounts = dict.fromkeys((*invoice.FIELDS, *(f"{f}_level" for f in (*invoice.FIELDS, *invoice.ITEM_FIELDS))), "")
    row = amounts | {"file": "a.pdf", "page": 1, "kind": "receipt", "TaxableValue": "100.00", "TotalTaxAmount": "18.00", "IGSTAmount": "18.00", "InvoiceTotal": "200.00", "TaxableValue_level": "check", "IGSTAmount_level": "check", "VendorName_level": "read"}
    data = spark.createDataFrame([row]).withColumn("Items", F.from_json(F.lit('[{"Description":"pen","Qty":"","UnitPrice":"","UnitAmount":"","HSNSAC":"","level":"read"},{"Description":"","Qty":"","UnitPrice":"","UnitAmount":"","HSNSAC":"","level":"empty"}]'), invoice.ITEMS_TYPE))
    noted = invoice.balance_note(data)
    note = "Taxable value 100.00 + tax 18.00 = 118.00, but the total is 200.00: another charge, or a misread figure"
    assert [tuple(r) for r in invoice.to_look_at(noted).collect()] == [("a.pdf", 1, "TaxableValue, IGSTAmount", "check", note)]
    fits = invoice.balance_note(data.withColumn("InvoiceTotal", F.lit("118.00")))
    assert fits.first().notes == {} and {r.note for r in invoice.to_look_at(fits).collect()} == {""}
    whole = invoice.summary(noted).first()
    assert (whole.Lines, whole.DocumentType, whole.InvoiceTotal) == (1, "Receipt", "200.00")
    back = json.loads(invoice.as_json(noted).first().json)
    assert back["notes"]["IGSTAmount"] == note and back["TaxableValue_level"] == "check"


def test_sheets_as_text(spark, tmp_path):
    rows = [("s", 0, ["a", "b|c", None, " "]), ("s", 1, [None, " "]), ("s", 2, ["1"]), ("s", 3, ["2", "x\ny", "z"]), ("none", 0, [None])]
    found = {r.sheet: r.text for r in sheets.sheet_texts(spark.createDataFrame(rows, "sheet string, position int, cells array<string>")).collect()}
    assert found == {"s": "| a | b/c |  |\n| --- | --- | --- |\n| 1 |  |  |\n| 2 | x y | z |"}
    cut = sheets.sheet_texts(spark.createDataFrame(rows, "sheet string, position int, cells array<string>"), 2).first().text
    assert cut.endswith("| 1 |  |  |\n(only the first 2 rows of this sheet were read)")
    raw = spark.createDataFrame([(i, r) for i, r in enumerate([["City Name", "Sales"], ["Oslo", "10"], ["Rome", "20"]])], "position int, cells array<string>")
    text = sheets.described(sheets.load(raw), "t1", "Sheet1", "a.xlsx")
    assert text.startswith('Table "t1" (sheet "Sheet1" of a.xlsx, 2 rows)') and "| Oslo | 10 |" in text and '("City Name")' in text


def test_tools_answer_and_never_raise(spark):
    spark.range(3).createOrReplaceTempView("few")
    box = tools.of_tables(spark)
    assert {d["name"] for d in box.definitions()} == {"list_tables", "describe_table", "query"} and "query(sql)" in box.system_prompt()
    assert box.run("query", {"sql": "SELECT count(*) AS n FROM few"}) == ("n\n3", "1 rows")
    assert box.run("describe_table", {"table": "few"}) == ("id bigint", "1 columns")
    assert "few" in box.run("list_tables", {})[0]
    assert box.run("nothing", {})[1] == "unknown tool" and box.run("query", {})[1] == "missing argument"
    assert box.run("query", {"sql": "DROP TABLE few"})[1] == "failed" and box.run("describe_table", {"table": "no_such"})[1] == "failed"
    spark.catalog.dropTempView("few")
    models = spark.createDataFrame([("a", 0, "cloud", True, True), ("b", 1, "local", False, True), ("c", 2, "local", True, None), ("d", 3, "local", True, True), ("e", 4, "local", True, False)], "id string, position int, provider string, available boolean, tools boolean")
    assert [tools.answering_model(models, p).first().id for p in ("c", "e", "a")] == ["c", "d", "d"]
    assert tools.answering_model(models.where("id = 'a'"), "a").count() == 0


def test_origins_of_letters_without_a_capital(spark):
    """ß has no single capital, Σ has two small ones: case is that of characters, whatever stands around them."""
    rows = [("Geßbe x", "", "Die geßbe x.", "prompt"), ("οδοσία"[:4], "οδοσία", "", "source"), ("ŉame", "", "of ŉame", "prompt"), ("İz", "so iz", "", "source"), ("Straße", "Strase", "", "model")]
    given = spark.createDataFrame(rows, "value string, source string, prompt string, want string")
    found = given.select("value", "want", texts.origin(values.upper_each(F.col("value")), F.col("source"), F.col("prompt")).alias("got")).collect()
    assert [(r.value, r.got) for r in found] == [(r.value, r.want) for r in found]
