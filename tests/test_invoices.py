"""Pages into invoices against plain code on random pages; lines with doubtful figures; notes in exports."""

import json
import random

import pytest
from pyspark.sql import functions as F

from brindle.functions import values
from brindle.operators import invoice, pages
from test_domain import record

TYPES = {"page": "int", "Items": "array<struct<Description:string,Qty:string,UnitPrice:string,Amount:string,HSNSAC:string>>", "unsure": "array<string>"}


def frame(spark, records):
    fields = list(records[0])
    return spark.createDataFrame([tuple(r[f] for f in fields) for r in records], ", ".join(f"{f} {TYPES.get(f, 'string')}" for f in fields))


def made(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lines = [(r.choice(["desk", "lamp", ""]), r.choice(["1", "2", ""]), r.choice(["100.00", "about ten", ""]), r.choice(["100.00", "200.00", "about ten", ""]), "") for _ in range(r.randint(0, 3))]
        given = {
            "InvoiceId": r.choice(["A-1", "a 1", "B-2", "", ""]), "InvoiceDate": r.choice(["05/03/2026", "05/03/2020", "soon", ""]), "VendorName": r.choice(["Asha & Co", "ASHA CO.", "Ravi Ltd", ""]), "CustomerName": r.choice(["Ravi Ltd", "", "Kim"]),
            "InvoiceTotal": r.choice(["200.00", "236.00", "many", "", ""]), "TaxableValue": r.choice(["200.00", "", "x"]), "CGSTAmount": r.choice(["18.00", "36.00", "", ""]), "SGSTAmount": r.choice(["18.00", "36.00", "", ""]), "IGSTAmount": r.choice(["36.00", "", "9%"]),
            "Discount": r.choice(["10.00", "", "5%"]), "TotalTax": r.choice(["36.00", "", ""]), "unsure": r.sample(["InvoiceId", "VendorName", "Items", "DueDate"], r.randint(0, 2)), "page_text": r.choice(["", "", "Asha & Co A-1 200.00 desk"]),
            "kind": r.choice(["invoice", "invoice", "receipt", "payment", "letter"]),
        }
        out.append(record(page=i // 2 if r.random() < 0.2 else i, lines=lines, **given) | {"file": f"f{i % 4}.pdf"})
    return out


def plain(rows):
    """The same by a walk over the pages of each file that keeps, for each field, a triple of value, level and note."""
    rank = {"empty": 0, "check": 0.35, "read": 0.8, "ok": 1.0}
    short = lambda s: "".join(c for c in s.lower() if c in "0123456789abcdefghijklmnopqrstuvwxyz")
    words = lambda s: " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split())
    groups = []
    for r in sorted(rows, key=lambda r: (r["file"], r["page"], r["InvoiceId"])):
        fields = {f: (r[f], r[f"{f}_level"], r[f"{f}_note"]) for f in invoice.FIELDS}
        own = {"file": r["file"], "pages": [r["page"]], "kind": r["kind"], "fields": fields, "lines": [dict(x) for x in r["Items"]], "unsure": r["_items_unsure"]}
        if groups and groups[-1]["file"] == r["file"] and r["page"] > groups[-1]["pages"][-1]:
            a = {f: v[0] for f, v in groups[-1]["fields"].items()}
            same = short(a["InvoiceId"]) != "" and short(a["InvoiceId"]) == short(r["InvoiceId"])
            bare = r["InvoiceId"] == r["VendorName"] == r["CustomerName"] == r["InvoiceDate"] == ""
            tail = r["InvoiceId"] == "" != a["InvoiceId"] and a["InvoiceTotal"] == "" and words(a["VendorName"]) != "" and words(a["VendorName"]) == words(r["VendorName"])
            if same or bare or tail:
                g = groups[-1]
                for f, new in fields.items():
                    old = g["fields"][f]
                    if new[0] and (not old[0] or f in invoice.AMOUNTS or (same and rank[new[1]] > rank[old[1]])):
                        g["fields"][f] = new
                full = [x for x in own["lines"] if any(x[f] for f in invoice.ITEM_FIELDS)]
                if full:
                    g["lines"] = [x for x in g["lines"] if any(x[f] for f in invoice.ITEM_FIELDS)] + full
                g["unsure"] |= own["unsure"]
                g["pages"] += own["pages"]
                continue
        groups.append(own)
    out = []
    for g in groups:
        full = [x for x in g["lines"] if any(x[f] for f in invoice.ITEM_FIELDS)]
        value, level, note = ({f: v[i] for f, v in g["fields"].items()} for i in range(3))

        def number(s):
            try:
                return float(s)
            except ValueError:
                return None

        sums, total = [number(x["UnitAmount"]) for x in full], number(value["InvoiceTotal"])
        base, tax, off = number(value["TaxableValue"]), number(value["TotalTaxAmount"]) or 0, number(value["Discount"]) or 0
        if full and total is not None and all(x is not None for x in sums):
            near = [abs(sum(sums) - t) <= 1.01 for t in (total, total - tax, total - tax + off)]
            if any(near) or (base is not None and (abs(sum(sums) - base) <= 1.01 or abs(sum(sums) - base - off) <= 1.01)):
                for x in full:
                    x["level"] = "ok"
                if any(near) and level["InvoiceTotal"] == "read":
                    level["InvoiceTotal"], note["InvoiceTotal"] = "ok", "the lines add up to it"
            elif len(full) > 1:
                note["UnitAmount"] = "the lines make"
        if g["unsure"]:
            note["Description"] = "the lines were not clearly readable"
        for f, name in pages.LEVEL_OF.items():
            for x in full:
                if g["unsure"] and x[name] == "read":
                    x[name] = "check"
            level[f] = min((x[name] for x in full if x[f]), key=rank.get, default="empty")
        got = weight = 0
        for f, w in invoice.WEIGHTS.items():
            if level[f] != "empty" or f in invoice.EXPECTED[g["kind"]]:
                got, weight = got + w * (0.3 if level[f] == "empty" else rank[level[f]]), weight + w
        out.append((g["file"], g["pages"], value, level, {f: n[:14] for f, n in note.items() if n}, [[x[f] for f in invoice.ITEM_FIELDS] for x in g["lines"]], round(got / weight, 2)))
    return sorted(out, key=lambda x: (x[0], x[1], x[2]["InvoiceId"]))


@pytest.mark.parametrize("seed", [1])
def test_merged_pages_equal_plain_code(spark, seed):
    read = invoice.read(frame(spark, made(seed, 400)), 2026).cache()
    got = sorted((r.asDict(recursive=True) for r in invoice.merged(read).collect()), key=lambda r: (r["file"], r["page_numbers"], r["InvoiceId"]))
    want = plain([r.asDict(recursive=True) for r in read.collect()])
    assert len(got) == len(want) and max(len(x[1]) for x in want) > 2
    for r, (file, numbers, value, level, note, lines, confidence) in zip(got, want, strict=True):
        assert (r["file"], r["page_numbers"], r["pages"], r["first_page"]) == (file, numbers, len(numbers), numbers[0])
        assert {f: r[f] for f in value} == value
        assert {f: r[f"{f}_level"] for f in level} == level
        assert {f: n[:14] for f, n in r["notes"].items()} == note
        assert [[x[f] for f in invoice.ITEM_FIELDS] for x in r["Items"]] == lines
        assert r["confidence"] == pytest.approx(confidence, abs=0.011)


def test_pages_are_folded_by_columns_in_slices(spark, monkeypatch):
    """Some pages at once or all of them, also with an invoice over several slices: the same invoices."""
    given = made(2, 150) + [record(InvoiceId="L-1", lines=[(f"line {i}", "", "", "1.00", "")], page=i) | {"file": "long.pdf"} for i in range(30)]
    read = invoice.read(frame(spark, given), 2026)
    rows = read.withColumns({"_key": F.regexp_replace(F.lower("InvoiceId"), "[^0-9a-z]", ""), "_seller": values.plain(F.col("VendorName"))}).orderBy("file", "page", "InvoiceId").toArrow()
    batches, names = rows.combine_chunks().to_batches(), pages._schema(read)[1]
    at_once = [x for b in pages.folded(batches, names) for x in b.to_pylist()]
    monkeypatch.setattr(pages, "TOGETHER", 4)
    assert [x for b in pages.folded(batches, names) for x in b.to_pylist()] == at_once
    (long,) = [x for x in at_once if x["file"] == "long.pdf"]
    assert long["page_numbers"] == list(range(30)) and [x["Description"] for x in long["Items"]] == [f"line {i}" for i in range(30)]


def test_tidy_texts_skip_the_cleaning(spark):
    given = {"oak lamp": "oak lamp", "N/A": "", " a": "a", '"a" ': "a", "a  b": "a b", "a,": "a", "a, , b": "a, b", "a\nb": "a, b", "a\n": "a", "": "", None: ""}
    rows = spark.createDataFrame([(k, v) for k, v in given.items()], "c string, want string")
    assert [(r.c, r.got) for r in rows.select("c", "want", values.answer(F.col("c")).alias("got")).where("got <> want").collect()] == []
    assert rows.where(F.col("c").rlike(values.TIDY)).count() == 2


def test_lines(spark):
    lines = [("", "", "", "", ""), ("Grand Total", "", "", "500", ""), ("desk ;,", "2", "100", "about ten", "HSN 7318 / 7319, 7318"), ("oak lamp", "1", "9% 50", "50.00", "12"), ("chair", "3", "5", "16.50", "")]
    row = invoice.read(frame(spark, [record(lines=lines, page_text="an oak lamp")]), 2026).select(F.inline("Items")).collect()
    assert [(r.Description, r.UnitPrice, r.UnitAmount, r.HSNSAC) for r in row] == [("desk", "100.00", "about ten", "7318; 7319"), ("oak lamp", "50.00", "50.00", ""), ("chair", "5.00", "16.50", "")]
    assert [(r.level, r.UnitPrice_level, r.Qty_level, r.Description_level, r.HSNSAC_level) for r in row] == [("check", "read", "read", "read", "read"), ("ok", "ok", "ok", "ok", "empty"), ("read", "read", "read", "read", "empty")]
    many = invoice.read(frame(spark, [record(lines=[("total", "", "", "1", "")] * 59 + [("a", "", "", "1", ""), ("b", "", "", "2", "")])]), 2026)
    assert [r.Description for r in many.select(F.inline("Items")).collect()] == ["a"]  # the first 60 are looked at, before totals go


def test_notes_reach_the_exports(spark):
    given = record(TaxableValue="100.00", IGSTAmount="18.00", InvoiceTotal="200.00", CustomerName="", unsure=["VendorName"], DueDate="net 30 days")
    rows = invoice.clean(frame(spark, [given]), 2026).cache()
    look = {r.fields: (r.level, r.note) for r in invoice.to_look_at(rows).collect()}
    assert look["TaxableValue, IGSTAmount"][0] == "check" and "= 118.00, but the total is 200.00" in look["TaxableValue, IGSTAmount"][1]
    assert look["VendorName"] == ("check", "not clearly readable")
    back = json.loads(invoice.as_json(rows).first().json)
    assert back["notes"]["CustomerName"] == "not on the page" and back["notes"]["DueDate"] == "payment terms, no date: net 30 days"


def test_tidy_lines_are_read_like_others(spark, monkeypatch):
    """Lines that need no cleaning are answered column by column: as the expressions for all other lines do."""
    from brindle.operators import tidy_lines

    rng = random.Random(5)
    pools = {
        "Description": ["part 7", "part 8 ;", "", None, " ; ", ";", "Total", "sub total", "net", "n/a", "NA", "a,b", 'say "x"', "x  y", "é 5", "x" * 301, "round off", "tab\tx", "-"],
        "Qty": ["2", "3", "", None, "1.5", "2 nos", "007", "-1", "x", "1,000", "0"],
        "UnitPrice": ["3.50", "10.00", "", None, "3.5", "0.00", "Rs 4", "9% 4.00", "12345678901234.00", "x", "-2.00", "1.005"],
        "Amount": ["7.00", "30.00", "", None, "8.01", "8.02", "5.25", "1,234.50", "9%", "na", "0.00", "00.50"],
        "HSNSAC": ["", "", None, "1234", "12345678", "123", "1234 5678", "123456789", "none"],
    }
    kind = "array<struct<Description:string,Qty:string,UnitPrice:string,Amount:string,HSNSAC:string>>"

    def line():
        plain = rng.random() < 0.7
        return tuple(rng.choice(p[: 4 if plain else len(p)]) for p in pools.values())

    given = [(i, rng.choice(["", "", "", " ", None, "part 7 at 3.50, 7.00"]), [line() if rng.random() < 0.98 else None for _ in range(rng.choice([0, 1, 1, 2, 3]))]) for i in range(1500)]
    given += [(-1, "", None), (-2, "", [("p", "1", "1.00", "1.00", "")] * 60), (-3, "", [("p", "1", "1.00", "1.00", "")] * 61)]
    rows = spark.createDataFrame(given, f"k int, page_text string, Items {kind}").withColumn("page_text", F.coalesce("page_text", F.lit("")))
    fast = rows.select("k", tidy_lines.tidy_lines(F.col("Items"), F.col("page_text"), invoice.ITEMS_TYPE, names=(*invoice.ITEM_FIELDS, *invoice.ITEM_LEVELS), maybe_not=invoice.MAYBE_NOT, non_answers=values.NON_ANSWERS, most=60, most_chars=300, round_off=1.01).alias("t"))
    answered = {r.k for r in fast.where("t IS NOT NULL").select("k").collect()}
    assert {-1, -2} <= answered and -3 not in answered and 300 < len(answered) < 1200
    got = {r.k: r.Items for r in invoice.items(rows).collect()}
    monkeypatch.setattr(tidy_lines, "tidy_lines", lambda *_, **__: F.lit(None).cast(invoice.ITEMS_TYPE))
    want = {r.k: r.Items for r in invoice.items(rows).collect()}
    assert got == want
