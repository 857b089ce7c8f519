"""Files of invoices: read back equal to plain code; nothing partial after a failure; ends of sheets, notes and totals."""

import csv
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from brindle.operators import exports, invoice
from brindle.operators.ordering import numbered
from brindle.sources import one_file, sheets
from test_invoices import frame, made
from test_domain import record


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows"))
    extra = record(lines=[], TaxableValue="100.00", IGSTAmount="18.00", InvoiceTotal="200.00", CustomerName="=run()", InvoiceId="00123", page=1) | {"file": "z.pdf"}
    invoice.merged(invoice.read(frame(spark, [*made(3, 120), extra]), 2026)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def order(r):
    return r["file"], r["page"], r["InvoiceId"]


def plain_sheet(rows, repeat_details, repeat_totals):
    out = []
    for r in sorted(rows, key=order):
        for i, item in enumerate(r["Items"] or [None]):
            line = []
            for f in exports.COLUMNS:
                if f in invoice.ITEM_FIELDS:
                    line.append(item[f] if item else "")
                elif i == 0 or (repeat_totals if f in invoice.AMOUNTS else repeat_details):
                    line.append({"kind": invoice.KIND_NAMES.get(r["kind"], ""), "confidence": f"{round(r['confidence'] * 100)}%"}.get(f, r.get(f) or ""))
                else:
                    line.append("")
            out.append(line)
    return out


def unsafe(x):
    try:
        signed = x[:1] in ("+", "-") and float(x) is None
    except ValueError:
        signed = True
    return x[:1] in ("=", "@", "\t", "\r") or signed


@pytest.mark.parametrize(("details", "amounts"), [(False, False), (True, False), (True, True)])
def test_csv_reads_back(spark, rows, tmp_path, details, amounts):
    path = str(tmp_path / "out.csv")
    exports.write_csv(rows.repartition(7), path, details, amounts)
    data = (tmp_path / "out.csv").read_bytes()
    assert data.startswith(b"\xef\xbb\xbf") and data.count(b"\xef\xbb\xbf") == 1 and [x.name for x in tmp_path.iterdir()] == ["out.csv"]
    head, *got = list(csv.reader(data.decode("utf-8-sig").splitlines(keepends=True)))
    assert len(head) == 28 and head[0] == "Invoice File Name" and head[-2:] == ["DocumentType", "Confidence"]
    want = plain_sheet([r.asDict(recursive=True) for r in rows.collect()], details, amounts)
    assert got == [["'" + c if unsafe(c) else c for c in r] for r in want]
    assert "'=run()" in {r[7] for r in got}


def test_nothing_partial(spark, tmp_path):
    place = tmp_path / "out.csv"
    good = spark.range(10, numPartitions=3).select(F.col("id").cast("string"))
    one_file.write_csv(good, str(place))
    before = place.read_bytes()
    assert before == b"\xef\xbb\xbfid\r\n" + b"".join(b"%d\r\n" % i for i in range(10))
    bad = spark.range(10, numPartitions=3).select(F.when(F.col("id") == 8, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        one_file.write_csv(bad, str(place), overwrite=True)
    with pytest.raises(Exception, match="is there already"):
        one_file.write_csv(good, str(place))
    assert place.read_bytes() == before and [x.name for x in tmp_path.iterdir()] == ["out.csv"]
    one_file.write_csv(good.limit(0), f"file:{place}", overwrite=True)
    assert place.read_bytes() == b"\xef\xbb\xbfid\r\n"


def read_back(spark, path):
    found = {}
    for r in sheets.raw_xlsx(spark, path).orderBy("sheet", "position").collect():
        found.setdefault(r.sheet, []).append(r.cells)
    return found


def test_workbook_reads_back(spark, rows, tmp_path):
    path = str(tmp_path / "out.xlsx")
    exports.write_workbook(rows.repartition(5), path, summary=True, checks=True, totals=True)
    plain = sorted((r.asDict(recursive=True) for r in rows.collect()), key=order)
    found = read_back(spark, path)
    assert list(found) and set(found) == {"Invoices", "Summary", "Checks"}

    def stored(r):
        out = []
        for f, v in zip(exports.COLUMNS, r, strict=True):
            if f in invoice.DATES and v:
                try:
                    v = str((datetime.strptime(v, "%d-%m-%Y") - datetime(1899, 12, 30)).days)
                except ValueError:
                    pass
            if f == "confidence":
                v = float(v.rstrip("%")) / 100 if v else None
            elif f in exports.NUMBERS and v:
                try:
                    v = float(v)
                except ValueError:
                    pass
            out.append(v.strip() or None if isinstance(v, str) else v)
        return out

    def value(f, c):
        try:
            return float(c) if c and (f in exports.NUMBERS or f == "confidence") else c
        except ValueError:
            return c

    body = plain_sheet(plain, False, False)
    got = [[value(f, c) for f, c in zip(exports.COLUMNS, r, strict=True)] for r in found["Invoices"][1 : 1 + len(body)]]
    for g, w in zip(got, map(stored, body), strict=True):
        assert g[:-1] == w[:-1] and (g[-1] is None) == (w[-1] is None) and (g[-1] is None or abs(g[-1] - w[-1]) < 0.006)
    gap, total = found["Invoices"][1 + len(body) :]
    assert not any(gap) and total[0] == "Total"

    def number(s):
        try:
            return float(s)
        except (TypeError, ValueError):
            return 0.0

    assert float(total[4]) == pytest.approx(sum(number(r["InvoiceTotal"]) for r in plain), abs=0.01)
    assert float(total[17]) == pytest.approx(sum(number(x["UnitAmount"]) for r in plain for x in r["Items"]), abs=0.01) and total[16] is None
    assert len(found["Summary"]) == 1 + len(plain) + 2 and [r[1] for r in found["Summary"][1 : 1 + len(plain)]] == [r["InvoiceId"] or None for r in plain]
    starts, at = {}, 2
    for r in plain:
        starts.setdefault((r["file"], ", ".join(map(str, r["page_numbers"]))), at)
        at += max(len(r["Items"]), 1)
    checks = found["Checks"][1:]
    assert len(checks) == invoice.to_look_at(rows).count() and [float(r[1]) for r in checks] == sorted(float(r[1]) for r in checks)
    for r in checks:
        assert starts[r[0], r[2]] == int(float(r[1]))
    z = zipfile.ZipFile(path)
    assert z.testzip() is None and 'state="frozen"' in z.read("xl/worksheets/sheet1.xml").decode() and f'ref="A1:AB{len(body) + 1}"' in z.read("xl/worksheets/sheet1.xml").decode()


def test_long_sheets_go_on(spark, tmp_path):
    path = str(tmp_path / "long.xlsx")
    cell = F.array(F.struct(F.concat(F.lit("a\n<b>\u0001"), "id").alias("value"), F.lit("text!").alias("style")))
    body = spark.range(25, numPartitions=4).select(F.lit("S").alias("sheet"), F.lit(False).alias("foot"), cell.alias("cells"))
    foot = spark.range(1).select(F.lit("S").alias("sheet"), F.lit(True).alias("foot"), cell.alias("cells"))
    one_file.write_workbook(body.unionByName(foot), path, [{"name": "S", "header": ["h"], "widths": [9], "filter": True}, {"name": "None", "header": ["h"], "widths": [9]}], most_rows=12)
    found = read_back(spark, path)
    assert [len(found[s]) for s in ("S", "S 2", "S 3", "None")] == [10, 10, 10 - 2 + 2, 1]
    assert [r[0] for s in ("S", "S 2", "S 3") for r in found[s][1:] if r][:25] == [f"a\n<b> {i}" for i in range(25)] and found["S 3"][-1] == ["a\n<b> 0"]


def test_json_lines(spark, rows, tmp_path):
    exports.write_json(rows, str(tmp_path / "json"))
    back = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()]
    want = {(r.file, r.page, r.InvoiceId): (r.InvoiceTotal, r.notes) for r in rows.collect()}
    assert len(back) == rows.count() and all(want[x["file"], x["page"], x["InvoiceId"]] == (x["InvoiceTotal"], x["notes"]) for x in back)


def test_numbered(spark):
    got = sorted(numbered(spark.range(1000, numPartitions=6).select(((F.col("id") * 7919) % 500).alias("k"), "id"), "k").collect(), key=lambda r: r["at"])
    assert [r["at"] for r in got] == list(range(1000)) and [r["k"] for r in got] == sorted(r["k"] for r in got)
    assert numbered(spark.range(0), "id").count() == 0
