"""Sheets, files and streams, from small inputs written by the tests."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from brindle.sources import files, sheets
from brindle.streaming import streams


def xlsx(*named_rows) -> bytes:
    """A workbook of inline strings and numbers: what a spreadsheet program stores, without its styles."""
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {space}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}"/>' for i, (n, _) in enumerate(named_rows, 1)) + "</sheets></workbook>")
        for i, (_, rows) in enumerate(named_rows, 1):
            body = ""
            for r, row in enumerate(rows, 1):
                cells = (f'<c r="{chr(65 + c)}{r}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row) if v is not None)
                body += f'<row r="{r}">{"".join(cells)}</row>'
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {space}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def docx(*paragraphs: str) -> bytes:
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {space}><w:body>" + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "</w:body></w:document>")
    return out.getvalue()


def test_csv_sheet(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text('Sales report Q1\n\nRegion,Month,Amount (₹),PIN\nNorth,31/01/2026,"1,23,456.50",011001\nSouth,28/02/2026,₹500,560001\n', encoding="utf-8-sig")
    sheet = sheets.load(sheets.raw_csv(spark, str(path)))
    assert [(n, t) for n, _, t in sheet.columns] == [("region", "TEXT"), ("month", "DATE"), ("amount", "REAL"), ("pin", "TEXT")]
    assert sheet.title == "Sales report Q1"
    row = sheet.rows.agg(F.count("*").alias("n"), F.sum("amount").alias("s"), F.min("month").alias("m"), F.max("pin").alias("p")).first()
    assert tuple(row) == (2, 123956.5, dt.date(2026, 1, 31), "560001")


def test_csv_without_header_and_with_equal_ones(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1;2\n3;4\n")
    sheet = sheets.load(sheets.raw_csv(spark, str(tmp_path / "a.csv")))
    assert [n for n, _, _ in sheet.columns] == ["column_1", "column_2"] and sheet.rows.count() == 2
    (tmp_path / "b.csv").write_text("x,x,y\na,b,1\nc,d,2,more\n")
    sheet = sheets.load(sheets.raw_csv(spark, str(tmp_path / "b.csv")))
    assert [n for n, _, _ in sheet.columns] == ["x", "x_2", "y", "column_4"]


def test_cells_of_another_type_are_rescued(spark, tmp_path):
    lines = ["name,total", *(f"n{i},{i}" for i in range(1200)), "last,unknown"]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    sheet = sheets.load(sheets.raw_csv(spark, str(tmp_path / "t.csv")))
    last = sheet.rows.where("name = 'last'").first()
    assert last.total is None and last._rescued == {"total": "unknown"} and sheet.rows.count() == 1201


def test_empty_sheet_is_refused(spark, tmp_path):
    (tmp_path / "e.csv").write_text("\n,\n")
    with pytest.raises(sheets.SheetError):
        sheets.load(sheets.raw_csv(spark, str(tmp_path / "e.csv")))


def test_workbook(spark, tmp_path):
    rows = [["Register 2026"], [None], ["Invoice No", "Date", "Customer", "Total"], *([f"INV-{i:04}", "05/03/2026", "Asha" if i % 2 == 0 else "Ravi", 100 + i] for i in range(3000))]
    (tmp_path / "register.xlsx").write_bytes(xlsx(("Invoices 2026", rows), ("Empty", [])))
    raw = sheets.raw_xlsx(spark, str(tmp_path / "register.xlsx"))
    assert {r.sheet for r in raw.select("sheet").distinct().collect()} == {"Invoices 2026"}
    sheet = sheets.load(raw.where("sheet = 'Invoices 2026'").select("position", "cells"))
    got = {r.customer: (r.n, r.s) for r in sheet.rows.groupBy("customer").agg(F.count("*").alias("n"), F.sum("total").alias("s")).collect()}
    assert got == {"Asha": (1500, 2_398_500), "Ravi": (1500, 2_400_000)}


def test_texts_of_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿hello\n", encoding="utf-8")
    (tmp_path / "b.docx").write_bytes(docx("one", "two"))
    (tmp_path / "c.bin").write_bytes(b"\x00\x01")
    (tmp_path / ".hidden").write_text("no")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.problem is None) for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("hello\n", True), "b.docx": ("one\ntwo", True), "c.bin": (None, False)}
    assert files.docx_text(b"no zip") is None


def test_sections_are_capped(spark):
    rows = spark.createDataFrame([("a", 1, "x" * 6), ("a", 2, "y" * 6), ("a", 3, "z"), ("b", 1, "w")], "name string, position int, text string")
    got = sorted(tuple(r) for r in files.capped_sections(rows, 8).collect())
    assert got == [("a", 1, "xxxxxx"), ("a", 2, "yy"), ("b", 1, "w")]


# --- streams -----------------------------------------------------------------


def table_of(spark, stream, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", str(tmp_path / "checkpoint")).option("path", out).trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.parquet(out)


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    later = spark.sql("SELECT TIMESTAMP_NTZ '2100-01-01 00:00:00' AS ts, 'end' AS event_type, 0.0D AS value")
    events.unionByName(later).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), events.schema)
    got = sorted(tuple(r) for r in table_of(spark, streams.windowed_counts(stream), tmp_path).where("event_type <> 'end'").collect())
    assert got == sorted(tuple(r) for r in streams.windowed_counts(events).collect()) and got


def test_streamed_documents_once(spark, tmp_path):
    rows = [("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("b", "x", 4)]
    df = spark.createDataFrame(rows, "name string, text string, k int").withColumn("added", F.timestamp_seconds(F.col("k")))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), df.schema)
    got = table_of(spark, streams.fresh_only(stream), tmp_path)
    assert sorted((r.name, r.text) for r in got.collect()) == [("a", "x"), ("a", "y"), ("b", "x")]


def test_upserts_are_exactly_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "name string, text string"
    for number, rows in enumerate(([("a", "1"), ("b", "1")], [("b", "2"), ("c", "2")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        streams.upsert_into(streams.read_stream(spark, source, schema), target, str(tmp_path / "checkpoint")).awaitTermination(120)
        assert spark.read.parquet(target).count() == (2, 3)[number]
    assert sorted((r.name, r.text) for r in spark.read.parquet(target).collect()) == [("a", "1"), ("b", "1"), ("c", "2")]


def test_assembled_and_sessions(spark):
    pieces = spark.createDataFrame([(1, "p", 2, "c"), (1, "p", 0, "a"), (1, "p", 1, "b"), (1, "p", 1, "b"), (1, "q", 0, "z")], "session int, part string, offset int, text string")
    assert sorted((r.part, r.text) for r in streams.assembled(pieces).collect()) == [("p", "abc"), ("q", "z")]
    events = spark.createDataFrame([(1, dt.datetime(2026, 1, 1, 10, m)) for m in (0, 20, 55)], "user_id int, ts timestamp_ntz")
    assert sorted((r.start, r.n) for r in streams.sessions(events).collect()) == [(dt.datetime(2026, 1, 1, 10, 0), 2), (dt.datetime(2026, 1, 1, 10, 55), 1)]
