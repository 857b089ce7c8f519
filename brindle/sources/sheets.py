"""Spreadsheets as typed tables: the head of a file tells delimiter, header, names and types; Spark reads the rest."""

from __future__ import annotations

import csv
import io
import zipfile
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.values import column_name, sheet_cell, sheet_date, sheet_number
from brindle.sources import stores

SCAN, TYPED = 30, 1000
AGREE = 0.95
SPARK_TYPES = {"INTEGER": "bigint", "REAL": "double", "DATE": "date", "TEXT": "string"}


class SheetError(ValueError):
    """The file can't be read as a spreadsheet; the message says why."""


@dataclass
class Sheet:
    """rows: typed columns and _rescued, a map of the cells that don't fit their column's type; columns: (name, header, type)."""

    rows: DataFrame
    columns: list[tuple[str, str, str]]
    title: str


def delimiter(head: str) -> str:
    """The mark among , ; tab | that splits the first lines most evenly."""
    lines = [x for x in head.splitlines() if x.strip()][:SCAN]
    counts = {mark: [len(next(csv.reader([x], delimiter=mark))) for x in lines] for mark in ",;\t|"}
    return max(counts, key=lambda m: (sum(n > 1 for n in counts[m]), sum(counts[m]))) if lines else ","


def stays_open(line: str, mark: str, inside: bool) -> bool:
    """Is a quoted cell open at the end of a line, if one was open (inside) or not at its start? A quote opens a cell only as its first character."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside:
            if line[at : at + 1] == '"':
                at += 1
            else:
                at = line.find(mark, at) + 1
                if not at:
                    return False
                continue
        close = line.find('"', at)
        while close >= 0 and line[close + 1 : close + 2] == '"':  # a quote within the cell is written twice
            close = line.find('"', close + 2)
        if close < 0:
            return True
        inside, at = False, line.find(mark, close + 1) + 1
        if not at:
            return False


#: Bytes that Windows' Latin code page leaves undefined: a file with one of them is read as Latin-1.
UNDEFINED = frozenset(b"\x81\x8d\x8f\x90\x9d")


def raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """(position, cells array<string>) of a CSV or TSV file, blank cells null; position is the record's place in the file, from 0.

    The file is read in splits. A first pass tells for each split how many records start in it, and whether a quoted cell is open at its end,
    both if one was open at its start and if not; and which encoding fits all of it. These few figures (one row for a split) give each split
    where it starts. A record that goes over the end of a split is put together from its pieces. The head of 64 KB tells the delimiter.
    """
    fs, place = stores.opened(spark, path)
    with_head = fs.open(place)
    try:
        head = bytes(with_head.readNBytes(65536))
    finally:
        with_head.close()
    mark, end = delimiter(head.decode("utf-8-sig", "replace")), "\n" if b"\n" in head or b"\r" not in head else "\r"
    lines = spark.read.option("lineSep", end).text(path).select(F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("line"))

    def figures(batches):
        now = None
        for batch in batches:
            for split, line in zip(batch["split"], batch["line"], strict=True):
                if now is None or now[0] != split:
                    if now:
                        yield pd.DataFrame([now], columns=_FIGURES)
                    now = [split, 0, 0, False, True, True, True]
                text = line.decode("latin-1")
                now[1] += not now[3]
                now[2] += not now[4]
                now[3], now[4] = stays_open(text, mark, now[3]), stays_open(text, mark, now[4])
                now[5] = now[5] and (line.isascii() or _decoded(line, "utf-8") is not None)
                now[6] = now[6] and (line.isascii() or UNDEFINED.isdisjoint(line))
        if now:
            yield pd.DataFrame([now], columns=_FIGURES)

    found = sorted(lines.mapInPandas(figures, "split long, closed long, open long, from_closed boolean, from_open boolean, utf8 boolean, windows boolean").collect())
    starts, before, inside = {}, 0, False
    for f in found:
        starts[f.split] = (before, inside)
        before, inside = before + (f.open if inside else f.closed), f.from_open if inside else f.from_closed
    encoding = "utf-8" if all(f.utf8 for f in found) else "cp1252" if all(f.windows for f in found) else "latin-1"
    last = max(starts, default=0)

    def records(batches):
        """(position, split, is it whole, text): a record that began before its split, or isn't over at its end, is a piece."""
        split, held, number, inside, whole = None, [], 0, False, True

        def row(done):
            return (number - 1, split, whole and done, end.join(held))

        for batch in batches:
            out = []
            for at, line in zip(batch["split"], batch["line"], strict=True):
                if at != split:
                    if held:
                        out.append(row(not inside or split == last))
                    split, held = at, []
                    number, inside = starts[at]
                    whole = not inside
                text = line.decode(encoding).removeprefix("\ufeff" if at == 0 and number == 0 else "")
                if not inside:
                    if held:
                        out.append(row(True))
                        whole = True
                    held, number = [], number + 1
                held.append(text)
                inside = stays_open(text, mark, inside)
            yield pd.DataFrame(out, columns=["position", "split", "whole", "text"])
        if held:
            yield pd.DataFrame([row(not inside or split == last)], columns=["position", "split", "whole", "text"])

    def cells(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [c.strip() or None for r in csv.reader(io.StringIO(t, newline=""), delimiter=mark) for c in r])

    rows = lines.mapInPandas(records, "position long, split long, whole boolean, text string")
    done = rows.where("whole").select("position", "text")
    if any(inside for _, inside in starts.values()):
        pieces = F.array_sort(F.collect_list(F.struct("split", "text")))
        done = done.unionByName(rows.where("NOT whole").groupBy("position").agg(F.array_join(F.transform(pieces, lambda x: x["text"]), end).alias("text")))
    return done.select("position", F.pandas_udf(cells, "array<string>")("text").alias("cells"))


_FIGURES = ["split", "closed", "open", "from_closed", "from_open", "utf8", "windows"]


def _decoded(content: bytes, encoding: str) -> str | None:
    try:
        return content.decode(encoding)
    except UnicodeDecodeError:
        return None


def raw_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(sheet, position, cells array<string>) of the stored values of each worksheet, by the zip's XML alone."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

    def column(ref: str) -> int:
        n = 0
        for ch in ref:
            if ch.isalpha():
                n = n * 26 + ord(ch.upper()) - 64
        return n - 1

    def rows(batches):
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    shared = []
                    if "xl/sharedStrings.xml" in z.namelist():
                        shared = ["".join(t.text or "" for t in si.iter(f"{space}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{space}si")]
                    names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{space}sheet")]
                    parts = sorted((n for n in z.namelist() if n.startswith("xl/worksheets/sheet")), key=lambda n: int("".join(filter(str.isdigit, n)) or 0))
                    for name, part in zip(names, parts, strict=False):
                        out = []
                        for k, row in enumerate(ElementTree.fromstring(z.read(part)).iter(f"{space}row")):
                            cells: list = []
                            for c in row.iter(f"{space}c"):
                                at, v = column(c.get("r")) if c.get("r") else len(cells), c.find(f"{space}v")
                                value = v.text if v is not None else "".join(t.text or "" for t in c.iter(f"{space}t"))
                                value = shared[int(value)] if c.get("t") == "s" else value
                                cells += [None] * (at + 1 - len(cells))
                                cells[at] = (value or "").strip() or None
                            out.append((name, k, cells))
                        yield pd.DataFrame(out, columns=["sheet", "position", "cells"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "sheet string, position long, cells array<string>")


def header_at(rows: list[list[str | None]], is_word: list[list[bool]]) -> int | None:
    """the first row that is wide enough decides: it is the header if it is mostly words, else there is none."""
    widest = max((sum(c is not None for c in r) for r in rows), default=0)
    for i, row in enumerate(rows):
        filled = [w for c, w in zip(row, is_word[i], strict=True) if c is not None]
        if len(filled) >= max(2, 0.6 * widest) or (widest == 1 and filled):
            return i if sum(filled) >= 0.6 * len(filled) else None
    return None


def column_type(values: Column) -> Column:
    """of an array of texts: codes with leading zeros stay TEXT; 95 % of a kind make INTEGER, REAL or DATE."""
    seen = F.filter(values, lambda v: v.isNotNull())
    numbers = F.filter(F.transform(seen, sheet_number), lambda n: n.isNotNull())
    days = F.filter(F.transform(seen, sheet_date), lambda n: n.isNotNull())
    whole = F.forall(numbers, lambda n: n == F.floor(n))
    enough = lambda a: (F.size(a) > 0) & (F.size(a) >= AGREE * F.size(seen))
    return F.when(F.exists(seen, lambda v: v.rlike(r"^0\d")), "TEXT").when(enough(numbers), F.when(whole, "INTEGER").otherwise("REAL")).when(enough(days), "DATE").otherwise("TEXT")


def load(raw: DataFrame) -> Sheet:
    """Typed rows of one sheet (position, cells). Only the first SCAN rows and one row of figures per column reach the driver."""
    filled = raw.where(F.exists("cells", lambda c: c.isNotNull()))
    head = filled.orderBy("position").limit(SCAN).select("position", "cells", F.transform("cells", lambda c: c.isNotNull() & sheet_number(c).isNull() & sheet_date(c).isNull()).alias("words")).collect()
    if not head:
        raise SheetError("the sheet is empty")
    at = header_at([r.cells for r in head], [r.words for r in head])
    start = head[at].position if at is not None else head[0].position - 1
    width = filled.agg(F.max(F.size("cells"))).first()[0]
    headers = [(head[at].cells[i] if at is not None and i < len(head[at].cells) else None) or "" for i in range(width)]
    data = filled.where(F.col("position") > start)
    cell = lambda i: F.get("cells", F.lit(i))
    sample = data.orderBy("position").limit(TYPED)
    figures = sample.agg(*[column_type(F.collect_list(cell(i))).alias(f"t{i}") for i in range(width)], *[column_name(F.lit(h), F.lit(f"column_{i + 1}")).alias(f"n{i}") for i, h in enumerate(headers)]).first()
    names: list[str] = []
    for i in range(width):
        base, name, n = figures[f"n{i}"], figures[f"n{i}"], 2
        while name in names:  # x, x_2, x_3: a made name may meet a given one
            name, n = f"{base}_{n}", n + 1
        names.append(name)
    kinds = [figures[f"t{i}"] for i in range(width)]
    typed, rescued = [], []
    for i, (name, kind) in enumerate(zip(names, kinds, strict=True)):
        text = sheet_cell(cell(i))
        value = {"TEXT": text, "DATE": sheet_date(text), "REAL": sheet_number(text), "INTEGER": sheet_number(text).cast("long")}[kind]
        typed.append(value.alias(name))
        rescued.append(F.when(text.isNotNull() & value.isNull(), F.struct(F.lit(name).alias("k"), text.alias("v"))))
    kept = F.map_from_entries(F.filter(F.array(*rescued), lambda x: x.isNotNull()))
    title = " / ".join(c for r in head[: at or 0] for c in r.cells if c)[:200]
    return Sheet(data.select("position", *typed, kept.alias("_rescued")), list(zip(names, headers, kinds, strict=True)), title)


def described(sheet: Sheet, table: str, name: str, file: str, samples: int = 5) -> str:
    """A loaded sheet as text: its table, title, columns with their headers, and the first rows. A few rows reach the driver."""
    columns = ", ".join(f"{n} {kind}" + (f' ("{header}")' if header not in ("", n) else "") for n, header, kind in sheet.columns)
    names = [n for n, _, _ in sheet.columns]
    first = sheet.rows.orderBy("position").limit(samples).select(names).collect()
    rows = ["| " + " | ".join("" if v is None else str(v)[:40] for v in row) + " |" for row in first]
    title = [f"Title above the table: {sheet.title}"] if sheet.title else []
    shown = ["First rows:", f"| {' | '.join(names)} |", *rows] if rows else []
    return "\n".join([f'Table "{table}" (sheet "{name}" of {file}, {sheet.rows.count():,} rows)', *title, f"Columns: {columns}", *shown])


def sheet_texts(rows: DataFrame, most: int = 2000) -> DataFrame:
    """Sheets (sheet, position, cells) as Markdown tables: (sheet, text). Blank rows and cells at the end of rows go; others are padded.

    At most so many rows of a sheet are given, and then a last line says so: a top-k by place, which is cut in each task first.
    """
    cell = lambda c: F.trim(F.translate(F.coalesce(c, F.lit("")), "|\n", "/ "))
    last = F.array_max(F.transform("cells", lambda c, i: F.when(c != "", i + 1).otherwise(0)))
    tidy = rows.withColumn("cells", F.transform("cells", cell)).withColumn("cells", F.slice("cells", F.lit(1), F.coalesce(last, F.lit(0)))).where(F.size("cells") > 0)
    first = tidy.withColumn("n", F.row_number().over(Window.partitionBy("sheet").orderBy("position"))).where(F.col("n") <= most + 1)
    found = first.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("n", "cells"))).alias("rows"), F.max(F.size("cells")).alias("width"))
    line = lambda x: F.concat(F.lit("| "), F.array_join(F.concat(x["cells"], F.array_repeat(F.lit(""), F.col("width") - F.size(x["cells"]))), " | "), F.lit(" |"))
    lines = F.transform(F.slice("rows", 1, most), line)
    more = F.when(F.size("rows") > most, F.array(F.lit(f"(only the first {most} rows of this sheet were read)"))).otherwise(F.array().cast("array<string>"))
    rule = F.array(F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("width"))))
    return found.select("sheet", F.array_join(F.concat(F.slice(lines, 1, 1), rule, F.slice(lines, 2, most), more), "\n").alias("text"))
