"""Writers of one file by many tasks: a CSV sheet (K04) and a workbook (K05), as data sources with commit and abort.

Each task writes the rows of its partition beside the file that is to come. The commit puts them in the order of the partitions, as a
stream of bounded memory, into a draft, and renames that: a reader sees the whole file or none. Whatever fails leaves what was there.
Rows must come sorted by ranges (orderBy); the folder must be one that the driver and all executors share. Only parts that a commit names
are read, so that attempts of lost executors don't matter.
"""

from __future__ import annotations

import csv
import io
import json
import posixpath
import uuid
import zipfile
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

AT_ONCE = 1 << 20
#: Fixed value: rows a worksheet can have.
MOST_ROWS = 1048576
#: The kinds of cells, in the order of the styles below; each is there plain and shaded.
STYLES = ("text", "bold", "date", "number", "percent", "wrapped")


@dataclass
class Written(WriterCommitMessage):
    partition: int
    parts: list  # (sheet, is it a foot, file, rows)


class _OneFile(DataSourceWriter):
    """path: where the file will be; its parts lie in a folder beside it until the commit."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        self.options = options
        fs, place = files.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (files.LocalFileSystem(), self.path)
        if not overwrite and fs.get_file_info(place).type != files.FileType.NotFound:
            raise FileExistsError(f"{self.path} is there already")
        self.place, folder = place, posixpath.dirname(place)
        self.staging = f"{folder}/.{posixpath.basename(place)}-{uuid.uuid4().hex}"
        fs.create_dir(self.staging, recursive=True)

    def fs(self):
        return files.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else files.LocalFileSystem()

    def line(self, row) -> tuple[str, bool, str]:
        """(sheet, is it a foot, text) of a row."""
        raise NotImplementedError

    def assemble(self, fs, out, parts: list) -> None:
        raise NotImplementedError

    def write(self, iterator):
        fs, partition = self.fs(), TaskContext.get().partitionId()
        open_parts: dict = {}
        try:
            for row in iterator:
                sheet, foot, text = self.line(row)
                if (sheet, foot) not in open_parts:
                    name = f"{self.staging}/part-{partition:05d}-{uuid.uuid4().hex}"
                    open_parts[sheet, foot] = [name, io.BufferedWriter(fs.open_output_stream(name), AT_ONCE), 0]
                part = open_parts[sheet, foot]
                part[1].write(text.encode("utf-8"))
                part[2] += 1
        finally:
            for part in open_parts.values():
                part[1].close()
        return Written(partition, [(sheet, foot, name, n) for (sheet, foot), (name, _, n) in open_parts.items()])

    def commit(self, messages):
        fs = self.fs()
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        draft = f"{self.staging}/draft"
        with fs.open_output_stream(draft) as out:
            self.assemble(fs, out, [part for m in done for part in m.parts])
        try:
            fs.move(draft, self.place)
        except OSError:  # file systems that don't rename over a file
            fs.delete_file(self.place)
            fs.move(draft, self.place)
        fs.delete_dir(self.staging)

    def abort(self, messages):
        self.fs().delete_dir(self.staging)

    @staticmethod
    def lines(fs, parts: list):
        for *_, name, _ in parts:
            with io.BufferedReader(fs.open_input_file(name), AT_ONCE) as part:
                yield from part


class CsvSheet(DataSource):
    """Columns of strings as one CSV file that starts with a byte order mark and has one header."""

    @classmethod
    def name(cls):
        return "csv_sheet"

    def writer(self, schema, overwrite):
        return _CsvWriter(dict(self.options), overwrite, schema.names)


class _CsvWriter(_OneFile):
    def __init__(self, options, overwrite, names):
        super().__init__(options, overwrite)
        self.names = names

    def line(self, row):
        return "", False, self.text(row)

    @staticmethod
    def text(cells) -> str:
        out = io.StringIO(newline="")
        csv.writer(out).writerow(["" if c is None else c for c in cells])
        return out.getvalue()

    def assemble(self, fs, out, parts):
        out.write(b"\xef\xbb\xbf" + self.text(self.names).encode("utf-8"))
        for *_, name, _ in parts:
            with fs.open_input_stream(name) as part:
                while piece := part.read(AT_ONCE):
                    out.write(piece)


class Workbook(DataSource):
    """Rows (sheet, foot, cells array<struct<value, style>>) as one XLSX file.

    Option `sheets`, JSON: for each sheet in order its name, header, widths, freeze (the first cell that moves) and filter (true or
    false). A foot stands under the rows after a gap. What is more than a worksheet can have goes on in another one.
    """

    @classmethod
    def name(cls):
        return "workbook"

    def writer(self, schema, overwrite):
        return _WorkbookWriter(dict(self.options), overwrite)


def _column(n: int) -> str:
    letters = ""
    while n:
        n, rest = divmod(n - 1, 26)
        letters = chr(65 + rest) + letters
    return letters


def _xml_text(text: str) -> str:
    """What XML can't hold becomes a blank; line ends are written as references, so that a row stays one line of its part."""
    kept = "".join(c if c >= " " or c in "\t\n\r" else " " for c in text)
    kept = "".join(" " if "\ud800" <= c <= "\udfff" or c in "￾￿" else c for c in kept)
    return escape(kept, {"\n": "&#10;", "\r": "&#13;"})


def _row(cells) -> str:
    out = []
    for value, style in cells:
        shaded = style.endswith("!")
        kind = style.rstrip("!")
        s = STYLES.index(kind) + len(STYLES) * shaded
        if value is None or value == "":
            out.append(f'<c s="{s}"/>')
        elif kind in ("date", "number", "percent"):
            out.append(f'<c s="{s}"><v>{value}</v></c>')
        else:
            out.append(f'<c s="{s}" t="inlineStr"><is><t xml:space="preserve">{_xml_text(value)}</t></is></c>')
    return f"<row>{''.join(out)}</row>\n"


#: The parts of a workbook that don't depend on what is in it.
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def _styles() -> str:
    formats = {"date": 164, "number": 4, "percent": 9}
    fills = '<fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFFFF2CC"/></patternFill></fill>'
    one = lambda kind, fill: f'<xf numFmtId="{formats.get(kind, 0)}" fontId="{int(kind == "bold")}" fillId="{fill}" borderId="0" xfId="0" applyNumberFormat="1" applyFont="1" applyFill="1" applyAlignment="1"><alignment vertical="top" wrapText="{int(kind == "wrapped")}"/></xf>'
    xfs = "".join(one(kind, fill) for fill in (0, 2) for kind in STYLES)
    return (
        f'{_HEAD}<styleSheet xmlns="{_MAIN}"><numFmts count="1"><numFmt numFmtId="164" formatCode="DD\\-MMM\\-YYYY"/></numFmts>'
        '<fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><name val="Calibri"/></font></fonts>'
        f'<fills count="3">{fills}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        f'<cellXfs count="{2 * len(STYLES)}">{xfs}</cellXfs></styleSheet>'
    )


class _WorkbookWriter(_OneFile):
    def __init__(self, options, overwrite):
        super().__init__(options, overwrite)
        self.sheets = json.loads(options["sheets"])
        self.most = int(options.get("most_rows", MOST_ROWS))

    def line(self, row):
        return row[0], bool(row[1]), _row(row[2])

    def assemble(self, fs, out, parts):
        names = []
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for sheet in self.sheets:
                body = [p for p in parts if p[0] == sheet["name"] and not p[1]]
                foot = [p for p in parts if p[0] == sheet["name"] and p[1]]
                left, rows, a_sheet = sum(p[3] for p in body), self.lines(fs, body), self.most - 1 - (1 + sum(p[3] for p in foot)) * bool(foot)
                number = 1
                while number == 1 or left > 0:
                    names.append(sheet["name"] if number == 1 else f"{sheet['name']} {number}")
                    here = min(left, a_sheet)
                    left, number = left - here, number + 1
                    with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as x:
                        x.write(self.opening(sheet).encode("utf-8"))
                        for _ in range(here):
                            x.write(next(rows))
                        if foot and left == 0:
                            x.write(b"<row/>\n")
                            for line in self.lines(fs, foot):
                                x.write(line)
                        x.write(b"</sheetData>")
                        if sheet.get("filter"):
                            x.write(f'<autoFilter ref="A1:{_column(len(sheet["header"]))}{here + 1}"/>'.encode())
                        x.write(b"</worksheet>")
            listed = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
            z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')
            related = "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
            related += f'<Relationship Id="rId{len(names) + 1}" Type="{_REL}/styles" Target="styles.xml"/>'
            z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACK}/relationships">{related}</Relationships>')
            z.writestr("xl/styles.xml", _styles())
            z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_TYPE}.worksheet+xml"/>' for i in range(1, len(names) + 1))
            kinds += f'<Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{_TYPE}.styles+xml"/>'
            z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{kinds}</Types>')

    @staticmethod
    def opening(sheet: dict) -> str:
        at = sheet.get("freeze", "A2")
        left, top = ord(at[0]) - 65, int(at[1:]) - 1
        pane = "bottomRight" if left else "bottomLeft"
        view = f'<sheetViews><sheetView workbookViewId="0"><pane xSplit="{left}" ySplit="{top}" topLeftCell="{at}" activePane="{pane}" state="frozen"/></sheetView></sheetViews>'
        cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(sheet["widths"], 1))
        return f'{_HEAD}<worksheet xmlns="{_MAIN}">{view}<cols>{cols}</cols><sheetData>{_row([(h, "bold") for h in sheet["header"]])}'


def _register(spark: SparkSession) -> None:
    for source in (CsvSheet, Workbook):
        spark.dataSource.register(source)


def write_csv(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Columns of strings, sorted (orderBy), as one CSV file."""
    _register(rows.sparkSession)
    rows.write.format("csv_sheet").mode("overwrite" if overwrite else "append").save(path)


def write_workbook(rows: DataFrame, path: str, sheets: list[dict], overwrite: bool = False, most_rows: int = MOST_ROWS) -> None:
    """Rows (sheet, foot, cells), sorted (orderBy), as one workbook."""
    _register(rows.sparkSession)
    rows.write.format("workbook").option("sheets", json.dumps(sheets)).option("most_rows", most_rows).mode("overwrite" if overwrite else "append").save(path)
