"""Word documents as tables of blocks (S19): one row for each paragraph, by a table function that reads the file's XML."""

from __future__ import annotations

import io
import posixpath
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: What a run may hold to count as text, and what stands for a character in it.
PLAIN = {W + x for x in ("rPr", "t", "tab", "br", "cr", "noBreakHyphen", "softHyphen", "lastRenderedPageBreak")}
SIGNS = {W + "tab": "\t", W + "br": "\n", W + "cr": "\n", W + "noBreakHyphen": "-"}
ORDER = ("default", "first", "even")
SCHEMA = (
    "position int, block string, place string, table int, row int, col int, last_in_row boolean, merged boolean, anchor string, style string, level int, "
    "text string, picture boolean, stretch int, table_after boolean, runs array<struct<start:int,end:int,highlight:boolean>>, "
    "controls array<struct<start:int,end:int,label:string,options:array<string>>>, problem string"
)


def _val(node, path: str) -> str | None:
    found = node.find(path) if node is not None else None
    return None if found is None else found.get(W + "val")


class _Paragraph:
    """The text of a paragraph with the runs and prompts in it, and the text boxes that hang on it."""

    def __init__(self, node):
        self.text, self.runs, self.prompts, self.boxes = "", [], [], []
        self._read(node, True)
        self.picture = any(node.find(f".//{W}{x}") is not None for x in ("drawing", "pict"))

    def _read(self, node, counts: bool) -> None:
        """counts: is this part of the text, rather than deleted or moved away?"""
        for child in node:
            if child.tag == W + "txbxContent":
                self.boxes.append(child)
            elif child.tag == MC + "Fallback":  # the copy of a text box for old versions
                self._without_boxes(child, counts)
            elif child.tag == W + "r":
                self._run(child, counts)
                self._read(child, counts)
            elif child.tag == W + "sdt":
                start = len(self.text)
                self._read(child, counts)
                if prompt := prompt_of(child):
                    self.prompts.append((start, len(self.text), *prompt))
            else:
                self._read(child, counts and child.tag not in (W + "del", W + "moveFrom"))

    def _without_boxes(self, node, counts: bool) -> None:
        kept = self.boxes
        self.boxes = []
        self._read(node, counts)
        self.boxes = kept

    def _run(self, run, counts: bool) -> None:
        if not counts or any(c.tag not in PLAIN or (c.tag == W + "br" and c.get(W + "type") in ("page", "column")) for c in run):
            return
        text = "".join((c.text or "") if c.tag == W + "t" else SIGNS.get(c.tag, "") for c in run)
        light = run.find(f"{W}rPr/{W}highlight")
        lit = light is not None and light.get(W + "val") not in ("0", "false", "none")
        self.runs.append((len(self.text), len(self.text) + len(text), lit))
        self.text += text


def prompt_of(control) -> tuple[str, list[str]] | None:
    """Label and options of a content control that still shows its prompt."""
    settings = control.find(W + "sdtPr")
    if settings is None or settings.find(W + "showingPlcHdr") is None:
        return None
    label = _val(settings, W + "alias") if settings.find(W + "alias") is not None else _val(settings, W + "tag")
    options = [i.get(W + "displayText") or i.get(W + "value") or "" for i in settings.iter(W + "listItem")]
    return label or "", [o for o in options if o]


class _Document:
    def __init__(self, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            self.body = ElementTree.fromstring(z.read("word/document.xml")).find(W + "body")
            names = set(z.namelist())
            styles = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in names else []
            self.parts = self._parts(z, names)
        self.names, self.levels = {}, {}
        for style in styles:
            if style.tag == W + "style" and style.get(W + "styleId"):
                self.names[style.get(W + "styleId")] = _val(style, W + "name") or style.get(W + "styleId")
                self.levels[style.get(W + "styleId")] = self._outline(style.find(W + "pPr"))
        self.tables = self.stretches = self.position = 0
        self.counts = dict.fromkeys("phft", 0)

    def _parts(self, z, names) -> list:
        """(place, root) of headers and footers in the order of the sections; one that several sections share is read once."""
        targets = {}
        if "word/_rels/document.xml.rels" in names:
            targets = {r.get("Id"): posixpath.normpath(posixpath.join("word", r.get("Target", ""))).lstrip("/") for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))}
        found: dict = {}
        for section in self.body.iter(W + "sectPr"):
            for place in ("header", "footer"):
                of_kind = {r.get(W + "type", "default"): targets.get(r.get(R + "id")) for r in section.findall(f"{W}{place}Reference")}
                for name in (of_kind.get(kind) for kind in ORDER):
                    if name in names and name not in found:
                        found[name] = (place, ElementTree.fromstring(z.read(name)))
        return list(found.values())

    @staticmethod
    def _outline(properties) -> int | None:
        level = _val(properties, W + "outlineLvl") or ""
        return int(level) + 1 if level.isdigit() and int(level) < 9 else None

    def _level(self, node, style: str | None, name: str) -> int | None:
        words = name.lower().split(" ")
        if len(words) == 2 and words[0] == "heading" and len(words[1]) == 1 and words[1].isdigit():
            return int(words[1])
        return self._outline(node.find(W + "pPr")) or self.levels.get(style)

    def rows(self):
        for place, root in [("body", self.body), *self.parts]:
            yield from self._walk(root, place, None, None)

    def _walk(self, node, place: str, cell, whole):
        """Rows of what lies in a node. cell: (table, row, col, is it the last, does it go on from above); whole: a prompt around paragraphs."""
        self.stretches += 1
        stretch, children = self.stretches, list(node)
        for i, child in enumerate(children):
            if child.tag == W + "p":
                after = i + 1 < len(children) and children[i + 1].tag == W + "tbl"
                yield from self._paragraph(child, place, cell, whole, stretch, after)
            elif child.tag == W + "tbl":
                if place != "body":  # only tables of the body are numbered
                    yield from self._walk(child, place, cell, whole)
                else:
                    yield from self._table(child, place, whole)
                self.stretches += 1
                stretch = self.stretches
            elif child.tag == W + "sdt":
                yield from self._walk(child, place, cell, prompt_of(child) or whole)
            elif len(child):
                yield from self._walk(child, place, cell, whole)

    def _table(self, node, place, whole):
        self.tables += 1
        number, row = self.tables, 0
        for child in node:
            if child.tag != W + "tr":
                yield from self._walk(child, place, None, whole)
                continue
            row += 1
            cells = [c for c in child if c.tag == W + "tc"]
            for col, cell in enumerate(cells, 1):
                goes_on = cell.find(f"{W}tcPr/{W}vMerge")
                merged = goes_on is not None and goes_on.get(W + "val") != "restart"
                yield from self._walk(cell, place, (number, row, col, col == len(cells), merged), whole)

    def _paragraph(self, node, place, cell, whole, stretch, after):
        letter = {"textbox": "t"}.get(place, "p" if place == "body" else place[0])
        self.counts[letter] += 1
        block, read = f"{letter}{self.counts[letter]}", _Paragraph(node)
        yield self._row(node, read, block, place, cell, whole, stretch, after, None)
        for box in read.boxes:
            for inner in box.iter(W + "p"):
                held = _Paragraph(inner)
                self.counts["t"] += 1
                yield self._row(inner, held, f"t{self.counts['t']}", "textbox", None, None, None, False, block)

    def _row(self, node, read, block, place, cell, whole, stretch, after, anchor):
        style = _val(node, f"{W}pPr/{W}pStyle")
        name = self.names.get(style, style) if style else "Normal"
        prompts = read.prompts + ([(0, len(read.text), *whole)] if whole else [])
        self.position += 1
        return (self.position, block, place, *(cell or (None,) * 5), anchor, name, self._level(node, style, name), read.text, read.picture, stretch, after, read.runs, prompts, None)


class WordBlocks:
    """The rows of one file. What isn't a Word document is one row with a problem, and nothing fails."""

    def eval(self, content: bytes):
        try:
            yield from _Document(content).rows()
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError, TypeError):
            yield (None,) * 17 + ("it is not a Word document",)


def blocks(files: DataFrame, content: str = "content") -> DataFrame:
    """The columns of files but for the content, and for each paragraph a row: position in the file (from 1), its block's name (p, h, f or t with
    a number: body, header, footer, text box), its table's number with row and column, its style and heading level, its text with runs.

    Text boxes follow the paragraph they hang on (anchor), in their new copy only. Deleted text and runs that hold pictures or fields aren't
    text. stretch tells the paragraphs apart that have a table or another container between them. A paragraph of a table within a cell
    belongs to the inner table.
    """
    spark: SparkSession = files.sparkSession
    reader = F.udtf(WordBlocks, returnType=SCHEMA)
    spark.udtf.register("word_blocks", reader)
    others = [c for c in files.columns if c != content]
    return files.lateralJoin(reader(F.col(content).outer())).select(*others, *[x.split(" ")[0] for x in SCHEMA.replace("array<struct<start:int,end:int,highlight:boolean>>", "a").replace("array<struct<start:int,end:int,label:string,options:array<string>>>", "a").split(", ")])


def read_blocks(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    """(path, ...) of the blocks of a folder's Word documents."""
    return blocks(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content"))
