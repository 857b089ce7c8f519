"""Edits of documents in their order (D05 to D08): each edit sees what the ones before it left, and one that can't be done is refused with a reason.

A document's blocks and edits meet in one row, so a join by document is all that is shuffled; the fold over a document's edits runs in
Arrow batches where the row lies. Blocks are addressed by their position at the start, however much moves meanwhile, and are numbered
anew at the end.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits of one document that are looked at; the rest is refused.
MOST_EDITS = 60
BLOCK = "struct<position:int,was:int,type:string,level:int,text:string,table:int,row:int,col:int,looks:map<string,string>>"
LOG = "array<struct<seq:int,op:string,applied:boolean,said:string>>"
#: Parameters of edits and their types; columns that a table of edits doesn't have are null.
PARAMETERS = {
    "blocks": "array<int>", "target": "string", "text": "string", "place": "string", "style": "string", "find": "string", "put": "string", "match_case": "boolean", "align": "string", "spacing": "double",
    "bold": "boolean", "italic": "boolean", "underline": "boolean", "size": "double", "color": "string", "font": "string", "table": "int", "row": "int", "col": "int", "cells": "array<string>",
}

#: Other names of styles, of alignments, and of colours.
STYLE_NAMES = {"h1": "heading 1", "h2": "heading 2", "h3": "heading 3", "heading1": "heading 1", "heading2": "heading 2", "heading3": "heading 3", "body": "normal", "paragraph": "normal", "bullet": "list bullet", "bullets": "list bullet", "list": "list bullet", "number": "list number", "numbered": "list number"}
ALIGNMENTS = {"left": "left", "start": "left", "center": "center", "centre": "center", "centered": "center", "centred": "center", "middle": "center", "right": "right", "end": "right", "justify": "justify", "justified": "justify", "both": "justify"}
COLORS = {"black": "000000", "white": "FFFFFF", "red": "C00000", "blue": "1F4E79", "green": "2E7D32", "grey": "595959", "gray": "595959", "orange": "D9730D", "purple": "5B3A8C"}
#: What a style makes of a block.
STYLES = {f"heading {n}": ("heading", n) for n in range(1, 10)} | {"title": ("heading", 1), "normal": ("text", 0), "list bullet": ("list", 0), "list number": ("list", 0), "quote": ("quote", 0)}


class Refused(Exception):
    """Why an edit is not done."""


class Document:
    """Blocks in order, as dicts; those that are removed leave the order but keep their address."""

    def __init__(self, blocks: list[dict]):
        self.blocks = [b | {"was": b["position"], "looks": dict(b["looks"] or [])} for b in blocks]
        self.by_address = {b["was"]: b for b in self.blocks}
        self.order = list(self.blocks)
        self.tables: dict[int, list[list[list[dict]]]] = {}  # table -> rows -> cells -> blocks; removed rows keep their number
        for b in self.blocks:
            if b["table"] is not None:
                rows = self.tables.setdefault(b["table"], [])
                rows.extend([] for _ in range(b["row"] - len(rows)))
                cells = rows[b["row"] - 1]
                cells.extend([] for _ in range(b["col"] - len(cells)))
                cells[b["col"] - 1].append(b)

    # Blocks are told apart by identity: two of them may have equal values.
    def there(self, block: dict) -> bool:
        return any(b is block for b in self.order)

    def place(self, block: dict) -> int:
        return next(i for i, b in enumerate(self.order) if b is block)

    def remove(self, some: list[dict]) -> None:
        gone = set(map(id, some))
        self.order = [b for b in self.order if id(b) not in gone]

    def chosen(self, edit: dict, one: bool = False) -> list[dict]:
        """The blocks that an edit names, or its target stands for."""
        ids, target = edit["blocks"] or [], (edit["target"] or "").lower()
        if ids and target in ("", "ids"):
            found = [self.by_address.get(i) for i in ids]
            if None in found:
                raise Refused("no such block")
            if not all(map(self.there, found)):
                raise Refused("removed before")
        else:
            tests = {"all": lambda b: True, "headings": lambda b: b["type"] == "heading", "body": lambda b: b["table"] is None and b["type"] != "heading", "tables": lambda b: b["table"] is not None}
            if target not in tests:
                raise Refused("names neither blocks nor a target")
            found = [b for b in self.blocks if tests[target](b) and self.there(b)]
        if not found:
            raise Refused("nothing matches")
        if one and len(found) != 1:
            raise Refused("needs one block")
        return found

    def written(self, at: int, like: dict, text: str) -> int:
        """Put a block per line of text before place `at` of the order; a line with a bullet is a list item."""
        new = []
        for line in filter(None, map(str.strip, text.splitlines())):
            bare = re.sub(r"^[-*•]\s+", "", line)
            new.append(like | {"was": None, "text": bare, "looks": dict(like["looks"])} | ({"type": "list", "level": 0} if bare != line else {}))
        self.order[at:at] = new
        return len(new)

    def row(self, edit: dict) -> tuple[list, int]:
        rows = self.tables.get(1 if edit["table"] is None else edit["table"])
        if rows is None:
            raise Refused("no such table")
        if edit["row"] is None or not 1 <= edit["row"] <= len(rows):
            raise Refused("no such row")
        return rows, edit["row"] - 1

    def live(self, row: list[list[dict]]) -> bool:
        return any(self.there(b) for cell in row for b in cell)

    def result(self) -> list[dict]:
        numbers = {}
        for table, rows in self.tables.items():
            for number, row in enumerate(filter(self.live, rows), 1):
                numbers |= {id(b): number for cell in row for b in cell}
        return [b | {"position": i, "row": numbers.get(id(b), b["row"]), "looks": list(b["looks"].items())} for i, b in enumerate(self.order)]


def _text(edit: dict) -> str:
    if not (edit["text"] or "").strip():
        raise Refused("no text")
    return edit["text"].strip()


def _plain_look(block: dict) -> dict:
    """A look for new text beside a block: its own, without emphasis."""
    return block | {"looks": {k: v for k, v in block["looks"].items() if k not in ("bold", "italic", "underline")}}


def _styled(name: str | None) -> tuple[str, tuple[str, int]]:
    low = " ".join((name or "").lower().split())
    low = STYLE_NAMES.get(low.replace(" ", ""), low)
    if low not in STYLES:
        raise Refused("no such style")
    return low, STYLES[low]


def replace_text(doc: Document, edit: dict) -> int:
    block = doc.chosen(edit, one=True)[0]
    block["text"] = _text(edit)
    return 1


def insert(doc: Document, edit: dict) -> int:
    block, text = doc.chosen(edit, one=True)[0], _text(edit)
    at = doc.place(block)
    plain = {"type": "text", "level": 0, "table": None, "row": None, "col": None, "looks": {}}
    if edit["style"]:
        style, (kind, level) = _styled(edit["style"])
        like = block | plain | {"type": kind, "level": level, "looks": {"style": style}} | {k: block[k] for k in ("table", "row", "col")}
    elif block["type"] != "heading":
        like = _plain_look(block)
    else:  # next to a heading: as the first text that follows
        body = next((b for b in doc.order[at + 1 :] if b["type"] != "heading" and b["table"] is None and b["text"].strip()), None)
        like = _plain_look(body) if body else block | plain
    before = len(doc.order)
    where = at + ((edit["place"] or "after").lower() != "before")
    count = doc.written(where, like, text)
    if like["table"] is not None:  # more paragraphs of the same cell
        cell = next(c for r in doc.tables[like["table"]] for c in r if any(b is block for b in c))
        cell.extend(doc.order[where : where + len(doc.order) - before])
    return count


def delete(doc: Document, edit: dict) -> int:
    if (edit["target"] or "").lower() in ("all", "body", "headings", "tables"):
        raise Refused("deleting needs blocks")
    removed = 0
    for block in doc.chosen(edit):
        if block["type"] == "image" or not doc.there(block):
            continue
        cell = next((c for r in doc.tables.get(block["table"], ()) for c in r if any(b is block for b in c)), [])
        if sum(map(doc.there, cell)) == 1:
            block["text"] = ""  # a cell keeps a block
        else:
            doc.remove([block])
        removed += 1
    if not removed:
        raise Refused("pictures stay")
    return removed


def replace_section(doc: Document, edit: dict) -> int:
    """What stands under a heading, up to the next heading, table or section."""
    head = doc.chosen(edit, one=True)[0]
    if head["type"] != "heading":
        raise Refused("not a heading")
    text, at = _text(edit), doc.place(head) + 1
    under = []
    for b in doc.order[at:]:
        if b["type"] in ("heading", "section_break") or b["table"] is not None:
            break
        under.append(b)
    like = next((b for b in under if b["text"].strip()), under[0] if under else None)
    doc.remove(under)
    plain = {"type": "text", "level": 0, "looks": {}}
    return doc.written(at, _plain_look(like) if like else head | plain, text)


def find_replace(doc: Document, edit: dict) -> int:
    if not (edit["find"] or "").strip() or edit["put"] is None:
        raise Refused("needs what to find and what to put")
    pattern, count = re.compile(re.escape(edit["find"]), 0 if edit["match_case"] else re.IGNORECASE), 0
    for b in doc.order:
        if b["was"] is not None and b["type"] != "contents":
            b["text"], n = pattern.subn(lambda _: edit["put"], b["text"])
            count += n
    if not count:
        raise Refused("not found")
    return count


def set_cell(doc: Document, edit: dict) -> int:
    rows, r = doc.row(edit)
    if edit["col"] is None or not 1 <= edit["col"] <= len(rows[r]):
        raise Refused("no such column")
    cell = [b for b in rows[r][edit["col"] - 1] if doc.there(b)]
    if not cell:
        raise Refused("removed before")
    cell[0]["text"] = (edit["text"] or "").strip()
    doc.remove(cell[1:])
    return 1


def add_row(doc: Document, edit: dict) -> int:
    """A row like the one named, or the last one, after it."""
    rows = doc.tables.get(1 if edit["table"] is None else edit["table"])
    if rows is None:
        raise Refused("no such table")
    alive = [i for i, row in enumerate(rows) if doc.live(row)]
    if not alive:
        raise Refused("no rows left")
    source = alive[-1] if edit["row"] is None else edit["row"] - 1
    if source not in alive:
        raise Refused("no such row")
    given = edit["cells"] or []
    new = [[next(filter(doc.there, cell)) | {"was": None, "text": (given[c] or "").strip() if c < len(given) else ""}] if any(map(doc.there, cell)) else [] for c, cell in enumerate(rows[source])]
    at = max(doc.place(b) for cell in rows[source] for b in cell if doc.there(b)) + 1
    doc.order[at:at] = [b | {"looks": dict(b["looks"])} for cell in new for b in cell]
    made = iter(doc.order[at:])
    rows.insert(source + 1, [[next(made)] if cell else [] for cell in new])
    return 1


def delete_row(doc: Document, edit: dict) -> int:
    rows, r = doc.row(edit)
    if not doc.live(rows[r]):
        raise Refused("removed before")
    if sum(map(doc.live, rows)) == 1:
        raise Refused("a table keeps a row")
    doc.remove([b for cell in rows[r] for b in cell])
    return 1


def style(doc: Document, edit: dict) -> int:
    name, (kind, level) = _styled(edit["style"])
    some = doc.chosen(edit)
    for b in some:
        b |= {"type": kind, "level": level}
        b["looks"]["style"] = name
    return len(some)


def _looks(doc: Document, edit: dict, looks: dict) -> int:
    some = doc.chosen(edit)
    for b in some:
        b["looks"] |= looks
    return len(some)


def align(doc: Document, edit: dict) -> int:
    value = ALIGNMENTS.get((edit["align"] or "").strip().lower())
    if not value:
        raise Refused("no such alignment")
    return _looks(doc, edit, {"align": value})


def spacing(doc: Document, edit: dict) -> int:
    if edit["spacing"] is None or not 0.8 <= edit["spacing"] <= 3:
        raise Refused("spacing is 0.8 to 3")
    return _looks(doc, edit, {"spacing": f"{edit['spacing']:g}"})


def format(doc: Document, edit: dict) -> int:
    color = (edit["color"] or "").strip().lstrip("#")
    color = COLORS.get(color.lower(), color.upper())
    if color and not re.fullmatch("[0-9A-F]{6}", color):
        raise Refused("no such colour")
    if edit["size"] is not None and not 6 <= edit["size"] <= 72:
        raise Refused("size is 6 to 72")
    looks = {k: str(edit[k]).lower() for k in ("bold", "italic", "underline") if edit[k] is not None}
    looks |= {"size": f"{edit['size']:g}"} if edit["size"] is not None else {}
    looks |= {"color": color} if color else {}
    looks |= {"font": edit["font"].strip()} if (edit["font"] or "").strip() else {}
    if not looks:
        raise Refused("no formatting named")
    return _looks(doc, edit, looks)


OPERATIONS = {f.__name__: f for f in (replace_text, insert, delete, replace_section, find_replace, align, format, style, spacing, set_cell, add_row, delete_row)}


#: Documents that are Python objects at once.
TOGETHER = 32


def folded(blocks: list[dict], edits: list[dict]) -> tuple[list[dict], list[dict]]:
    """The blocks after all edits, and a line of the log for each edit."""
    doc, log = Document(blocks), []
    for i, edit in enumerate(edits):
        name = (edit["op"] or "").strip().lower()
        try:
            if i >= MOST_EDITS:
                raise Refused(f"more than {MOST_EDITS} edits")
            if name not in OPERATIONS:
                raise Refused("no such operation")
            said, applied = str(OPERATIONS[name](doc, edit)), True
        except Refused as reason:
            said, applied = str(reason), False
        log.append({"seq": edit["seq"], "op": name, "applied": applied, "said": said})
    return doc.result(), log


def edit_documents(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """(id, blocks, log), a row per document: its blocks after the edits, and what became of each edit (how many blocks or places it changed, or why it was refused).

    blocks: (id, position, type, level, text), and perhaps table, row, col (counted from 1) and looks. edits: (id, seq, op) and columns
    of PARAMETERS. Documents without edits come through as they are; edits of unknown documents go.
    """
    have = {c.lower() for c in blocks.columns}
    kinds = dict(part.split(":", 1) for part in ("table:int", "row:int", "col:int", "looks:map<string,string>"))
    full = blocks.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in have})
    entry = F.struct("position", F.lit(None).cast("int").alias("was"), "type", "level", F.coalesce("text", F.lit("")).alias("text"), "table", "row", "col", "looks").cast(BLOCK)
    given = edits.withColumns({c: F.lit(None).cast(kind) for c, kind in PARAMETERS.items() if c not in edits.columns})
    order = lambda c, by: F.array_sort(c, lambda a, b: F.when(a[by] < b[by], -1).when(a[by] > b[by], 1).otherwise(0))
    docs = full.groupBy("id").agg(order(F.collect_list(entry), "position").alias("blocks"))
    lists = given.groupBy("id").agg(order(F.collect_list(F.struct(F.col("seq").cast("int").alias("seq"), "op", *[F.col(c).cast(k).alias(c) for c, k in PARAMETERS.items()])), "seq").alias("edits"))
    both = docs.join(lists, "id", "left")
    kind = blocks.schema["id"].dataType.simpleString()

    def fold(batches):
        for batch in (whole.slice(at, TOGETHER) for whole in batches for at in range(0, len(whole), TOGETHER)):
            done = [folded(b, e) for b, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = [pa.array([d[i] for d in done], types[i]) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "blocks", "log"])

    field = lambda pairs: pa.list_(pa.struct([pa.field(n, t) for n, t in pairs]))
    whole, text = pa.int32(), pa.string()
    types = (
        field((("position", whole), ("was", whole), ("type", text), ("level", whole), ("text", text), ("table", whole), ("row", whole), ("col", whole), ("looks", pa.map_(text, text)))),
        field((("seq", whole), ("op", text), ("applied", pa.bool_()), ("said", text))),
    )
    changed = both.where("edits is not null").select("id", "blocks", "edits").mapInArrow(fold, f"id {kind}, blocks array<{BLOCK}>, log {LOG}")
    rest = both.where("edits is null").select("id", F.transform("blocks", lambda b: b.withField("was", b["position"])).cast(f"array<{BLOCK}>").alias("blocks"), F.array().cast(LOG).alias("log"))
    return changed.unionByName(rest)


def blocks_of(edited: DataFrame) -> DataFrame:
    """The blocks of edit_documents() as rows again."""
    return edited.select("id", F.inline("blocks"))


def log_of(edited: DataFrame) -> DataFrame:
    """(id, seq, op, applied, said): what became of each edit."""
    return edited.select("id", F.inline("log"))
