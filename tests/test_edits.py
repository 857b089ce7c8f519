"""Edits of documents against plain code that keeps a list of lines: a thousand random edit lists, and known cases."""

import random
import re

from pyspark.sql import functions as F

from brindle.operators import edits

FIELDS = ("id", "position", "type", "level", "text", "table", "row", "col")
SCHEMA = "id long, position int, type string, level int, text string, table int, row int, col int"
GIVEN = {"id": "long", "seq": "int", "op": "string"} | {k: edits.PARAMETERS[k] for k in ("blocks", "target", "text", "place", "find", "put", "match_case", "table", "row", "col", "cells")}


def made(r, doc):
    rows, tables = [], 0
    while len(rows) < r.randint(1, 25):
        if r.random() < 0.15:
            tables += 1
            width = r.randint(1, 3)
            for y in range(r.randint(1, 3)):
                rows += [("cell", 0, r.choice(["", "a b", "Cd"]), tables, y + 1, x + 1) for x in range(width)]
        else:
            kind = r.choice(["heading", "text", "text", "text", "list", "image", "section_break"])
            rows.append((kind, 1 if kind == "heading" else 0, r.choice(["", "alpha beta", "Beta. beta", "gamma"]), None, None, None))
    return [(doc, i, *x) for i, x in enumerate(rows)]


def asked(r, doc, n_blocks):
    out = []
    for seq in range(r.choice([1, 5, 20, 65])):
        e = dict.fromkeys(GIVEN) | {"id": doc, "seq": seq, "op": r.choice(["replace_text", "insert", "delete", "replace_section", "find_replace", "set_cell", "add_row", "delete_row", " Insert", "paint", None])}
        if r.random() < 0.9:
            e["blocks"] = [r.randint(0, n_blocks) for _ in range(r.choice([1, 1, 1, 2, 3]))]
        e["target"] = r.choice([None, None, None, "ids", "headings", "all"])
        e["text"] = r.choice([None, " ", "one", "one\n\n- two \nthree"])
        e["place"] = r.choice([None, "before", "after"])
        e["find"], e["put"], e["match_case"] = r.choice([None, "beta", "."]), r.choice([None, "", "Beta beta"]), r.choice([None, True, False])
        e["table"], e["row"], e["col"], e["cells"] = r.choice([None, 1, 2]), r.choice([None, 1, 2, 4]), r.choice([None, 1, 2]), r.choice([None, [], ["x", " y ", "z", "w"]])
        out.append(tuple(e.values()))
    return out


def plain(blocks, listed):
    """The same by lists of lists: a line is [address, type, text, cell], a table a list of rows of lines."""
    lines = [[b[1], b[2], b[4], b[5:] if b[5] else None] for b in blocks]
    first, gone = {x[0]: x for x in lines}, []
    grids = {}
    for x in lines:
        if x[3]:
            grids.setdefault(x[3][0], {}).setdefault(x[3][1] - 1, []).append([x])
    grids = {t: [rows[y] for y in sorted(rows)] for t, rows in grids.items()}
    is_in = lambda x: any(x is y for y in lines)
    log = []

    def new(text, kind, cell):
        out = []
        for part in text.split("\n"):
            if part.strip():
                bullet = re.match(r"\s*[-*•]\s+", part)
                out.append([None, "list" if bullet else kind, part[bullet.end() :].strip() if bullet else part.strip(), cell])
        return out

    def pick(e, one):
        if e["blocks"] and e["target"] in (None, "ids"):
            if any(i not in first for i in e["blocks"]):
                return "no such block"
            if any(not is_in(first[i]) for i in e["blocks"]):
                return "removed before"
            some = [first[i] for i in e["blocks"]]
        elif e["target"] in ("headings", "all"):
            some = [x for x in first.values() if is_in(x) and (e["target"] == "all" or x[1] == "heading")]
        else:
            return "names neither blocks nor a target"
        return "nothing matches" if not some else "needs one block" if one and len(some) != 1 else some

    for n, e in enumerate(listed):
        op, said = (e["op"] or "").strip().lower(), None
        if n >= 60:
            said = "more than 60 edits"
        elif op in ("replace_text", "insert", "replace_section"):
            said = pick(e, True)
            if not isinstance(said, str):
                x = said[0]
                at = [y is x for y in lines].index(True)
                if op == "replace_section" and x[1] != "heading":
                    said = "not a heading"
                elif not (e["text"] or "").strip():
                    said = "no text"
                elif op == "replace_text":
                    x[2], said = e["text"].strip(), 1
                elif op == "insert":
                    kind, cell = x[1], x[3]
                    if x[1] == "heading":
                        kind = next((y[1] for y in lines[at + 1 :] if y[1] != "heading" and not y[3] and y[2].strip()), "text")
                        cell = None
                    more = new(e["text"], kind, cell)
                    lines[at + (e["place"] != "before") : at + (e["place"] != "before")] = more
                    if cell:
                        for row in grids[cell[0]]:
                            for c in row:
                                if any(y is x for y in c):
                                    c += more
                    said = len(more)
                else:
                    end = at + 1
                    while end < len(lines) and lines[end][1] not in ("heading", "section_break") and not lines[end][3]:
                        end += 1
                    under = lines[at + 1 : end]
                    kind = next((y[1] for y in under if y[2].strip()), under[0][1] if under else "text")
                    lines[at + 1 : end] = more = new(e["text"], kind, None)
                    said = len(more)
        elif op == "delete":
            said = "deleting needs blocks" if e["target"] in ("all", "headings") else pick(e, False)
            if not isinstance(said, str):
                count = 0
                for x in said:
                    if x[1] == "image" or not is_in(x):
                        continue
                    count += 1
                    mates = [y for rows in grids.values() for row in rows for c in row if any(z is x for z in c) for y in c if is_in(y)]
                    if len(mates) == 1:
                        x[2] = ""
                    else:
                        lines = [y for y in lines if y is not x]
                said = count or "pictures stay"
        elif op == "find_replace":
            if not e["find"] or e["put"] is None:
                said = "needs what to find and what to put"
            else:
                count = 0
                for x in lines:
                    if x[0] is not None:
                        hay, needle = (x[2], e["find"]) if e["match_case"] else (x[2].lower(), e["find"].lower())
                        count += hay.count(needle)
                        out, at = "", 0
                        while (k := hay.find(needle, at)) >= 0:
                            out, at = out + x[2][at:k] + e["put"], k + len(needle)
                        x[2] = out + x[2][at:]
                said = count or "not found"
        elif op in ("set_cell", "add_row", "delete_row"):
            rows = grids.get(e["table"] or 1)
            alive = [any(is_in(y) for c in row for y in c) for row in rows or []]
            if rows is None:
                said = "no such table"
            elif op == "add_row" and not any(alive):
                said = "no rows left"
            elif not (op == "add_row" and e["row"] is None) and not (e["row"] and e["row"] <= len(rows)):
                said = "no such row"
            elif op == "set_cell":
                if not (e["col"] and e["col"] <= len(rows[e["row"] - 1])):
                    said = "no such column"
                else:
                    left = [y for y in rows[e["row"] - 1][e["col"] - 1] if is_in(y)]
                    said = 1 if left else "removed before"
                    if left:
                        left[0][2] = (e["text"] or "").strip()
                        lines = [y for y in lines if not any(y is z for z in left[1:])]
            elif op == "delete_row":
                said = "removed before" if not alive[e["row"] - 1] else "a table keeps a row" if sum(alive) == 1 else 1
                if said == 1:
                    dead = [y for c in rows[e["row"] - 1] for y in c]
                    lines = [y for y in lines if not any(y is z for z in dead)]
            else:
                k = max(i for i, a in enumerate(alive) if a) if e["row"] is None else e["row"] - 1
                if not alive[k]:
                    said = "no such row"
                else:
                    at = max(i for i, y in enumerate(lines) if any(y is z for c in rows[k] for z in c)) + 1
                    cells = e["cells"] or []
                    row = [[[None, next(z for z in c if is_in(z))[1], cells[i].strip() if i < len(cells) else "", c[0][3]]] for i, c in enumerate(rows[k])]
                    lines[at:at] = [c[0] for c in row]
                    rows.insert(k + 1, row)
                    said = 1
        else:
            said = "no such operation"
        log.append((e["seq"], op, not isinstance(said, str), str(said)))
    numbers = {}
    for rows in grids.values():
        live = [row for row in rows if any(is_in(y) for c in row for y in c)]
        numbers |= {id(y): k + 1 for k, row in enumerate(live) for c in row for y in c}
    return [(i, x[0], x[1], x[2], numbers.get(id(x))) for i, x in enumerate(lines)], log


def test_a_thousand_random_edit_lists(spark):
    r = random.Random(11)
    blocks = {doc: made(r, doc) for doc in range(1000)}
    listed = {doc: asked(r, doc, len(blocks[doc])) for doc in range(1000) if doc % 20}
    frame = spark.createDataFrame([x for b in blocks.values() for x in b], SCHEMA)
    given = spark.createDataFrame([x for e in listed.values() for x in e], ", ".join(f"`{k}` {v}" for k, v in GIVEN.items()))
    got = edits.edit_documents(frame, given).collect()
    assert len(got) == 1000
    done = refused = 0
    for row in got:
        want, log = plain(blocks[row.id], [dict(zip(GIVEN, e, strict=True)) for e in listed.get(row.id, [])])
        assert [(b.position, b.was, b.type, b.text, b.row) for b in row.blocks] == want, row.id
        assert [tuple(x) for x in row.log] == log, row.id
        done, refused = done + sum(x[2] for x in log), refused + sum(not x[2] for x in log)
    assert done > 2500 and refused > 2500


def test_looks_and_limits(spark):
    frame = spark.createDataFrame([(1, 0, "heading", 1, "Title", None, None, None), (1, 1, "text", 0, "body", None, None, None), (2, 0, "text", 0, "x", None, None, None)], SCHEMA)
    rows = [
        dict(op="format", target="all", bold=True, color="Red", size=12.0), dict(op="format", target="body", color="pink"), dict(op="format", target="body", size=100.0), dict(op="format", target="body"),
        dict(op="align", target="headings", align="Centre"), dict(op="align", target="headings", align="up"), dict(op="spacing", blocks=[1], spacing=1.5), dict(op="spacing", blocks=[1], spacing=9.0),
        dict(op="style", blocks=[1], style="H2"), dict(op="style", blocks=[1], style="fancy"), dict(op="insert", blocks=[1], text="more", style="bullets"), dict(op="insert", blocks=[1], text="plain"),
    ]
    names = [*edits.PARAMETERS]
    given = spark.createDataFrame([(1, i, e["op"], *[e.get(n) for n in names]) for i, e in enumerate(rows)] + [(9, 0, "delete", *[None] * len(names))], "id long, seq int, op string, " + ", ".join(f"`{n}` {edits.PARAMETERS[n]}" for n in names))
    out = edits.edit_documents(frame, given).cache()
    log = {r.seq: (r.applied, r.said) for r in edits.log_of(out).collect()}
    assert [i for i in log if not log[i][0]] == [1, 2, 3, 5, 7, 9]
    found = edits.blocks_of(out).where("id = 1").orderBy("position").collect()
    assert [(b.type, b.level, b.text) for b in found] == [("heading", 1, "Title"), ("heading", 2, "body"), ("text", 0, "plain"), ("list", 0, "more")]
    assert found[0].looks == {"bold": "true", "color": "C00000", "size": "12", "align": "center"}
    assert found[1].looks == {"bold": "true", "color": "C00000", "size": "12", "spacing": "1.5", "style": "heading 2"}
    assert edits.blocks_of(out).where("id = 2").count() == 1 and edits.log_of(out).where(F.col("id") != 1).count() == 0
