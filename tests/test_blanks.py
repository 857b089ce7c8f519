"""Word documents as blocks against what they were made of; blanks against plain code on random lines; blanks that need layout."""

import io
import random
import re
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from brindle.operators import blanks
from brindle.sources import word

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def run(text, light=False):
    return f'<w:r><w:rPr>{"<w:highlight w:val=\'yellow\'/>" if light else ""}</w:rPr><w:t xml:space="preserve">{escape(text)}</w:t></w:r>'


def par(*runs, style=None, inner=""):
    return f'<w:p>{f"<w:pPr><w:pStyle w:val=\'{style}\'/></w:pPr>" if style else ""}{"".join(runs)}{inner}</w:p>'


def table(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{c}</w:tc>" for c in row) + "</w:tr>" for row in rows) + "</w:tbl>"


def box(*texts):
    inner = "".join(par(run(t)) for t in texts)
    return f"<w:r><mc:AlternateContent><mc:Choice><w:drawing><w:txbxContent>{inner}</w:txbxContent></w:drawing></mc:Choice><mc:Fallback><w:pict><w:txbxContent>{inner}</w:txbxContent></w:pict></mc:Fallback></mc:AlternateContent></w:r>"


def docx(body, parts=()):
    """parts: (place, kind, xml) of headers and footers."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        refs = "".join(f'<w:{place}Reference w:type="{kind}" r:id="r{i}"/>' for i, (place, kind, _) in enumerate(parts))
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}<w:sectPr>{refs}</w:sectPr></w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="part{i}.xml"/>' for i in range(len(parts))) + "</Relationships>")
        for i, (place, _, xml) in enumerate(parts):
            z.writestr(f"word/part{i}.xml", f"<w:{place[:3]} {NS}>{xml}</w:{place[:3]}>")
        styles = '<w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H2"><w:name w:val="Heading 2"/></w:style><w:style w:styleId="Own"><w:name w:val="Mine"/><w:pPr><w:outlineLvl w:val="2"/></w:pPr></w:style><w:style w:styleId="TOC1"><w:name w:val="toc 1"/></w:style>'
        z.writestr("word/styles.xml", f"<w:styles {NS}>{styles}</w:styles>")
    return out.getvalue()


def made(seed):
    """A random file, and its rows: (block, place, table, row, col, anchor, level, text)."""
    r = random.Random(seed)
    xml, rows, n = [], [], {"p": 0, "t": 0, "tbl": 0}

    def paragraph(cell):
        style, texts = r.choice([None, None, "H1", "H2", "Own"]), [r.choice(["a ", "<b>", "", "ü\t"]) for _ in range(r.randint(0, 3))]
        boxes = [r.choice(["in box", "two"]) for _ in range(r.randint(0, 2))] if r.random() < 0.2 else []
        gone = "<w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:r><w:fldChar/><w:t>field</w:t></w:r>" if r.random() < 0.3 else ""
        n["p"] += 1
        rows.append((f"p{n['p']}", "body", *cell, None, {"H1": 1, "H2": 2, "Own": 3}.get(style), "".join(texts)))
        for t in boxes:
            n["t"] += 1
            rows.append((f"t{n['t']}", "textbox", None, None, None, f"p{n['p']}", None, t))
        return par(*[run(t) for t in texts], style=style, inner=gone + (box(*boxes) if boxes else ""))

    for _ in range(r.randint(1, 12)):
        if r.random() < 0.3:
            n["tbl"] += 1
            number = n["tbl"]
            xml.append(table(*[[paragraph((number, i, j)) for j in range(1, r.randint(2, 4))] for i in range(1, r.randint(2, 4))]))
        else:
            whole = paragraph((None, None, None))
            xml.append(f"<w:sdt><w:sdtContent>{whole}</w:sdtContent></w:sdt>" if r.random() < 0.2 else whole)
    parts = [("footer", "default", par(run("foot"))), ("header", "first", par(run("one")) + par(run("two"))), ("header", "default", par(run("zero")))]
    rows += [("h1", "header", None, None, None, None, None, "zero"), ("h2", "header", None, None, None, None, None, "one"), ("h3", "header", None, None, None, None, None, "two"), ("f1", "footer", None, None, None, None, None, "foot")]
    return docx("".join(xml), parts), rows


def test_word_blocks_equal_what_was_written(spark):
    files = [(i, made(i)) for i in range(60)]
    given = spark.createDataFrame([(i, bytearray(f[0])) for i, f in files] + [(98, bytearray(b"no zip")), (99, None)], "id int, content binary")
    got = {}
    for r in word.blocks(given).orderBy("id", "position").collect():
        got.setdefault(r.id, []).append(r)
    for i, (_, rows) in files:
        assert [(r.block, r.place, r.table, r.row, r.col, r.anchor, r.level, r.text) for r in got[i]] == rows
        assert [r.position for r in got[i]] == list(range(1, len(rows) + 1))
        assert all("".join(r.text[x.start : x.end] for x in r.runs) == r.text for r in got[i])
    assert [r.problem for i in (98, 99) for r in got[i]] == ["it is not a Word document"] * 2


def plain(lines):
    """Fields of a document's lines by marking characters that are taken, style by style."""
    styles = [("{{", "}}", "{}"), ("[[", "]]", "[]"), ("«", "»", "«»"), ("<<", ">>", "<>"), ("[", "]", "[]")]
    out, by_key = [], {}
    for i, text in enumerate(lines):
        taken, here = [False] * len(text), []
        for left, right, never in styles:
            at = 0
            while (at := text.find(left, at)) >= 0:
                end = at + len(left)
                while end < len(text) and text[end] not in never:
                    end += 1
                inside, whole = text[at + len(left) : end], end + len(right)
                label = " ".join(inside.replace("_", " ").split())
                ok = text[end:whole] == right and label and 2 <= len(inside) + (len(left) > 1) and not any(taken[at:whole])
                if ok and not all(c in "0123456789 ,;–-" for c in label):
                    taken[at:whole] = [True] * (whole - at)
                    here.append((at, whole, "placeholder", label.capitalize() if label == label.lower() and label != label.upper() else label, label.lower()))
                at += 1
        for m in re.finditer("_+", text):
            if len(m.group()) >= 3 and not any(taken[m.start() : m.end()]):
                here.append((m.start(), m.end(), "blank", None, None))
        ends = sorted(h[1] for h in here)
        for a, b, how, label, key in sorted(here):
            if how == "blank":
                earlier = max((e for e in ends if e <= a and any(h[1] == e and (h[2] == "placeholder" or h[0] < a) for h in here)), default=0)
                label = " ".join(text[earlier:a].strip().lstrip(".,;:)").rstrip(":-–(").split()[-7:])
                label = label or " ".join(text[b:].strip().strip("()[]:").split()[:6]) * (not text[b:].strip().strip("()[]:").strip().startswith("___"))
                beside = [lines[j] for j in (i + 1, i - 1) if 0 <= j < len(lines) and 0 < len(lines[j]) <= 60 and "___" not in lines[j]]
                label = label or (beside[0].rstrip(":") if beside else f"Blank {1 + sum(x[0] == 'blank' for x in out)}")
            if key in by_key:
                by_key[key][3].append((i, a, b))
                continue
            item = [how, label, text[a:b], [(i, a, b)]]
            out.append(item)
            if key:
                by_key[key] = item
    return out


def test_blanks_equal_plain_code(spark):
    r = random.Random(5)
    pieces = ["{{name}}", "{{ first_name }}", "[Name]", "[[Date]]", "[x]", "[1, 2]", "«City»", "<<City>>", "[a {{b}} c]", "{{", "]]", "____", "__", "______", "Total", "of", "the sum:", "(", ")", "<<", "[[x] y]"]
    docs = {i: [" ".join(["Row", *r.choices(pieces, k=r.randint(1, 6)), "end."]) for _ in range(r.randint(1, 5))] for i in range(250)}
    rows = [(i, k, t) for i, lines in docs.items() for k, t in enumerate(lines)]
    got = {}
    for f in blanks.fields(spark.createDataFrame(rows, "id int, position int, text string")).orderBy("id", "field").collect():
        got.setdefault(f.id, []).append([f.how, f.label, f.current, [(s.position, s.start, s.end) for s in f.spots]])
        assert f.field == len(got[f.id]) and "[____]" in f.context
    for i, lines in docs.items():
        assert got.get(i, []) == plain(lines), lines


def test_blanks_of_layout(spark):
    prompt = '<w:sdt><w:sdtPr><w:alias w:val="Sign date"/><w:showingPlcHdr/><w:listItem w:value="a"/></w:sdtPr><w:sdtContent>' + run("Pick one") + "</w:sdtContent></w:sdt>"
    cells = [[par(run("Item")), par(run("Price")), par(run("Qty"))], [par(run("Desk")), par(), par(run("1"))], [par(run("Lamp")), par(run("5")), par()]]
    body = [
        par(run("Scope"), style="H1"), par(), par(run("Terms"), style="H1"), par(run("Net 30 days")), par(run("Annex"), style="H2"), par(run("Part"), style="Own"),
        par(run("Paid in "), run("INR ", True), run("or USD", True), run(" on "), inner=prompt), par(run("Your name:")), table([par(run("Date:")), par()]), table(*cells), par(run("....... 12"), style="TOC1"), par(run("_____")), par(run("(signature)")), par(run("Last"), style="H1"),
    ]
    got = blanks.fields(word.blocks(spark.createDataFrame([(1, bytearray(docx("".join(body))))], "id int, content binary"))).orderBy("field").collect()
    found = [(f.how, f.label, f.current, f.spots[0].do) for f in got]
    assert found == [
        ("section", "Scope", "", "section"), ("highlight", "INR or USD", "INR or USD", "span"), ("control", "Sign date", "Pick one", "span"), ("label", "Your name", "", "append"), ("cell", "Date", "", "paragraph"),
        ("cell", "Desk - Price", "", "paragraph"), ("cell", "Lamp - Qty", "", "paragraph"), ("blank", "(signature)", "_____", "span"), ("section", "Last", "", "after"),
    ]
    assert got[2].options == ["a"] and got[5].context == "Desk | [____] | 1" and [f.field for f in got] == list(range(1, 10))


def test_odd_blanks(spark):
    rows = [(1, 0, None), (1, 1, ""), (1, 2, "{{a}} " * 3), (1, 3, "____"), (1, 4, "____"), (2, 0, "z" * 100000 + " {{end}}"), (3, None, "{{a}}")] + [(4, i, f"{{{{k{i}}}}}") for i in range(300)]
    got = blanks.fields(spark.createDataFrame(rows, "id int, position int, text string")).orderBy("id", "field").collect()
    assert [(f.label, len(f.spots)) for f in got if f.id == 1] == [("A", 3), ("{{a}} {{a}} {{a}}", 1), ("Blank 2", 1)]
    assert [(f.label, f.spots[0].start) for f in got if f.id == 2] == [("End", 100001)] and sum(f.id == 4 for f in got) == 200 and not any(f.id == 3 for f in got)
    assert blanks.fields(spark.createDataFrame([], "id int, position int, text string")).count() == 0


def test_lines_are_dealt_to_tasks_before_they_are_looked_at(spark):
    rows = spark.range(0, 64, 1, 1).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("position"), F.concat(F.lit("{{a}} of "), "id", F.lit(":")).alias("text"))
    found = blanks.fields(rows)
    above, *below = found._jdf.queryExecution().executedPlan().toString().split("ArrowEvalPython")
    assert len(below) == 1 and "Exchange hashpartitioning(id" in below[0]  # once, and behind a shuffle
    assert sorted((f.id, f.how, f.label, len(f.spots)) for f in found.collect()) == [(i, "placeholder", "A", 2) for i in range(64)]


def test_lines_that_ask_beside_lines_with_blanks(spark):
    rows = [(1, 0, ":"), (1, 1, "Phone:"), (1, 2, "____"), (1, 3, "Sum {{x}}:"), (2, 0, "See mm and here, XXXX or dd-MM-yy, Enter your name here."), (2, 1, "… ….. ……")]
    got = blanks.fields(spark.createDataFrame(rows, "id int, position int, text string")).orderBy("id", "field").collect()
    assert [(f.id, f.field, f.how, f.label, f.current, *f.spots[0]) for f in got] == [
        (1, 1, "label", "Blank 1", "", 0, None, None, "append"), (1, 2, "label", "Phone", "", 1, None, None, "append"), (1, 3, "blank", "Sum {{x}}", "____", 2, 0, 4, "span"), (1, 4, "placeholder", "X", "{{x}}", 3, 4, 9, "span"),
        (2, 1, "sample", "See mm and here,", "XXXX", 0, 17, 21, "span"), (2, 2, "sample", "or", "dd-MM-yy", 0, 25, 33, "span"), (2, 3, "sample", "Enter your name here.", "Enter your name here.", 0, 35, 56, "span"),
        (2, 4, "blank", rows[4][2], "……", 1, 6, 8, "span"),
    ]
