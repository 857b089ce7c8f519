"""Blanks of documents (D01): places that look meant to be filled, one field for a placeholder that comes again, in reading order."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.blocks import cell_labels

#: How blanks are marked, the most specific first, samples that a template leaves, and how much is shown.
MARKED = (
    r"\{\{\s*([^{}\n]{1,80}?)\s*\}\}",
    r"\[\[\s*([^\[\]\n]{1,80}?)\s*\]\]",
    r"«\s*([^«»\n]{1,80}?)\s*»",
    r"<<\s*([^<>\n]{1,80}?)\s*>>",
    r"\[([^\[\]\n]{2,60})\]",
    r"<([A-Za-z][\w '/&.-]{1,40})>",
)
SAMPLES = (
    r"\b[Dd]{2}[/.\-][Mm]{2}[/.\-][Yy]{2,4}\b",
    r"\b[Xx]{4,}\b",
    r"(?i:click or tap here to enter (?:text|a date)\.?)",
    r"(?i:click here to enter (?:text|a date)\.?)",
    r"(?i:(?:enter|insert|type) (?:your |the )?(?:text|[\w ]{2,30}?) here\.?)",
)
LINE = r"_{3,}|\.{5,}|…{2,}"
OPENING, CLOSING, BRACKETS = ".,;:)", ":-–(", "()[]:"
CITATION = r"[\d\s,;–-]+"
MOST_FIELDS, SHOWN, MOST_LABEL = 200, 70, 60

_MARKED, _SAMPLE, _LINE = [(re.compile(p), left) for p, left in zip(MARKED, ("{{", "[[", "«", "<<", "[", "<"), strict=True)], re.compile("|".join(SAMPLES)), re.compile(LINE)
SPAN = "array<struct<start:int,end:int,how:string,label:string,key:string,context:string,options:array<string>>>"
_SPAN = [("start", pa.int32()), ("end", pa.int32()), ("how", pa.string()), ("label", pa.string()), ("key", pa.string()), ("context", pa.string()), ("options", pa.list_(pa.string()))]
_SENTENCE, _CITED = re.compile(r"\t|\n|[.;!?]\s+"), re.compile(CITATION)
#: Lines that are Python objects at once.
TOGETHER = 256


def around(text: str, start: int, end: int, floor: int) -> str:
    """What a blank is for by its own line: up to seven words of its sentence before it (after an earlier blank, which ends at floor), else
    up to six after it; empty if neither says anything."""
    sentence = _SENTENCE.split(text[floor:start])[-1].strip()
    if words := sentence.lstrip(OPENING).rstrip(CLOSING).split():
        return " ".join(words[-7:])
    rest = text[end:].partition("\t")[0].strip().strip(BRACKETS).strip()
    return "" if _LINE.match(rest) else " ".join(rest.split()[:6])


def spans(text: str, lit: list[tuple[int, int]], prompts: list[tuple[int, int, str, list[str]]]) -> list[tuple]:
    """The blanks of a line as (start, end, how, label, key, context, options): prompts of controls, placeholders from the most specific style on,
    samples, lines and dots, highlighted text. None overlaps one that was found before it. lit: highlighted ranges."""
    found: list[tuple] = []

    def offer(start, end, how, label, key=None, options=()):
        if all(end <= a or start >= b for a, b, *_ in found):
            if label is None:
                label = around(text, start, end, max((f[1] for f in found if f[1] <= start), default=0))
            shown = f"{text[max(0, start - SHOWN) : start]}[____]{text[end : end + SHOWN]}"
            found.append((start, end, how, label, key, " ".join(shown.split()), list(options)))

    for start, end, label, options in prompts:
        if end > start:
            offer(start, end, "control", label or None, options=options)
    for pattern in (p for p, left in _MARKED if left in text):
        for m in pattern.finditer(text):
            label = " ".join(m.group(1).replace("_", " ").split())
            if label and not _CITED.fullmatch(label):
                offer(*m.span(), "placeholder", label[0].upper() + label[1:] if label.islower() else label, label.lower())
    low = text.lower()
    for m in _SAMPLE.finditer(text) if "mm" in low or "xxxx" in low or "here" in low else ():  # each sample has one of them
        offer(*m.span(), "sample", None)
    for m in _LINE.finditer(text) if "___" in text or "....." in text or "……" in text else ():
        if not re.fullmatch(r"\s*\d+\s*", text[m.end() :]):  # else the dots lead to a page's number
            offer(*m.span(), "blank", None)
    for start, end in lit:
        if marked := text[start:end].strip():
            offer(start, end, "highlight", marked if len(marked) <= MOST_LABEL else marked[: MOST_LABEL - 3] + "...", f"highlight:{marked.lower()}")
    return found


def _spans(text: pa.Array, runs: pa.Array, controls: pa.Array) -> pa.Array:
    found, ends = [], [0]
    for at in range(0, len(text), TOGETHER):
        for t, rs, cs in zip(*(c.slice(at, TOGETHER).to_pylist() for c in (text, runs, controls)), strict=True):
            lit, last = [], False
            for r in rs or []:
                if r["highlight"] and last:
                    lit[-1] = (lit[-1][0], r["end"])
                elif r["highlight"]:
                    lit.append((r["start"], r["end"]))
                last = r["highlight"]
            found += spans(t, lit, [(c["start"], c["end"], c["label"], c["options"]) for c in cs or []])
            ends.append(len(found))
    columns = [pa.array([f[i] for f in found], kind) for i, (_, kind) in enumerate(_SPAN)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=[pa.field(*x) for x in _SPAN]))


#: What blocks without these columns get: they are lines of plain text.
_DEFAULTS = {
    "place": "'body'", "table": "cast(null as int)", "row": "cast(null as int)", "col": "cast(null as int)", "last_in_row": "true", "merged": "false", "style": "''", "level": "cast(null as int)",
    "picture": "false", "stretch": "1", "table_after": "false", "runs": "cast(null as array<struct<start:int,end:int,highlight:boolean>>)",
    "controls": "cast(null as array<struct<start:int,end:int,label:string,options:array<string>>>)",
}


def fields(blocks: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, field, how, label, context, current, options, spots) of blocks (id, position, text, and what sources.word gives if it is there).

    field counts from 1 in reading order, up to MOST_FIELDS a document; spots are array<struct<position, start, end, do>>: fill a span, append
    to a line that ends with a colon, fill an empty cell (paragraph), write under a heading (section) or after it. A label that neither its
    line nor its cell nor a short line beside it tells is "Blank" with a number. Null texts are empty; positions must be unique in a document.
    Documents are dealt to all shuffle partitions before their lines are looked at: a small file's rows may be one task else.
    """
    rows = blocks.where(F.col("position").isNotNull()).withColumnRenamed(id_col, "id").withColumns({"text": F.coalesce("text", F.lit("")), **{c: F.expr(v) for c, v in _DEFAULTS.items() if c not in blocks.columns}})
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    order = Window.partitionBy("id").orderBy("position")
    rows = rows.withColumn("_bare", F.trim("text", F.lit(" \t\n\r")))
    bare, words = F.col("_bare"), lambda c: F.size(F.split(c, r"\s+"))
    near = F.when((F.length(bare) > 0) & (F.length(bare) <= MOST_LABEL) & ~F.col("text").rlike(LINE), F.rtrim(bare, F.lit(":")))
    rows = rows.withColumn("_near", near)
    beside = [F.when(shift("place", 1).over(order) == F.col("place"), shift("_near", 1).over(order)) for shift in (F.lead, F.lag)]
    rows = rows.withColumns({"_after": beside[0], "_before": beside[1], "_spans": F.when((bare != "") & ~F.lower("style").startswith("toc"), F.arrow_udf(_spans, SPAN)("text", "runs", "controls"))})
    in_cell = F.col("table").isNotNull()
    cells = rows.where(in_cell).groupBy("id", "table", "row", "col").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "_bare"))), lambda x: F.nullif(x["_bare"], F.lit(""))), " ").alias("text"),
        F.min("position").alias("position"), F.bool_or("picture").alias("_picture"), F.bool_or("merged").alias("_merged"),
    )
    names = cell_labels(cells.select(F.col("id").alias("doc"), "table", "row", "col", "text"), only_empty=False).withColumnRenamed("doc", "id").withColumnRenamed("label", "_cell")
    empty = cells.where((F.col("text") == "") & ~F.col("_picture") & ~F.col("_merged")).join(names, ["id", "table", "row", "col"])
    by_row = cells.groupBy("id", "table", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: F.when(x["text"] == "", "[____]").otherwise(x["text"])), " | ").alias("_line"))
    text, none = F.lit(None).cast("string"), F.array().cast("array<string>")

    def made(source, at, how, label, context, do, position=F.col("position")):
        spot = F.struct(position.cast("int").alias("position"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(do).alias("do"))
        return source.select("id", F.col("position").cast("long").alias("position"), F.lit(at).alias("at") if isinstance(at, int) else at.cast("int").alias("at"), F.lit(how).alias("how"), label.alias("label"), text.alias("key"), context.alias("context"), F.lit("").alias("current"), none.alias("options"), spot.alias("spot"))

    # a line's blanks, or the line itself if it asks for something: one pass for both
    asks = F.endswith(F.col("_bare"), F.lit(":")) & (F.length("_bare") <= 50) & (words(F.col("_bare")) <= 6) & F.col("level").isNull() & (~in_cell | F.coalesce("last_in_row", F.lit(True))) & ~F.lower("style").startswith("toc")
    asked = F.struct(F.length("text").alias("start"), F.lit(None).cast("int").alias("end"), F.lit("label").alias("how"), F.trim(F.rtrim("_bare", F.lit(":"))).alias("label"), text.alias("key"), F.concat("_bare", F.lit(" [____]")).alias("context"), none.alias("options"))
    items = F.when(F.size("_spans") > 0, F.col("_spans")).when(asks, F.array(asked))
    each = rows.withColumn("_items", items).select("id", "position", "text", "table", "row", "col", "_after", "_before", F.explode("_items").alias("x")).join(names, ["id", "table", "row", "col"], "left")
    line = F.col("x.how") == "label"
    spot = F.struct(F.col("position").cast("int").alias("position"), F.when(~line, F.col("x.start")).alias("start"), F.col("x.end").alias("end"), F.when(line, "append").otherwise("span").alias("do"))
    current = F.when(line, "").otherwise(F.substring("text", F.col("x.start") + 1, F.col("x.end") - F.col("x.start")))
    label = F.coalesce(F.when(line, F.col("x.label")), F.nullif("x.label", F.lit("")), F.nullif("_cell", F.lit("")), F.col("_after"), F.col("_before"), F.when(F.col("x.how") == "sample", current), F.lit(""))
    found = each.select("id", F.col("position").cast("long").alias("position"), F.col("x.start").alias("at"), F.col("x.how").alias("how"), label.alias("label"), F.col("x.key").alias("key"), F.col("x.context").alias("context"), current.alias("current"), F.col("x.options").alias("options"), spot.alias("spot"))
    found = found.unionByName(made(empty.where(F.col("_cell") != "").join(by_row, ["id", "table", "row"]), 0, "cell", F.col("_cell"), F.left("_line", F.lit(200)), "paragraph"))
    body = rows.where((F.col("place") == "body") & ~in_cell)
    starts = F.col("level").isNotNull() | (F.coalesce(F.lag("stretch").over(order), F.lit(-1)) != F.col("stretch"))
    body = body.withColumns({"_group": F.sum(starts.cast("int")).over(order), "_next": F.lead("level").over(order), "_any": F.lead("position").over(order).isNotNull()})
    group = Window.partitionBy("id", "_group")
    under = F.col("level").isNull()
    body = body.withColumns({"_below": F.count(F.when(under, 1)).over(group), "_full": F.count(F.when(under & ((F.col("_bare") != "") | F.col("picture")), 1)).over(group), "_first": F.min(F.when(under, F.col("position"))).over(group)})
    heads = body.where(F.col("level").isNotNull() & (F.col("_bare") != ""))
    title = F.concat(F.lit('Section under the heading "'), "_bare", F.lit('"'))
    found = found.unionByName(made(heads.where((F.col("_below") > 0) & (F.col("_full") == 0)), 10**6, "section", F.col("_bare"), title, "section", F.col("_first")))
    ends = ~F.col("_any") | F.coalesce(F.col("_next") <= F.col("level"), F.lit(False))
    found = found.unionByName(made(heads.where((F.col("_below") == 0) & ends & ~F.col("table_after")), 10**6, "section", F.col("_bare"), title, "after"))
    # one field for a placeholder that comes again: the first place tells what it is, all places are filled
    same = F.coalesce(F.concat(F.lit("k"), "key"), F.concat_ws(" ", F.lit("p"), "position", "at", "how"))
    of_field = Window.partitionBy("id", "_same").orderBy("position", "at", "how")
    spots = F.collect_list("spot").over(of_field.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    one = found.withColumn("_same", same).withColumns({"_place": F.row_number().over(of_field), "spots": spots}).where(F.col("_place") == 1).drop("_same", "_place", "spot")
    in_order = Window.partitionBy("id").orderBy("position", "at", "how")
    one = one.withColumns({"field": F.row_number().over(in_order), "_n": F.row_number().over(Window.partitionBy("id", "how").orderBy("position", "at"))})
    named = F.when(F.col("label") == "", F.concat(F.lit("Blank "), "_n")).otherwise(F.col("label"))
    return one.where(F.col("field") <= MOST_FIELDS).select("id", "field", "how", named.alias("label"), "context", "current", "options", "spots")
