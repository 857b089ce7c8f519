"""Documents as tables of blocks: Markdown to blocks, blanks and their labels, filling, editing, outlines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a blank is marked; double braces go first.
PLACEHOLDER = r"\{\{\s*([^{}\n]{1,60}?)\s*\}\}|\[\s*([^\[\]\n]{1,60}?)\s*\]|<<\s*([^<>\n]{1,60}?)\s*>>|\{\s*([^{}\n]{1,60}?)\s*\}|(_{4,}|\.{6,})"


def markdown_blocks(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, position, type, level, text) of each line of a Markdown text that isn't blank: heading, list, quote, rule, table,
    code (inside a fence) or text. Anything unknown is text; nothing fails."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\r?\n")).alias("position", "line"))
    order = Window.partitionBy("id").orderBy("position")
    fence = F.col("line").rlike(r"^\s*```")
    lines = lines.withColumns({"fence": fence, "open": F.sum(fence.cast("int")).over(order) % 2 == 1})
    line = F.col("line")
    kind = (
        F.when(F.col("open"), "code").when(line.rlike(r"^#{1,6}\s+\S"), "heading").when(line.rlike(r"^\s*([-*_])(\s*\1){2,}\s*$"), "rule").when(line.rlike(r"^\s*([-*+]|\d+[.)])\s+\S"), "list").when(line.rlike(r"^\s*>"), "quote").when(line.rlike(r"^\s*\|.*\|\s*$"), "table").otherwise("text")
    )
    level = F.when(kind == "heading", F.length(F.regexp_extract(line, "^(#+)", 1))).otherwise(0)
    bare = F.trim(F.when(kind == "code", line).otherwise(F.regexp_replace(line, r"^(#{1,6}\s+|\s*([-*+]|\d+[.)])\s+|\s*>\s?)", "")))
    return lines.where(~F.col("fence") & (F.trim("line") != "")).select("id", "position", kind.alias("type"), level.alias("level"), bare.alias("text"))


def blanks(blocks: DataFrame) -> DataFrame:
    """(id, position, n, label) of the placeholders of blocks; those with figures only are citations and left out.

    A quick list by line, without layout or precedence: blanks.fields() gives whole fields."""
    whole = F.regexp_extract_all("text", F.lit(PLACEHOLDER), F.lit(0))
    found = blocks.select("id", "position", F.posexplode(whole).alias("n", "mark"))
    label = F.trim(F.regexp_replace("mark", r"^[\[{<\s]+|[\]}>\s]+$", ""))
    return found.withColumn("label", F.when(F.col("mark").rlike(r"^[_.]+$"), F.lit("")).otherwise(label)).where(~F.col("label").rlike(r"^[\d,\s]+$")).select("id", "position", "n", "label")


def fill(text: Column, given: Column) -> Column:
    """A text with {{name}} marks replaced by the values of a map; unknown names stay."""
    names = F.map_keys(given)
    return F.aggregate(names, text, lambda s, k: F.replace(s, F.concat(F.lit("{{"), k, F.lit("}}")), F.coalesce(F.try_element_at(given, k), F.lit(""))))


def outline(blocks: DataFrame, deepest: int = 2) -> DataFrame:
    """(id, contents): headings down to a level, indented."""
    heads = blocks.where((F.col("type") == "heading") & (F.col("level") <= deepest))
    lines = F.array_sort(F.collect_list(F.struct("position", F.concat(F.repeat(F.lit("  "), F.col("level") - 1), "text").alias("line"))))
    return heads.groupBy("id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("contents"))


def with_heading(blocks: DataFrame) -> DataFrame:
    """Each block with the heading above it."""
    upto = Window.partitionBy("id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("heading", F.last(F.when(F.col("type") == "heading", F.col("text")), ignorenulls=True).over(upto))


def edited(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (id, position, op, text) over blocks: replace, delete, and insert after a position; numbered anew.

    Edits of one document touch blocks by position, so they are joins and a union, not a walk through the document.
    """
    op = lambda name: edits.where(F.col("op") == name)
    new = op("replace").select("id", "position", F.col("text").alias("_new"))
    kept = blocks.join(op("delete").select("id", "position"), ["id", "position"], "left_anti").join(new, ["id", "position"], "left")
    kept = kept.withColumn("text", F.coalesce("_new", "text")).drop("_new").withColumn("_after", F.lit(0))
    more = op("insert").select("id", "position", F.lit("text").alias("type"), F.lit(0).alias("level"), "text", F.lit(1).alias("_after"))
    order = Window.partitionBy("id").orderBy("position", "_after", "text")
    both = kept.select("id", "position", "type", "level", "text", "_after").unionByName(more)
    return both.withColumn("position", F.row_number().over(order) - 1).drop("_after")


def found_and_replaced(text: Column, find: str, put: str) -> tuple[Column, Column]:
    """The text with every occurrence replaced, and how many there were."""
    return F.replace(text, F.lit(find), F.lit(put)), F.floor((F.length(text) - F.length(F.replace(text, F.lit(find), F.lit("")))) / len(find)).cast("long")


def selected(blocks: DataFrame, target: str, ids: list[int] | None = None) -> DataFrame:
    """The blocks an edit is meant for: those of given positions, all, headings, body (neither headings nor tables), or tables."""
    kind = F.col("type")
    chosen = {"ids": F.col("position").isin(ids or []), "all": F.lit(True), "headings": kind == "heading", "body": ~kind.isin("heading", "table"), "tables": kind == "table"}
    if target not in chosen:
        raise ValueError("name positions, or one of all, headings, body and tables")
    return blocks.where(chosen[target])


def without_empty_pages(blocks: DataFrame) -> DataFrame:
    """Page breaks before any content, or right after another one, would make empty pages and go."""
    before = F.lag("type").over(Window.partitionBy("id").orderBy("position"))
    return blocks.withColumn("_before", before).where((F.col("type") != "page_break") | F.coalesce(F.col("_before") != "page_break", F.lit(False))).drop("_before")


def cell_labels(cells: DataFrame, only_empty: bool = True) -> DataFrame:
    """What the empty cells of tables (doc, table, row, col, text; counted from 1) are for: (doc, table, row, col, label).

    A cell on the left that ends with a colon settles it. In a grid of three columns or more with a full heading row it is the row's first
    cell and the column's heading; else the cell on the left, else the heading. Labels are short: at most 8 words.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    of_row, of_col, whole = Window.partitionBy("doc", "table", "row").orderBy("col"), Window.partitionBy("doc", "table", "col").orderBy("row"), Window.partitionBy("doc", "table")
    top = F.when(F.col("row") == 1, F.col("t"))
    marked = cells.withColumn("t", text).withColumns({
        "left": F.coalesce(F.lag("t").over(of_row), F.lit("")),
        "name": F.when(F.col("col") > 1, F.first("t").over(of_row)).otherwise(""),
        "head": F.first("t").over(of_col),
        "columns": F.count(top).over(whole),
        "full": F.coalesce(F.min(top != "").over(whole), F.lit(False)),
    })

    def short(c: str, most: int) -> Column:
        bare = F.trim(F.regexp_replace(c, ":+$", ""))
        return F.when((F.length(c) <= most) & (F.size(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))) <= 8), bare).otherwise("")

    left, name = short("left", 60), short("name", 60)
    head = F.when((F.col("row") > 1) & (F.col("columns") > 1) & F.col("full"), short("head", 40)).otherwise("")
    grid = (head != "") & (F.col("columns") > 2) & ~F.endswith("left", F.lit(":"))
    label = F.when(grid, F.when(name != "", F.concat(name, F.lit(" - "), head)).otherwise(F.concat(head, F.lit(" (row "), F.col("row") - 1, F.lit(")")))).when(left != "", left).otherwise(head)
    return marked.where("t = ''" if only_empty else "true").select("doc", "table", "row", "col", label.alias("label"))


def snake(c: Column) -> Column:
    """A name of lower-case words joined by _."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_"))


#: The numbers at the end of a name, from 2 on.
NUMBERED = "(?:_(?:[1-9][0-9]++|[2-9]))++$"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of the fields (doc, position, base, family), sorted. Of a family what is held are its bases, each with the last number given:
    b_n is in use if it came as a base, or if b has got as far as n. Numbers only grow, as names don't become free again."""
    of, last = None, {}
    for batch in batches:
        names = []
        for doc, base, family in zip(*(batch.column(c).to_pylist() for c in ("doc", "base", "family")), strict=True):
            if (doc, family) != of:
                of, last = (doc, family), {}
            before, _, number = base.rpartition("_")
            if base not in last:
                given = number.isdecimal() and number[0] != "0" and len(number) < 19 and 1 < int(number) <= last.get(before, 0)
                if not given:
                    last[base] = 1
                    names.append(base)
                    continue
            n = last.get(base, 1) + 1
            while f"{base}_{n}" in last:
                n += 1
            last[base] = n
            names.append(f"{base}_{n}")
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("position"), pa.array(names, pa.string())], ["doc", "position", "name"])


def slot_fields(labels: DataFrame) -> DataFrame:
    """The single fields of a slot map: (doc, position, name). labels: (doc, position, role, name, group, instance).

    In reading order a name that is taken gets the first number from 2 on that makes it free: a, a, a_2 become a, a_2, a_2_2. Only names
    that are alike but for numbers at their end can meet, so each such family of a document is sorted and gone through by itself (see
    _numbered). Fields without a name are no fields.
    """
    named = labels.where("role = 'field'").select("doc", "position", snake(F.col("name")).alias("base")).where("base <> ''")
    family = named.withColumn("family", F.regexp_replace("base", NUMBERED, ""))
    rows = family.repartition("doc", "family").sortWithinPartitions("doc", "family", "position", "base")
    kinds = {f.name: f.dataType.simpleString() for f in named.schema}
    return rows.mapInArrow(_numbered, f"doc {kinds['doc']}, position {kinds['position']}, name string")


def slot_groups(labels: DataFrame) -> DataFrame:
    """The repeated items of a slot map: (doc, group, instance, fields, lists, start, end, apart).

    A name that stands twice in one item is a list in all items of its group. Items that reach into each other aren't separate runs
    of blocks, and then apart is false for the whole group.
    """
    items = labels.where("role = 'group_item'").select("doc", "position", snake(F.col("name")).alias("name"), snake(F.col("group")).alias("group"), F.coalesce("instance", F.lit(1)).alias("instance"))
    items = items.where("name <> '' AND `group` <> ''")
    counted = items.groupBy("doc", "group", "instance", "name").agg(F.array_sort(F.collect_list("position")).alias("places"))
    counted = counted.withColumn("listed", F.max(F.size("places") > 1).over(Window.partitionBy("doc", "group", "name")))
    entry = lambda flag, value: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("listed") == flag, F.struct("name", value.alias("v"))))))
    made = counted.groupBy("doc", "group", "instance").agg(
        entry(False, F.get("places", F.lit(0))).alias("fields"), entry(True, F.col("places")).alias("lists"), F.min(F.array_min("places")).alias("start"), F.max(F.array_max("places")).alias("end")
    )
    reach = F.max("end").over(Window.partitionBy("doc", "group").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    return made.withColumn("reach", reach).withColumn("apart", F.min(F.coalesce(F.col("start") > F.col("reach"), F.lit(True))).over(Window.partitionBy("doc", "group"))).drop("reach")
