"""Cutting texts into overlapping pieces."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 1200, 200
WHITE = re.compile(r"\s+")
END_MARKS = ".!?:;"


def last_break(text: str, at: int, limit: int, least: int) -> int:
    """Where a piece from at ends: behind the last blank line, else sentence, else white space that ends in [least, limit]; else limit.

    The runs of white space are looked at once; what a run is follows from its line ends and from the character before it.
    """
    blank = sentence = space = 0
    for run in WHITE.finditer(text, at, limit):
        first, stop = run.span()
        if text.count("\n", first, stop) > 1:
            blank = max(blank, text.rfind("\n", first, stop) + 1)
        if first > at and text[first - 1] in END_MARKS:
            sentence = stop
        space = stop
    return next((place for place in (blank, sentence, space) if place >= least), limit)


def pieces(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Pieces of at most size characters that end at good breaks; the next one begins behind the first space of the overlap, if any."""
    text, found, at, end = re.sub(r"[ \t]+\n", "\n", text or "").strip(), [], 0, 0
    while end < len(text):
        end = len(text) if len(text) - at <= size else last_break(text, at, at + size, at + size // 2)
        found.append(text[at:end].strip())
        earliest = max(at + 1, end - overlap)
        at = text.find(" ", earliest, end) + 1 or earliest
    return [piece for piece in found if piece]


def chunks(docs: DataFrame, text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece with its position; other columns are kept, texts without a piece give no row."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pieces(t, size, overlap))

    others = [c for c in docs.columns if c != text_col]
    return docs.select(*others, F.posexplode(cut(F.col(text_col))).alias("position", "piece"))


def section_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Documents (name, sections array<struct<label, text>>) to (name, position, label, piece), numbered over the whole document."""
    flat = docs.select("name", F.posexplode("sections").alias("section", "s")).select("name", "section", F.col("s.label").alias("label"), F.col("s.text").alias("text"))
    cut = chunks(flat, size=size, overlap=overlap)
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("name").orderBy("section", "position")) - 1
    return cut.select("name", number.alias("position"), "label", "piece")


def line_pieces(text: str | None, size: int) -> list[str]:
    """Whole lines (between \n) as far as they fit into size; a line that is longer is cut by length. A short text is one piece."""
    if len(text or "") <= size:
        return [text or ""]
    done, now = [], ""
    for line in text.split("\n"):
        *whole, line = [line[k : k + size] for k in range(0, max(1, len(line)), size)]
        done += whole
        joined = f"{now}\n{line}" if now else line  # empty lines before the first of a piece leave no trace
        if now and len(joined) > size:
            done.append(now)
            joined = line
        now = joined
    return done + [now] * bool(now.strip())


#: Texts that are cut at once.
TOGETHER = 128


def line_chunks(docs: DataFrame, id_col: str, text_col: str = "text", size: int = 4000) -> DataFrame:
    """One row per piece of line_pieces() with its position."""

    def cut(batches):
        for batch in (whole.slice(at, TOGETHER) for whole in batches for at in range(0, len(whole), TOGETHER)):
            found = [line_pieces(t, size) for t in batch.column(1).to_pylist()]
            row = [i for i, pieces_ in enumerate(found) for _ in pieces_]
            columns = [batch.column(0).take(pa.array(row, pa.int32())), pa.array([n for p in found for n in range(len(p))], pa.int32()), pa.array([x for p in found for x in p], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "position", "piece"])

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(cut, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, position int, piece string")
