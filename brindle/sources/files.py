"""Texts of files: plain text and Word documents, by Spark's binaryFile source."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str | None:
    """Text, tabs and breaks of word/document.xml; None if it isn't a Word document."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    marks = {f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n"}
    lines = ["".join(x.text or "" if x.tag == f"{WORD}t" else marks.get(x.tag, "") for x in p.iter()) for p in root.iter(f"{WORD}p")]
    return "\n".join(lines).strip()


def read_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, text, problem) of the files of a folder; what can't be read has a problem and no text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)

    @F.pandas_udf("string")
    def word(contents: pd.Series) -> pd.Series:
        return contents.map(docx_text)

    plain = F.when(~F.contains("content", F.lit(b"\x00")), F.make_valid_utf8(F.col("content").cast("string")))
    text = F.when(F.lower("path").endswith(".docx"), word("content")).otherwise(F.regexp_replace(plain, "^﻿", ""))
    return files.where(~F.col("path").rlike(r"/\.[^/]*$")).select("path", text.alias("text")).withColumn("problem", F.when(F.col("text").isNull(), "it is not a text"))


def capped_sections(sections: DataFrame, most_chars: int) -> DataFrame:
    """Sections (name, position, label, text) of each document up to so many characters; the one that crosses the limit is cut."""
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("name").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = sections.withColumn("_before", before).where(F.col("_before") < most_chars)
    return kept.withColumn("text", F.left("text", F.lit(most_chars) - F.col("_before"))).drop("_before")


def tidy_layout(c):
    """Runs of spaces cut to 6, of line ends to 2."""
    return F.regexp_replace(F.regexp_replace(c, " {7,}", "      "), r"\n{3,}", "\n\n")
