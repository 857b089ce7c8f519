"""Invoices as files: a CSV sheet (K04), a workbook with summary and checks (K05), JSON lines.

rows are those of invoice.clean() or invoice.merged(), with levels and notes. Invoices stand in the order of file, page and number, a row for
each of their lines; one without lines has one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.values import formula_safe, percent
from brindle.operators.invoice import AMOUNTS, DATES, FIELDS, ITEM_FIELDS, KIND_NAMES, TAXES, as_json, to_look_at
from brindle.operators.ordering import numbered
from brindle.operators.pages import LEVEL_OF
from brindle.sources import one_file

#: The columns of the sheet and of the summary in their order, the titles that differ from the field's name, and widths.
COLUMNS = (
    "file", "InvoiceId", "InvoiceDate", "DueDate", "InvoiceTotal", "VendorName", "VendorAddress", "CustomerName", "CustomerId", "BillingAddress",
    "BillingAddressRecipient", "VendorAddressRecipient", "VendorGST", "CustomerGST", "Description", "Qty", "UnitPrice", "UnitAmount", "Discount",
    "TaxableValue", "CGSTAmount", "SGSTAmount", "IGSTAmount", "TotalTaxAmount", "HSNSAC", "Currency", "kind", "confidence",
)
SUMMARY = ("file", "InvoiceId", "InvoiceDate", "VendorName", "VendorGST", "CustomerName", "lines", "TaxableValue", *TAXES, "TotalTaxAmount", "InvoiceTotal", "Currency", "kind", "confidence")
CHECKS = ("Invoice File Name", "Row", "Pages", "Kind", "Fields", "Level", "Note")
TITLES = {"file": "Invoice File Name", "InvoiceDate": "Invoice Date", "kind": "DocumentType", "confidence": "Confidence", "lines": "Lines"}
WIDTHS = {
    "file": 34, "InvoiceId": 20, "InvoiceTotal": 14, "VendorName": 30, "VendorAddress": 44, "CustomerName": 30, "CustomerId": 14, "BillingAddress": 44,
    "BillingAddressRecipient": 30, "VendorAddressRecipient": 30, "VendorGST": 19, "CustomerGST": 19, "confidence": 11, "Description": 44, "Qty": 12,
    "UnitPrice": 12, "TaxableValue": 14, "TotalTaxAmount": 15, "Discount": 12, "HSNSAC": 12, "Currency": 9, "lines": 8,
}
OTHER_WIDTH = 13
CHECK_WIDTHS = (34, 6, 8, 10, 34, 8, 90)
NUMBERS = (*AMOUNTS, "UnitPrice", "UnitAmount")
WRAPPED = ("VendorAddress", "BillingAddress", "Description")


def _title(f: str) -> str:
    return TITLES.get(f, f)


def _kind() -> Column:
    names = F.create_map(*[F.lit(x) for pair in KIND_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.col("kind")), F.lit(""))


def sheet(rows: DataFrame, repeat_details: bool = False, repeat_totals: bool = False) -> DataFrame:
    """The 28 columns as they are read, named by field, and for each row _keys (what it is sorted by), _first and its _levels by field.

    An invoice's own values stand on its first row only, unless its details or its amounts are to repeat.
    """
    lines = rows.select("*", F.posexplode_outer("Items").alias("_line", "_item"))
    line = F.coalesce("_line", F.lit(0))
    first = line == 0
    columns = {}
    for f in COLUMNS:
        if f in ITEM_FIELDS:
            columns[f] = F.coalesce(F.col(f"_item.{f}"), F.lit(""))
        else:
            shown = first | F.lit(repeat_totals if f in AMOUNTS else repeat_details)
            value = _kind() if f == "kind" else F.col(f).cast("string")
            columns[f] = F.when(shown, F.coalesce(value, F.lit(""))).otherwise("")
    levels = [x for f in FIELDS for x in (F.lit(f), F.when(first, F.col(f"{f}_level")))] + [x for f in ITEM_FIELDS for x in (F.lit(f), F.col(f"_item.{LEVEL_OF[f]}"))]
    keys = F.struct("file", "page", F.col("InvoiceId").alias("id"), line.alias("line"))
    return lines.select(*[c.alias(f) for f, c in columns.items()], keys.alias("_keys"), first.alias("_first"), F.create_map(*levels).alias("_levels"))


def csv_rows(rows: DataFrame, repeat_details: bool = False, repeat_totals: bool = False) -> DataFrame:
    """The sheet under its titles, in order: confidence in percent, and no cell that a spreadsheet would run."""
    cells = sheet(rows, repeat_details, repeat_totals).orderBy("_keys")
    shown = lambda f: F.coalesce(percent(F.col(f).try_cast("double")), F.lit("")) if f == "confidence" else formula_safe(F.col(f))
    return cells.select(*[shown(f).alias(_title(f)) for f in COLUMNS])


def write_csv(rows: DataFrame, path: str, repeat_details: bool = False, repeat_totals: bool = False, overwrite: bool = False) -> None:
    """One CSV file with a byte order mark."""
    one_file.write_csv(csv_rows(rows, repeat_details, repeat_totals), path, overwrite)


def write_json(rows: DataFrame, path: str) -> None:
    """A folder of JSON lines, one for each invoice, with everything read, levels and notes."""
    as_json(rows).select("json").write.text(path)


def _cell(f: str, form: str, level: Column | None = None) -> Column:
    """A value as it is stored in a workbook: figures and days as numbers, all else as text (never a formula, and 00123 keeps its zeros)."""
    value, number = F.col(f), F.col(f).try_cast("double")
    kind = F.lit("wrapped" if f in WRAPPED else "text")
    if f in DATES:
        day = F.datediff(F.try_to_date(value, form), F.lit("1899-12-30"))
        value, kind = F.coalesce(day.cast("string"), value), F.when(day.isNotNull(), "date").otherwise(kind)
    elif f in NUMBERS or f == "confidence":
        good = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
        kind = F.when(good, "percent" if f == "confidence" else "number").otherwise(kind)
        value = F.when(good, number.cast("string")).otherwise("" if f == "confidence" else value)
    elif f == "lines":
        value, kind = F.when(value > 0, value.cast("string")), F.lit("text")
    if level is not None:
        kind = F.concat(kind, F.when(level == "check", "!").otherwise(""))
    return F.struct(value.cast("string").alias("value"), kind.alias("style"))


def _total(lines: DataFrame, name: str, columns: tuple, keys: Column) -> DataFrame:
    """The row that adds up a sheet: an invoice's figures once, whatever repeats; prices aren't added. Figures are summed as decimals."""
    number = lambda f: F.col(f).try_cast("decimal(30,6)")
    once = {f: F.sum(number(f) if f in ITEM_FIELDS else F.when(F.col("_first"), number(f))) for f in columns if f in NUMBERS and f != "UnitPrice"}
    sums = lines.agg(*[F.round(c, 2).cast("double").alias(f) for f, c in once.items()]).where(F.coalesce(*once).isNotNull())
    cells = [F.struct(F.lit("Total").alias("value"), F.lit("bold").alias("style"))] + [F.struct((F.col(f).cast("string") if f in once else F.lit("")).alias("value"), F.lit("number" if f in once else "text").alias("style")) for f in columns[1:]]
    return sums.select(F.lit(name).alias("sheet"), F.lit(True).alias("foot"), F.array(*cells).alias("cells"), keys.alias("at"))


def workbook_rows(rows: DataFrame, form: str = "dd-MM-yyyy", repeat_details: bool = False, repeat_totals: bool = False, summary: bool = False, checks: bool = False, totals: bool = False) -> tuple[DataFrame, list[dict]]:
    """Rows (sheet, foot, cells) in order, and the sheets they belong to: Invoices, and as asked for Summary and Checks."""
    lines = numbered(sheet(rows, repeat_details, repeat_totals), "_keys")
    made = [lines.select(F.lit("Invoices").alias("sheet"), F.lit(False).alias("foot"), F.array(*[_cell(f, form, F.try_element_at("_levels", F.lit(f))) for f in COLUMNS]).alias("cells"), "at")]
    sheets = [{"name": "Invoices", "header": [_title(f) for f in COLUMNS], "widths": [WIDTHS.get(f, OTHER_WIDTH) for f in COLUMNS], "freeze": "B2", "filter": True}]
    if totals:
        made.append(_total(lines, "Invoices", COLUMNS, F.lit(0).cast("long")))
    starts = lines.where("_first").groupBy(F.col("_keys.file").alias("file"), F.col("_keys.page").alias("page")).agg((F.min("at") + 2).alias("start"))
    if summary:
        full = F.filter("Items", lambda x: F.concat(*[F.coalesce(x.getField(f), F.lit("")) for f in ITEM_FIELDS]) != "")
        each = rows.select("page", F.lit(True).alias("_first"), *[(_kind() if f == "kind" else F.size(full) if f == "lines" else F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f) for f in SUMMARY], *[F.col(f"{f}_level") for f in FIELDS])
        each = numbered(each, "file", "page", "InvoiceId")
        made.append(each.select(F.lit("Summary").alias("sheet"), F.lit(False).alias("foot"), F.array(*[_cell(f, form, F.col(f"{f}_level") if f in FIELDS else None) for f in SUMMARY]).alias("cells"), "at"))
        sheets.append({"name": "Summary", "header": [_title(f) for f in SUMMARY], "widths": [WIDTHS.get(f, OTHER_WIDTH) for f in SUMMARY], "freeze": "B2", "filter": True})
        if totals:
            made.append(_total(each, "Summary", SUMMARY, F.lit(0).cast("long")))
    if checks:
        numbers = F.array_join(F.col("page_numbers").cast("array<string>"), ", ") if "page_numbers" in rows.columns else F.col("page").cast("string")
        of = rows.groupBy("file", "page").agg(F.min(numbers).alias("pages"), F.min("kind").alias("kind"))
        look = to_look_at(rows).join(of, ["file", "page"]).join(starts, ["file", "page"])
        values = (F.col("file"), F.col("start").cast("string"), F.col("pages"), F.col("kind"), F.col("fields"), F.col("level"), F.col("note"))
        cells = F.array(*[F.struct(F.coalesce(c, F.lit("")).alias("value"), F.lit("number" if i == 1 else "text").alias("style")) for i, c in enumerate(values)])
        made.append(numbered(look, "start", "fields").select(F.lit("Checks").alias("sheet"), F.lit(False).alias("foot"), cells.alias("cells"), "at"))
        sheets.append({"name": "Checks", "header": list(CHECKS), "widths": list(CHECK_WIDTHS), "freeze": "A2"})
    all_rows = made[0]
    for more in made[1:]:
        all_rows = all_rows.unionByName(more)
    return all_rows.orderBy("sheet", "foot", "at").select("sheet", "foot", "cells"), sheets


def write_workbook(rows: DataFrame, path: str, overwrite: bool = False, most_rows: int = one_file.MOST_ROWS, **asked) -> None:
    """One XLSX file; asked are the options of workbook_rows()."""
    cells, sheets = workbook_rows(rows, **asked)
    one_file.write_workbook(cells, path, sheets, overwrite, most_rows)
