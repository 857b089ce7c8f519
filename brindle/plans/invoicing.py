"""Queries of the invoice pipeline, over invoices made of orders: an order is an invoice, its lines are the lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.catalog import table
from brindle.functions import taxid, values
from brindle.operators import invoice
from brindle.plans.book import Book

BOOK = Book()
query = BOOK.query
YEAR = 1998

#: Every fifth order's total is wrong, every seventh gives one tax as both halves, every eleventh has seller and buyer alike.
_BASE = """orders.o_orderkey AS k, c_name, s_name, coalesce(net, 0::DOUBLE) AS net, coalesce(tax, 0::DOUBLE) AS tax, n, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey
  LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice) * 100)::BIGINT / 100 AS net, (round(sum(l_extendedprice) * 100)::BIGINT * 18 // 100) / 100 AS tax, count(*) AS n, min(l_suppkey) AS sk FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
  LEFT JOIN supplier ON s_suppkey = sk"""


def records(spark, d):
    """One record per order, as a reader of pages would give it."""
    lines = table(spark, d, "lineitem")
    text = lambda c: F.format_string("%.2f", c)
    item = lambda x: F.struct(F.concat(F.lit("part "), x["l_partkey"]).alias("Description"), x["l_quantity"].cast("long").cast("string").alias("Qty"), text(x["l_extendedprice"] / x["l_quantity"]).alias("UnitPrice"), text(x["l_extendedprice"]).alias("Amount"), F.lit("").alias("HSNSAC"))
    per_order = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.round(F.sum("l_extendedprice") * 100).cast("long").alias("cents"),
        F.min("l_suppkey").alias("s_suppkey"),
        F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")).alias("lines"),
    )
    made = F.transform("lines", lambda x: F.struct(x["l_linenumber"], x["l_partkey"], item(x).alias("item")))  # figures are shuffled, not their texts
    per_order = per_order.withColumn("Items", F.transform(F.array_sort(made), lambda x: x["item"])).drop("lines")
    per_order = per_order.withColumns({"net": F.col("cents") / 100, "tax": F.floor(F.col("cents") * 18 / 100) / 100})
    orders = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    rows = orders.join(per_order, "o_orderkey", "left").join(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "left")
    k = F.col("o_orderkey")
    net, tax = F.coalesce("net", F.lit(0.0)), F.coalesce("tax", F.lit(0.0))
    seller = F.when(k % 11 == 0, F.col("c_name")).otherwise(F.col("s_name"))
    shown = net + tax + F.when(k % 5 == 0, F.lit(100.0)).otherwise(F.lit(0.0))
    empty = F.lit("")
    given = {
        "kind": F.when(k % 13 == 0, "other").otherwise("invoice"),
        "InvoiceId": F.concat(F.lit("INV-"), k),
        "InvoiceDate": F.date_format("o_orderdate", "dd/MM/yyyy"),
        "DueDate": F.when(k % 3 == 0, "net 30 days").otherwise(F.date_format(F.date_add(F.col("o_orderdate").cast("date"), F.lit(30)), "d MMM yyyy")),
        "InvoiceTotal": F.concat(F.lit("Rs. "), text(shown)),
        "VendorName": seller,
        "CustomerName": F.col("c_name"),
        "TaxableValue": text(net),
        "CGSTAmount": F.when(k % 7 == 0, text(tax)).otherwise(empty),
        "SGSTAmount": F.when(k % 7 == 0, text(tax)).otherwise(empty),
        "IGSTAmount": F.when(k % 7 != 0, text(tax)).otherwise(empty),
        "Discount": F.lit("9%"),
    }
    blank = [f for f in invoice.FIELDS if f not in given and f not in ("TotalTaxAmount", "Currency")] + ["TotalInWords", "TotalTax", "page_text"]
    columns = [v.alias(f) for f, v in given.items()] + [F.lit("").alias(f) for f in blank]
    return rows.select(F.concat(F.lit("order-"), k, F.lit(".pdf")).alias("file"), F.lit(1).alias("page"), "Items", F.array().cast("array<string>").alias("unsure"), *columns)


def _clean(spark, d):
    return invoice.clean(records(spark, d), YEAR)


def _read(spark, d):
    """Pages whose invoices aren't finished: all that columns other than levels of lines and the confidence need."""
    return invoice.read(records(spark, d), YEAR)


_KEPT = f"(SELECT 'order-' || k || '.pdf' AS file, * FROM (SELECT {_BASE}) WHERE k % 13 <> 0)"
_TOTAL = "(net + tax + CASE WHEN k % 5 = 0 THEN 100 ELSE 0 END)"


@query("I02_kinds_kept", f"SELECT file FROM {_KEPT}")
def kinds_kept(spark, d):
    return invoice.texts(records(spark, d)).select("file")


@query("I06_seller_is_buyer", f"SELECT file, k % 11 = 0 AS flagged FROM {_KEPT} WHERE n IS NOT NULL")
def seller_is_buyer(spark, d):
    rows = invoice.texts(records(spark, d)).where("VendorName <> '' AND size(Items) > 0")
    return rows.select("file", (F.col("VendorName_level") == "check").alias("flagged"))


@query(
    "I07_dates",
    f"""SELECT file, CASE WHEN year(o_orderdate) BETWEEN 2000 AND 2100 THEN strftime(o_orderdate, '%d-%m-%Y') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS issued,
        CASE WHEN year(o_orderdate) BETWEEN 2000 AND 2004 THEN 'read' ELSE 'check' END AS issued_level,
        CASE WHEN k % 3 = 0 THEN '' WHEN year(o_orderdate + INTERVAL 30 DAY) BETWEEN 2000 AND 2100 THEN strftime(o_orderdate + INTERVAL 30 DAY, '%d-%m-%Y')
             ELSE strftime(o_orderdate + INTERVAL 30 DAY, '%-d %b %Y') END AS due FROM (SELECT * FROM {_KEPT})""",
)
def dates(spark, d):
    """Dates are read for 2000 to 2100; an older one is left as it is written, and flagged."""
    rows = invoice.dates(invoice.texts(records(spark, d)), YEAR + 5)
    return rows.select("file", F.col("InvoiceDate").alias("issued"), F.col("InvoiceDate_level").alias("issued_level"), F.col("DueDate").alias("due"))


@query("I09_lines", f"SELECT 'order-' || o_orderkey || '.pdf' AS file, greatest(coalesce(n, 0), 1)::BIGINT AS lines, coalesce(round(s, 2), 0) AS amount FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey % 13 <> 0")
def lines(spark, d):
    rows = invoice.items(invoice.texts(records(spark, d)))
    amount = F.aggregate("Items", F.lit(0.0), lambda s, x: s + F.coalesce(F.nullif(x["UnitAmount"], F.lit("")).cast("double"), F.lit(0.0)))
    return rows.select("file", F.size("Items").cast("long").alias("lines"), F.round(amount, 2).alias("amount"))


@query("I10_taxes", f"SELECT file, CASE WHEN tax > 0 THEN printf('%.2f', CASE WHEN k % 7 = 0 THEN 2 * tax ELSE tax END) ELSE '' END AS tax_total, '' AS discount FROM {_KEPT}")
def taxes(spark, d):
    rows = invoice.taxes(invoice.total(invoice.texts(records(spark, d))))
    return rows.select("file", F.col("TotalTaxAmount").alias("tax_total"), F.col("Discount").alias("discount"))


@query(
    "I12_balance",
    f"""SELECT file, CASE WHEN twice OR one OR (k % 7 <> 0 AND k % 5 <> 0) THEN 'ok' ELSE 'check' END AS base_level, CASE WHEN tax > 0 AND (k % 7 <> 0 OR one) THEN printf('%.2f', tax) ELSE '' END AS igst,
        CASE WHEN tax > 0 AND k % 7 = 0 AND NOT one THEN printf('%.2f', tax) ELSE '' END AS cgst FROM
        (SELECT *, NOT twice AND k % 7 = 0 AND k % 5 <> 0 AND tax > 0 AS one FROM (SELECT *, k % 7 = 0 AND abs(tax - CASE WHEN k % 5 = 0 THEN 100 ELSE 0 END) <= 1.01 AS twice FROM {_KEPT}))""",
)
def balance(spark, d):
    """Totals that are off are flagged; one tax given as both halves becomes IGST where that makes the total."""
    rows = invoice.balance(invoice.taxes(invoice.total(invoice.texts(records(spark, d)))))
    return rows.select("file", F.col("TaxableValue_level").alias("base_level"), F.col("IGSTAmount").alias("igst"), F.col("CGSTAmount").alias("cgst"))


@query("I17_lines_and_totals", f"SELECT file, n IS NOT NULL AS lines_ok FROM {_KEPT}")
def lines_and_totals(spark, d):
    """Every line's amount is its quantity times its price; an invoice without lines has one, empty."""
    return _clean(spark, d).select("file", F.forall("Items", lambda x: x["level"] == "ok").alias("lines_ok"))


@query("I18_confidence")
def confidence(spark, d):
    return _clean(spark, d).select("file", "confidence")


@query(
    "I19_flattened",
    """SELECT 'order-' || o_orderkey || '.pdf' AS file, line, CASE WHEN line = 0 THEN 'INV-' || o_orderkey ELSE '' END AS InvoiceId, Description FROM
       (SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey) - 1)::BIGINT AS line, coalesce('part ' || l_partkey, '') AS Description FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 13 <> 0)""",
)
def flattened(spark, d):
    sheet = invoice.flattened(_read(spark, d))
    return sheet.select("file", F.col("line").cast("long").alias("line"), F.when(F.col("line") == 0, F.col("InvoiceId")).otherwise(F.lit("")).alias("InvoiceId"), "Description")


@query("I20_totals", f"SELECT round(sum({_TOTAL}), 1) AS total, round(sum(net), 1) AS base FROM {_KEPT}")
def totals(spark, d):
    return invoice.totals(invoice.flattened(_read(spark, d))).select(F.round("InvoiceTotal", 1).alias("total"), F.round("TaxableValue", 1).alias("base"))


@query("I16_merged_pages")
def merged_pages(spark, d):
    """Orders of one customer as pages of one file; every third page repeats the number before it, every fifth has no heading."""
    from pyspark.sql import Window

    pages = _read(spark, d).withColumn("file", F.col("CustomerName"))
    page = F.row_number().over(Window.partitionBy("file").orderBy("InvoiceId"))
    pages = pages.withColumn("page", page).withColumn("InvoiceId", F.when(F.col("page") % 3 == 0, F.lag("InvoiceId").over(Window.partitionBy("file").orderBy("page"))).otherwise(F.col("InvoiceId")))
    bare = F.col("page") % 5 == 0
    return invoice.merged(pages.withColumns({f: F.when(bare, F.lit("")).otherwise(F.col(f)) for f in ("InvoiceId", "VendorName", "CustomerName", "InvoiceDate")}))


@query("K04_formula_safe", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '''=' || p_name WHEN p_size % 4 = 1 THEN '''@' || p_name ELSE p_name END AS cell FROM part")
def formula_safe(spark, d):
    cell = F.concat(F.when(F.col("p_size") % 4 == 0, "=").when(F.col("p_size") % 4 == 1, "@").otherwise(""), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", values.formula_safe(cell).alias("cell"))


@query("K10_newest_version", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def newest_version(spark, d):
    return invoice.best_version(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("F01_sheet_numbers", "SELECT o_orderkey, round(o_totalprice, 2) AS n FROM orders")
def sheet_numbers(spark, d):
    """Totals written with commas and currency marks, read back."""
    mark = F.element_at(F.array(*map(F.lit, ("₹", "Rs. ", "$", ""))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.round(values.sheet_number(F.concat(mark, F.format_number("o_totalprice", 2))), 2).alias("n"))


@query("F02_sheet_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def sheet_dates(spark, d):
    """Dates written in four of the forms, read back."""
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    written = F.when(k == 0, F.date_format(day, "dd/MM/yyyy")).when(k == 1, F.date_format(day, "yyyy-MM-dd")).when(k == 2, F.date_format(day, "d-MMM-yyyy")).otherwise(F.date_format(day, "MMMM d, yyyy"))
    return table(spark, d, "orders").select("o_orderkey", values.sheet_date(written).cast("string").alias("day"))


@query("F10_invoice_dates", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 20 YEAR, '%Y-%m-%d') AS day FROM orders")
def invoice_dates(spark, d):
    day = F.add_months(F.col("o_orderdate").cast("date"), 240)
    k = F.col("o_orderkey") % 3
    written = F.when(k == 0, F.date_format(day, "dd/MM/yyyy 10:30 'am'")).when(k == 1, F.date_format(day, "d'th' MMM, yyyy")).otherwise(F.date_format(day, "yyyy.MM.dd"))
    return table(spark, d, "orders").select("o_orderkey", values.invoice_date(written).cast("string").alias("day"))


@query("F09_money", "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS n FROM lineitem")
def money(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(values.money(F.concat(F.lit("9% Rs "), F.format_number("l_extendedprice", 2), F.lit("/-"))), 2).alias("n"))


_ALPHABET = f"'{taxid.ALPHABET}'"
_STEM = "(lpad((o_orderkey % 90 + 10)::VARCHAR, 2, '0') || 'ABCDE' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || chr((65 + o_orderkey % 26)::INT) || '1Z')"


@query(
    "F20_tax_id_check_digits",
    f"""SELECT o_orderkey, substr({_ALPHABET}, ((36 - list_sum(list_transform(range(1, 15), lambda i: ((strpos({_ALPHABET}, substr(stem, i, 1)) - 1) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)) // 36
        + ((strpos({_ALPHABET}, substr(stem, i, 1)) - 1) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)) % 36)) % 36) % 36 + 1)::INT, 1) AS digit FROM (SELECT o_orderkey, {_STEM} AS stem FROM orders)""",
)
def tax_id_check_digits(spark, d):
    k = F.col("o_orderkey")
    stem = F.concat(F.lpad((k % 90 + 10).cast("string"), 2, "0"), F.lit("ABCDE"), F.lpad((k % 10000).cast("string"), 4, "0"), F.char(65 + k % 26), F.lit("1Z"))
    return table(spark, d, "orders").select("o_orderkey", taxid.check_digit(stem).alias("digit"))


@query("F37_slugs", "SELECT p_partkey, substr(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40) AS slug FROM part")
def slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", values.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


@query("F50_hashes", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md5 FROM documents")
def hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"))


@query("F52_json_field", "SELECT event_type, sum((json_extract_string(props, '$.k'))::DOUBLE) AS total, count(*) AS n FROM events GROUP BY event_type")
def json_field(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("double")).alias("total"), F.count("*").alias("n"))
