import datetime as dt

import pytest
from pyspark.sql import functions as F

from brindle.functions import taxid, values


def one(spark, f, *texts):
    row = spark.createDataFrame([tuple(texts)], ", ".join(f"c{i} string" for i in range(len(texts)))).select(f(*[F.col(f"c{i}") for i in range(len(texts))]).alias("x")).first()
    return row.x


def many(spark, f, pairs):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, c string").select("i", f(F.col("c")).alias("x")).collect()
    got = {r.i: r.x for r in rows}
    assert [got[i] for i in range(len(pairs))] == [w for _, w in pairs]


def test_numbers(spark):
    many(spark, values.sheet_number, [("₹1,23,456.50", 123456.5), ("Rs.500", 500.0), ("Rs. 1,200.50", 1200.5), ("-₹5", -5.0), ("12%", 12.0), ("abc", None), ("1,2", None), ("$ 3", 3.0), (None, None)])
    many(spark, values.amount, [("₹ 1,17,977.58", 117977.58), ("6451/-", 6451.0), ("none", None)])
    many(spark, values.money, [("9% 4,725.00", 4725.0), ("9%", None)])
    many(spark, values.chart_number, [("₹1,200.50", 1200.5), ("1e3", 1000.0), ("n/a", None), ("1e999", None)])


def test_dates(spark):
    d = dt.date
    many(spark, values.sheet_date, [("31/01/2026", d(2026, 1, 31)), ("1/2/2026", d(2026, 2, 1)), ("2026-03-04", d(2026, 3, 4)), ("5-Mar-85", d(1985, 3, 5)), ("5-Mar-26", d(2026, 3, 5)), ("March 5, 2026", d(2026, 3, 5)), ("5 MARCH 2026", d(2026, 3, 5)), ("31/02/2026", None), ("x", None)])
    many(spark, values.invoice_date, [("03/04/2026", d(2026, 4, 3)), ("03/31/2026", d(2026, 3, 31)), ("2nd Sept 2026 10:30 am", d(2026, 9, 2)), ("Jan 5, 26", d(2026, 1, 5)), ("2026-02-03", d(2026, 2, 3)), ("1/1/1999", None), ("30/02/2026", None), ("hello", None)])


def test_words_amount(spark):
    many(spark, values.words_amount, [("INR Sixty One Thousand Nine Hundred Fifty Only", 61950.0), ("Two lakhs three", 200003.0), ("Seventy Seven and Fifty Eight Paise", 77.58), ("Rupees ten and paise five only", 10.05), ("five apples", None), ("only", None)])


def test_texts(spark):
    many(spark, values.answer, [(' "Acme\n\nPune" ', "Acme, Pune"), ("N/A", ""), (None, ""), ("a,, b", "a, b")])
    many(spark, values.keywords, [("What is the Sick leave limit, the limit?", ["sick", "leave", "limit"]), ("what is it", ["what", "is", "it"])])
    many(spark, values.formula_safe, [("=1+1", "'=1+1"), ("@x", "'@x"), ("+x", "'+x"), ("-5.00", "-5.00"), ("a", "a")])
    many(spark, values.unfenced, [("```md\nhello\n```", "hello"), ("hello", "hello")])
    many(spark, values.currency, [("₹ 5", "INR"), ("S$ 3", "SGD"), ("US$ or €", ""), ("20 dollars", "USD")])
    assert one(spark, lambda c: values.column_name(c, F.lit("column_1")), "Amount (₹)") == "amount"
    assert one(spark, lambda c: values.column_name(c, F.lit("column_1")), "2026 total") == "c_2026_total"
    assert one(spark, lambda c: values.snapped(c, ["Yes", "No"]), "yes.") == "Yes"
    assert one(spark, lambda v, t: values.amount_in_text(v.cast("double"), t), "1200", "Total 1,200.00 paid")
    assert not one(spark, lambda v, t: values.amount_in_text(v.cast("double"), t), "200", "Total 1,200.00 paid")
    assert one(spark, lambda a, b: values.words_present(a, b), "12 Park Street Pune", "park street, 12 pune")
    assert one(spark, lambda c: values.first_json(c).cast("string"), 'well {"a": 1} ok') == '{"a":1}'


def _id(first14: str) -> str:
    alphabet, total = taxid.ALPHABET, 0
    for i, ch in enumerate(first14):
        p = alphabet.index(ch) * (2 if i % 2 else 1)
        total += p // 36 + p % 36
    return first14 + alphabet[(36 - total % 36) % 36]


@pytest.mark.parametrize("stem", ["29ABCDE1234F1Z", "07XYZAB9876K2Z"])
def test_tax_ids(spark, stem):
    good = _id(stem)
    assert one(spark, taxid.valid, good) and not one(spark, taxid.valid, good[:-1] + ("A" if good[-1] != "A" else "B"))
    assert one(spark, taxid.ids_in, f"GST {good[:4]} {good[4:]} and {good}") == [good]
    assert one(spark, taxid.repaired, good, "").level == "ok"
    misread = good.replace("0", "O", 1) if "0" in good[:2] else good[:7] + good[7:11].replace("1", "I", 1) + good[11:]
    assert tuple(one(spark, taxid.repaired, misread, ""))[:2] == (good, "ok")
    wrong = good[:3] + ("Q" if good[3] != "Q" else "R") + good[4:]
    assert tuple(one(spark, taxid.repaired, wrong, f"id {good}"))[:2] == (good, "ok")
    assert one(spark, taxid.repaired, wrong, "").level == "check"
    assert one(spark, taxid.repaired, "ABCDE1234F", "").level == "empty"
    assert one(spark, taxid.repaired, "12", "").level == "check"
