"""GSTIN tax ids: check digit, validity, ids in a text, and repair of misread ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions import values

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FORM = r"\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]"
PAN = r"^[A-Z]{5}\d{4}[A-Z]$"
#: Characters that look alike, by what the place wants.
AS_DIGIT = ("OQDILSBZG", "000115826")
AS_LETTER = ("015826", "OISBZG")
#: What one character of an id that may be either is changed to.
SWAPS = ("O0I1S5B8Z2G6QD", "0O1I5S8B2Z6G00")


def check_digit(c: Column) -> Column:
    """base 36; every second character counts twice; the digits of each product are added."""

    def add(total, i):
        product = (F.instr(F.lit(ALPHABET), F.substring(c, i, F.lit(1))) - 1) * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.floor(product / 36).cast("int") + product % 36

    total = F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.lit(0), add)
    return F.substring(F.lit(ALPHABET), (F.lit(36) - total % 36) % 36 + 1, F.lit(1))


def valid(c: Column) -> Column:
    """the form, and the check digit."""
    return c.rlike(f"^{FORM}$") & (check_digit(c) == F.substring(c, 15, 1))


def ids_in(text: Column) -> Column:
    """every valid id of a text, also with spaces inside."""
    upper = F.upper(text)
    closed = F.regexp_replace(upper, "(?<=[0-9A-Z]) {1,3}(?=[0-9A-Z])", "")
    found = F.concat(*[F.regexp_extract_all(t, F.lit(FORM), F.lit(0)) for t in (upper, closed)])
    return F.array_distinct(F.filter(found, valid))


def _distance(a: Column, b: Column) -> Column:
    places = F.sequence(F.lit(1), F.lit(15))
    return F.aggregate(places, F.lit(0), lambda n, i: n + (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))).cast("int"))


def repaired(c: Column, text: Column) -> Column:
    """struct (value, level, note): ok if the check digit or the text confirms it, read for one likely swap, else check; empty."""
    raw = F.upper(F.regexp_replace(c, "[^0-9A-Za-z]", ""))
    inside = F.regexp_extract(raw, FORM, 0)
    raw = F.when((F.length(raw) > 15) & (inside != ""), inside).otherwise(raw)
    return F.when(F.coalesce(c, F.lit("")) == "", _out(F.lit(""), "empty", "")).otherwise(values.bound(raw, lambda r: _judged(r, text)))


def _out(value: Column, level: str, note: str) -> Column:
    return F.struct(value.alias("value"), F.lit(level).alias("level"), F.lit(note).alias("note"))


def _judged(raw: Column, text: Column) -> Column:
    part = lambda a, n, table: F.translate(F.substring(raw, a, n), *table)
    fixed = F.concat(part(1, 2, AS_DIGIT), part(3, 5, AS_LETTER), part(8, 4, AS_DIGIT), part(12, 1, AS_LETTER), F.substring(raw, 13, 3))
    near = F.filter(ids_in(F.coalesce(text, F.lit(""))), lambda g: _distance(g, raw) <= 2)
    swaps = F.array(*[F.concat(F.substring(fixed, 1, at - 1), F.translate(F.substring(fixed, at, 1), *SWAPS), F.substring(fixed, at + 1, 15 - at)) for at in (13, 15)])
    swaps = F.filter(swaps, lambda s: (s != fixed) & valid(s))
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", _out(F.lit(""), "empty", ""))
        .when(raw.rlike(PAN), _out(F.lit(""), "empty", "a PAN is given here"))
        .when(F.length(raw) != 15, _out(raw, "check", "an id has 15 characters"))
        .when(valid(raw), _out(raw, "ok", ""))
        .when((fixed != raw) & valid(fixed), _out(fixed, "ok", "characters that look alike were corrected"))
        .when(F.size(near) == 1, _out(F.get(near, F.lit(0)), "ok", "corrected from the text"))
        .when(F.size(swaps) == 1, _out(F.get(swaps, F.lit(0)), "read", "one character was changed; compare"))
        .when(raw.rlike(f"^{FORM}$"), _out(raw, "check", "the check digit doesn't match"))
        .otherwise(_out(raw, "check", "not the form of an id"))
    )
