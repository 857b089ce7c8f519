"""Lines of invoices (I09) that need no cleaning, column by column: what most lines are, and what invoice.items() need not look at again.

A line is tidy if its texts are single words with single spaces and its figures plainly written ones ("12.50"), which stay as they are. A
record without a page's text whose lines are all tidy is answered here; for any other one the answer is null, and the expressions of
invoice.items() say what becomes of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

GIVEN = ("Description", "Qty", "UnitPrice", "Amount", "HSNSAC")
#: Words of printable ASCII without commas and quotes; whole codes; figures, and figures as they are written in the end.
WORDS, CODE, FIGURE, WRITTEN = r"\A[!#-+\--~]+( [!#-+\--~]+)*\z", r"\A[0-9]{4,8}\z", r"\A(0|[1-9][0-9]{0,12})(\.[0-9]{1,2})?\z", r"\A(0|[1-9][0-9]{0,12})\.[0-9]{2}\z"


def _true(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False).astype(bool)


def _picked(where: np.ndarray, then: str, other: np.ndarray | str) -> np.ndarray:
    return np.where(where, then, other)


def cleaned(listed: pa.Array, text: pa.Array, names: tuple[str, ...], maybe_not: str, non_answers: tuple[str, ...], most: int, most_chars: int, round_off: float) -> pa.Array:
    """Cleaned lines of the records that are tidy, null for the others. names: the lines' values and levels."""
    n = len(listed)
    lengths = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lines, of = listed.flatten(), np.repeat(np.arange(n), lengths)
    said = {f: pc.fill_null(pc.struct_field(lines, f), "") for f in GIVEN}
    empty = {f: _true(pc.equal(c, "")) for f, c in said.items()}
    like = lambda f, pattern: empty[f] | _true(pc.match_substring_regex(said[f], pattern))
    tidy = like("HSNSAC", CODE) & like("Qty", FIGURE) & like("UnitPrice", WRITTEN) & like("Amount", WRITTEN)
    words = said["Description"]
    tidy &= like("Description", WORDS) & ~_true(pc.match_substring_regex(words, maybe_not)) & (pc.binary_length(words).to_numpy(zero_copy_only=False) <= most_chars)
    tidy &= ~_true(pc.is_in(pc.utf8_lower(words), value_set=pa.array([x for x in non_answers if x])))
    fine = np.bincount(of[~tidy], minlength=n) == 0
    fine &= (lengths <= most) & _true(pc.equal(pc.utf8_trim(pc.fill_null(text, ""), " "), ""))
    said["Description"] = pc.utf8_rtrim(words, " ;,")
    empty["Description"] = _true(pc.equal(said["Description"], ""))

    real = fine[of] & ~(np.logical_and.reduce(list(empty.values())))
    kept = np.flatnonzero(real)
    of, at = of[kept], pa.array(kept)
    said, empty = {f: c.take(at) for f, c in said.items()}, {f: x[kept] for f, x in empty.items()}
    number = {f: pc.cast(pc.replace_with_mask(said[f], pa.array(empty[f]), pa.scalar("nan")), pa.float64()).to_numpy(zero_copy_only=False) for f in ("Qty", "UnitPrice", "Amount")}
    sums = np.abs(number["Qty"] * number["UnitPrice"] - number["Amount"]) <= round_off
    proven = _picked(sums, "ok", "read")
    levels = [_picked(empty["Amount"], "empty", proven), _picked(empty["Description"], "empty", "read"), _picked(empty["Qty"], "empty", proven), _picked(empty["UnitPrice"], "empty", proven), _picked(empty["HSNSAC"], "empty", "read")]
    counts = np.bincount(of, minlength=n)
    blank = np.flatnonzero(fine & (counts == 0))  # at least one, empty, line
    order = pa.array(np.argsort(np.concatenate([of, blank]), kind="stable"))
    counts[blank] = 1
    filled = lambda x, by: pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.string()), pa.array([by] * len(blank), pa.string())]).take(order)
    columns = [filled(x, "") for x in said.values()] + [filled(x, "empty") for x in levels]
    ends = np.concatenate([[0], np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, list(names)), mask=pa.array(~fine))


def tidy_lines(listed: Column, text: Column, kind: str, **fixed) -> Column:
    """cleaned() as a column; kind is its type."""

    @F.arrow_udf(kind)
    def run(listed: pa.Array, text: pa.Array) -> pa.Array:
        return cleaned(listed, text, **fixed)

    return run(listed, text)
