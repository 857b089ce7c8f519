"""Pages into invoices (I16, I17): whether a page goes on with an invoice depends on all that was gathered of it, so a file's pages are folded in order.

A file's pages come to one task, sorted. A walk over few columns tells which pages go together; all else is worked out for some
thousand pages at once, column by column. Values, levels, notes and lines are merged; what needs the whole invoice (lines against totals, levels of the line columns, the
confidence) is worked out once it is whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import values
from brindle.operators.invoice import AMOUNTS, EXPECTED, FIELDS, ITEM_FIELDS, ITEM_LEVELS, MISSING, POINTS, ROUND_OFF, WEIGHTS

#: Level of a line's value, by the value's name.
LEVEL_OF = dict(zip(("UnitAmount", "Description", "Qty", "UnitPrice", "HSNSAC"), ITEM_LEVELS, strict=True))
#: Levels from the most doubtful one on.
LEVELS = ("empty", "check", "read", "ok")
#: Pages that a task folds at once.
TOGETHER = 4096


class Fold:
    """Which pages go on with an invoice, page after page; of the open invoice only what that depends on is held."""

    def __init__(self):
        self.begun, self.file, self.page, self.total = False, None, 0, False

    def next(self, file, page, heads, texts, total: bool, bare: bool) -> str:
        """How a page goes on with the invoice before it: same (its number again), rest (a page without a heading, or of the same seller
        without number while no total is known), or not at all (''). heads, texts: of the number and the seller, whether there is one
        with its points, and what it is known by."""
        how = self._goes_on(file, page, heads, texts, bare)
        if not how:
            self.begun, self.file, self.heads, self.texts, self.total = True, file, list(heads), list(texts), False
        for i, (there, points) in enumerate(heads if how else ()):
            if there and (not self.heads[i][0] or how == "same" and points > self.heads[i][1]):
                self.heads[i], self.texts[i] = heads[i], texts[i]
        self.page, self.total = page, self.total or total
        return how

    def _goes_on(self, file, page, heads, texts, bare) -> str:
        if not self.begun or file != self.file or page <= self.page:
            return ""  # another file, or two documents on one page
        if self.texts[0] and self.texts[0] == texts[0]:
            return "same"
        if bare:
            return "rest"
        tail = not heads[0][0] and self.heads[0][0] and not self.total
        return "rest" if tail and self.texts[1] and self.texts[1] == texts[1] else ""


def _number(text: str | None) -> float | None:
    try:
        return float(text) if text else None
    except ValueError:
        return None


def _there(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.not_equal(column, ""), False).to_numpy(zero_copy_only=False)


def _rank(column: pa.Array) -> np.ndarray:
    """0 to 3: places in LEVELS."""
    return pc.fill_null(pc.index_in(column, value_set=pa.array(LEVELS)), 0).to_numpy(zero_copy_only=False)


def hows(rows: pa.RecordBatch, fold: Fold) -> list[str]:
    """How each page goes on with the invoice before it; '' begins one."""
    c = rows.column
    there = {f: _there(c(f)).tolist() for f in ("InvoiceId", "VendorName", "CustomerName", "InvoiceDate", "InvoiceTotal")}
    bare = [not any(x) for x in zip(*(there[f] for f in ("InvoiceId", "VendorName", "CustomerName", "InvoiceDate")), strict=True)]
    heads = zip(*(zip(there[f], _rank(c(f"{f}_level")).tolist(), strict=True) for f in ("InvoiceId", "VendorName")), strict=True)
    texts = zip(c("_key").to_pylist(), c("_seller").to_pylist(), strict=True)
    return [fold.next(*x) for x in zip(c("file").to_pylist(), c("page").to_pylist(), heads, texts, there["InvoiceTotal"], bare, strict=True)]


def _winners(rows: pa.RecordBatch, same: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """For each field the page that gives it: totals and taxes come from the later page; else what was missing is taken, and of the same
    number what is better known."""
    there, rank = {f: _there(rows.column(f)) for f in FIELDS}, {f: _rank(rows.column(f"{f}_level")) for f in FIELDS}
    found, groups, k = {f: starts.copy() for f in FIELDS}, np.flatnonzero(sizes > 1), 1
    while len(groups):
        at = starts[groups] + k
        for f in FIELDS:
            own = found[f][groups]
            takes = there[f][at] & (~there[f][own] | (f in AMOUNTS) | (same[at] & (rank[f][at] > rank[f][own])))
            found[f][groups] = np.where(takes, at, own)
        k += 1
        groups = groups[sizes[groups] > k]
    return found


def merge(rows: pa.RecordBatch, how: list[str], names: list[str]) -> pa.RecordBatch:
    """Whole invoices of whole groups of pages: values merged; lines against totals; the level of each line column (that of its most
    doubtful line); the confidence."""
    starts = np.flatnonzero(np.array([not h for h in how]))
    sizes, n = np.diff(np.append(starts, len(rows))), len(starts)
    group = np.repeat(np.arange(n), sizes)
    out = {name: rows.column(name).take(pa.array(starts)) for name in rows.schema.names if not name.startswith("_") and not name.endswith("_note")}
    notes = {}
    for f, at in _winners(rows, np.array([h == "same" for h in how], bool), starts, sizes).items():
        at = pa.array(at)
        out[f], out[f"{f}_level"], notes[f] = (rows.column(x).take(at) for x in (f, f"{f}_level", f"{f}_note"))
    unsure = np.bincount(group, pc.fill_null(rows.column("_items_unsure"), False).to_numpy(zero_copy_only=False), n) > 0

    # lines: a page's blank ones go once a later page has real ones
    listed = rows.column("Items")
    lines, of = listed.flatten(), pc.list_parent_indices(listed).to_numpy(zero_copy_only=False)
    real = np.any([_there(lines.field(f)) for f in ITEM_FIELDS], axis=0) if len(lines) else np.zeros(0, bool)
    later = np.ones(len(rows), bool)
    later[starts] = False
    more = np.bincount(group[of], real & later[of], n) > 0
    kept = np.flatnonzero(real | (~later[of] & ~more[group[of]]))
    lines, of, real = lines.take(pa.array(kept)), group[of[kept]], real[kept]
    ends = np.searchsorted(of, np.arange(n + 1))
    column = {f: lines.field(f) for f in (*ITEM_FIELDS, *ITEM_LEVELS)}

    # lines against totals
    said: list[dict] = [{} for _ in range(n)]
    for f in FIELDS:
        for d, x in zip(said, notes[f].to_pylist(), strict=True):
            if x:
                d[f] = x
    amounts, is_real = [_number(x) for x in column["UnitAmount"].to_pylist()], real.tolist()
    totals = zip(*([_number(x) for x in out[f].to_pylist()] for f in ("InvoiceTotal", "TaxableValue", "TotalTaxAmount", "Discount")), strict=True)
    add_up, total_level = np.zeros(n, bool), out["InvoiceTotal_level"].to_pylist()
    for i, ((total, base, tax, discount), a, b) in enumerate(zip(totals, ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        own = [x for x, there in zip(amounts[a:b], is_real[a:b], strict=True) if there]
        if not own or total is None or None in own:
            continue
        made, less, back = sum(own), tax or 0.0, discount or 0.0
        on_total = any(abs(made - x) <= ROUND_OFF for x in (total, total - less, total - less + back))
        if on_total or base is not None and any(abs(made - x) <= ROUND_OFF for x in (base, base + back)):
            add_up[i] = True
            if on_total and total_level[i] == "read":
                total_level[i], said[i]["InvoiceTotal"] = "ok", "the lines add up to it"
        elif len(own) > 1:
            said[i]["UnitAmount"] = f"the lines make {made:.2f}, the total is {total:.2f}{'' if base is None else f', the taxable value {base:.2f}'}: a line is missing, or lines carry discounts"
    for i in np.flatnonzero(unsure).tolist():
        said[i]["Description"] = "the lines were not clearly readable"
    out["InvoiceTotal_level"] = pa.array(total_level, pa.string())
    column["level"] = pc.if_else(pa.array(add_up[of] & real), "ok", column["level"])
    doubt = pa.array(unsure[of] & real)
    for level in ITEM_LEVELS:
        column[level] = pc.if_else(pc.and_(doubt, pc.fill_null(pc.equal(column[level], "read"), False)), "check", column[level])
    for f in ITEM_FIELDS:
        worst, filled = np.full(n, len(LEVELS)), _there(column[f]) & real
        np.minimum.at(worst, of[filled], _rank(column[LEVEL_OF[f]])[filled])
        out[f"{f}_level"] = pa.array([*LEVELS, "empty"]).take(pa.array(worst))
    kinds = [x.name for x in lines.type]
    whole = pa.StructArray.from_arrays([column[k] for k in kinds], kinds)
    none = pc.and_(pc.is_null(out["Items"]), pa.array(np.diff(ends) == 0))
    out["Items"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), whole, mask=none if pc.any(none).as_py() else None)

    points, weight, kind = np.zeros(n), np.zeros(n), out["kind"]
    worth = np.array([MISSING, *(POINTS[x] for x in LEVELS[1:])])
    for f, w in WEIGHTS.items():
        rank = _rank(out[f"{f}_level"])
        expected = pc.is_in(kind, value_set=pa.array([k for k, fields in EXPECTED.items() if f in fields], pa.string())).to_numpy(zero_copy_only=False)
        counts = (rank > 0) | expected
        points, weight = points + np.where(counts, w * worth[rank], 0.0), weight + np.where(counts, w, 0.0)
    out["confidence"] = pa.array([round(p / w, 2) if w else 0.0 for p, w in zip(points.tolist(), weight.tolist(), strict=True)], pa.float64())
    out["notes"] = pa.array([list(d.items()) for d in said], pa.map_(pa.string(), pa.string()))
    out["page_numbers"] = pa.ListArray.from_arrays(pa.array(np.append(starts, len(rows)), pa.int32()), rows.column("page").cast(pa.int32()))
    return pa.RecordBatch.from_arrays([out[x] for x in names], names)


def folded(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Finished invoices of pages that are ordered by file and page. The pages of the open invoice wait for its last one."""
    fold, held, how = Fold(), [], []
    for batch in batches:
        for at in range(0, len(batch), TOGETHER):
            rows = batch.slice(at, TOGETHER)
            new = hows(rows, fold)
            last = max((i for i, h in enumerate(new) if not h), default=None)
            if last is None:  # all of it goes on
                held, how = [*held, rows], how + new
                continue
            whole = pa.concat_batches([*held, rows.slice(0, last)])
            if len(whole):
                yield merge(whole, how + new[:last], names)
            held, how = [rows.slice(last)], new[last:]
    if held:
        yield merge(pa.concat_batches(held), how, names)


def _schema(rows: DataFrame) -> tuple[str, list[str]]:
    own = [c for c in rows.columns if not c.startswith("_") and not c.endswith("_note")]
    added = [f"{f}_level" for f in ITEM_FIELDS]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    listed = [f"`{c}` {kinds[c]}" for c in own] + [f"`{c}` string" for c in added]
    return ", ".join([*listed, "page_numbers array<int>", "notes map<string,string>", "confidence double"]), [*own, *added, "page_numbers", "notes", "confidence"]


def _mapped(rows: DataFrame, how) -> DataFrame:
    schema, names = _schema(rows)
    ready = rows.withColumns({"_key": F.regexp_replace(F.lower("InvoiceId"), "[^0-9a-z]", ""), "_seller": values.plain(F.col("VendorName"))})

    def run(batches):
        yield from how(batches, names)

    return ready.mapInArrow(run, schema)


def finished(rows: DataFrame) -> DataFrame:
    """Each row of read() as an invoice of its own: with notes, levels of the line columns, and the confidence."""
    return _mapped(rows, lambda batches, names: (merge(b, [""] * len(b), names) for b in batches if len(b)))


def invoices(rows: DataFrame) -> DataFrame:
    """I16: the rows of read() as whole invoices, one row each, of the pages page_numbers; page is the first one."""
    return _mapped(rows.repartition("file").sortWithinPartitions("file", "page", "InvoiceId"), folded)
