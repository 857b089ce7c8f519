"""From rows to chart series: labels and values in order, checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("bar", "line", "area", "pie")
MOST_LABELS, MOST_SERIES, MOST_SLICES = 60, 6, 12


class ChartError(ValueError):
    """The rows can't be drawn; the message says why."""


def series(rows: DataFrame, label: str, name: str, value: str) -> DataFrame:
    """(name, labels, values): one row per series, labels in ascending order, missing values null, repeated ones summed."""
    points = rows.groupBy(F.col(label).cast("string").alias("label"), F.col(name).cast("string").alias("name")).agg(F.sum(value).cast("double").alias("value"))
    ordered = F.array_sort(F.collect_list(F.struct("label", "value")))
    return points.groupBy("name").agg(F.transform(ordered, lambda x: x["label"]).alias("labels"), F.transform(ordered, lambda x: x["value"]).alias("values"))


def build(chart: DataFrame, kind: str = "bar", title: str = "") -> dict:
    """The specification of a chart from series(): bounded by its own limits, which are checked before anything is brought."""
    if kind not in KINDS:
        raise ChartError(f"{kind} is not one of {', '.join(KINDS)}")
    found = chart.orderBy("name").limit(MOST_SERIES + 1).collect()
    if not found:
        raise ChartError("there is nothing to draw")
    if len(found) > MOST_SERIES:
        raise ChartError(f"more than {MOST_SERIES} series")
    labels = list(found[0].labels)
    if any(list(r.labels) != labels for r in found):
        raise ChartError("the series have different labels")
    if len(labels) > (MOST_SLICES if kind == "pie" else MOST_LABELS):
        raise ChartError("too many labels")
    if kind == "pie" and (len(found) != 1 or any((v or 0) < 0 for v in found[0]["values"])):
        raise ChartError("a pie has one series without negative values")
    tidy = lambda v: int(v) if v is not None and float(v).is_integer() else v
    return {"type": kind, "title": title[:120], "labels": labels, "series": [{"name": r.name[:60], "values": [tidy(v) for v in r["values"]]} for r in found]}
