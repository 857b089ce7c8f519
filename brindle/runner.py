"""Bounded, time-limited, read-only queries: the rows, whether there were more, and values that JSON can hold."""

from __future__ import annotations

import base64
import datetime as dt
import decimal
import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

from brindle import guard

MOST_ROWS = 200
SECONDS = 30.0


class QueryError(RuntimeError):
    """The query failed or took too long; one line that can be shown."""


@dataclass
class Result:
    columns: list[str]
    rows: list[list]
    truncated: bool


def plain(value):
    """A value that JSON can hold. Decimals stay exact as text, dates and times become ISO text, long binaries their size."""
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if isinstance(value, (dt.date, dt.time)):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return f"base64:{base64.b64encode(value).decode()}" if len(value) <= 64 else f"<{len(value)} bytes>"
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict(recursive=False).items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return format(value, "f") if isinstance(value, decimal.Decimal) else str(value)


def run(spark: SparkSession, sql: str, most_rows: int = MOST_ROWS, seconds: float = SECONDS) -> Result:
    """Check a statement, run it, and bring at most most_rows rows; its jobs are cancelled after so many seconds."""
    statement = guard.check(spark, sql)
    context, group = spark.sparkContext, f"query-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop():
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, statement[:100], interruptOnCancel=True)
    timer.start()
    try:
        rows = spark.sql(statement).limit(most_rows + 1)
        found = rows.collect()
    except Exception as error:
        raise QueryError(f"the query took more than {seconds:g} seconds" if late.is_set() else str(error).splitlines()[0][:500]) from None
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
    return Result(rows.columns, [[plain(v) for v in row] for row in found[:most_rows]], len(found) > most_rows)
