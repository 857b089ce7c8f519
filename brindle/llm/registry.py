"""Queries of the training-data operators, and the SQL that they must equal."""

from __future__ import annotations

from brindle.llm import queries as q


def queries() -> dict:
    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(q.ORACLES)
