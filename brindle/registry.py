"""Names of the queries and the SQL they must equal, gathered from the modules that define them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.plans import budgets, invoicing, other, relational, searching, workspace
from brindle.plans.book import Query

BOOKS = (relational.BOOK, searching.BOOK, budgets.BOOK, invoicing.BOOK, other.BOOK, workspace.BOOK)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.BOOK.queries["J03_revenue_by_nation"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for book in BOOKS for name, query in book.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for book in BOOKS for name, sql in book.oracles.items()}
