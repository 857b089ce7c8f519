"""Which statements a caller may run: one statement of Spark SQL that only reads.

The statement is parsed by the session's own parser, and every node of the plan is looked at: children, bodies of common table
expressions, subqueries inside expressions, and what EXPLAIN wraps. A node whose class isn't known to only read is refused, and so are
calls of functions that reach outside the data. Names of tables and columns are never judged.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


class RefusedQuery(ValueError):
    """The statement isn't one reading statement; the message says what to change."""


#: Plan nodes that only read.
READING = frozenset(
    """UnresolvedWith SubqueryAlias Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Tail Distinct Deduplicate Union Intersect
    Except Join AsOfJoin LateralJoin UnresolvedRelation UnresolvedInlineTable LocalRelation OneRowRelation UnresolvedSubqueryColumnAliases
    UnresolvedHaving WithWindowDefinition Window Generate UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedHint Sample Pivot
    Unpivot UnresolvedPivot UnresolvedUnpivot Range ParameterizedQuery TableValuedFunction CTERelationDef WithCTE InlineTable UnionLoop
    ResolvedInlineTable UnresolvedOrderedColumns PlanWithUnresolvedIdentifier View Expand UnresolvedOrdinal""".split()
)
#: Statements that look around.
LOOKING = frozenset("ExplainCommand ShowTables ShowColumns ShowFunctions ShowViews ShowNamespaces ShowTablesCommand ShowColumnsCommand DescribeRelation DescribeFunction DescribeQueryCommand DescribeColumn UnresolvedNamespace UnresolvedTableOrView UnresolvedTable UnresolvedView CurrentNamespace UnresolvedFunctionName UnresolvedAttribute".split())
#: Functions that run code of the machine or read its files.
OUTSIDE = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length http_get".split())
_LITERALS = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`", re.DOTALL)


def _seq(items) -> list:
    return [items.apply(i) for i in range(items.size())]


def _functions_and_plans(expression, found: list[str]) -> list:
    """Plans of the subqueries in an expression; names of called functions go to found."""
    kind = expression.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        found.append(_seq(expression.nameParts())[-1].lower())
    plans = [expression.plan()] if hasattr(expression, "plan") and kind.endswith(("Subquery", "Exists", "ListQuery")) else []
    for child in _seq(expression.children().toSeq()):
        plans += _functions_and_plans(child, found)
    return plans


def _walk(plan, names: set[str], functions: list[str]) -> None:
    kind = plan.getClass().getSimpleName().rstrip("$")
    names.add(kind)
    below = _seq(plan.children().toSeq())
    below += [p for p in _seq(plan.innerChildren().toSeq()) if hasattr(p, "expressions")]
    if kind == "ExplainCommand":
        below.append(plan.logicalPlan())
    if kind == "DescribeQueryCommand":
        below.append(plan.plan())
    if kind == "UnresolvedTableValuedFunction":
        functions.append(_seq(plan.name())[-1].lower())
    for expression in _seq(plan.expressions().toSeq()):
        below += _functions_and_plans(expression, functions)
    for p in below:
        _walk(p, names, functions)


def check(spark: SparkSession, sql: str | None) -> str:
    """The statement without its last semicolon, or RefusedQuery."""
    text = (sql or "").strip()
    if not text:
        raise RefusedQuery("the query is empty")
    bare = _LITERALS.sub(" ", text)
    if any(q in bare for q in "'\"`"):
        raise RefusedQuery("a string or quoted name isn't closed")
    if "--" in bare or "/*" in bare or "*/" in bare:
        raise RefusedQuery("take the comments out")
    text = text.rstrip("; \n\t")
    if ";" in bare.rstrip("; \n\t"):
        raise RefusedQuery("one statement at a time")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as error:
        raise RefusedQuery(f"it can't be parsed: {str(error).splitlines()[0][:300]}") from None
    names: set[str] = set()
    functions: list[str] = []
    _walk(plan, names, functions)
    if unknown := sorted(names - READING - LOOKING):
        raise RefusedQuery(f"only queries that read are allowed, not {', '.join(unknown)}")
    if called := sorted(set(functions) & OUTSIDE):
        raise RefusedQuery(f"these functions aren't allowed: {', '.join(called)}")
    return text
