"""Named tools over a session: what each does, and calls that always answer with a text and a summary."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle import catalog, runner


@dataclass(frozen=True)
class Tool:
    """run takes the call's arguments by name and returns (text, summary)."""

    name: str
    does: str
    arguments: tuple[str, ...]
    run: Callable[..., tuple[str, str]]


@dataclass
class Toolbox:
    """Tools by name."""

    tools: dict[str, Tool] = field(default_factory=dict)

    def add(self, tool: Tool) -> None:
        if tool.name in self.tools:
            raise ValueError(f"{tool.name} is there already")
        self.tools[tool.name] = tool

    def definitions(self) -> list[dict]:
        return [{"name": t.name, "description": t.does, "parameters": list(t.arguments)} for t in self.tools.values()]

    def system_prompt(self) -> str:
        return "\n".join(f"- {t.name}({', '.join(t.arguments)}): {t.does}" for t in self.tools.values())

    def run(self, name: str, arguments: dict) -> tuple[str, str]:
        """An unknown name, a missing argument and a failure are answered, not raised."""
        tool = self.tools.get(name)
        if tool is None:
            return f"There is no tool {name}. There are: {', '.join(self.tools) or 'none'}.", "unknown tool"
        missing = [a for a in tool.arguments if a not in arguments]
        if missing:
            return f"{name} needs {', '.join(missing)}.", "missing argument"
        try:
            return tool.run(**{a: arguments[a] for a in tool.arguments})
        except (ValueError, runner.QueryError) as error:
            return str(error), "failed"


def of_tables(spark: SparkSession) -> Toolbox:
    """The tools of registered tables: list them, describe one, ask a bounded read-only query."""

    def listed() -> tuple[str, str]:
        names = [r[0] for r in catalog.list_tables(spark).collect()]
        return "\n".join(names), f"{len(names)} tables"

    def described(table: str) -> tuple[str, str]:
        rows = catalog.describe(spark, table).collect()
        return "\n".join(f"{r['name']} {r['type']}" for r in rows), f"{len(rows)} columns"

    def asked(sql: str) -> tuple[str, str]:
        found = runner.run(spark, sql)
        lines = [" | ".join(found.columns), *(" | ".join("" if v is None else str(v) for v in row) for row in found.rows)]
        return "\n".join(lines), f"{len(found.rows)} rows" + (", more left out" if found.truncated else "")

    box = Toolbox()
    box.add(Tool("list_tables", "names of the tables", (), listed))
    box.add(Tool("describe_table", "columns of a table and their types", ("table",), described))
    box.add(Tool("query", "rows of one read-only SQL statement", ("sql",), asked))
    return box


def answering_model(models: DataFrame, preferred: str) -> DataFrame:
    """The one model (id, position, provider, available, tools) that answers with tools: one that is available and local.

    The preferred one, if nothing says that it can't use tools, else the first that can. No row if there is none.
    """
    fit = models.where(F.col("available") & (F.col("provider") != "cloud"))
    wanted = (F.col("id") == preferred) & F.coalesce("tools", F.lit(True))
    return fit.where(wanted | F.coalesce("tools", F.lit(False))).orderBy(F.desc(wanted), "position").limit(1)
