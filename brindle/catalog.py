"""Tables of a data folder: reading them, registering them as views, listing and describing them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
NAME = r"^[A-Za-z0-9_-]{1,40}$"
JDBC_URLS = {"postgresql": "jdbc:postgresql://{host}:{port}/{database}", "mysql": "jdbc:mysql://{host}:{port}/{database}", "sqlite": "jdbc:sqlite:{path}"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Connection:
    """A saved source: a folder of Parquet tables, or a database that JDBC reaches."""

    id: str
    engine: str = "parquet"
    path: str = ""
    host: str = ""
    port: int = 0
    database: str = ""
    schema: str = ""
    user: str = ""
    password: str = field(default="", repr=False)
    ssl: bool = False

    def problems(self) -> list[str]:
        import re

        found = [] if re.match(NAME, self.id) else ["the id may hold letters, digits, - and _ only"]
        if self.engine not in ("parquet", *JDBC_URLS):
            found.append(f"unknown engine {self.engine}")
        elif self.engine in ("parquet", "sqlite"):
            found += [] if self.path else ["a path is needed"]
        else:
            found += [f"{name} is needed" for name in ("host", "database", "user") if not getattr(self, name)]
        return found

    def public(self) -> dict:
        """What may be shown: that there is a password, not which."""
        shown = {k: v for k, v in self.__dict__.items() if k != "password"}
        return shown | {"has_password": bool(self.password)}

    def edited(self, **changes) -> Connection:
        """Changed settings. An empty password keeps the old one only for the same host, so that it is never sent elsewhere."""
        new = Connection(**(self.__dict__ | {"password": ""} | changes))
        same = (new.engine, new.host, new.port) == (self.engine, self.host, self.port)
        return new if changes.get("password") or not same else Connection(**(new.__dict__ | {"password": self.password}))


def jdbc_options(connection: Connection, query: str, timeout_s: int = 30) -> dict[str, str]:
    """Options of spark.read.format("jdbc") for one read-only, time-limited query."""
    options = {"url": JDBC_URLS[connection.engine].format(**connection.__dict__), "query": query, "queryTimeout": str(timeout_s), "fetchsize": "1000"}
    if connection.user:
        options |= {"user": connection.user, "password": connection.password}
    if connection.engine == "postgresql":
        path = f" SET search_path TO {connection.schema};" if connection.schema else ""
        options["sessionInitStatement"] = f"SET default_transaction_read_only = on; SET statement_timeout = {timeout_s * 1000};{path}"
        options |= {"ssl": "true"} if connection.ssl else {}
    if connection.engine == "sqlite":
        options["open_mode"] = "1"  # the driver's read-only mode
    if connection.engine == "mysql":
        options["sessionInitStatement"] = "SET SESSION TRANSACTION READ ONLY"
        options |= {"useSSL": "true"} if connection.ssl else {}
    return options


def scan(spark: SparkSession, connection: Connection, query: str, timeout_s: int = 30) -> DataFrame:
    """The rows of a query over a database, read by JDBC."""
    return spark.read.format("jdbc").options(**jdbc_options(connection, query, timeout_s)).load()


def probe(spark: SparkSession, connection: Connection, timeout_s: int = 10) -> str | None:
    """What keeps a connection from being used, or None: its settings are checked, then a table is listed or SELECT 1 is asked."""
    found = connection.problems()
    if found:
        return "; ".join(found)
    try:
        if connection.engine == "parquet":
            spark.read.parquet(f"{connection.path.rstrip('/')}/*.parquet").limit(1).count()
        else:
            scan(spark, connection, "SELECT 1 AS one", timeout_s).first()
    except Exception as problem:  # noqa: BLE001 - whatever a driver raises is the answer
        said = str(problem).splitlines()[0][:300]
        return said.replace(connection.password, "***") if connection.password else said
    return None


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> list[str]:
    """Make the tables of a folder views of the session."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return list(names)


def list_tables(spark: SparkSession) -> DataFrame:
    """(name, type) of the session's tables and views, by name."""
    rows = sorted((t.name, "view" if t.isTemporary or t.tableType == "VIEW" else "table") for t in spark.catalog.listTables())
    return spark.createDataFrame(rows, "name string, type string")


def describe(spark: SparkSession, name: str) -> DataFrame:
    """(position, name, type, nullable) of a table's columns in their order; an unknown table is an error."""
    if not spark.catalog.tableExists(name):
        raise ValueError(f"there is no table {name}")
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(spark.table(name).schema)]
    return spark.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def connections(spark: SparkSession, saved: list[Connection]) -> DataFrame:
    """The registry as rows, without passwords."""
    rows = [(c.id, c.engine, c.path or c.host, bool(c.password)) for c in saved]
    return spark.createDataFrame(rows, "id string, engine string, place string, has_password boolean").orderBy("id")


def as_markdown(rows: DataFrame, most: int = 400) -> DataFrame:
    """(line) of a Markdown table of the first rows: columns, rule, cells."""
    cells = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\|", r"\\|"), F.lit("")) for c in rows.columns]
    head = [f"| {' | '.join(rows.columns)} |", f"|{' --- |' * len(rows.columns)}"]
    body = rows.limit(most).select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    return rows.sparkSession.createDataFrame([(x,) for x in head], "line string").unionByName(body)
