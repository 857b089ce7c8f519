import pytest

from brindle import catalog, guard, runner

READS = [
    "SELECT * FROM staff WHERE first_name LIKE 'sam%'",
    "select count(*) from orders;",
    "WITH t AS (SELECT 1 AS n) SELECT n FROM t",
    "SELECT 'drop table x; delete' AS note",
    "SELECT owner, comment, status, replace(name, 'a', 'b') FROM pets",
    "SELECT 'it''s', 'a' FROM t",
    r"SELECT 'it\'s' FROM t",
    "EXPLAIN SELECT 1",
    "SHOW TABLES",
    "SELECT * FROM benchmark",
    "SELECT `call`, lock, copy FROM t",
    "SELECT a FROM t WHERE EXISTS (SELECT 1 FROM u WHERE u.x = t.x) UNION ALL SELECT max(a) OVER (PARTITION BY b) FROM t",
    "DESCRIBE orders",
    "VALUES (1, 2), (3, 4)",
]
WRITES = [
    "",
    None,
    "SELECT 1 -- a comment",
    "SELECT /* c */ 1",
    "DELETE FROM orders",
    "drop table orders",
    "SELECT 1; DELETE FROM orders",
    "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x",
    "FROM t INSERT INTO u SELECT *",
    "EXPLAIN DELETE FROM t",
    "SELECT * INTO backup FROM orders",
    "SELECT * FROM orders FOR UPDATE",
    "PRAGMA writable_schema = 1",
    "SELECT 'unclosed",
    "EXECUTE IMMEDIATE 'DROP TABLE t'",
    "BEGIN SELECT 1; END",
    "SET a=b",
    "CACHE TABLE t",
    "SELECT TRANSFORM(a) USING 'echo hi' FROM t",
    "SELECT reflect('java.lang.System', 'exit', 1)",
    "SELECT (SELECT java_method('java.lang.System', 'currentTimeMillis'))",
    "SELECT 1 WHERE EXISTS (SELECT TRANSFORM(a) USING 'echo hi' FROM t)",
    "CREATE TABLE x AS SELECT 1",
]


@pytest.mark.parametrize("sql", READS)
def test_reads_pass(spark, sql):
    assert guard.check(spark, sql) == sql.rstrip(";")


@pytest.mark.parametrize("sql", WRITES)
def test_writes_are_refused(spark, sql):
    with pytest.raises(guard.RefusedQuery):
        guard.check(spark, sql)


def test_runner_bounds_rows_and_time(spark):
    found = runner.run(spark, "SELECT id FROM range(5) ORDER BY id", most_rows=2)
    assert (found.columns, found.rows, found.truncated) == (["id"], [[0], [1]], True)
    assert not runner.run(spark, "SELECT id FROM range(2)", most_rows=2).truncated
    with pytest.raises(runner.QueryError, match="more than"):
        runner.run(spark, "SELECT count(*) FROM range(100000000000) WHERE hash(id) = 1", seconds=1)
    row = runner.run(spark, "SELECT DATE '2026-01-31' AS d, CAST(1.50 AS DECIMAL(5,2)) AS m, X'0102' AS b, array(1, 2) AS a, named_struct('x', 1) AS s").rows[0]
    assert row == ["2026-01-31", "1.50", "base64:AQI=", [1, 2], {"x": 1}]


def test_catalog(spark):
    catalog.register(spark, "/root/testdata/sf0.001", ("nation", "region"))
    assert {"nation", "region"} <= {r.name for r in catalog.list_tables(spark).collect()}
    assert [r.name for r in catalog.describe(spark, "region").collect()] == ["r_regionkey", "r_name"]
    with pytest.raises(ValueError):
        catalog.describe(spark, "nowhere")
    lines = [r.line for r in catalog.as_markdown(spark.sql("SELECT 'a|b' AS name, 1 AS total")).collect()]
    assert lines == ["| name | total |", "| --- | --- |", r"| a\|b | 1 |"]


def test_connections():
    base = catalog.Connection("sales-db", "postgresql", host="h", port=5432, database="d", user="u", password="p")
    assert base.problems() == [] and base.public()["has_password"] and "password" not in base.public()
    assert base.edited(database="e").password == "p"
    assert base.edited(host="other").password == ""
    assert catalog.Connection("x y", "oracle").problems()
    assert "read_only" in catalog.jdbc_options(base, "SELECT 1")["sessionInitStatement"]


def test_probe(spark, tmp_path):
    assert catalog.jdbc_options(catalog.Connection("s", "sqlite", path="/x.db"), "SELECT 1")["open_mode"] == "1"
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert catalog.probe(spark, catalog.Connection("p", "parquet", path=str(tmp_path))) is None
    assert catalog.probe(spark, catalog.Connection("p", "parquet", path=str(tmp_path / "none")))
    assert "host is needed" in catalog.probe(spark, catalog.Connection("p", "mysql"))
    said = catalog.probe(spark, catalog.Connection("p", "mysql", host="h", port=1, database="d", user="u", password="secret"))
    assert said and "secret" not in said
