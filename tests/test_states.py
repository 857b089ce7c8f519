"""Streams with state: vectors after a restart from the checkpoint, sessions that fall silent."""

import time

import pytest
from pyspark.sql import functions as F

from brindle.streaming import states, streams

SCHEMA = "name string, position long, text string"


@pytest.fixture(autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    states.set_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run_until(query, done, seconds=90):
    """Let a query run until something holds."""
    stop = time.time() + seconds
    try:
        while not done() and time.time() < stop:
            assert query.exception() is None
            time.sleep(0.5)
        assert done()
    finally:
        query.stop()


def test_vectors_survive_a_restart(spark, tmp_path):
    source, out, switch, calls = (str(tmp_path / n) for n in ("in", "out", "model-is-up", "calls"))

    def embed(texts):
        import os

        with open(calls, "a") as f:
            f.writelines(t + "\n" for t in texts)
        if "away" in texts[0] and not os.path.exists(switch):
            raise OSError("the model is away")
        return [None if "bad" in t else [len(t), 1.0] for t in texts]

    def start():
        rows = states.vectors(streams.read_stream(spark, source, spark.createDataFrame([], SCHEMA).schema), embed, tries=3, retry_seconds=1)
        return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").trigger(processingTime="1 second").start()

    def status():
        try:
            return {(r.name, r.position): r.status for r in states.with_status(spark.read.parquet(source), spark.read.schema("name string, position long, status string, tries int, vector array<double>").parquet(out)).collect()}
        except Exception:
            return {}

    rows = [("a", 0, "one"), ("a", 1, "two"), ("b", 0, "bad one"), ("b", 1, "fine"), ("c", 0, "away")]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run_until(start(), lambda: status().get(("a", 1)) == "ready" and len(status()) == 5)
    assert status()[("b", 1)] == "ready" and status()[("b", 0)] in ("pending", "failed") and status()[("c", 0)] in ("pending", "failed")
    spark.createDataFrame([("a", 0, "one"), ("a", 2, "three"), ("c", 0, "away"), ("d", 0, None)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    open(switch, "w").close()
    run_until(start(), lambda: status().get(("a", 2)) == "ready" and status().get(("b", 0)) == "failed" and status().get(("c", 0)) == "ready")
    assert status()[("d", 0)] == "pending"  # no text, nothing to embed
    made = open(calls).read().split("\n")
    assert made.count("one") == made.count("two") == made.count("fine") == 1 and made.count("bad one") == 3


def test_silent_sessions_end(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "user_id long, text string"
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], schema).coalesce(1).write.mode("append").parquet(source)
    stream = streams.read_stream(spark, source, spark.read.parquet(source).schema)
    query = states.ended_sessions(stream, "user_id", seconds=2).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="500 milliseconds").start()

    def ended():
        try:
            return sorted(tuple(r) for r in spark.read.schema("session string, n long, silent_ms long").parquet(out).where(F.col("silent_ms") >= 2000).select("session", "n").collect())
        except Exception:
            return []

    run_until(query, lambda: ended() == [("1", 2), ("2", 1)])
