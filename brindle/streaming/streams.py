"""Streams over tables that arrive in pieces: windows, sessions, idempotent ingest, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling windows per event type; rows later than the watermark are left out, as in a batch they aren't."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp"))
    stamped = stamped.withWatermark("at", late) if events.isStreaming else stamped
    grouped = stamped.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A user's session ends after so long without an event."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp"))
    stamped = stamped.withWatermark("at", late) if events.isStreaming else stamped
    grouped = stamped.groupBy("user_id", F.session_window("at", gap).alias("s")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("start"), "n")


def fresh_only(documents: DataFrame, late: str = "1 day") -> DataFrame:
    """The first of rows with one name and content; a stream forgets them after the watermark."""
    hashed = documents.withColumn("sha256", F.sha2("text", 256))
    return hashed.withWatermark("added", late).dropDuplicatesWithinWatermark(["name", "sha256"]) if documents.isStreaming else hashed.dropDuplicates(["name", "sha256"])


def kept(rows: DataFrame, added: str, now, hours: int) -> DataFrame:
    """Rows not older than so many hours, at a time that is given."""
    return rows.where(F.col(added) > F.lit(now) - F.make_interval(hours=F.lit(hours)))


def upsert_into(stream: DataFrame, path: str, checkpoint: str, key: str = "name") -> StreamingQuery:
    """Append what is new to a Parquet table, exactly once per key: each batch leaves out the keys that are there."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        target = f"{path}/batch={number}"
        fresh = batch.dropDuplicates([key])
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
            # A batch that is run again overwrites its own folder, so only earlier batches count as known.
            fresh = fresh.join(spark.read.parquet(path).where(F.col("batch") < number).select(key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def assembled(pieces: DataFrame) -> DataFrame:
    """Pieces (session, part, offset, text) of streamed texts joined in order; a repeated offset counts once."""
    once = pieces.dropDuplicates(["session", "part", "offset"])
    return once.groupBy("session", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "text"))), lambda x: x["text"]), "").alias("text"))
