"""Stored tables that change as a whole (K09): new files are written beside the old ones, then one pointer is renamed; a reader sees the old or the new state.

A store is a folder with a file `_current` that lists the folders of its state. Whoever crashes before the rename leaves the old state,
and folders that nothing points to; sweep() removes these.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

POINTER = "_current"
UNREADABLE = "_unreadable"


def shared_dir(spark: SparkSession) -> str:
    """Where the driver and all executors can write: spark.checkpoint.dir, or a temporary folder where all runs in one process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or tempfile.mkdtemp(prefix="brindle-")).rstrip("/")


def opened(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders of a store's state; none of a store that isn't there yet."""
    fs, place = opened(spark, f"{path}/{POINTER}")
    if not fs.exists(place):
        return []
    stream = fs.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def new_folder(path: str) -> str:
    return f"{path}/part-{uuid.uuid4().hex}"


def point(spark: SparkSession, path: str, to: list[str]) -> None:
    """Make these folders the store's state, in one rename."""
    draft = f"{path}/.{uuid.uuid4().hex}.tmp"
    fs, place = opened(spark, draft)
    stream = fs.create(place, True)
    try:
        stream.write(bytearray(json.dumps(to), "utf-8"))
    finally:
        stream.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(place, jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}"), overwrite)


def replace(table: DataFrame, path: str) -> None:
    """Put a table in place of a store's. The table may be made of what the store holds."""
    folder = new_folder(path)
    table.write.parquet(folder)
    point(table.sparkSession, path, [folder])


def read(spark: SparkSession, path: str) -> DataFrame:
    found = folders(spark, path)
    if not found:
        raise FileNotFoundError(f"no table is stored at {path}")
    return spark.read.parquet(*found)


def sweep(spark: SparkSession, path: str) -> int:
    """Remove what no pointer names: (only) while nobody writes or reads an old state. Returns how many folders went."""
    fs, place = opened(spark, path)
    held, gone = {f.rsplit("/", 1)[-1] for f in folders(spark, path)}, 0
    for status in fs.listStatus(place):
        name = status.getPath().getName()
        if name.startswith("part-") and name not in held:
            gone += fs.delete(status.getPath(), True)
    return gone


def read_json(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Records of JSON files (an object or an array of objects each) under a schema, and the texts of those that can't be read, with their file.

    Fields that a record doesn't have are null, others are left out; a file that is broken makes no record fail but its own.
    """
    full = StructType([*schema.fields, StructField(UNREADABLE, StringType())])
    texts = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    listed = F.when(F.ltrim("text").startswith("["), F.from_json("text", "array<string>"))
    each = texts.select("file", F.explode(F.coalesce(listed, F.array("text"))).alias("text"))
    rows = each.withColumn("record", F.from_json("text", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": UNREADABLE}))
    broken = F.col("record").isNull() | F.col(f"record.{UNREADABLE}").isNotNull()
    return rows.where(~broken).select(*[F.col(f"record.`{n}`").alias(n) for n in schema.names]), rows.where(broken).select("file", "text")
