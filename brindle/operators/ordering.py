"""Positions of rows in a total order, without a window over all of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.stores import shared_dir

_BITS = 33  # of a monotonically increasing id, the lower bits count within a partition


def numbered(rows: DataFrame, *keys: str, name: str = "at") -> DataFrame:
    """rows with their place (from 0) by keys, as column `name`. Equal keys get places of their own, in any order.

    Rows are sorted in ranges of the keys and stored in the shared folder with their place in the range; how many rows the ranges before
    hold is one number per range, which is small enough to send to all tasks.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/numbered-{uuid.uuid4().hex}"
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path).withColumn("_range", F.shiftright("_id", _BITS))
    sizes = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << _BITS) - 1))
    return stored.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range").withColumn(name, places).drop("_range", "_id", "_before")
