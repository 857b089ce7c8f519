"""A document index as two tables: documents (name, sha256, added) and passages (name, position, text, vector)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.search import stand_in_vector


def fresh(index: DataFrame, arriving: DataFrame) -> DataFrame:
    """Arriving (name, text) that the index (name, sha256) doesn't have with the same content."""
    hashed = arriving.withColumn("sha256", F.sha2("text", 256))
    return hashed.join(index.select("name", "sha256"), ["name", "sha256"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """Rows of new replace all rows of old with their key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def with_vectors(passages: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """Set vectors where there are new ones, keep the others."""
    new = vectors.select(key, F.col("vector").alias("_new"))
    return passages.join(new, key, "left").withColumn("vector", F.coalesce("_new", "vector")).drop("_new")


def reindexed(passages: DataFrame, stale: bool) -> DataFrame:
    """Clear the vectors of another model, then fill what is missing with the stand-in."""
    kept = F.lit(None).cast("array<double>") if stale else F.col("vector")
    return passages.withColumn("vector", F.coalesce(kept, stand_in_vector(F.col("text"))))
