"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.base import cut

#: Rounds after which something must be wrong; the method needs about the logarithm of the longest path.
MOST_ROUNDS = 60


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Link each node's neighbours to the smallest node of its neighbourhood: the larger ones, or (small) the smaller ones."""
    if small:
        near = edges  # a > b: b is a smaller neighbour of a
    else:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    moved = near.join(least, "a")
    if small:
        out = moved.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
    else:
        out = moved.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of an edge: label is the smallest node of its component.

    Edges are pairs of longs; loops, repeats and either direction are allowed, nulls are ignored. Nothing is collected but the two
    figures that tell whether a round changed anything.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = cut(edges.filter(x.isNotNull() & y.isNotNull()).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).filter("a <> b").distinct())
    seen = None
    for _ in range(MOST_ROUNDS):
        now = cut(_stars(_stars(now, small=False), small=True))
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen or not state[0]:
            break
        seen = state
    else:
        raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
