"""Connected components of links between documents, by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MAX_ROUNDS = 60


def _star(edges: DataFrame, scratch: Scratch, large: bool) -> tuple[DataFrame, DataFrame]:
    """One round over edges (u > v). large: each node's larger neighbours move to its smallest neighbour; else its smaller ones and itself do.

    The smallest neighbour comes from a map-side combined aggregate, which is written, so that the join after it has an exchange
    on both sides and adaptive execution can split a hub's rows.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = scratch.cut(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")))
    joined = both.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return scratch.cut(moved.where("u <> v").distinct()), least


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of edges (a, b), root being the smallest node of its component, without rows for the roots themselves."""
    now = scratch.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = _print(now)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        mid, a = _star(now, scratch, True)
        fresh, b = _star(mid, scratch, False)
        scratch.drop(now, mid, a, b)
        now, last, seen = fresh, seen, _print(fresh)
        if seen == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
