"""Connected components of an edge table by alternating large and small stars; no graph reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, freed


def _pull(edges: DataFrame) -> DataFrame:
    """One round of a star operation on rows (u, v): every v of u gets u's smallest neighbour (u included)."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the smallest node reachable.

    Null ends and loops are ignored, repeated edges count once.  Each round is cut by a reliable checkpoint, and what it shuffled is freed.
    """
    e = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, seen = cut(e), None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _pull(both).where("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        pulled = _pull(large)
        small = pulled.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(pulled.where("u > m").select("u", F.col("m").alias("v"))).distinct()
        e = cut(small)
        del both, large, pulled, small
        freed(e.sparkSession)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
