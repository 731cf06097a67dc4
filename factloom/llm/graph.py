"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every vertex of ``edges`` (src, dst: long); label is the component's smallest vertex.

    Each round is two grouped minima and two joins on the vertex, so a hub is
    one key of a partially aggregated minimum.  Lineage is cut each round by a
    written table; no edge reaches the driver.  An empty input gives no rows.
    """
    now = materialize(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "cc")
    state = None
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(down.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(small, "cc")
        sign = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(now)
        now = new
        if sign == state or not sign[0]:
            break
        state = sign
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
