"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import cut, hot_keys, salted_join


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root for every node of edges (u, v: long); root is the least node of the component.

    Each round is two joins of the edges with one row per node, the edges of hubs salted; the edges never
    leave the executors. An edge between equal nodes makes a component of one. Empty edges give an empty table.
    """
    own = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    e = cut(edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct())
    mark = (e.count(), None)
    for _ in range(most if mark[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        # large star: neighbours above u hang on u's least neighbour
        large = salted_join(both.where("v > u"), low.select("u", "m"), "u", hot_keys(low, "u", "n", 2 * mark[0]), F.col("v"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: what lies below u hangs on the least of it
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = salted_join(large, low.select("u", "m"), "u", hot_keys(low, "u", "n", 2 * mark[0]), F.col("v"))
        e = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut(e)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        if mark[0]:
            raise RuntimeError("components did not settle")
    return own.join(e.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
