"""Connected components over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import cut, drop, spread_join


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (the least node that links reach) for each node of the links (u, v: long).

    Rounds of large-star and small-star: every node hands its greater, then its smaller neighbours on to the least
    one it knows, until nothing changes. Links never gather in one task: the least neighbour is a partial aggregate,
    the links of a node meet it in parts, and a round keeps at most one link for each link before it. Each round is
    written to the shared folder, and the one before it goes.
    """
    now = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (mark["n"], mark["s"]) == before:
            break
        before = (mark["n"], mark["s"])
        if not mark["n"]:
            break
        # Large star: each greater neighbour of a node goes to the least of the node and its neighbours.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both, least, "u", F.col("v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours go to the least of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = spread_join(large, least, "u", F.col("v"))
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        past, now = now, cut(small.where("u <> v").distinct(), "links")
        drop(past)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(now.select("v", "v").distinct())
