"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washbay.plans.staging import staged


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root (smallest node reachable) for every node of ``links`` (a, b of one type).

    Each round hangs every node's larger neighbours, then its smaller ones, below the
    smallest node that it knows; edges never grow in number and stars of depth one remain
    after about log(length of the longest chain) rounds. The minimum per node is a partial
    aggregate, so a hub costs one row per task; edge tables are staged between rounds."""
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                   "edges")
    state = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()                            # a > b holds in every edge
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a")
        edges = staged(small.select("a", F.col("m").alias("b")).union(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
