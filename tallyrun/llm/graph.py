"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node that it can reach.

    Each round links a node's larger neighbours, then its smaller ones, to its smallest neighbour, until every node has one
    root that has none itself; the number of rounds grows with the logarithm of the longest path. Rounds are written to
    the shared folder.
    """
    pairs = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct())
    while not _stars(pairs):
        both = pairs.unionByName(pairs.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("low")).select("node", F.least("node", "low").alias("low"))
        large = both.join(least, "node").where("root > node").select(F.col("root").alias("node"), F.col("low").alias("root")).where("node <> root").distinct()
        low = large.groupBy("node").agg(F.min("root").alias("low"))
        small = large.join(low, "node").where("root <> low").select(F.col("root").alias("node"), F.col("low").alias("root"))
        pairs = stored(small.unionByName(low.select("node", F.col("low").alias("root"))).distinct())
    return pairs.select("node", F.col("root").alias("component")).unionByName(pairs.select(F.col("root").alias("node"), F.col("root").alias("component")).distinct())


def _stars(pairs: DataFrame) -> bool:
    ends = pairs.select(F.col("node").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(pairs.select(F.col("root").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 OR (below > 0 AND above > 0)").isEmpty()
