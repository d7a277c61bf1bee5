"""Rendezvous hashing over weighted shards, in DataFrame functions only.

Every shard scores a record's key by a hash of key and shard, scaled by the shard's weight; the best score takes it. A
further shard therefore only takes rows into itself, its share of all of them. Slots number a shard's rows without gaps:
rows are counted by input partition and shard, the counts are summed up, and each partition numbers its own rows from
there, so that no task holds a shard.

Defined cases: null keys count as one key; equal keys share a shard; rows are each placed, also equal ones; an empty table
gives an empty result; other columns are not looked at by ``placed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def score(key: Column, shard: Column, weight: Column) -> Column:
    """The smaller, the better; each is exponential with the weight as its rate."""
    part = (F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double") + 0.5) / float(2**53)
    return -F.ln(part) / weight


def best(key: Column, weights: list[float]) -> Column:
    """struct<score, shard>"""
    listed = F.array(*(F.lit(float(w)) for w in weights))
    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda j: F.struct(score(key, j, F.element_at(listed, j + 1)).alias("score"), j.alias("shard"))))


def placed(rows: DataFrame, key: str, weights: list[float], grown: float | None = None) -> DataFrame:
    """Adds ``shard``, ``slot`` and, if one more shard of weight ``grown`` is asked for, ``grown_shard``."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    k = F.col(f"`{key}`")
    chosen = rows.select(*columns, best(k, weights).alias("best"), F.spark_partition_id().alias("part"))
    more = F.lit(None).cast("int")
    if grown is not None:
        new = F.lit(len(weights))
        more = F.when(score(k, new, F.lit(float(grown))) < F.col("best.score"), new).otherwise(F.col("best.shard"))
    table = stored(chosen.select(*columns, F.col("best.shard").alias("shard"), more.alias("grown_shard"), "part"))
    counts = table.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    inside = Window.partitionBy("part", "shard").orderBy(*columns)
    numbered = table.join(counts.select("part", "shard", before.alias("before")), ["part", "shard"])
    return numbered.select(*columns, "shard", (F.col("before") + F.row_number().over(inside) - 1).alias("slot"), "grown_shard")
