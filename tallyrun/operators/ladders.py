"""Which ladder a scenario is ranked on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ladder as rank
from ..functions.text import family, js_trim, season


def candidates(ladder: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every scenario's ladders in order of preference: family as listed, latest season, position; the first is default."""
    keyed = benchmark.select(
        "benchmark_id", "position", family(F.col("name")).alias("family"), season(F.col("name")).alias("season")
    )
    first = keyed.groupBy("family").agg(F.min("position").alias("family_order"))
    ordered = ladder.join(keyed.join(first, "family"), "benchmark_id")
    place = Window.partitionBy("scenario_name").orderBy("family_order", F.col("season").desc(), "position")
    return ordered.withColumn("candidate_order", F.row_number().over(place)).withColumn(
        "is_default", F.col("candidate_order") == 1
    )


def pick(found: DataFrame, picks: DataFrame, preferred: int | None = None) -> DataFrame:
    """The ladder shown for each scenario.

    ``picks(scenario_name, stored_id, is_none)`` holds stored choices. A preferred benchmark that has the scenario
    wins; a stored one counts while it still has it; an explicit choice of none leaves the scenario out.
    """
    joined = found.join(picks, "scenario_name", "left")
    liked = F.col("benchmark_id") == (F.lit(preferred) if preferred is not None else F.lit(None).cast("bigint"))
    stored = F.col("benchmark_id") == F.col("stored_id")
    weight = F.when(liked, 0).when(F.coalesce("is_none", F.lit(False)), None).when(stored, 1).when(F.col("is_default"), 2)
    best = Window.partitionBy("scenario_name").orderBy("_weight")
    return (
        joined.withColumn("_weight", weight)
        .where(F.col("_weight").isNotNull())
        .withColumn("_n", F.row_number().over(best))
        .where("_n = 1")
        .drop("_n", "_weight", "stored_id", "is_none")
    )


def rank_rows(rows: DataFrame, picked: DataFrame, ranks: DataFrame) -> DataFrame:
    """Fractional rank, name and text of every scored row on its scenario's picked ladder."""
    ladders = picked.select(F.col("scenario_name").alias("_name"), "benchmark_id", "thresholds").join(
        ranks.select("benchmark_id", "ranks"), "benchmark_id"
    )
    scored = rows.where(F.col("score").isNotNull()).withColumn("_name", js_trim(F.col("scenario_name")))
    joined = scored.join(ladders, "_name").drop("_name")
    named = joined.withColumn("r", rank.fractional_rank(F.col("thresholds"), F.col("score"))).withColumn(
        "rank", rank.rank_name(F.col("r"), F.col("ranks"))
    )
    return named.withColumn("rank_text", rank.rank_text(F.col("rank")))
