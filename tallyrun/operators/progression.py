"""A scenario's progression and the scenario directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ladder as rank
from ..functions.numbers import array_median
from ..functions.text import js_trim, natural_key, short_hash
from . import scan
from .views import HISTORY

GROUP = ["sens_scale", "horiz_sens", "vert_sens", "dpi", "fov", "fov_scale"]
SLOTS = 3
WINDOW = 10


def config_groups(history: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Runs grouped by the settings that change how aiming feels, labelled in order of first use.

    The ``slots`` most recently used groups get a slot number, in label order; the rest have none.
    """
    groups = scan.percentiles(
        history, [*HISTORY, *GROUP], "score", {"median": 0.5},
        runs=F.count(F.lit(1)), best=F.max("score"),
        _first=F.min(F.struct("started_at", "id")), last_used=F.max("started_at"),
    )
    base = Window.partitionBy(*HISTORY)
    numbered = groups.withColumn("group_no", F.row_number().over(base.orderBy("_first")))
    recency = F.row_number().over(base.orderBy(F.col("last_used").desc(), F.col("group_no").desc()))
    ranked = numbered.withColumn("_recent", recency)
    chosen = F.col("_recent") <= slots
    slot = F.when(chosen, F.count_if(chosen).over(base.orderBy("group_no")) - 1)
    return (
        ranked.withColumn("slot", slot)
        .withColumn("label", F.concat(F.lit("C"), F.col("group_no").cast("string")))
        .withColumn("current", F.col("_recent") == 1)
        .withColumn("first_used", F.col("_first.started_at"))
        .drop("_first", "_recent")
    )


def best_so_far(runs: DataFrame, better: str = "higher", value: str = "score") -> DataFrame:
    step = scan.highest if better == "higher" else scan.lowest
    return scan.running(runs, HISTORY, ["started_at", "id"], best=step(F.col(value)))


def rolling_form(runs: DataFrame, window: int = WINDOW, value: str = "score") -> DataFrame:
    return scan.rolling_median(runs, HISTORY, ["started_at", "id"], value, window)


def directory_rows(directory: DataFrame, window: int = WINDOW) -> DataFrame:
    """Directory rows with a tag where versions share a name, and form against the best."""
    shared = directory.groupBy("player_id", "scenario_name").agg(F.count(F.lit(1)).alias("_same"))
    m = array_median(F.col("recent"))
    gap = F.when(F.col("pb") != 0, (F.col("median") - F.col("pb")) / F.abs("pb"))
    return (
        directory.join(shared, ["player_id", "scenario_name"])
        .withColumn("tag", F.when(F.col("_same") > 1, short_hash(F.col("scenario_hash"))))
        .withColumn("median", m)
        .withColumn("full", F.size("recent") >= window)
        .withColumn("gap", gap)
        .drop("_same")
    )


def filter_by_name(rows: DataFrame, q: str) -> DataFrame:
    needle = q.strip().lower()
    return rows if needle == "" else rows.where(F.contains(F.lower("scenario_name"), F.lit(needle)))


def sort_directory(rows: DataFrame, key: str, direction: str = "desc") -> DataFrame:
    """Orders each player's directory; blanks come last either way and ties go to the last played."""
    up = direction == "asc"

    def way(c: Column) -> Column:
        return c.asc_nulls_last() if up else c.desc_nulls_last()

    if key == "name":
        order = [way(natural_key(F.col("scenario_name"))), way(F.col("scenario_hash"))]
    elif key == "played":
        order = [way(F.col("last_played"))]
    else:
        column = {"rank": "k", "pb": "pb", "form": "gap", "runs": "runs"}[key]
        order = [way(F.col(column)), F.col("last_played").desc()]
    place = Window.partitionBy("player_id").orderBy(*order, "scenario_id")
    return rows.withColumn("place", F.row_number().over(place))


def benchmarks_of(rows: DataFrame, ladder: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmarks that contain a scenario among the rows."""
    used = rows.select("player_id", js_trim(F.col("scenario_name")).alias("scenario_name")).distinct()
    ids = used.join(ladder.select("benchmark_id", "scenario_name"), "scenario_name").select("player_id", "benchmark_id").distinct()
    return ids.join(benchmark.select("benchmark_id", "name", "difficulty"), "benchmark_id")


def in_benchmark(rows: DataFrame, ladder: DataFrame, benchmark: DataFrame, benchmark_id: int) -> DataFrame:
    """Rows whose scenario is in the benchmark; an unknown id keeps them all."""
    known = benchmark.select(F.max((F.col("benchmark_id") == benchmark_id).cast("int"))).scalar()
    names = ladder.where(F.col("benchmark_id") == benchmark_id).select("scenario_name").distinct()
    inside = names.select(F.col("scenario_name").alias("_name"), F.lit(True).alias("_in"))
    marked = rows.withColumn("_name", js_trim(F.col("scenario_name"))).join(inside, "_name", "left")
    return marked.where((F.coalesce(known, F.lit(0)) == 0) | F.col("_in")).drop("_name", "_in")


def pb_ranks(rows: DataFrame, picked: DataFrame) -> DataFrame:
    """The rank of each scenario's best on its picked ladder ``(scenario_name, benchmark_id, thresholds)``."""
    named = rows.where(F.col("pb").isNotNull()).withColumn("_name", js_trim(F.col("scenario_name")))
    ladders = picked.select(F.col("scenario_name").alias("_name"), "benchmark_id", "thresholds")
    return named.join(ladders, "_name").withColumn("k", rank.rank_on(F.col("thresholds"), F.col("pb"))["k"]).drop("_name")


def pb_summary(history: DataFrame) -> DataFrame:
    """The best run (the earlier on a tie), the runs since, and the time played."""
    order = ["started_at", "id"]
    placed = scan.running(history, HISTORY, order, _n=scan.position())
    best = F.max_by(F.struct("id", "_n"), F.when(F.col("score").isNotNull(), F.struct("score", -F.col("_n"))))
    folded = placed.groupBy(*HISTORY).agg(
        best.alias("_b"), F.max("_n").alias("_last"), F.sum("duration_s").alias("played_s")
    )
    return folded.select(
        *HISTORY,
        F.col("_b.id").alias("pb_id"),
        F.when(F.col("_b").isNull(), 0).otherwise(F.col("_last") - F.col("_b._n")).alias("runs_since"),
        "played_s",
    )


def progress_series(history: DataFrame, picked: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per run for the score chart: value, best, form, rank on the picked ladder and change from the best before."""
    hot = scan.hot_groups(history, HISTORY, "started_at")
    order = ["started_at", "id"]
    rolled = scan.rolling_median(history, HISTORY, order, "score", window, hot=hot)
    lines = scan.running(rolled, HISTORY, order, hot, run_no=scan.position(), best=scan.highest(F.col("score")))
    ladders = picked.select(F.col("scenario_name").alias("_name"), "thresholds")
    ranked = lines.withColumn("_name", js_trim(F.col("scenario_name"))).join(ladders, "_name", "left").drop("_name")
    k = rank.rank_on(F.col("thresholds"), F.col("score"))["k"]
    return ranked.withColumn("k", F.when(F.col("thresholds").isNotNull() & F.col("score").isNotNull(), k)).withColumn(
        "vs_pb", F.col("score") - F.col("pb_before")
    )
