"""Distributions and history reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .views import HISTORY

BAND_FLOOR = 5


def distribution(complete: DataFrame) -> DataFrame:
    """Run count, mean, median, 90th percentile and best of each scenario."""
    return scan.percentiles(
        complete, HISTORY, "score", {"p50": 0.5, "p90": 0.9},
        n=F.count(F.lit(1)), mean=F.avg("score"), best=F.max("score"),
    )


def distribution_sketch(complete: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """The same with mergeable percentile sketches, for when a small error is worth one pass."""
    return complete.groupBy(*HISTORY).agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"),
        F.percentile_approx("score", 0.5, accuracy).alias("p50"),
        F.percentile_approx("score", 0.9, accuracy).alias("p90"), F.max("score").alias("best"),
    )


def bot_rollup(kills: DataFrame) -> DataFrame:
    """Kills, mean time to kill and sums of each bot in each run."""
    return kills.groupBy("run_id", "bot").agg(
        F.count(F.lit(1)).alias("kills"),
        F.avg("ttk").alias("avg_ttk"),
        *(F.sum(c).alias(c) for c in ("shots", "hits", "damage_done", "damage_possible", "overshots")),
    )


def percentiles_of_others(
    df: DataFrame, keys: Sequence[str], owner: str, wanted: dict[str, dict[str, float]], others: str = "others", hot: scan.Hot | None | str = "auto"
) -> DataFrame:
    """Per group and owner, exact percentiles over the group's values that belong to other owners.

    ``wanted`` gives the percentiles of each value column: ``{column: {name: point}}``; ``others`` counts the others' values
    of the first column. All columns are numbered in one pass, each along its own group. Leaving an owner's own values out
    moves a position by how many of them lie at or below it: an own value at position a that has i own ones below it moves
    every rank from a - i on. So a percentile is a count of these and two lookups by position; no owner is paired with the
    others' rows, and none gathers its own.
    """
    keys, columns = list(keys), list(wanted)
    long = df.select(*keys, owner, F.inline(F.array(*(F.struct(F.lit(i).alias("_of"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)))))
    group = [*keys, "_of"]
    if hot == "auto":
        hot = scan.hot_groups(df, keys)
    # Rows without a value come last in their group, so that positions count values only and every owner stays.
    flagged = long.withColumn("_none", F.col("_v").isNull().cast("int")).withColumn("_key", F.coalesce("_v", F.lit(0.0)))
    placed = scan.running(flagged, group, ["_none", "_key", owner], hot, _at=scan.position())
    moved = scan.running(placed, [*group, owner], ["_at"], hot, _nth=scan.position()).withColumn("_from", F.col("_at") - F.col("_nth"))
    # One row per owner: how many own values move each rank that a percentile reads.
    points = [(i, name, p) for i, c in enumerate(columns) for name, p in wanted[c].items()]
    rows = _sized(moved, group, owner, hot)
    place = lambda p: (F.col("_n") - F.col("_own") - 1) * p
    ends = [(i, name, p, end, at) for i, name, p in points for end, at in (("lo", F.floor), ("hi", F.ceil))]
    ranks = rows.groupBy(*group, owner).agg(
        F.first(F.col("_n") - F.col("_own")).alias("_m"),
        *(F.count_if((F.col("_of") == i) & F.col("_v").isNotNull() & (F.col("_from") <= at(place(p)))).alias(f"_{name}_{end}") for i, name, p, end, at in ends),
    )
    at_m = lambda p: (F.col("_m") - 1) * p
    looks = F.array(*(
        F.struct(F.lit(i).alias("of"), F.lit(name).alias("name"),
                 (at_m(p) - F.floor(at_m(p)) if end == "hi" else 1 - at_m(p) + F.floor(at_m(p))).alias("part"),
                 (at(at_m(p)) + F.col(f"_{name}_{end}") + 1).alias("at"))
        for i, name, p, end, at in ends
    ))
    looked = ranks.where("_m > 0").select(*group, owner, "_m", F.explode(F.filter(looks, lambda w: w["of"] == F.col("_of"))).alias("_w")).select(
        *group, owner, "_m", "_w.name", "_w.part", F.col("_w.at").cast("bigint").alias("_at")
    )
    found = looked.join(placed.where("_none = 0").select(*group, F.col("_at").cast("bigint").alias("_at"), "_v"), [*group, "_at"])
    mix = (F.sum(F.when((F.col("_of") == i) & (F.col("name") == name), F.col("part") * F.col("_v"))).alias(name) for i, name, p in points)
    return found.groupBy(*keys, owner).agg(F.max(F.when(F.col("_of") == 0, F.col("_m"))).alias(others), *mix)


def _sized(placed: DataFrame, group: list[str], owner: str, hot: scan.Hot | None) -> DataFrame:
    """Adds how many values the group (``_n``) and the owner (``_own``) have; groups too large for a window are counted first."""
    if hot is None:
        sizes = {"_n": Window.partitionBy(*group), "_own": Window.partitionBy(*group, owner)}
        return placed.withColumns({name: F.count("_v").over(over) for name, over in sizes.items()})
    own = placed.groupBy(*group, owner).agg(F.count("_v").alias("_own"))
    size = own.groupBy(*group).agg(F.sum("_own").alias("_n"))
    return placed.join(own, [*group, owner]).join(size, group)


def bot_breakdown(rollup: DataFrame, complete: DataFrame) -> DataFrame:
    """Each run's bots against the scenario's other runs: percentiles of the other runs' means."""
    owner = complete.select(F.col("id").alias("run_id"), *HISTORY)
    mine = rollup.join(owner, "run_id").withColumn("accuracy", F.col("hits") / F.nullif(F.col("shots"), F.lit(0)))
    by = [*HISTORY, "bot", "run_id"]
    told = percentiles_of_others(
        mine, by[:-1], "run_id",
        {"avg_ttk": {"p50_ttk": 0.5, "p90_ttk": 0.9, "best_ttk": 0.0}, "accuracy": {"p50_accuracy": 0.5, "p90_accuracy": 0.9, "best_accuracy": 1.0}},
        "runs",
    )
    return mine.select(*by, "kills", "avg_ttk", "accuracy").join(told, by, "left")


def kill_breakdown(kills: DataFrame) -> DataFrame:
    """Each run's bots against single kills of the scenario's other runs."""
    return percentiles_of_others(kills, [*HISTORY, "bot"], "run_id", {"ttk": {"p50_ttk": 0.5, "p90_ttk": 0.9, "best_ttk": 0.0}})


def pb_timeline(progress: DataFrame) -> DataFrame:
    """Runs that set a personal best; a scenario's first run counts."""
    return progress.where(F.col("pb_before").isNull() | (F.col("score") > F.col("pb_before")))


def pb_cost(progress: DataFrame, attempts: DataFrame) -> DataFrame:
    """Personal bests with the attempts and resets they took."""
    tries = attempts.select("player_id", "id", "attempt_no", "resets_before")
    return pb_timeline(progress).join(tries, ["player_id", "id"])


def reroll_rate(run: DataFrame) -> DataFrame:
    resets, completes = F.count_if(F.col("kind") == "reset"), F.count_if(F.col("kind") == "complete")
    return run.groupBy(*HISTORY).agg(
        resets.alias("resets"), completes.alias("completes"), (resets / F.count(F.lit(1))).alias("reroll_rate")
    )


def cumulative(ticks: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Ticks with running sums of ``metrics`` along each run."""
    steps = {f"c_{m}": scan.total(F.col(m)) for m in metrics}
    return scan.running(ticks, ["run_id"], ["tick_no"], **steps)


def score_band(ticks: DataFrame, complete: DataFrame, inspected: DataFrame, floor: int = BAND_FLOOR) -> DataFrame:
    """The running score of the inspected run of each scenario beside the band of all its runs, by elapsed second.

    ``inspected(player_id, scenario_id, run_id)`` names at most one run per scenario. Seconds with fewer than ``floor``
    ticks have no band.
    """
    owner = complete.select(F.col("id").alias("run_id"), *HISTORY)
    climbed = cumulative(ticks, ["score"]).join(owner, "run_id").select(
        *HISTORY, "run_id", F.floor("t").alias("second"), F.col("c_score").alias("c")
    )
    by = [*HISTORY, "second"]
    band = scan.percentiles(climbed, by, "c", {"p50": 0.5, "p90": 0.9}, n=F.count(F.lit(1))).where(F.col("n") >= floor)
    mine = climbed.join(inspected.select(*HISTORY, "run_id"), [*HISTORY, "run_id"], "left_semi").select(*by, "c")
    return mine.join(band, by, "full")


def run_with_pb(progress: DataFrame) -> DataFrame:
    return progress.withColumn("delta", F.col("score") - F.col("pb_before"))


def slot_stats(kills: DataFrame) -> DataFrame:
    """Per kill slot of a scenario: runs, mean and population deviation of the time to kill, where it is positive."""
    return kills.where(F.col("ttk") > 0).groupBy(*HISTORY, F.col("ordinal").alias("slot")).agg(
        F.count(F.lit(1)).alias("runs"), F.avg("ttk").alias("mean"), F.stddev_pop("ttk").alias("spread")
    )


def kill_detail(kills: DataFrame) -> DataFrame:
    """One row per run with its kills as an ordered array."""
    packed = F.array_sort(F.collect_list(F.struct("ordinal", "bot", "hits", "shots", "ttk")))
    return kills.groupBy("run_id").agg(packed.alias("kills"))


def tick_spread(ticks: DataFrame, complete: DataFrame) -> DataFrame:
    """How far apart a scenario's runs are in time at the same tick number."""
    owner = complete.select(F.col("id").alias("run_id"), *HISTORY)
    return ticks.join(owner, "run_id").groupBy(*HISTORY, "tick_no").agg((F.max("t") - F.min("t")).alias("spread"))


def confounds(progress: DataFrame) -> DataFrame:
    """What else changed since the run before: settings, game version, frame rate."""
    walked = scan.running(
        progress, HISTORY, ["started_at", "id"],
        _version=scan.previous(F.col("game_version_id")), _fps=scan.previous(F.col("avg_fps")),
    )
    changed = F.col("_version").isNotNull() & (F.col("_version") != F.col("game_version_id"))
    return walked.withColumn("version_changed", changed).withColumn("fps_delta", F.col("avg_fps") - F.col("_fps")).drop(
        "_version", "_fps"
    )


def score_formula_error(ticks: DataFrame) -> DataFrame:
    """The largest distance of a run's running score from ``10 kills sqrt(hits / shots)``."""
    sums = cumulative(ticks, ["score", "kills", "shots_hit", "shots_fired"])
    model = 10 * F.col("c_kills") * F.sqrt(F.col("c_shots_hit") / F.nullif(F.col("c_shots_fired"), F.lit(0.0)))
    return sums.groupBy("run_id").agg(F.max(F.abs(F.col("c_score") - model)).alias("max_error"))


def latest_per_scenario(runs: DataFrame) -> DataFrame:
    """The newest run of each scenario, as ``(player_id, scenario_id, run_id)``."""
    newest = F.max_by("id", F.struct("started_at", "id")).alias("run_id")
    return runs.groupBy(*HISTORY).agg(newest)


