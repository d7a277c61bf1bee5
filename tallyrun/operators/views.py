"""Row views of the run model: ticks, kills, complete runs, attempts, progress and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from . import scan

HISTORY = ["player_id", "scenario_id"]
GAP = "INTERVAL 30 MINUTES"


def series(ticks: DataFrame, metrics: list[str], key: str | list[str] = "run_id") -> DataFrame:
    """One row per run: its ticks as an ordered array, and which metrics were reported at all.

    A struct array keeps every tick's nulls, which a plain ``collect_list`` of one metric would drop.
    """
    tick = F.struct("tick_no", "t", *metrics)
    return ticks.groupBy(key).agg(
        F.array_sort(F.collect_list(tick)).alias("ticks"),
        *((F.count(m) > 0).alias(f"has_{m}") for m in metrics),
    )


def tick_rows(series_rows: DataFrame, metrics: list[str], key: str = "run_id") -> DataFrame:
    """One row per tick; a metric the run never reported is null throughout."""
    spread = series_rows.select(key, F.posexplode("ticks").alias("tick_no", "tick"))
    return spread.select(key, "tick_no", "tick.t", *(f"tick.{m}" for m in metrics))


def kill_rows(kills: DataFrame, runs: DataFrame) -> DataFrame:
    """Kills with ratios and their offset from the run's start; the offset is not unwrapped at midnight."""
    owner = runs.select(F.col("id").alias("run_id"), "player_id", "scenario_id", "start_ms")
    return kills.join(owner, "run_id").select(
        "player_id",
        "scenario_id",
        *(c for c in kills.columns if c != "cheated"),
        (F.col("cheated") != 0).alias("cheated"),
        ratio(F.col("hits"), F.col("shots")).alias("accuracy"),
        ratio(F.col("damage_done"), F.col("damage_possible")).alias("efficiency"),
        ((F.col("at_ms") - F.col("start_ms")) / 1000.0).alias("t_offset"),
    )


def run_complete(run: DataFrame, scenario: DataFrame, version: DataFrame, perf: DataFrame) -> DataFrame:
    """Complete runs with their dimensions and whether a performance file is attached."""
    names = scenario.select("scenario_id", F.col("hash").alias("scenario_hash"), F.col("name").alias("scenario_name"))
    labels = version.select("game_version_id", F.col("label").alias("game_version"))
    landed = perf.select("player_id", F.col("run_id").alias("id"), F.lit(True).alias("_perf"))
    return (
        run.where("kind = 'complete'")
        .join(names, "scenario_id")
        .join(labels, "game_version_id")
        .join(landed, ["player_id", "id"], "left")
        .withColumn("has_perf", F.col("_perf").isNotNull())
        .drop("_perf")
    )


def run_attempt(run: DataFrame) -> DataFrame:
    """Attempt number and resets before it, over runs of every kind."""
    reset = F.when(F.col("kind") == "reset", 1).otherwise(0)
    numbered = scan.running(
        run, HISTORY, ["written_at", "id"], attempt_no=scan.position(), resets_before=scan.total(reset, "before")
    )
    return numbered.select(
        "player_id", "id", "scenario_id", "kind", "written_at", "attempt_no",
        F.coalesce("resets_before", F.lit(0)).alias("resets_before"),
    )


def run_progress(complete: DataFrame) -> DataFrame:
    """Each complete run's place in its scenario's history.

    ``best_so_far`` counts runs tied on ``started_at``; ``pb_before`` counts rows before this one only.
    """
    score, settings = F.col("score"), F.col("config_id")
    walked = scan.running(
        complete,
        HISTORY,
        ["started_at", "id"],
        completion_no=scan.position(),
        prev_score=scan.previous(score),
        pb_before=scan.highest(score, "before"),
        best_so_far=scan.highest(score, "ties"),
        prev_config=scan.previous(settings),
    )
    changed = F.col("prev_config").isNotNull() & (F.col("prev_config") != settings)
    return walked.withColumn("config_changed", changed).drop("prev_config")


def run_session(run: DataFrame, gap: str = GAP) -> DataFrame:
    """Numbers each player's sessions; a gap longer than ``gap`` starts one."""
    order = ["written_at", "id"]
    hot = scan.hot_groups(run, ["player_id"], "written_at")
    flagged = starts_session(run, gap, hot).withColumn("_new", F.col("is_start").cast("int"))
    placed = scan.running(flagged, ["player_id"], order, hot, session_id=scan.total(F.col("_new")))
    return scan.running(
        placed,
        ["player_id", "session_id"],
        order,
        hot,
        position_in_session=scan.position(),
        session_first_run_id=scan.opening(F.col("id")),
        session_start=scan.opening(F.col("written_at")),
    ).drop("_new", "is_start")


def starts_session(run: DataFrame, gap: str = GAP, hot: scan.Hot | None | str = "auto") -> DataFrame:
    """Marks runs with no other run in the ``gap`` before them, which the run just before decides."""
    behind = scan.running(run, ["player_id"], ["written_at", "id"], hot, _ago=scan.previous(F.col("written_at")))
    wait: Column = F.col("written_at") - F.col("_ago")
    return behind.withColumn("is_start", F.col("_ago").isNull() | (wait > F.expr(gap))).drop("_ago")
