"""Session totals and recent form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .views import HISTORY

BASELINE_RUNS = 20
SESSION = ["player_id", "session_id"]


def edges(sessions: DataFrame) -> DataFrame:
    """Each session's first run, and the next session's."""
    starts = sessions.groupBy(*SESSION).agg(
        F.min("written_at").alias("start"), F.first("session_first_run_id").alias("first_run_id")
    )
    return scan.running(starts, ["player_id"], ["-session_id"], next_start=scan.previous(F.col("start")))


def played(sessions: DataFrame, complete: DataFrame) -> DataFrame:
    """Complete runs with the session they belong to."""
    return complete.join(sessions.select("player_id", "id", "session_id"), ["player_id", "id"])


def bounds(played_runs: DataFrame) -> DataFrame:
    return played_runs.groupBy(*SESSION).agg(
        F.min("started_at").alias("started_at"), F.max("written_at").alias("ended_at"), F.count(F.lit(1)).alias("runs")
    )


def per_scenario(played_runs: DataFrame) -> DataFrame:
    """Median and best score of each scenario in each session."""
    scored = played_runs.where(F.col("score").isNotNull())
    return scan.percentiles(scored, [*SESSION, "scenario_id"], "score", {"median": 0.5}, best=F.max("score"))


def form(played_runs: DataFrame, runs: int = BASELINE_RUNS) -> DataFrame:
    """Per session and scenario: median, best, the median of the last ``runs`` scores before the session, and the best
    of the last earlier session that scored it.

    The baseline is the rolling median as it stood on the scenario's row just before the session's first one, so no run
    is paired with its predecessors.
    """
    scored = played_runs.where(F.col("score").isNotNull())
    order = ["started_at", "id"]
    hot = scan.hot_groups(scored, HISTORY, "started_at")
    rolled = scan.rolling_median(scored, HISTORY, order, "score", runs, "_form", None, hot)
    walked = scan.running(
        rolled, HISTORY, order, hot, _was=scan.previous(F.col("_form")), _session=scan.previous(F.col("session_id"))
    )
    enters = F.col("_session").isNull() | (F.col("_session") != F.col("session_id"))
    baseline = walked.where(enters).select(*SESSION, "scenario_id", F.col("_was").alias("baseline"))
    totals = per_scenario(played_runs)
    ahead = scan.running(totals, HISTORY, ["session_id"], prev_best=scan.previous(F.col("best")))
    return ahead.join(baseline, [*SESSION, "scenario_id"], "left")


def change(form_rows: DataFrame) -> DataFrame:
    """A session's mean change against form, over scenarios with a positive baseline."""
    base = F.col("baseline")
    return form_rows.groupBy(*SESSION).agg(
        F.avg(F.when(base > 0, (F.col("median") - base) / base)).alias("change")
    )


def row_change(history: DataFrame) -> DataFrame:
    """Change from the previous score, and whether the run beat every earlier one."""
    beat = F.col("score").isNotNull() & F.col("pb_before").isNotNull() & (F.col("score") > F.col("pb_before"))
    return history.withColumn("delta", F.col("score") - F.col("prev_score")).withColumn(
        "is_pb", F.coalesce(beat, F.lit(False))
    )


def list_groups(rows: DataFrame) -> DataFrame:
    """Numbers stretches of rows of one session in list order (newest first)."""
    order = ["-written_at", "-id"]
    hot = scan.hot_groups(rows, ["player_id"], "written_at")
    walked = scan.running(rows, ["player_id"], order, hot, _prev=scan.previous(F.col("session_id")))
    turn = (F.col("_prev").isNull() | (F.col("_prev") != F.col("session_id"))).cast("int")
    return scan.running(walked.withColumn("_turn", turn), ["player_id"], order, hot, group_no=scan.total(F.col("_turn"))).drop(
        "_prev", "_turn"
    )


def session_line(form_rows: DataFrame) -> DataFrame:
    """A session's best in a scenario and its change from the last session's."""
    return form_rows.withColumn("delta", F.col("best") - F.col("prev_best"))


def breaks(history: DataFrame) -> DataFrame:
    """Within a scenario's history: where the session changes, and the session's number from 1."""
    order = ["started_at", "id"]
    hot = scan.hot_groups(history, HISTORY, "started_at")
    walked = scan.running(history, HISTORY, order, hot, _prev=scan.previous(F.col("session_id")))
    turned = F.col("_prev").isNotNull() & (F.col("_prev") != F.col("session_id"))
    marked = walked.withColumn("is_break", turned).withColumn("_one", turned.cast("int"))
    return scan.running(marked, HISTORY, order, hot, _n=scan.total(F.col("_one"))).withColumn(
        "session_no", F.col("_n") + 1
    ).drop("_prev", "_one", "_n")


def position_effect(sessions: DataFrame, complete: DataFrame) -> DataFrame:
    """Mean score over the scenario's median, by position in the session."""
    usual = scan.percentiles(complete, HISTORY, "score", {"p50": 0.5})
    placed = complete.join(sessions.select("player_id", "id", "position_in_session"), ["player_id", "id"]).join(usual, HISTORY)
    return placed.groupBy("player_id", "position_in_session").agg(
        F.avg(F.col("score") / F.nullif(F.col("p50"), F.lit(0))).alias("normalised")
    )
