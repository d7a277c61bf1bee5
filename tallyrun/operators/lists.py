"""Lookups, lists and pages over complete runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_trim
from ..session import stored
from . import scan
from .views import HISTORY

PAGE = 50
SETTINGS = ["sens_scale", "horiz_sens", "vert_sens"]


def rows_by_key(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``ids``."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def page_table(complete: DataFrame) -> DataFrame:
    """Complete runs as a stored table in the order of players' lists, in which a page reads the files and row groups up
    to its cursor only."""
    return stored(complete.repartitionByRange("player_id", "written_at").sortWithinPartitions("player_id", "written_at", "id"))


def page(
    complete: DataFrame, scenario_id: int | None = None, before: tuple | None = None, size: int = PAGE, player_id: int | None = None
) -> DataFrame:
    """The newest runs, one more than ``size`` as the sign that another page follows.

    ``before`` is the ``(written_at, id)`` of the last row already shown. Rows past ``size`` are marked ``ahead``.
    """
    rows = complete if player_id is None else complete.where(F.col("player_id") == player_id)
    if scenario_id is not None:
        rows = rows.where(F.col("scenario_id") == scenario_id)
    if before is not None:
        written, last = F.lit(before[0]), F.lit(before[1])
        # the first bound is implied, but only it reaches the scan
        rows = rows.where(F.col("written_at") <= written).where(
            (F.col("written_at") < written) | ((F.col("written_at") == written) & (F.col("id") < last))
        )
    cut = rows.orderBy(F.col("written_at").desc(), F.col("id").desc()).limit(size + 1)
    numbered = cut.withColumn("_p", F.lit(0))
    return (
        scan.running(numbered, ["_p"], ["-written_at", "-id"], None, row_no=scan.position())
        .drop("_p")
        .withColumn("ahead", F.col("row_no") > size)
    )


def cursor(shown: DataFrame, size: int = PAGE) -> tuple | None:
    """The ``before`` of the page that follows a page of ``size``; None where there is none."""
    last = shown.where(F.col("row_no") >= size).orderBy("row_no").select("row_no", "written_at", "id").take(2)
    return (last[0]["written_at"], last[0]["id"]) if len(last) == 2 else None


def with_history(complete: DataFrame) -> DataFrame:
    """Adds the last score that was recorded and the best one, both before each run."""
    score = F.col("score")
    return scan.running(
        complete,
        HISTORY,
        ["started_at", "id"],
        prev_score=scan.latest(score, "before"),
        pb_before=scan.highest(score, "before"),
    )


def attempts_page(complete: DataFrame, config: DataFrame, sessions: DataFrame, **cut) -> DataFrame:
    """A page with each row's settings, history and session; only the page's histories are read."""
    shown = page(complete, **cut)
    keys = shown.select(*HISTORY).distinct()
    past = with_history(complete.join(keys, HISTORY, "left_semi")).select("player_id", "id", "prev_score", "pb_before")
    named = sessions.select("player_id", "id", "session_first_run_id")
    return (
        shown.join(config.select("config_id", *SETTINGS), "config_id")
        .join(past, ["player_id", "id"])
        .join(named, ["player_id", "id"])
    )


def paged(complete: DataFrame, size: int = PAGE) -> DataFrame:
    """Every run's page number in its player's list, newest first."""
    walked = scan.running(complete, ["player_id"], ["-written_at", "-id"], row_no=scan.position())
    return walked.withColumn("page_no", F.floor((F.col("row_no") - 1) / size))


def merge_pages(pages: DataFrame) -> DataFrame:
    """Overlapping pages as one list: each file once, at its first page."""
    first = pages.groupBy("player_id", "file_stem").agg(F.min("page_no").alias("page_no"))
    return pages.join(first, ["player_id", "file_stem", "page_no"], "left_semi").dropDuplicates(
        ["player_id", "file_stem"]
    )


def latest_run(complete: DataFrame, by: list[str]) -> DataFrame:
    """The last written complete run of each group."""
    columns = [c for c in complete.columns if c not in by]
    newest = F.max_by(F.struct(*columns), F.struct("written_at", "id")).alias("_r")
    return complete.groupBy(*by).agg(newest).select(*by, "_r.*")


def played_scenarios(scenario: DataFrame, complete: DataFrame) -> DataFrame:
    return scenario.join(complete.select("scenario_id").distinct(), "scenario_id", "left_semi")


def versions(scenario: DataFrame, complete: DataFrame) -> DataFrame:
    """Played versions with the name they share, and the newest of each name marked."""
    played = complete.groupBy("player_id", "scenario_id").agg(
        F.count(F.lit(1)).alias("runs"), F.max("started_at").alias("last_played")
    )
    rows = played.join(scenario, "scenario_id").withColumn("trimmed", js_trim(F.col("name")))
    newest = rows.groupBy("player_id", "trimmed").agg(
        F.max_by("hash", F.struct("last_played", "hash")).alias("_newest")
    )
    return rows.join(newest, ["player_id", "trimmed"]).withColumn("is_newest", F.col("hash") == F.col("_newest")).drop("_newest")


def history(progress: DataFrame, config: DataFrame, sessions: DataFrame) -> DataFrame:
    """A scenario's runs with their settings and session, oldest first by ``started_at, id``."""
    return progress.join(config, "config_id").join(sessions.select("player_id", "id", "session_id"), ["player_id", "id"])


def top_recent(complete: DataFrame, k: int = 10) -> DataFrame:
    """The last ``k`` scores of each scenario, newest first."""
    from pyspark.sql import Window

    newest = Window.partitionBy(*HISTORY).orderBy(F.col("started_at").desc(), F.col("id").desc())
    ranked = complete.where(F.col("score").isNotNull()).select(*HISTORY, "score", F.row_number().over(newest).alias("n"))
    kept = ranked.where(F.col("n") <= k)
    return kept.groupBy(*HISTORY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "score"))), lambda x: x["score"]).alias("recent")
    )


def directory(complete: DataFrame, k: int = 10) -> DataFrame:
    """Every played scenario with its totals and its last scores."""
    totals = complete.groupBy(*HISTORY, "scenario_name", "scenario_hash").agg(
        F.count(F.lit(1)).alias("runs"), F.max("score").alias("pb"), F.max("started_at").alias("last_played")
    )
    recent = top_recent(complete, k)
    empty = F.array().cast("array<double>")
    return totals.join(recent, HISTORY, "left").withColumn("recent", F.coalesce("recent", empty))


def rank_stream(run: DataFrame, scenario: DataFrame, names: DataFrame) -> DataFrame:
    """Complete scored runs of every version of the scenarios whose trimmed name is in ``names(scenario_name)``."""
    trimmed = scenario.withColumn("scenario_name", js_trim(F.col("name"))).drop("name")
    wanted = trimmed.join(names.select("scenario_name").distinct(), "scenario_name", "left_semi")
    scored = run.where("kind = 'complete' AND score IS NOT NULL")
    return scored.join(wanted, "scenario_id").select(
        "player_id", "scenario_id", "scenario_name", "hash", "id", F.col("started_at").alias("t"), "score"
    )


def played_bests(run: DataFrame, scenario: DataFrame) -> DataFrame:
    """Best score and last run per trimmed scenario name, grouped by version first."""
    per = (
        run.where("kind = 'complete' AND score IS NOT NULL")
        .groupBy(*HISTORY)
        .agg(F.max("score").alias("pb"), F.max("started_at").alias("last"))
    )
    named = per.join(scenario.select("scenario_id", js_trim(F.col("name")).alias("scenario_name")), "scenario_id")
    return named.groupBy("player_id", "scenario_name").agg(F.max("pb").alias("pb"), F.max("last").alias("last"))


def has_runs(complete: DataFrame) -> DataFrame:
    """One row: whether any complete run exists. Reads no more than one row."""
    return complete.limit(1).agg((F.count(F.lit(1)) > 0).alias("has_runs"))


def newer_than(complete: DataFrame, cursor: DataFrame) -> DataFrame:
    """Per player whether a run was written after the remembered ``cursor(player_id, written_at, id)``."""
    top = complete.groupBy("player_id").agg(F.max(F.struct("written_at", "id")).alias("_top"))
    seen = cursor.select("player_id", F.struct("written_at", "id").alias("_seen"))
    joined = top.join(seen, "player_id", "left")
    return joined.select("player_id", (F.col("_seen").isNull() | (F.col("_top") > F.col("_seen"))).alias("newer"))


def most_played_with_kills(complete: DataFrame, kills: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` scenarios with most runs that have kill rows."""
    owners = kills.select(F.col("run_id").alias("id")).distinct()
    counted = complete.join(owners, "id", "left_semi").groupBy("scenario_id").agg(F.count(F.lit(1)).alias("runs"))
    return counted.orderBy(F.col("runs").desc(), "scenario_id").limit(k)
