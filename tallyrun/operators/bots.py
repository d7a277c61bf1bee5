"""Encounters with single opponents: when each was engaged, what it cost, and how that changes over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .curves import PARAMS, at_time, comparable

HISTORY = ["player_id", "scenario_id"]
CLICK_MAX_SHOTS = 3
WINDOW_MAX_SPREAD = 0.02
WINDOW_MIN_RUNS = 2
LOOK_BACK = 5
TINTS = 6
PAIR = ["run_id", "other_id"]


def clicking(kills: DataFrame) -> DataFrame:
    """Whether a run's lower median of shots per kill is a clicker's."""
    middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY shots)")
    return kills.groupBy("run_id").agg((middle <= CLICK_MAX_SHOTS).alias("is_clicking"))


def fixed_window(slot_stats: DataFrame) -> DataFrame:
    """The live window of scenarios whose time to kill is the same in every run, null for others."""
    judged = slot_stats.where(F.col("runs") >= WINDOW_MIN_RUNS)
    loose = ~(F.col("mean") > 0) | (F.col("spread") / F.col("mean") > WINDOW_MAX_SPREAD)
    first = F.max(F.when(F.col("slot") == 0, F.col("mean")))
    folded = judged.groupBy(*HISTORY).agg(first.alias("_first"), F.some(loose).alias("_loose"))
    return folded.select(*HISTORY, F.when(~F.col("_loose"), F.col("_first")).alias("window_s"))


def engagements(kills: DataFrame, windows: DataFrame) -> DataFrame:
    """Start and end of each engagement, in runs whose kill times hold.

    ``kills`` has ``kill_t`` and ``in_order``. A start lies between the previous kill and the own one, and no more than
    the scenario's live window before it.
    """
    valid = kills.groupBy("run_id").agg(F.every("in_order").alias("_fine")).where("_fine").select("run_id")
    timed = kills.join(valid, "run_id", "left_semi").join(windows, HISTORY, "left")
    walked = scan.running(timed, ["run_id"], ["ordinal"], _prev=scan.previous(F.col("kill_t")))
    end, prev = F.col("kill_t"), F.coalesce(F.col("_prev"), F.lit(0.0))
    reach = F.when(F.col("window_s").isNull(), F.col("ttk")).otherwise(F.least("ttk", "window_s"))
    start = F.least(end, F.greatest(prev, end - F.coalesce(reach, F.lit(0.0))))
    return walked.select(
        *HISTORY, "run_id", F.col("ordinal").alias("slot"), "bot", "hits", "shots", start.alias("start"), end.alias("end"),
        (start - prev).alias("dead"),
    )


def encounters(engaged: DataFrame, params: DataFrame) -> DataFrame:
    """Engagements as spans of progress: equal slots in a race, times over the duration on a clock."""
    rows = engaged.join(params.where("kind <> 'unsupported'").select("run_id", "kind", "duration_s", "bots"), "run_id")
    race = F.col("kind") == "race"

    def share(t: str):
        return F.least(F.lit(1.0), F.col(t) / F.col("duration_s"))

    return rows.withColumn("x0", F.when(race, F.col("slot") / F.col("bots")).otherwise(share("start"))).withColumn(
        "x1", F.when(race, (F.col("slot") + 1) / F.col("bots")).otherwise(share("end"))
    )


def dead_time(engaged: DataFrame) -> DataFrame:
    return engaged.groupBy("run_id").agg(F.sum("dead").alias("dead_s"), F.count(F.lit(1)).alias("slots"))


def best_splits(engaged: DataFrame) -> DataFrame:
    """The fastest split of each slot over a scenario's runs with the same number of slots."""
    sized = engaged.join(dead_time(engaged), "run_id")
    return sized.groupBy(*HISTORY, "slots", "slot").agg(F.min(F.col("end") - F.col("start")).alias("best"))


def race_table(engaged: DataFrame, params: DataFrame, pairs: DataFrame) -> DataFrame:
    """Race slots with split, pace, baseline and best; slot -1 is the time between engagements.

    ``pairs(run_id, other_id)`` gives the baseline run. One with another number of slots does not count.
    """
    races = params.where("kind = 'race'").select("run_id")
    own = engaged.join(races, "run_id", "left_semi").withColumn("split", F.col("end") - F.col("start"))
    size = dead_time(own)
    base = pairs.join(size.select("run_id", "slots"), "run_id").join(
        size.select(F.col("run_id").alias("other_id"), F.col("slots").alias("_slots"), F.col("dead_s").alias("base_dead")), "other_id"
    ).where("slots = _slots").select("run_id", "other_id", "base_dead")
    splits = own.select(F.col("run_id").alias("other_id"), "slot", F.col("split").alias("baseline"))
    rows = own.join(size, "run_id").join(base, "run_id", "left").join(splits, ["other_id", "slot"], "left")
    rows = rows.join(best_splits(own), [*HISTORY, "slots", "slot"])
    table = rows.select(
        "run_id", "slot", "bot", "split", (F.col("split") * F.col("slots")).alias("pace"), "baseline",
        (F.col("baseline") - F.col("split")).alias("delta"), F.least("best", "split").alias("best"),
    ).withColumn("delta_best", F.col("best") - F.col("split"))
    dead = size.join(base, "run_id", "left").select(
        "run_id", F.lit(-1).alias("slot"), F.col("dead_s").alias("split"), F.col("base_dead").alias("baseline"),
        (F.col("base_dead") - F.col("dead_s")).alias("delta"),
    )
    return table.unionByName(dead, allowMissingColumns=True)


def points_by_bot(engaged: DataFrame, points: DataFrame) -> DataFrame:
    """Engagements of clock runs with the points gained in each."""
    clocks = points.where("kind = 'clock'")
    ids = clocks.where("idx = 0").select("run_id", "duration_s")
    own = engaged.join(ids, "run_id")
    ends = F.array(F.struct(F.lit(-1.0).alias("sign"), F.col("start").alias("t")), F.struct(F.lit(1.0).alias("sign"), F.col("end").alias("t")))
    # Probes bring their engagement along: a join by run and slot would shuffle all of them once more.
    rest = F.struct(*(c for c in own.columns if c not in ("run_id", "slot")))
    probes = own.select("run_id", "slot", rest.alias("_own"), F.inline(ends))
    gained = at_time(clocks, probes).groupBy("run_id", "slot").agg(
        F.sum(F.col("sign") * F.col("u")).alias("points"), F.collect_list(F.when(F.col("sign") > 0, F.col("_own"))).alias("_owns")
    )
    return gained.select("run_id", "slot", "points", F.inline("_owns")).select(*own.columns, "points")


def clock_table(engaged: DataFrame, points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Clock runs by bot in order of first meeting, against the baseline run; a null bot is what no bot took."""
    spent = points_by_bot(engaged, points)
    by_bot = spent.groupBy("run_id", "bot", "duration_s").agg(
        F.min("slot").alias("first_slot"), F.sum(F.col("end") - F.col("start")).alias("time"), F.count(F.lit(1)).alias("encounters"),
        F.sum("hits").alias("hits"), F.sum("shots").alias("shots"), F.sum("points").alias("points"),
    )
    base = by_bot.select(F.col("run_id").alias("other_id"), "bot", F.col("points").alias("_base"))
    rows = by_bot.join(pairs, "run_id", "left").join(base, ["other_id", "bot"], "left")
    against = F.when(F.col("other_id").isNotNull(), F.coalesce("_base", F.lit(0.0)))
    table = rows.select(
        "run_id", "bot", "first_slot", "time", "encounters", "hits", "shots",
        F.when(F.col("shots") > 0, F.col("hits") / F.col("shots")).alias("accuracy"), "points",
        F.when(F.col("time") > 0, F.col("points") / F.col("time") * F.col("duration_s")).alias("pace"),
        against.alias("baseline"), (F.col("points") - against).alias("delta"),
    )
    total = by_bot.groupBy("run_id", "duration_s").agg(F.sum("time").alias("_t"), F.sum("points").alias("_p"))
    ends = points.where("kind = 'clock'").groupBy("run_id").agg(F.max_by("u", "idx").alias("_u"))
    dead = total.join(ends, "run_id").select(
        "run_id", F.greatest(F.lit(0.0), F.col("duration_s") - F.col("_t")).alias("time"), (F.col("_u") - F.col("_p")).alias("points")
    )
    return table.unionByName(dead, allowMissingColumns=True)


def largest_loss(table: DataFrame, place: str) -> DataFrame:
    """The row of each run that lost most, if any did; the first of equals."""
    lost = table.where((F.col("delta") < 0) & F.col("bot").isNotNull())
    return lost.groupBy("run_id").agg(
        F.min_by(F.struct("bot", F.col(place).alias("place"), "delta"), F.struct("delta", place)).alias("_w")
    ).select("run_id", "_w.*")


def bot_numbers(kills: DataFrame) -> DataFrame:
    """A category number per bot of a scenario, by name, the same in every run."""
    names = kills.select("scenario_id", "bot").distinct()
    return names.withColumn(
        "slot_no", (F.dense_rank().over(Window.partitionBy("scenario_id").orderBy("bot")) - 1) % TINTS
    )


def last_perf_runs(header: DataFrame, k: int = LOOK_BACK) -> DataFrame:
    """The newest ``k`` runs with performance files of each scenario, numbered from the newest."""
    newest = Window.partitionBy(*HISTORY).orderBy(F.col("started_at").desc(), F.col("run_id").desc())
    return header.where("has_perf").withColumn("age", F.row_number().over(newest)).where(F.col("age") <= k)


def scenario_kind(header: DataFrame, params: DataFrame, k: int = LOOK_BACK) -> DataFrame:
    """Race with its budget, clock or unknown, from the newest curve among the last runs."""
    tried = last_perf_runs(header, k).select(*HISTORY, "run_id", "age").join(params.select("run_id", "kind", "budget"), "run_id", "left")
    fine = F.coalesce(F.col("kind") != "unsupported", F.lit(False))
    folded = tried.groupBy(*HISTORY).agg(F.min_by(F.struct("kind", "budget"), F.when(fine, F.col("age"))).alias("_k"))
    played = header.select(*HISTORY).distinct().join(folded, HISTORY, "left")
    return played.select(*HISTORY, F.coalesce("_k.kind", F.lit("unknown")).alias("kind"), "_k.budget")


def reference_run(header: DataFrame, ticks: DataFrame, kills: DataFrame, params: DataFrame, k: int = LOOK_BACK) -> DataFrame:
    """The run whose engagements name a scenario's tabs: the newest of the last ``k`` with ticks and kills.

    A click scenario, or a reference without a curve, has no tabs.
    """
    has = ticks.select("run_id").distinct().join(kills.select("run_id").distinct(), "run_id", "left_semi")
    latest = last_perf_runs(header, k).join(has, "run_id", "left_semi").groupBy(*HISTORY).agg(F.min_by("run_id", "age").alias("run_id"))
    usable = latest.join(clicking(kills).where("NOT is_clicking"), "run_id", "left_semi")
    return usable.join(params.where("kind <> 'unsupported'").select("run_id", F.struct(*PARAMS).alias("reference")), "run_id")


def bot_tabs(reference: DataFrame, engaged: DataFrame) -> DataFrame:
    """Tabs: one per slot of a race, one per bot of a clock run in order of first meeting."""
    rows = reference.join(engaged.drop(*HISTORY), "run_id")
    race = F.col("reference.kind") == "race"
    key = F.when(race, F.col("slot").cast("string")).otherwise(F.col("bot"))
    label = F.when(race, F.concat((F.col("slot") + 1).cast("string"), F.lit(" · "), F.col("bot"))).otherwise(F.col("bot"))
    named = rows.withColumn("key", key).withColumn("label", label)
    tabs = named.groupBy(*HISTORY, "reference", "key").agg(F.min("slot").alias("_first"), F.min_by("label", "slot").alias("label"))
    place = Window.partitionBy(*HISTORY).orderBy("_first")
    return tabs.withColumn("tab_no", F.row_number().over(place)).withColumn("kind", F.col("reference.kind")).drop("_first")


def bot_series(tabs: DataFrame, engaged: DataFrame, points: DataFrame, params: DataFrame, kills: DataFrame) -> DataFrame:
    """One value per run and tab on the score scale, with the table's own figure, over runs that compare with the reference."""
    refs = tabs.groupBy(*HISTORY, "reference").agg(F.count(F.lit(1)).alias("tabs"))
    own = params.where("kind <> 'unsupported'").select(*HISTORY, "run_id", "budget", F.struct(*PARAMS).alias("p"))
    fit = own.join(refs, HISTORY).where(comparable(F.col("reference"), F.col("p")))
    fit = fit.join(clicking(kills).where("NOT is_clicking"), "run_id", "left_semi").select("run_id", "budget", "tabs")
    size = engaged.groupBy("run_id").agg(F.count(F.lit(1)).alias("slots"))
    split = F.col("end") - F.col("start")
    race_ids = params.where("kind = 'race'").select("run_id")
    races = (
        engaged.join(race_ids, "run_id", "left_semi").join(fit, "run_id").join(size, "run_id").where("slots = tabs")
        .select(*HISTORY, "run_id", F.col("slot").cast("string").alias("key"), (F.col("budget") - split * F.col("slots")).alias("value"), split.alias("raw"))
    )
    spent = points_by_bot(engaged, points).join(fit, "run_id", "left_semi")
    clocks = spent.groupBy(*HISTORY, "run_id", "bot", "duration_s").agg(F.sum("points").alias("raw"), F.sum(split).alias("_t")).select(
        *HISTORY, "run_id", F.col("bot").alias("key"),
        F.when(F.col("_t") > 0, F.col("raw") / F.col("_t") * F.col("duration_s")).alias("value"), "raw",
    )
    return races.unionByName(clocks).join(tabs.select(*HISTORY, "key", "tab_no"), [*HISTORY, "key"])


def covered(series: DataFrame) -> DataFrame:
    """How many runs of each scenario have a value."""
    return series.groupBy(*HISTORY).agg(F.count_distinct("run_id").alias("covered"))
