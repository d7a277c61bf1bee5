"""Progress curves of runs, their pace, and how runs compare.

A curve is a list of points ``(t, x, u)``: seconds, progress from 0 to 1, and what was spent or earned so far. A clock
run progresses by time and earns points; a race progresses by damage and kills and spends seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import NO_LIMIT, project
from . import scan
from .joins import between, interpolate

DAY_S = 86_400
WINDOW_S = 5.0
COUNTDOWN_SLACK = 0.02
COUNTDOWN_SHARE = 0.9
PARAMS = ["kind", "duration_s", "budget", "pool", "bots"]


def inputs(header: DataFrame, ticks: DataFrame, kills: DataFrame) -> DataFrame:
    """One row per complete run with a performance file: settings, ticks and kill offsets as ordered arrays."""
    series = ticks.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("t", "score", F.col("damage_done").alias("damage")))).alias("ticks")
    )
    offsets = kills.groupBy("run_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "t_offset"))), lambda k: k["t_offset"]).alias("kill_offsets")
    )
    none = F.array().cast("array<double>")
    return (
        header.where("has_perf").join(series, "run_id").join(offsets, "run_id", "left")
        .withColumn("kill_offsets", F.coalesce("kill_offsets", none))
    )


def countdown(ticks: DataFrame) -> DataFrame:
    """Per run: tick count, end, which series it reports, and whether the score counts a race down.

    A countdown starts above zero and then, on nine ticks of ten, falls by the tick's duration.
    """
    walked = scan.running(ticks, ["run_id"], ["t"], _before=scan.previous(F.col("t")), _n=scan.position())
    step = F.abs(F.coalesce("score", F.lit(0.0)) + F.col("t") - F.col("_before")) < COUNTDOWN_SLACK
    folded = walked.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("ticks"),
        F.max("t").alias("end"),
        (F.count("score") > 0).alias("has_score"),
        (F.count("damage_done") > 0).alias("has_damage"),
        F.max(F.when(F.col("_n") == 1, F.coalesce("score", F.lit(0.0)))).alias("_first"),
        F.avg(F.when(F.col("_n") > 1, step.cast("int"))).alias("_share"),
    )
    falls = (F.col("_first") > 0) & (F.col("ticks") >= 2) & (F.col("_share") >= COUNTDOWN_SHARE)
    return folded.withColumn("is_countdown", F.coalesce(falls, F.lit(False))).drop("_first", "_share")


def kill_times(kills: DataFrame, ends: DataFrame) -> DataFrame:
    """Kills with their time on the run's clock, a day added past midnight, and whether the run's times all hold.

    They hold when they are in order and no later than one second past the last tick.
    """
    offset = F.col("t_offset")
    timed = kills.withColumn("kill_t", F.when(offset < 0, offset + DAY_S).otherwise(offset)).join(
        ends.select("run_id", "end"), "run_id"
    )
    walked = scan.running(timed, ["run_id"], ["ordinal"], _before=scan.previous(F.col("kill_t")))
    wrong = (F.col("kill_t") > F.col("end") + 1) | (F.col("kill_t") < F.col("_before"))
    return walked.withColumn("in_order", ~F.coalesce(wrong, F.lit(False))).drop("_before", "end")


def classify(header: DataFrame, ticks: DataFrame, kills: DataFrame) -> DataFrame:
    """The kind of curve each run with a performance file has, or why it has none."""
    shape = countdown(ticks)
    killed = kill_times(kills, shape).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("_kills"), F.every("in_order").alias("_ordered")
    )
    runs = header.where("has_perf").join(shape, "run_id", "left").join(killed, "run_id", "left")
    limit, scale = F.col("time_limit"), F.coalesce("timescale", F.lit(1.0))
    sentinel = F.coalesce(limit == NO_LIMIT, F.lit(False))
    bots = F.coalesce("_kills", F.lit(0))
    pool = F.coalesce(F.col("damage_done") > 0, F.lit(False)) & F.col("has_damage") & (bots > 0)
    good = limit.isNotNull() & (limit > 0) & (limit < NO_LIMIT) & (scale > 0)
    reason = (
        F.when(~F.coalesce("has_score", F.lit(False)), "no-score-series")
        .when(sentinel != F.col("is_countdown"), "signals-disagree")
        .when(sentinel & ~pool, "no-race-pool")
        .when(sentinel & ~F.col("_ordered"), "bad-kill-times")
        .when(~sentinel & ~F.coalesce(good, F.lit(False)), "bad-time-limit")
    )
    told = runs.withColumn("reason", reason)
    fine = F.col("reason").isNull()
    clock, race = fine & ~sentinel, fine & sentinel
    source = (
        F.when(F.col("end_after_kills").isNotNull(), "kill-cap")
        .when(F.col("end_after_damage").isNotNull(), "damage-cap")
        .otherwise("time-limit")
    )
    return told.select(
        "player_id", "scenario_id", "run_id", "started_at", F.col("score").alias("final"),
        F.when(clock, "clock").when(race, "race").otherwise("unsupported").alias("kind"),
        F.when(clock, F.when(source == "time-limit", limit / scale).otherwise(F.col("end"))).alias("duration_s"),
        F.when(clock, source).alias("duration_from"),
        F.when(race, limit).alias("budget"),
        F.when(race, F.col("damage_done")).alias("pool"),
        F.when(race, bots).alias("bots"),
        "reason",
    )


def curve(params: DataFrame, ticks: DataFrame, kills: DataFrame) -> DataFrame:
    """The points of every supported run, numbered along it.

    Unions keep how their tables lie by run only under a new name of it, so that no point is shuffled.
    """
    kinds = params.where("kind <> 'unsupported'").select("run_id", *PARAMS)
    points = [clock_points(kinds.where("kind = 'clock'"), ticks), race_points(kinds.where("kind = 'race'"), ticks, kills)]
    clock, race = (p.withColumnRenamed("run_id", "_run") for p in points)
    return clock.unionByName(race).join(kinds.select(F.col("run_id").alias("_run"), "kind", "budget", "duration_s"), "_run").withColumnRenamed("_run", "run_id")


def clock_points(clocks: DataFrame, ticks: DataFrame) -> DataFrame:
    """From (0, 0, 0) through every tick, closed at the full duration when the last tick falls short of it."""
    summed = scan.running(
        ticks.select("run_id", "t", "score").join(clocks.select("run_id", "duration_s"), "run_id"), ["run_id"], ["t"],
        idx=scan.position(), u=scan.total(F.coalesce("score", F.lit(0.0))),
    )
    own = F.struct("idx", "t", F.least(F.lit(1.0), F.col("t") / F.col("duration_s")).alias("x"), "u")
    inside = summed.select("run_id", own.alias("p"))
    ends = summed.groupBy("run_id", "duration_s").agg(
        F.max("idx").alias("n"), F.max("t").alias("end"), F.max_by("u", "t").alias("u")
    )
    zero = F.lit(0.0)
    first = F.struct(F.lit(0).alias("idx"), zero.alias("t"), zero.alias("x"), zero.alias("u"))
    closing = F.struct((F.col("n") + 1).alias("idx"), F.col("duration_s").alias("t"), F.lit(1.0).alias("x"), "u")
    caps = F.when(F.col("end") < F.col("duration_s"), F.array(first, closing)).otherwise(F.array(first))
    return inside.select("run_id", "p.*").unionByName(ends.select("run_id", F.inline(caps)))


def race_points(races: DataFrame, ticks: DataFrame, kills: DataFrame) -> DataFrame:
    """Kill ``k`` stands exactly at ``(k + 1) / n``; ticks between kills stand at the damage done so far.

    A tick is held at or above the last kill's progress and dropped when it has reached the next kill's, shares a
    kill's time, or follows the last kill. Damage only grows, so this needs running sums and no look at the point kept
    before.
    """
    pools = races.select(F.col("run_id").alias("_run"), "pool", "bots")
    none = F.lit(None).cast("double")
    knots = kills.select(F.col("run_id").alias("_run"), F.col("kill_t").alias("t"), F.lit(0).alias("what"), F.col("ordinal").alias("no"), none.alias("damage"))
    samples = ticks.select(F.col("run_id").alias("_run"), "t", F.lit(1).alias("what"), F.col("tick_no").alias("no"), F.col("damage_done").alias("damage"))
    both = knots.unionByName(samples).join(pools, "_run")
    order = ["t", "what", "no"]
    walked = scan.running(
        both, ["_run"], order,
        k=scan.total((F.col("what") == 0).cast("int")), done=scan.total(F.coalesce("damage", F.lit(0.0))),
        knot_t=scan.latest(F.when(F.col("what") == 0, F.col("t"))),
    )
    k, n = F.col("k"), F.col("bots")
    x = F.when(F.col("what") == 0, k / n).otherwise(F.greatest(k / n, F.col("done") / F.col("pool")))
    placed = walked.withColumn("x", x)
    kept = (F.col("what") == 0) | (
        (F.col("x") < (k + 1) / n) & (k < n) & (F.col("t") > 0) & ~F.coalesce(F.col("knot_t") == F.col("t"), F.lit(False))
    )
    numbered = scan.running(placed.where(kept), ["_run"], order, idx=scan.position())
    inner = numbered.select(F.col("_run").alias("run_id"), "idx", "t", "x", F.col("t").alias("u"))
    zero = F.lit(0.0)
    # A race has at least one kill, so the runs that need a first point are all in the pools.
    return inner.unionByName(
        pools.select(F.col("_run").alias("run_id"), F.lit(0).alias("idx"), zero.alias("t"), zero.alias("x"), zero.alias("u"))
    )


def at_progress(points: DataFrame, probes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``t`` and ``u`` where a run first reached each probed progress ``x``."""
    return interpolate(points, probes, keys or ["run_id"], "x", ["t", "u"])


def at_time(points: DataFrame, probes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``x`` and ``u`` at each probed time ``t``."""
    return interpolate(points, probes, keys or ["run_id"], "t", ["x", "u"])


def accumulated(kind: Column, budget: Column, x: Column, u: Column) -> Column:
    return F.when(x > 0, project(kind, budget, u / x))


def pace(points: DataFrame, window_s: float = WINDOW_S) -> DataFrame:
    """Projected final score from the run so far and from its last seconds; null where there is no progress to go by.

    The line's first point takes the second's values: both are constant up to it.
    """
    base = points.select("run_id", "idx", "t", "x", "u", "kind", "budget")
    asks = base.select(
        "run_id", F.greatest(F.lit(0.0), F.col("t") - window_s).alias("t"),
        F.struct("idx", F.col("t").alias("at_t"), F.col("x").alias("at_x"), F.col("u").alias("at_u"), "kind", "budget").alias("p"),
    )
    then = at_time(base, asks).select("run_id", "p.*", "x", "u")
    dx = F.col("at_x") - F.col("x")
    rate = F.when(dx > 0, project(F.col("kind"), F.col("budget"), (F.col("at_u") - F.col("u")) / dx))
    lines = then.withColumn(
        "accumulated", accumulated(F.col("kind"), F.col("budget"), F.col("at_x"), F.col("at_u"))
    ).withColumn("local", rate)
    both = F.struct("accumulated", "local")
    follow = scan.running(lines, ["run_id"], ["-idx"], _next=scan.previous(both))
    opens = (F.col("idx") == 0) & F.col("_next").isNotNull()
    return follow.select(
        "run_id", "idx", F.col("at_t").alias("t"), F.col("at_x").alias("x"), F.col("at_u").alias("u"), "kind", "budget",
        *(F.when(opens, F.col(f"_next.{c}")).otherwise(F.col(c)).alias(c) for c in ("accumulated", "local")),
    )


def comparable(a: Column, b: Column) -> Column:
    """Whether two structs of ``PARAMS`` align at equal progress."""
    clocks = (a["kind"] == "clock") & (b["kind"] == "clock") & (F.abs(a["duration_s"] - b["duration_s"]) < 0.5)
    pools = F.abs(a["pool"] - b["pool"]) <= 1e-3 * F.greatest(a["pool"], b["pool"])
    races = (a["kind"] == "race") & (b["kind"] == "race") & (a["budget"] == b["budget"]) & (a["bots"] == b["bots"]) & pools
    return F.coalesce(clocks, F.lit(False)) | F.coalesce(races, F.lit(False))


def of_pairs(pairs: DataFrame, points: DataFrame, side: str) -> DataFrame:
    """The other run's points under each ``(run_id, other_id)`` pair.

    Points are copied per pair so that a run many others compare with stays many small groups, not one large one.
    """
    owner = points.withColumnRenamed("run_id", side)
    return pairs.select("run_id", "other_id").join(owner, side)


def readout(pairs: DataFrame, points: DataFrame, params: DataFrame, x: float | None = None, strict: bool = False) -> DataFrame:
    """How far ahead each run of ``pairs(run_id, other_id)`` is: final scores, or what was spent at progress ``x``.

    Runs that do not compare have no value, or raise when ``strict``.
    """
    facts = params.select("run_id", "final", "kind", F.struct(*PARAMS).alias("p"))
    joined = pairs.join(facts, "run_id").join(
        facts.select(F.col("run_id").alias("other_id"), F.col("final").alias("base"), F.col("p").alias("q")), "other_id"
    )
    fits = comparable(F.col("p"), F.col("q"))
    if strict:
        fits = F.when(fits, F.lit(True)).otherwise(F.raise_error(F.lit("runs do not compare")).cast("boolean"))
    unit = F.when(F.col("kind") == "race", "seconds").otherwise("points")
    if x is None:
        value = F.col("final") - F.col("base")
    else:
        probes = joined.select("run_id", "other_id", F.lit(float(x)).alias("x"))
        pair = ["run_id", "other_id"]
        here = at_progress(of_pairs(probes, points, "run_id"), probes, pair).select(*pair, F.col("u").alias("u_run"))
        there = at_progress(of_pairs(probes, points, "other_id"), probes, pair).select(*pair, F.col("u").alias("u_base"))
        joined = joined.join(here, pair, "left").join(there, pair, "left")
        ahead = F.col("u_run") - F.col("u_base")
        value = F.when(F.col("kind") == "race", -ahead).otherwise(ahead)
    return joined.select("run_id", "other_id", F.when(fits, value).alias("value"), unit.alias("unit"))


def recent_range(points: DataFrame, recent: DataFrame) -> DataFrame:
    """Mean, sample deviation and count of the recent runs' accumulated pace at each of a run's own points.

    ``recent(run_id, other_id)`` lists comparable earlier runs, at most ten for each.

    Curves travel packed, a row for each pair, and are unpacked where the pairs of a run lie together, so that points are
    neither shuffled one by one nor met by more than one sort.
    """
    packed = points.groupBy("run_id").agg(
        F.collect_list(F.struct(F.col("idx").alias("_i"), "x", "u")).alias("_dots"),
        F.collect_list(F.when(F.col("idx") == 0, F.struct("kind", "budget"))).alias("_likes"),
    )
    others = packed.withColumnRenamed("run_id", "other_id")
    own = packed.select("run_id", F.transform("_dots", lambda p: F.struct(p["x"].alias("x"), p["_i"].alias("at_idx"))).alias("_asks"))
    met = recent.select("run_id", "other_id").join(others, "other_id").repartition("run_id").join(own, "run_id").withColumn("_like", F.explode("_likes"))
    blank = F.lit(None)
    dots = F.transform("_dots", lambda p: F.struct(
        p["x"].alias("x"), F.lit(1).alias("_what"), p["_i"].alias("_i"), F.struct(p["x"].alias("at"), p["u"].alias("u")).alias("_point"), blank.cast("int").alias("at_idx")))
    asks = F.transform("_asks", lambda p: F.struct(
        p["x"].alias("x"), F.lit(0).alias("_what"), F.lit(0).alias("_i"), blank.cast("struct<at:double,u:double>").alias("_point"), p["at_idx"].alias("at_idx")))
    both = met.select("run_id", "other_id", "_like", F.inline(F.concat(dots, asks)))
    order, pair = ["x", "_what", "_i"], ["run_id", "other_id"]
    seen = scan.running(both, pair, order, None, _left=scan.latest(F.col("_point"), "before"))
    seen = scan.running(seen, pair, [f"-{c}" for c in order], None, _right=scan.latest(F.col("_point"), "before"))
    value = accumulated(F.col("_like.kind"), F.col("_like.budget"), F.col("x"), between(F.col("_left"), F.col("_right"), F.col("x"), "u"))
    return seen.where("_what = 0").groupBy("run_id", F.col("at_idx").alias("idx"), "x").agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("count")
    )
