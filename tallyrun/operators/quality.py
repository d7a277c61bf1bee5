"""Rules the run model must keep. Each returns ``(rule, source, key, detail)`` rows, one per violation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import NO_LIMIT
from ..functions.text import js_trim
from . import scan

EXACT = ["shots_fired", "shots_hit", "shots_missed", "kills", "overshots", "reloads"]
NEAR = ["damage_done", "damage_possible", "score", "player_damage_taken", "distance_traveled", "mbs_points"]
LIMIT_SLACK_S = 2.0


def _told(df: DataFrame, rule: str, source: str, key: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"), F.lit(source).alias("source"), key.cast("string").alias("key"), detail.cast("string").alias("detail")
    )


def violations(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def complete_has_times(run: DataFrame) -> DataFrame:
    done = F.col("kind") == "complete"
    parts = [F.col(c).isNotNull() for c in ("started_at", "start_ms", "duration_s")]
    wrong = reduce(lambda a, b: a | b, [done != p for p in parts])
    return _told(run.where(wrong), "complete has start and duration", "run", F.col("id"), F.col("kind"))


def ends_after_start(run: DataFrame) -> DataFrame:
    wrong = (F.col("kind") == "complete") & (F.col("written_at") <= F.col("started_at"))
    return _told(run.where(wrong), "ends after it starts", "run", F.col("id"), F.col("kind"))


def fps_only_complete(run: DataFrame) -> DataFrame:
    wrong = (F.col("kind") != "complete") & F.col("avg_fps").isNotNull()
    return _told(run.where(wrong), "frame rate only when complete", "run", F.col("id"), F.col("kind"))


def shots_add_up(run: DataFrame) -> DataFrame:
    off = F.col("shots") - F.col("hits") - F.col("misses")
    return _told(run.where(off != 0), "shots are hits and misses", "run", F.col("id"), off)


def no_overlap(run: DataFrame) -> DataFrame:
    """Complete runs that begin before an earlier run of the player has ended."""
    done = run.where("kind = 'complete'")
    walked = scan.running(done, ["player_id"], ["started_at", "id"], until=scan.highest(F.col("written_at"), "before"))
    return _told(walked.where("until > started_at"), "runs do not overlap", "run", F.col("id"), F.col("player_id"))


def perf_belongs(perf: DataFrame, run: DataFrame) -> DataFrame:
    """Performance rows without a complete run, and runs with more than one."""
    done = run.where("kind = 'complete'").select("player_id", F.col("id").alias("run_id"))
    loose = perf.join(done, ["player_id", "run_id"], "left_anti")
    many = perf.groupBy("player_id", "run_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _told(loose, "performance of a complete run", "run_perf", F.col("run_id"), F.lit(None)).unionByName(
        _told(many, "one performance per run", "run_perf", F.col("run_id"), F.col("n"))
    )


def arrays_aligned(series: DataFrame, lead: str, arrays: Sequence[str], key: str = "run_id") -> DataFrame:
    size = F.size(lead)
    wrong = [F.when(F.col(a).isNotNull() & (F.size(a) != size), F.lit(a)) for a in arrays]
    marked = series.withColumn("_bad", F.concat_ws(",", *wrong)).where("_bad <> ''")
    return _told(marked, "arrays are aligned", "series", F.col(key), F.col("_bad"))


def names_trimmed(dimension: DataFrame, source: str, name: str = "name") -> DataFrame:
    wrong = (F.col(name) == "") | (js_trim(F.col(name)) != F.col(name))
    return _told(dimension.where(wrong), "name is trimmed and not empty", source, F.col(name), F.length(name))


def unique_key(df: DataFrame, source: str, keys: Sequence[str]) -> DataFrame:
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _told(found, "natural key is unique", source, F.concat_ws("|", *(F.col(k).cast("string") for k in keys)), F.col("n"))


def perf_match_count(matches: DataFrame, perf: DataFrame) -> DataFrame:
    """Performance files that match no run, or several."""
    n = matches.groupBy("player_id", "perf_stem").agg(F.count(F.lit(1)).alias("n"))
    counted = perf.select("player_id", "perf_stem").join(n, ["player_id", "perf_stem"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _told(counted.where("n <> 1"), "performance matches one run", "perf", F.col("perf_stem"), F.col("n"))


def orphan_perf(perf: DataFrame, landed: DataFrame) -> DataFrame:
    lost = perf.join(landed, ["player_id", "perf_stem"], "left_anti")
    return _told(lost, "performance has landed", "perf", F.col("perf_stem"), F.lit(None))


def perf_same_scenario(matches: DataFrame) -> DataFrame:
    """Matches whose file names another scenario than the run."""
    return _told(matches.where("perf_hash <> run_hash"), "performance and run share a scenario", "perf", F.col("perf_stem"), F.col("perf_hash"))


def sums_reconcile(ticks: DataFrame, totals: DataFrame, exact: Sequence[str] = EXACT, near: Sequence[str] = NEAR) -> DataFrame:
    """Tick sums against the run's totals; ``totals`` has a column per metric. Counts must be equal, measures close."""
    metrics = [*exact, *near]
    sums = ticks.groupBy("run_id").agg(*(F.sum(m).alias(m) for m in metrics))
    pairs = [F.struct(F.lit(m).alias("metric"), F.coalesce(f"s.{m}", F.lit(0.0)).alias("ticks"), F.col(f"t.{m}").alias("total"),
                      F.lit(m in exact).alias("strict")) for m in metrics]
    long = sums.alias("s").join(totals.alias("t"), "run_id").select("run_id", F.inline(F.array(*pairs)))
    slack = F.when(F.col("strict"), 0.0).otherwise(F.greatest(F.lit(0.01), F.abs("total") * 1e-4))
    wrong = long.where(F.col("total").isNotNull() & (F.abs(F.col("ticks") - F.col("total")) > slack))
    return _told(wrong, "ticks add up to the totals", "tick", F.col("run_id"), F.col("metric"))


def kills_numbered(kills: DataFrame, totals: DataFrame, weapons: DataFrame) -> DataFrame:
    """Kill rows are numbered 1 to n and counted as such, unless every one is 0 and none is counted; weapon hits are all hits."""
    shape = kills.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("rows"), F.max("index").alias("hi"), F.min("index").alias("lo"), F.count_distinct("index").alias("different")
    )
    joined = totals.join(shape, "run_id", "left")
    rows = F.coalesce("rows", F.lit(0))
    loose = (F.col("hi") == 0) & (F.col("lo") == 0) & (F.col("kill_count") == 0)
    counted = (F.col("kill_count") == rows) & ((rows == 0) | ((F.col("lo") == 1) & (F.col("hi") == rows) & (F.col("different") == rows)))
    wrong = joined.where(~(F.coalesce(loose, F.lit(False)) | F.coalesce(counted, F.lit(False))))
    hits = weapons.groupBy("run_id").agg(F.sum("hits").alias("weapon_hits"))
    off = totals.join(hits, "run_id").where("weapon_hits <> hit_count")
    return _told(wrong, "kills are numbered and counted", "kill", F.col("run_id"), rows).unionByName(
        _told(off, "weapon hits are the hits", "run_weapon", F.col("run_id"), F.col("weapon_hits"))
    )


def overshoot_closed(ticks: DataFrame) -> DataFrame:
    """Runs whose overshoots do not end in exactly one negative that takes back the rest."""
    x = F.col("overshots")
    folded = ticks.groupBy("run_id").agg(F.count_if(x < 0).alias("negatives"), F.sum(x).alias("residual"), F.count(x).alias("n"))
    wrong = folded.where("n > 0 AND (negatives <> 1 OR residual <> 0)")
    return _told(wrong, "overshoots are taken back once", "tick", F.col("run_id"), F.concat_ws("|", F.col("negatives").cast("string"), F.col("residual").cast("int").cast("string")))


def ticks_ascend(ticks: DataFrame, header: DataFrame) -> DataFrame:
    """Ticks out of order, and last ticks far from the time limit of runs that end on it."""
    walked = scan.running(ticks, ["run_id"], ["tick_no"], _prev=scan.previous(F.col("t")))
    back = walked.where("t <= _prev")
    ends = ticks.groupBy("run_id").agg(F.max("t").alias("end"))
    limit = F.col("time_limit") / F.coalesce("timescale", F.lit(1.0))
    bound = F.col("end_after_kills").isNull() & F.col("end_after_damage").isNull() & (F.col("time_limit") < NO_LIMIT)
    far = header.join(ends, "run_id").where(bound & (F.abs(limit - F.col("end")) > LIMIT_SLACK_S))
    return _told(back, "ticks ascend", "tick", F.col("run_id"), F.col("tick_no")).unionByName(
        _told(far, "last tick is near the limit", "tick", F.col("run_id"), F.lit(None))
    )


def one_run_per_second(run: DataFrame) -> DataFrame:
    second = F.date_trunc("second", F.col("written_at").cast("timestamp_ntz")).cast("timestamp_ntz")
    found = run.groupBy("player_id", second.alias("second")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _told(found, "one run written per second", "run", F.concat_ws("|", F.col("player_id").cast("string"), F.date_format("second", "yyyy-MM-dd HH:mm:ss")), F.col("n"))


def ownership(run: DataFrame, perf: DataFrame) -> DataFrame:
    """One row: complete runs without a performance file, files without a run, and files of more than one run."""
    done = run.where("kind = 'complete'").select("player_id", F.col("id").alias("run_id"))
    by = ["player_id", "run_id"]
    bare = done.join(perf, by, "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("stats_only"))
    lost = perf.join(done, by, "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("orphan"))
    owned = perf.groupBy("player_id", "perf_stem").agg(F.count(F.lit(1)).alias("c"))
    many = owned.agg(F.count_if(F.col("c") > 1).alias("n")).withColumn("what", F.lit("multi"))
    return bare.unionByName(lost).unionByName(many)


def key_audit(run: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Distinct values and collisions of candidate content keys, all in one pass over the runs per key set."""
    named = F.array(*(F.struct(F.lit(n).alias("key"), c.cast("string").alias("value")) for n, c in keys.items()))
    counted = run.select(F.inline(named)).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("key").agg(
        F.count(F.lit(1)).alias("distinct"), (F.sum("n") - F.count(F.lit(1))).alias("collisions")
    )
