"""The run model derived from the driver's tables.

Runs with sessions and scores come from ``events``; runs with ticks and kills from ``orders`` and ``lineitem``; scenario
and benchmark dimensions from ``nation`` and ``region``. Everything is a pure expression of the tables.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import scan
from ..session import bucketed, stored


def once(build):
    """Keeps each plan per session and arguments: reading a schema or analysing a plan again costs more than the plan."""
    kept: dict[tuple, DataFrame] = {}

    @functools.wraps(build)
    def get(spark: SparkSession, *args) -> DataFrame:
        key = (spark.sparkContext.applicationId, id(spark), *args)
        if key not in kept:
            kept[key] = build(spark, *args)
        return kept[key]

    return get


def kept_table(build):
    """As ``once``, for a model table that is stored before it is queried, as ingest would have done."""
    return once(functools.wraps(build)(lambda spark, *args: stored(build(spark, *args))))


#: Order lines of a bucket, and of its runs' rows in other tables.
BUCKET_ROWS = 400_000


def kept_by(key: str, dealt: bool = True):
    """As ``kept_table``, in buckets by a run's key: what is made of a run's tables needs no shuffle then. ``dealt`` is false
    where rows come as they lie in the driver's tables."""

    def keep(build):
        return once(functools.wraps(build)(lambda spark, folder, *args: bucketed(build(spark, folder, *args), key, buckets(spark, folder), dealt)))

    return keep


@once
def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@once
def buckets(spark: SparkSession, folder: str) -> int:
    """How many buckets the tables of the order runs have."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, folder, "lineitem").count() // BUCKET_ROWS))


# ---------------------------------------------------------------- runs from events


@once
def run(spark: SparkSession, folder: str) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    done = F.col("kind") == "complete"
    started = F.col("ts") - F.expr("INTERVAL 60 SECOND")
    midnight = F.date_trunc("day", "started_at")
    return (
        table(spark, folder, "events")
        .withColumn("k", k)
        .withColumn("kind", F.when(F.col("event_type") == "error", "reset").otherwise("complete"))
        .withColumn("started_at", F.when(done, started))
        .select(
            (F.col("user_id") % 10).alias("player_id"),
            F.col("event_id").alias("id"),
            F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("file_stem"),
            (F.col("k") % 10).alias("scenario_id"),
            (F.col("k") % 6).alias("config_id"),
            (F.col("k") % 2).alias("game_version_id"),
            "kind",
            F.col("ts").alias("written_at"),
            "started_at",
            ((F.unix_micros(F.col("started_at").cast("timestamp")) - F.unix_micros(midnight.cast("timestamp"))) / 1000)
            .cast("int")
            .alias("start_ms"),
            F.when(done, F.lit(60.0)).alias("duration_s"),
            F.when(F.col("k") % 7 != 6, F.col("value")).alias("score"),
            F.when(done, (100 + F.col("k")).cast("double")).alias("avg_fps"),
            F.col("k").alias("hits"),
            (F.col("k") % 13).alias("misses"),
            (F.col("k") + F.col("k") % 13).alias("shots"),
            (done & (F.col("k") % 11 != 0)).alias("perf_landed"),
        )
    )


@once
def run_perf(spark: SparkSession, folder: str) -> DataFrame:
    return run(spark, folder).where("perf_landed").select(
        "player_id", F.col("id").alias("run_id"), F.concat(F.lit("perf-"), F.col("id").cast("string")).alias("perf_stem")
    )


@once
def scenario(spark: SparkSession, folder: str) -> DataFrame:
    tail = F.when(F.col("n_nationkey") >= 8, F.lit("\u00a0")).otherwise(F.lit(""))
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("scenario_id"),
        F.md5("n_name").alias("hash"),
        F.concat(F.lit("Strafe "), (F.col("n_nationkey") % 8).cast("string"), tail).alias("name"),
    )


@once
def game_version(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "region").select(
        F.col("r_regionkey").alias("game_version_id"), F.concat(F.lit("3."), F.col("r_regionkey").cast("string")).alias("label")
    )


@once
def config(spark: SparkSession, folder: str) -> DataFrame:
    """Client settings of the ids the runs use; ids four apart differ only in their crosshair."""
    group = F.col("n_nationkey") % 4
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("config_id"),
        F.lit("cm/360").alias("sens_scale"),
        (20 + group * 2.5).alias("horiz_sens"),
        (20 + group * 2.5).alias("vert_sens"),
        (800 + 400 * (group % 2)).cast("double").alias("dpi"),
        F.lit(103.0).alias("fov"),
        F.lit("Overwatch").alias("fov_scale"),
        F.concat(F.lit("cross"), F.col("n_nationkey").cast("string")).alias("crosshair"),
    )


# ---------------------------------------------------------------- runs from orders and lines


@kept_by("id", dealt=False)
def kill_run(spark: SparkSession, folder: str) -> DataFrame:
    seconds = F.col("o_orderkey") * 37 % 86_400
    started = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + seconds).cast("timestamp_ntz")
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        (F.col("o_custkey") % 20).alias("player_id"),
        key.alias("id"),
        F.concat(F.lit("duel-"), key.cast("string")).alias("file_stem"),
        (key % 4).cast("int").alias("scenario_id"),
        F.lit("complete").alias("kind"),
        started.alias("started_at"),
        (started + F.expr("INTERVAL 60 SECOND")).alias("written_at"),
        (seconds * 1000).cast("int").alias("start_ms"),
        F.when(key % 29 != 0, F.floor(F.col("o_totalprice") / 10) / 100).alias("score"),
        (key % 9 != 0).alias("has_perf"),
    )


@kept_by("l_orderkey", dealt=False)
def listed(spark: SparkSession, folder: str) -> DataFrame:
    """The order lines with the columns that runs are made from."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag")


@once
def line(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines numbered from 0 within their order, with a kill time on the run's clock."""
    lines = listed(spark, folder)
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]
    numbered = scan.running(lines, ["l_orderkey"], order, _n=scan.position()).withColumn("ordinal", F.col("_n") - 1)
    even = F.col("l_orderkey") % 2 == 0
    fixed = F.when(F.col("ordinal") == 0, F.lit(1.5)).otherwise(F.lit(2.0))
    timed = numbered.withColumn("ttk", F.when(even, F.col("l_quantity") / 10).otherwise(fixed))
    hot = scan.hot_groups(lines, ["l_orderkey"], "l_linenumber")
    return scan.running(timed, ["l_orderkey"], order, hot, _ttk=scan.total(F.col("ttk"))).withColumn(
        "at_s", F.round(F.col("_ttk") + 0.25 * (F.col("ordinal") + 1), 3)
    )


@kept_by("run_id")
def kill(spark: SparkSession, folder: str) -> DataFrame:
    """One row per kill with its wall clock, before offsets are worked out."""
    key = F.col("l_orderkey")
    hits = F.floor(F.col("l_quantity") * (1 - F.col("l_discount"))).cast("int")
    at_ms = (key * 37 % 86_400 * 1000 + F.round(F.col("at_s") * 1000).cast("bigint")) % clock.DAY_MS
    return line(spark, folder).select(
        key.alias("run_id"),
        "ordinal",
        at_ms.cast("int").alias("at_ms"),
        F.concat(F.lit("bot"), (F.col("l_suppkey") % 7).cast("string")).alias("bot"),
        F.col("l_returnflag").alias("weapon"),
        "ttk",
        F.col("l_quantity").cast("int").alias("shots"),
        hits.alias("hits"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("damage_done"),
        F.col("l_extendedprice").alias("damage_possible"),
        (F.col("l_partkey") % 3).cast("int").alias("overshots"),
        (F.col("l_partkey") % 50 == 0).cast("int").alias("cheated"),
    )


METRICS = (
    "shots_fired shots_hit shots_missed damage_done damage_possible score kills overshots player_damage_taken reloads "
    "pause_count distance_traveled mbs_points deaths"
).split()


@kept_by("run_id")
def tick(spark: SparkSession, folder: str) -> DataFrame:
    """Ticks of the order runs: scenarios 2 and 3 count a race down, 0 and 1 add points up."""
    race = F.col("l_orderkey") % 4 >= 2
    t = F.when(race, F.col("at_s") + (F.col("l_partkey") % 4) / 20 - 0.1).otherwise(
        F.col("ordinal") + 1 + (F.col("l_partkey") % 7) / 100
    )
    base = line(spark, folder).withColumn("t", F.round(t, 3))
    lines = listed(spark, folder)
    hot = scan.hot_groups(lines, ["l_orderkey"], "l_linenumber")
    # The jitter is smaller than any step between lines, so ordinal order is time order.
    order = ["l_linenumber", "ordinal"]
    base = scan.running(base, ["l_orderkey"], order, hot, _before=scan.previous(F.col("t")))
    shots = F.col("l_quantity").cast("int")
    hits = F.floor(F.col("l_quantity") * (1 - F.col("l_discount"))).cast("int")
    points = F.when(F.col("l_suppkey") % 7 != 6, F.col("l_quantity"))
    down = F.when(F.col("ordinal") == 0, F.lit(999.0)).otherwise(-(F.col("t") - F.col("_before")))
    return base.select(
        F.col("l_orderkey").alias("run_id"),
        F.col("ordinal").alias("tick_no"),
        "t",
        shots.cast("double").alias("shots_fired"),
        hits.cast("double").alias("shots_hit"),
        (shots - hits).cast("double").alias("shots_missed"),
        (F.lit(1000.0) * (0.9 + 0.2 * (F.col("ordinal") % 2))).alias("damage_done"),
        F.lit(1200.0).alias("damage_possible"),
        F.when(race, down).otherwise(points).alias("score"),
        F.lit(1.0).alias("kills"),
        F.when(F.col("l_partkey") % 3 != 0, (F.col("l_partkey") % 3).cast("double")).alias("overshots"),
        *(F.lit(None).cast("double").alias(m) for m in METRICS[8:]),
    )


@kept_by("run_id")
def header(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order run: its result and the challenge settings that decide its curve."""
    key = F.col("id")
    size = listed(spark, folder).groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0))
    limit = (
        F.when(F.col("scenario_id") >= 2, F.lit(1000.0))
        .when(key % 31 == 0, None)
        .when(key % 5 == 0, n.cast("double"))
        .otherwise(n + 1 + (key % 2) * 0.2)
    )
    return (
        kill_run(spark, folder)
        .join(size, "id", "left")
        .select(
            "player_id",
            key.alias("run_id"),
            "scenario_id",
            "file_stem",
            "started_at",
            "score",
            "has_perf",
            limit.alias("time_limit"),
            F.when(key % 6 != 0, F.lit(1.0)).alias("timescale"),
            F.when((F.col("scenario_id") < 2) & (key % 17 == 3), n.cast("double")).alias("end_after_kills"),
            F.when((F.col("scenario_id") < 2) & (key % 17 == 4), n * 1000.0).alias("end_after_damage"),
            (n * 1000.0).alias("damage_done"),
        )
    )


# ---------------------------------------------------------------- benchmarks

# Catalogue names of the five example benchmarks, by region key.
BENCHMARK_NAMES = ["Valor", "Valor S2", "Aim v3", "Aim Season 4", "Solo"]
RANKS = ["Iron", "Gold", "Ruby", "Master"]


@once
def benchmark(spark: SparkSession, folder: str) -> DataFrame:
    names = F.array(*(F.lit(n) for n in BENCHMARK_NAMES))
    return table(spark, folder, "region").select(
        F.col("r_regionkey").alias("benchmark_id"),
        F.get(names, F.col("r_regionkey")).alias("name"),
        F.col("r_name").alias("difficulty"),
        F.col("r_regionkey").alias("position"),
        F.array(*(F.lit(r) for r in RANKS)).alias("ranks"),
    )


@once
def _slots(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        F.col("n_regionkey").alias("benchmark_id"),
        F.floor(F.col("n_nationkey") / 5).cast("int").alias("place"),
        (F.col("n_nationkey") % 8).alias("j"),
        F.concat(F.lit("Strafe "), (F.col("n_nationkey") % 8).cast("string")).alias("scenario_name"),
    )


@once
def ladder(spark: SparkSession, folder: str) -> DataFrame:
    """Thresholds per benchmark and scenario; the last place of each benchmark is unrated."""
    base = (5 + F.col("j") + 2 * F.col("benchmark_id")).cast("double")
    tied = F.array(base, base * 2, base * 2, base * 8)
    return (
        _slots(spark, folder)
        .where("place < 4")
        .select(
            "benchmark_id",
            "scenario_name",
            "place",
            F.when(F.col("j") == 2, tied)
            .when(F.col("j") == 3, F.array(base))
            .otherwise(F.array(base, base * 2, base * 4, base * 8))
            .alias("thresholds"),
        )
    )


@once
def tree_slot(spark: SparkSession, folder: str) -> DataFrame:
    """Two categories of two subcategories; place 1 sits in two of them."""
    slots = _slots(spark, folder)
    p = F.col("place")
    first = slots.select(
        "benchmark_id",
        F.when(p <= 2, 0).otherwise(1).alias("cat_no"),
        F.when(p <= 1, 0).when(p == 2, 1).when(p == 3, 2).otherwise(3).alias("sub_no"),
        F.when(p == 1, 1).otherwise(0).alias("slot_no"),
        "scenario_name",
    )
    again = slots.where("place = 1").select(
        "benchmark_id", F.lit(1).alias("cat_no"), F.lit(2).alias("sub_no"), F.lit(1).alias("slot_no"), "scenario_name"
    )
    return first.unionByName(again)
