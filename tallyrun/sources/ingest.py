"""Parsed files to the tables of the run model, in batch or one micro-batch at a time."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import js_trim
from ..operators.joins import overlap_join
from ..session import stored
from . import stats_document

CONFIG = [
    "sens_scale", "sens_increment", "horiz_sens", "vert_sens", "dpi", "fov", "fov_scale", "hide_gun", "crosshair",
    "crosshair_scale", "crosshair_color", "resolution", "resolution_scale", "max_fps", "input_lag",
]
COUNTERS = ["deaths", "midairs", "midaired", "directs", "directed"]
TABLES = ["scenario", "game_version", "bot", "weapon", "config", "run", "run_weapon", "kill_series", "run_bot", "unattributed_file"]


def key_id(*columns: str) -> Column:
    """A row's id from its natural key, the same on every retry and every machine; a null part counts as such.

    Ids name rows; tables that belong to a run also carry its natural key and are grouped and joined by that.
    """
    return F.xxhash64(*(part for c in columns for part in (F.col(c).isNull(), F.col(c))))


def extra(kind: Column) -> Column:
    """Counters and measurements that differ from their default, and what a reset discards."""
    pairs = {c: (F.col(f"totals.{c}"), 0.0) for c in COUNTERS} | {
        c: (F.col(f"settings.{c}"), 1.0) for c in ("avg_target_scale", "avg_time_dilation")
    }
    named = F.create_map(*(x for c, (v, _) in pairs.items() for x in (F.lit(c), v.cast("string"))))
    plain = F.create_map(*(x for c, (_, d) in pairs.items() for x in (F.lit(c), F.lit(d).cast("string"))))
    kept = F.map_filter(named, lambda k, v: v != F.element_at(plain, k))
    raw = F.create_map(
        F.lit("raw.challenge_start"), F.col("settings.challenge_start"), F.lit("raw.avg_fps"), F.col("settings.avg_fps").cast("string")
    )
    return F.when(kind == "reset", F.map_concat(kept, raw)).otherwise(kept)


def stage(classified: DataFrame, owner: str = "player_id") -> dict[str, DataFrame]:
    """Good documents as staged rows that name their dimensions by natural key. A file listed twice counts once.

    They are brought together and stored once, so that the tables made from them each read their own columns.
    """
    fine = stored(stats_document.good(classified).dropDuplicates([owner, "file_stem"]))
    runs = fine.where("kind <> 'abort'")
    total = lambda c: F.aggregate("weapons", F.lit(0.0), lambda a, w: a + w[c])
    spine = runs.select(
        owner, "file_stem", "kind", "written_at", "started_at", "start_ms", "duration_s",
        F.col("settings.hash").alias("hash"), F.col("settings.scenario").alias("scenario_name"),
        F.col("settings.game_version").alias("game_version"),
        *(F.col(f"totals.{c}").alias(c) for c in stats_document.TOTALS.values() if c not in COUNTERS),
        total("shots").alias("shots"), total("damage_possible").alias("damage_possible"),
        F.when(F.col("kind") == "complete", F.col("settings.avg_fps")).alias("avg_fps"),
        extra(F.col("kind")).alias("extra"), *(F.col(f"settings.{c}").alias(c) for c in CONFIG),
    )
    weapons = runs.select(owner, "file_stem", F.inline("weapons")).withColumn("weapon", js_trim(F.col("weapon"))).drop("cells")
    kills = (
        runs.select(owner, "file_stem", F.inline("kills"))
        .withColumn("bot", js_trim(F.col("bot"))).withColumn("weapon", js_trim(F.col("weapon"))).drop("cells")
    )
    aborts = fine.where("kind = 'abort'").select(
        owner, "file_stem", "written_at", F.to_json(F.struct("kills", "weapons", "totals", "settings")).alias("payload")
    )
    return {"run": spine, "weapon": weapons, "kill": kills, "unattributed_file": aborts}


def new_dimension(staged: DataFrame, known: DataFrame | None, id_name: str, key: list[str]) -> DataFrame:
    """Rows of a dimension not there yet. The distinct of the keys comes before anything is compared."""
    fresh = staged.select(*key).distinct()
    if known is not None:
        same = None
        for k in key:
            part = fresh[k].eqNullSafe(known[k])
            same = part if same is None else same & part
        fresh = fresh.join(known.select(*key), same, "left_anti")
    return fresh.select(key_id(*key).alias(id_name), *key)


def dimensions(staged: dict[str, DataFrame], known: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    known = known or {}
    run = staged["run"]
    scenarios = run.groupBy("hash").agg(F.max_by("scenario_name", "file_stem").alias("name"))
    old = known.get("scenario")
    if old is not None:
        scenarios = scenarios.join(old.select("hash"), "hash", "left_anti")
    weapons = staged["weapon"].select(F.col("weapon").alias("name")).unionByName(staged["kill"].select(F.col("weapon").alias("name")))
    return {
        "scenario": scenarios.select(key_id("hash").alias("scenario_id"), "hash", "name"),
        "game_version": new_dimension(run.select(F.col("game_version").alias("label")), known.get("game_version"), "game_version_id", ["label"]),
        "bot": new_dimension(staged["kill"].select(F.col("bot").alias("name")), known.get("bot"), "bot_id", ["name"]),
        "weapon": new_dimension(weapons, known.get("weapon"), "weapon_id", ["name"]),
        "config": new_dimension(run, known.get("config"), "config_id", CONFIG),
    }


def run_rows(staged: dict[str, DataFrame], owner: str = "player_id") -> DataFrame:
    """The run spine. Ids are functions of natural keys, so no dimension has to be joined to find them."""
    return (
        staged["run"]
        .withColumn("id", key_id(owner, "file_stem"))
        .withColumn("scenario_id", key_id("hash"))
        .withColumn("game_version_id", key_id("game_version"))
        .withColumn("config_id", key_id(*CONFIG))
        .drop("hash", "scenario_name", "game_version", *CONFIG)
    )


def check_config(run: DataFrame, staged_run: DataFrame, config: DataFrame, owner: str = "player_id") -> DataFrame:
    """Runs whose settings are not those their config id stands for: two settings with one hash."""
    held = run.select(owner, "file_stem", "config_id").join(config, "config_id")
    wanted = staged_run.select(owner, "file_stem", *(F.col(c).alias(f"_{c}") for c in CONFIG))
    same = F.lit(True)
    for c in CONFIG:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return held.join(wanted, [owner, "file_stem"]).where(~same).select(owner, "file_stem", "config_id")


def weapon_totals(staged: dict[str, DataFrame], owner: str = "player_id") -> DataFrame:
    w = staged["weapon"]
    return w.select(
        owner, "file_stem", key_id(owner, "file_stem").alias("run_id"), key_id("weapon").alias("weapon_id"), "shots", "hits", "damage_done", "damage_possible"
    )


def kill_series(staged: dict[str, DataFrame], owner: str = "player_id") -> DataFrame:
    """Each run's kills as one array of structs, in file order."""
    k = staged["kill"].withColumn("bot_id", key_id("bot")).withColumn("weapon_id", key_id("weapon"))
    fields = ["idx", "at_ms", "bot_id", "weapon_id", "ttk", "shots", "hits", "damage_done", "damage_possible", "overshots", "cheated"]
    return k.groupBy(owner, "file_stem", key_id(owner, "file_stem").alias("run_id")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("kills"))


def run_bot(staged: dict[str, DataFrame], owner: str = "player_id") -> DataFrame:
    return staged["kill"].groupBy(owner, "file_stem", key_id(owner, "file_stem").alias("run_id"), key_id("bot").alias("bot_id")).agg(
        F.count(F.lit(1)).alias("kills"), F.avg("ttk").alias("avg_ttk"),
        *(F.sum(c).alias(c) for c in ("shots", "hits", "damage_done", "damage_possible", "overshots")),
    )


def tables(staged: dict[str, DataFrame], known: dict[str, DataFrame] | None = None, owner: str = "player_id") -> dict[str, DataFrame]:
    return {
        **dimensions(staged, known), "run": run_rows(staged, owner), "run_weapon": weapon_totals(staged, owner),
        "kill_series": kill_series(staged, owner), "run_bot": run_bot(staged, owner), "unattributed_file": staged["unattributed_file"],
    }


def perf_matches(perf: DataFrame, run: DataFrame, owner: str = "player_id") -> DataFrame:
    """Performance files with the complete runs whose ``[start, write)`` meets their whole second."""
    done = run.where("kind = 'complete'").select(owner, F.col("id").alias("run_id"), "started_at", "written_at")
    return overlap_join(perf, done, [owner], "challenge_start", "started_at", "written_at").drop("started_at", "written_at")


def attached(matches: DataFrame, also: Sequence[str] = (), owner: str = "player_id") -> DataFrame:
    """One run per performance file: of several the one with the smallest id. ``candidates`` tells how many there were;
    ``also`` names columns of the file that are kept."""
    return matches.groupBy(owner, "perf_stem", *also).agg(F.min("run_id").alias("run_id"), F.count(F.lit(1)).alias("candidates"))


def pending(perf: DataFrame, run_perf: DataFrame, owner: str = "player_id") -> DataFrame:
    """Performance files not attached yet, to be tried again when more runs are there."""
    return perf.join(run_perf.select(owner, "perf_stem"), [owner, "perf_stem"], "left_anti")


def list_array(text: Column, of: str) -> Column:
    """A JSON list as an ordered, typed array."""
    return F.from_json(text, f"array<{of}>")


def report(listing: DataFrame, todo: DataFrame, classified: DataFrame, matches: DataFrame, perf: DataFrame, owner: str = "player_id") -> DataFrame:
    """One row of counts for a batch."""

    def one(df: DataFrame, name: str, value: Column | None = None) -> DataFrame:
        return df.agg((value if value is not None else F.count(F.lit(1))).alias("n")).select(F.lit(name).alias("what"), F.col("n").cast("bigint").alias("n"))

    fine = F.size("errors") == 0
    per = perf.select(owner, "perf_stem").join(
        matches.groupBy(owner, "perf_stem").agg(F.count(F.lit(1)).alias("c")), [owner, "perf_stem"], "left"
    )
    parts = [
        one(listing, "scanned"), one(todo, "todo"),
        one(classified, "runs", F.count_if(fine & (F.col("kind") != "abort"))),
        one(classified, "aborts", F.count_if(fine & (F.col("kind") == "abort"))),
        one(classified, "failures", F.count_if(~fine)),
        one(per, "matched", F.count_if(F.col("c") == 1)), one(per, "ambiguous", F.count_if(F.col("c") > 1)),
        one(per, "orphans", F.count_if(F.col("c").isNull())),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    names = ["scanned", "todo", "runs", "aborts", "failures", "matched", "ambiguous", "orphans"]
    wide = out.groupBy().pivot("what", names).agg(F.first("n"))
    return wide.withColumn("skipped", F.col("scanned") - F.col("todo"))


# ---------------------------------------------------------------- batches on storage


PERIOD = "period"
#: Tables of a batch that are written at a time.
WRITERS = 8
#: Days of a period, the partition of tables that a batch looks into.
PERIOD_DAYS = 128


def period(day: Column) -> Column:
    """The number of a date's period; 0 where there is no date."""
    return F.coalesce(F.floor(F.unix_date(day) / PERIOD_DAYS).cast("int"), F.lit(0))


def periods_around(days: Iterable[int], before: int, after: int) -> list[int]:
    """The periods that hold the days from ``before`` days before each of ``days`` to ``after`` days after it."""
    return sorted({(day + more) // PERIOD_DAYS for day in days for more in range(-before, after + 1)} | {0})


def write_batch(outputs: dict[str, DataFrame], root: str, batch_id: int | str) -> None:
    """Writes a batch so that it shows whole or not at all.

    Every table gets the folder of this batch, overwritten if the batch is tried again; one with a column ``period`` is
    partitioned by it. The commit row comes last, and ``read_table`` shows only committed batches; no rename is needed,
    which object stores do not have.
    """
    spark = next(iter(outputs.values())).sparkSession

    def write(name: str) -> None:
        apart = PERIOD in outputs[name].columns
        rows = outputs[name].hint("rebalance", F.col(PERIOD)) if apart else outputs[name]
        rows.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}", partitionBy=PERIOD if apart else None)

    with ThreadPoolExecutor(WRITERS) as pool:  # small tables do not wait for each other
        list(pool.map(write, outputs))
    shapes = F.create_map(*(F.lit(x) for name, df in outputs.items() for x in (name, df.schema.json())))
    done = spark.range(1).select(F.lit(str(batch_id)).alias("batch_id"), F.current_timestamp().alias("committed_at"), shapes.alias("shapes"))
    done.write.mode("overwrite").parquet(f"{root}/_commits/part={batch_id}")


def commits(spark: SparkSession, root: str) -> DataFrame | None:
    """One row per committed batch: its id, and the schema of every table that it has written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_commits")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("batch_id string, committed_at timestamp, shapes map<string,string>").parquet(f"{root}/_commits")


def _shape(done: DataFrame, name: str) -> StructType | None:
    """The table's columns as last written; an empty partitioned table has no file that could tell."""
    newest = done.where(F.element_at("shapes", name).isNotNull()).agg(F.max_by(F.element_at("shapes", name), F.struct("committed_at", "batch_id"))).first()[0]
    return None if newest is None else StructType.fromJson(json.loads(newest))


def read_table(spark: SparkSession, root: str, name: str, periods: list[int] | None = None, keep_batch: bool = False) -> DataFrame | None:
    """A table's committed batches, or None before the first. With ``periods``, only these partitions are read; with
    ``keep_batch``, the column ``batch_id`` stays."""
    done = commits(spark, root)
    shape = None if done is None else _shape(done, name)
    if shape is None:
        return None
    rows = spark.read.schema(shape.add("batch_id", "string")).parquet(f"{root}/{name}")
    if periods is not None and PERIOD in rows.columns:
        rows = rows.where(F.col(PERIOD).isin(periods))
    shown = rows.join(done.select("batch_id"), "batch_id", "left_semi")
    return shown if keep_batch else shown.drop("batch_id")


def last_batch(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """What the newest committed batch has written of a table that every batch writes whole."""
    done = commits(spark, root)
    shape = None if done is None else _shape(done, name)
    if shape is None:
        return None
    newest = done.agg(F.max(F.col("batch_id").cast("long"))).first()[0]
    return spark.read.schema(shape).parquet(f"{root}/{name}/batch_id={newest}")
