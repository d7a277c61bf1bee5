"""Files made from the driver's tables: stat documents, performance files and catalogue JSON, to be read back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import performance
from ..sources.stats_document import KILL_HEADER
from . import bridge as b


def _clock(ms: Column) -> Column:
    part = lambda v, n: F.lpad(v.cast("bigint").cast("string"), n, "0")
    s = F.floor(ms / 1000)
    return F.concat(
        part(F.floor(s / 3600), 2), F.lit(":"), part(F.floor(s / 60) % 60, 2), F.lit(":"), part(s % 60, 2), F.lit("."), part(ms % 1000, 3)
    )


def _text(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


@b.kept_table
def documents(s, d) -> DataFrame:
    """One stat document per order: player, name and content.

    Orders divisible by 19 are aborts, by 23 resets; by 27 they lack a key and by 33 their kill rows lack a cell.
    """
    key = F.col("id")
    kills = b.kill(s, d)
    cells = [
        _text(F.col("ordinal") + 1), _clock(F.col("at_ms")), F.concat(F.lit(" "), F.col("bot"), F.lit(" ")), F.col("weapon"),
        F.concat(_text("ttk"), F.lit("s")), _text("shots"), _text("hits"), _text(F.round(F.col("hits") / F.col("shots"), 6)),
        _text("damage_done"), _text("damage_possible"), _text(F.lit(1)), _text("cheated"),
    ]
    full = F.concat_ws(",", *cells, _text("overshots"))
    row = F.when(F.col("run_id") % 33 == 0, F.concat_ws(",", *cells)).otherwise(full)
    lines = kills.groupBy(F.col("run_id").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", row.alias("l")))), lambda x: x["l"]).alias("kill_lines"),
        F.count(F.lit(1)).alias("n"), F.sum("hits").alias("hits"), F.sum("shots").alias("shots"),
    )
    weapons = kills.groupBy(F.col("run_id").alias("id"), "weapon").agg(
        *(F.sum(c).alias(c) for c in ("shots", "hits", "damage_done", "damage_possible"))
    ).groupBy("id").agg(
        F.array_sort(F.collect_list(F.concat_ws(",", "weapon", _text("shots"), _text("hits"), _text("damage_done"), _text("damage_possible"), F.lit("")))).alias("weapon_lines")
    )
    runs = b.kill_run(s, d).join(lines, "id", "left").join(weapons, "id", "left")
    abort, reset = key % 19 == 0, key % 23 == 0
    write_s = F.floor(F.col("start_ms") / 1000) + 60
    started = F.when(reset, write_s % 86_400 * 1000 + 200).otherwise(F.col("start_ms"))
    nothing = F.array().cast("array<string>")
    n, hits, shots = (F.coalesce(c, F.lit(0)) for c in ("n", "hits", "shots"))
    named = lambda k, v: F.concat(F.lit(f"{k}:,"), _text(v))
    zero = [named(k, F.lit(0)) for k in ("Midairs", "Midaired", "Directs", "Directed", "Reloads", "Distance Traveled", "MBS Points", "Pause Count", "Pause Duration")]
    kv = [
        named("Kills", n), named("Deaths", F.lit(999)), named("Deaths", key % 5), named("Fight Time", F.lit("0.0")), named("Time Remaining", F.lit("0.0")),
        named("Avg TTK", F.lit(0.5)), named("Damage Done", F.lit(0)), named("Total Overshots", F.lit(0)), named("Damage Taken", F.lit(0)),
        named("Hit Count", hits), named("Miss Count", shots - hits), *zero,
        named("Input Lag", F.lit(0)), named("Max FPS (config)", F.lit(400)), named("Sens Scale", F.lit("cm/360")), named("Sens Increment", F.lit(1)),
        named("Horiz Sens", 20 + key % 4), named("Vert Sens", 20 + key % 4), named("DPI", F.lit(800)), named("FOV", F.lit(103)), named("FOVScale", F.lit("Overwatch")),
        named("Hide Gun", F.lit("true")), named("Crosshair", F.lit("plus, wide")), named("Crosshair Scale", F.lit(1)), named("Crosshair Color", F.lit("FFFFFF")),
        named("Resolution", F.lit("1920x1080")), named("Avg FPS", 100 + key % 90), named("Resolution Scale", F.lit(100)),
        named("Avg Target Scale", 1 + (key % 2) * 0.5), named("Avg Time Dilation", F.lit(1)), named("Game Version", F.concat(F.lit("3."), _text(key % 3))),
        named("Challenge Start", _clock(started)),
        named("Scenario", F.when(abort, "").otherwise(F.concat(F.lit("Duel "), _text("scenario_id")))),
        named("Hash", F.when(abort, "").otherwise(F.md5(_text("scenario_id")))),
    ]
    score = F.when(key % 27 == 0, F.array(F.lit("Unknown Key:,1"))).otherwise(F.array(named("Score", F.coalesce("score", F.lit(0.0)))))
    body = F.concat(
        F.array(F.lit(KILL_HEADER)), F.coalesce("kill_lines", nothing), F.array(F.lit(""), F.lit("Weapon,Shots,Hits,Damage Done,Damage Possible,,Sens Scale")),
        F.coalesce("weapon_lines", F.array(F.lit("none,0,0,0,0,"))), F.array(F.lit("")), F.array(*kv), score,
    )
    when = F.date_format("written_at", "yyyy.MM.dd-HH.mm.ss")
    name = F.concat(F.lit("Duel "), _text(key), F.when(abort, F.lit(" - ")).otherwise(F.lit(" - Challenge - ")), when, F.lit(" Stats.csv"))
    # Rendered and stored in the buckets of the runs, so that neither lines nor texts are shuffled.
    return runs.select("player_id", "id", name.alias("name"), F.encode(F.array_join(body, "\r\n"), "UTF-8").alias("content"))


def _varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _part(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _single(number: int, value: float) -> bytes:
    return _varint(number << 3 | 5) + struct.pack("<f", value)


COUNTS = {"shots_fired", "shots_hit", "shots_missed", "kills", "overshots", "reloads", "pause_count", "deaths"}
NUMBERS = {kind: number for number, kind in performance.KINDS.items()}


def encode(scenario: str, start_ms: int, limit: float | None, bots: list[str], events: list[tuple[float, str, float]]) -> bytes:
    """A performance file for tests and round trips; what is absent is left out, as the format does."""
    profile = (_single(1, limit) if limit else b"") + b"".join(_part(3, x.encode()) for x in bots)
    profile += _part(5, b"".join(_varint(3) for _ in bots)) if bots else b""
    header = _part(1, scenario.encode()) + _part(2, b"hash") + _varint(3 << 3) + _varint(start_ms) + _varint(4 << 3) + _varint(1) + _part(5, profile)
    out = [_part(1, header)]
    for t, kind, value in events:
        inner = _varint(1 << 3) + _varint(int(value)) if kind in COUNTS else _single(1, value)
        out.append(_part(2, _single(1, t) + _part(NUMBERS[kind], inner)))
    return b"".join(out)


def land(files: DataFrame, folder: str) -> None:
    """Writes files (player_id, name, content) under ``player=<id>`` of a folder that any file system may hold, from tasks.

    A file appears whole: it is written beside and moved into place, so that a watcher never sees half of one.
    """

    def run(rows: Iterator) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        made = set()
        for r in rows:
            to, beside = f"{root}/player={r['player_id']}", f"{root}-beside"
            for new in {to, beside} - made:
                store.create_dir(new, recursive=True)
                made.add(new)
            with store.open_output_stream(f"{beside}/{r['player_id']}-{r['name']}") as out:
                out.write(bytes(r["content"]))
            store.move(f"{beside}/{r['player_id']}-{r['name']}", f"{to}/{r['name']}")

    files.select("player_id", "name", "content").foreachPartition(run)


@b.kept_table
def performance_files(s, d) -> DataFrame:
    """One performance file per order run with lines; every seventeenth holds an event kind that has no column."""
    kinds = ["shots_fired", "shots_hit", "damage_done", "score", "kills", "overshots"]
    told = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds))
    events = b.tick(s, d).select("run_id", "t", F.inline(told)).where("value IS NOT NULL").groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("t", "kind", "value"))).alias("events")
    )
    heads = b.header(s, d).select("player_id", "run_id", "scenario_id", "started_at", "time_limit").join(events, "run_id")

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                listed = [(e["t"], e["kind"], e["value"]) for e in r.events]
                if r.run_id % 17 == 0:
                    listed.append((1.0, "target_size", 2.0))
                limit = None if pd.isna(r.time_limit) else r.time_limit
                data = encode(f"Duel {r.scenario_id}", int(r.started_ms), limit, ["a", "b"] if r.run_id % 2 else [], listed)
                out.append((r.player_id, r.run_id, data))
            yield pd.DataFrame(out, columns=["player_id", "run_id", "content"])

    started = (F.unix_millis(F.col("started_at").cast("timestamp"))).alias("started_ms")
    return heads.select("player_id", "run_id", "scenario_id", started, "time_limit", "events").mapInPandas(
        batches, "player_id bigint, run_id bigint, content binary"
    )


@b.once
def catalogue_index(s, d) -> DataFrame:
    """Catalogue index JSON: a benchmark per region, one difficulty per nation of it."""
    region, nation = b.table(s, d, "region"), b.table(s, d, "nation")
    n = F.col("n_nationkey")
    sub = lambda name, count: F.struct(F.lit(name).alias("subcategoryName"), count.alias("scenarioCount"))
    cats = F.array(
        F.struct(F.lit(" Clicking ").alias("categoryName"), F.array(sub("Dynamic", F.lit(2)), sub("Static", F.when(n % 6 == 0, 5).otherwise(1))).alias("subcategories")),
        F.struct(F.lit("Tracking").alias("categoryName"), F.array(sub("Precise", F.lit(1))).alias("subcategories")),
    )
    colors = F.map_from_entries(F.transform(F.array(*(F.lit(r) for r in b.RANKS)), lambda r: F.struct(r, F.lit("#fff"))))
    difficulty = F.struct(
        F.col("n_name").alias("difficultyName"), n.alias("kovaaksBenchmarkId"),
        F.when(n % 2 == 0, F.concat(F.lit("KovaaKsRun"), n.cast("string"))).otherwise(F.lit("MANUAL")).alias("sharecode"),
        colors.alias("rankColors"), cats.alias("categories"),
    )
    # Collected as text: a map has no order to sort by.
    made = nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(
        F.array_sort(F.collect_list(F.struct("n_nationkey", F.to_json(difficulty).alias("d")))).alias("_d")
    )
    listed = F.array_join(F.transform("_d", lambda x: x["d"]), ",")
    names = F.array(*(F.lit(x) for x in b.BENCHMARK_NAMES))
    hidden = (F.col("r_regionkey") == 4).cast("string")
    body = F.concat(
        F.lit('{"benchmarkName":"'), F.get(names, F.col("r_regionkey")), F.lit('","hidden":'), hidden, F.lit(',"difficulties":['), listed, F.lit("]}")
    )
    return region.join(made, "r_regionkey").select(F.col("r_regionkey").alias("listed"), body.alias("body"))


@b.once
def catalogue_responses(s, d) -> DataFrame:
    """A response per nation with four scenarios; thresholds are faulty in some."""
    n = F.col("n_nationkey")

    def limits(i: int) -> Column:
        base = 10 + n + i
        good = F.array(*(_text(base * m) for m in (1, 2, 4, 8)))
        if i == 1:
            return F.when(n % 3 == 0, F.array(*(_text(base * m) for m in (1, 4, 2, 8)))).otherwise(good)
        if i == 2:
            return F.when(n % 4 == 0, F.array(F.lit("a"), *(_text(base * m) for m in (2, 4, 8)))).when(n % 5 == 0, F.array(*(_text(base) for _ in range(4)))).otherwise(good)
        return F.when(n == 7, F.array(_text(base))).otherwise(good)

    names = [F.concat(F.lit("  Strafe "), _text((n + i) % 7)) for i in range(4)]
    scenarios = lambda ids: F.map_from_entries(F.array(*(F.struct(names[i], F.struct(limits(i).alias("rank_maxes"))) for i in ids)))
    empty = F.map_from_entries(F.slice(F.array(F.struct(names[0], F.struct(limits(0).alias("rank_maxes")))), 1, 0))
    first = F.when(n == 11, empty).otherwise(scenarios([0, 1]))
    second = F.when(n == 11, empty).otherwise(scenarios([2, 3]))
    cats = F.map_from_entries(F.array(F.struct(F.lit("one"), F.struct(first.alias("scenarios"))), F.struct(F.lit("two"), F.struct(second.alias("scenarios")))))
    return b.table(s, d, "nation").select(n.alias("benchmark_id"), F.to_json(F.struct(cats.alias("categories"))).alias("body"))
