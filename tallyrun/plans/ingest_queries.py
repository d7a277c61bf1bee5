"""Queries over file intake, performance files, the catalogue and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import clock, text
from ..functions import ladder as rank
from ..operators import catalogue
from ..session import shared_folder
from ..sources import files, ingest, performance, sinks, stats_document
from ..streaming import live
from . import bridge as b
from . import fixtures
from .history_queries import complete, progress
from .quality_queries import FILES, MATCHES, matches, perf_file
from .registry import Query, query

ZONE = "Europe/Berlin"


@b.once
def parsed(s, d):
    return stats_document.parse(fixtures.documents(s, d))


@b.once
def classified(s, d):
    return stats_document.classify(parsed(s, d), "UTC")


@b.once
def staged(s, d):
    return ingest.stage(classified(s, d))


@b.once
def decoded(s, d):
    return performance.absent_as_null(performance.decode(fixtures.performance_files(s, d), ["player_id", "run_id"]))


@b.once
def read_ticks(s, d):
    fine, _ = performance.known_only(decoded(s, d), ["player_id", "run_id"])
    return performance.ticks(fine, ["player_id", "run_id"])


@b.once
def built(s, d):
    return catalogue.build(fixtures.catalogue_index(s, d), fixtures.catalogue_responses(s, d))


def _new_folder(s, name):
    return f"{shared_folder(s).rstrip('/')}/tallyrun/{name}-{uuid.uuid4().hex[:12]}"


DOC = """SELECT *, id % 19 = 0 AS abort, id % 23 = 0 AS is_reset, id % 27 = 0 OR (id % 33 = 0 AND n > 0) AS failed,
           'Duel ' || id || CASE WHEN id % 19 = 0 THEN ' - ' ELSE ' - Challenge - ' END || strftime(written_at, '%Y.%m.%d-%H.%M.%S') AS stem
         FROM (SELECT d.* EXCLUDE (file_stem), coalesce(k.n, 0) AS n, coalesce(k.hits, 0) AS hits, coalesce(k.shots, 0) AS shots, coalesce(k.possible, 0) AS possible FROM m_duel d LEFT JOIN
               (SELECT run_id, count(*) AS n, sum(hits) AS hits, sum(shots) AS shots, sum(damage_possible) AS possible FROM m_kill GROUP BY 1) k ON k.run_id = d.id)"""
KEPT = f"SELECT * FROM ({DOC}) WHERE NOT failed AND NOT abort"
LAST_SUNDAY = "(make_date(year(w), {m}, {e}) - CAST(dayofweek(make_date(year(w), {m}, {e})) AS INTEGER))"


def _summer(w):
    """Whether Berlin keeps summer time at the UTC instant ``w``; it ended in September until 1995."""
    sunday = lambda m, e: LAST_SUNDAY.format(m=m, e=e).replace("year(w)", f"year({w})") + " + INTERVAL 1 HOUR"
    return f"({w} >= {sunday(3, 31)} AND {w} < CASE WHEN year({w}) < 1996 THEN {sunday(9, 30)} ELSE {sunday(10, 31)} END)"


def _berlin(wall):
    one, two = f"({wall} - INTERVAL 1 HOUR)", f"({wall} - INTERVAL 2 HOUR)"
    fit = f"list_filter([CASE WHEN {_summer(two)} THEN {two} END, CASE WHEN NOT {_summer(one)} THEN {one} END], lambda x: x IS NOT NULL)"
    return f"(CASE WHEN len({fit}) = 0 THEN [{one}] ELSE {fit} END)"


def queries() -> list[Query]:
    q: list[Query] = []
    add = lambda *a: q.append(query(*a))
    names = lambda s, d: fixtures.documents(s, d).select("player_id", "id", "name")

    # ------------------------------------------------------------ intake
    add("S1_folder_scan", "name:s length:i", lambda s, d: files.scan_folder(s, d, [".parquet"]), None)
    add("S2_given_files", "name:s length:i", lambda s, d: files.read_paths(s, [f"{d}/events.parquet", f"{d}/orders.parquet"]), None)
    add("S4_unread_names", "player_id:i file_stem:s",
        lambda s, d: files.unseen(names(s, d), b.kill_run(s, d).where("has_perf").join(names(s, d).select("id", clock.file_stem(F.col("name")).alias("_s")), "id")
                                  .select(F.col("_s").alias("file_stem"))),
        f"SELECT *, stem AS file_stem FROM ({DOC}) WHERE NOT has_perf")
    add("I22_skip_known", "player_id:i file_stem:s",
        lambda s, d: files.unseen(names(s, d), staged(s, d)["run"], staged(s, d)["unattributed_file"], keys=["player_id", "file_stem"]),
        f"SELECT *, stem AS file_stem FROM ({DOC}) WHERE failed")
    add("I1_file_stem", "id:i file_stem:s", lambda s, d: names(s, d).withColumn("file_stem", clock.file_stem(F.col("name"))), f"SELECT id, stem AS file_stem FROM ({DOC})")
    add("I2_name_time", "id:i day:s ms:i",
        lambda s, d: names(s, d).withColumn("stem", clock.file_stem(F.col("name"))).select("id", clock.stem_date(F.col("stem")).alias("day"), clock.stem_ms(F.col("stem")).alias("ms")),
        f"SELECT id, CAST(CAST(written_at AS DATE) AS VARCHAR) AS day, epoch_ms(written_at) % 86400000 + 999 AS ms FROM ({DOC})")
    add("I3_clock_ms", "id:i idx:i at_ms:i", lambda s, d: parsed(s, d).select("id", F.inline("kills")).select("id", "idx", "at_ms"),
        "SELECT run_id AS id, ordinal AS idx, at_ms FROM m_kill")
    add("I4_sections", "id:i kills:i weapons:i kv:i",
        lambda s, d: stats_document.sections(fixtures.documents(s, d)).select("id", F.size("kill_lines").alias("kills"), F.size("weapon_lines").alias("weapons"), F.size("kv_lines").alias("kv")),
        f"""SELECT id, n AS kills, greatest(coalesce(w, 0), 1) AS weapons, greatest(coalesce(w, 0), 1) + 44 AS kv FROM ({DOC}) LEFT JOIN
              (SELECT run_id, count(DISTINCT weapon) AS w FROM m_kill GROUP BY 1) ON run_id = id""")
    add("I5_kill_rows", "id:i idx:i index:i bot:s weapon:s ttk:d shots:i hits:i damage_done:d damage_possible:d cheated:i cells:i",
        lambda s, d: parsed(s, d).select("id", F.inline("kills")),
        "SELECT run_id AS id, ordinal AS idx, ordinal + 1 AS index, ' ' || bot || ' ' AS bot, weapon, ttk, shots, hits, damage_done, damage_possible, cheated, CASE WHEN run_id % 33 = 0 THEN 12 ELSE 13 END AS cells FROM m_kill")
    weapon_sql = "SELECT run_id, weapon, sum(shots) AS shots, sum(hits) AS hits, sum(damage_done) AS damage_done, sum(damage_possible) AS damage_possible FROM m_kill GROUP BY ALL"
    add("I6_weapon_rows", "id:i weapon:s shots:i hits:i damage_done:e damage_possible:e", lambda s, d: parsed(s, d).select("id", F.inline("weapons")),
        f"SELECT run_id AS id, * EXCLUDE (run_id) FROM ({weapon_sql}) UNION ALL SELECT id, 'none', 0, 0, 0, 0 FROM ({DOC}) WHERE n = 0")
    kv = lambda s, d: stats_document.key_values(stats_document.sections(fixtures.documents(s, d)))
    add("I7_key_values", "id:i keys:i deaths:s crosshair:s",
        lambda s, d: kv(s, d).select("id", F.size("kv").alias("keys"), F.col("kv")["Deaths"].alias("deaths"), F.col("kv")["Crosshair"].alias("crosshair")),
        f"SELECT id, 42 AS keys, CAST(id % 5 AS VARCHAR) AS deaths, 'plus, wide' AS crosshair FROM ({DOC})")
    add("I8_totals_settings", "id:i kills:d deaths:d hit_count:d miss_count:d score:d scenario:s hash:s game_version:s horiz_sens:d hide_gun:b avg_fps:d",
        lambda s, d: parsed(s, d).select("id", "totals.*", "settings.*"),
        f"""SELECT id, n AS kills, id % 5 AS deaths, hits AS hit_count, shots - hits AS miss_count, CASE WHEN id % 27 <> 0 THEN coalesce(score, 0) END AS score,
              CASE WHEN abort THEN '' ELSE 'Duel ' || scenario_id END AS scenario, CASE WHEN abort THEN '' ELSE md5(CAST(scenario_id AS VARCHAR)) END AS hash,
              '3.' || (id % 3) AS game_version, 20 + id % 4 AS horiz_sens, true AS hide_gun, 100 + id % 90 AS avg_fps FROM ({DOC})""")
    add("I9_quarantine", "player_id:i name:s code:s line:i key:s value:s error:s", lambda s, d: stats_document.quarantine(classified(s, d), ["player_id"]),
        f"""SELECT player_id, stem || ' Stats.csv' AS name, CASE WHEN id % 27 = 0 THEN 'key.absent' ELSE 'kill.width' END AS code,
              CASE WHEN id % 27 <> 0 THEN 2 END AS line, CASE WHEN id % 27 = 0 THEN 'Score' END AS key, CASE WHEN id % 27 <> 0 THEN '12' END AS value,
              CASE WHEN id % 27 = 0 THEN 'key.absent key=Score' ELSE 'kill.width line=2 value=12' END AS error FROM ({DOC}) WHERE failed""")
    add("I15_classified", "id:i kind:s written_at:t started_at:t start_ms:i duration_s:d", classified,
        f"""SELECT id, CASE WHEN abort THEN 'abort' WHEN is_reset THEN 'reset' ELSE 'complete' END AS kind, written_at + INTERVAL 999 MILLISECOND AS written_at,
              CASE WHEN NOT abort AND NOT is_reset THEN started_at END AS started_at, CASE WHEN NOT abort AND NOT is_reset THEN start_ms END AS start_ms,
              CASE WHEN NOT abort AND NOT is_reset THEN 60.999 END AS duration_s FROM ({DOC})""")

    def wall(s, d):
        ms = F.col("o_orderkey") * 37 % 14_400 * 1000
        return b.table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), ms.alias("ms"))

    wall_sql = "(o_orderdate + to_seconds(o_orderkey * 37 % 14400))"
    add("I16_wall_clock", "o_orderkey:i n:i first:t last:t",
        lambda s, d: wall(s, d).withColumn("at", clock.instants(F.col("day"), F.col("ms"), ZONE)).select(
            "o_orderkey", F.size("at").alias("n"), F.get("at", F.lit(0)).alias("first"), F.element_at("at", -1).alias("last")),
        f"SELECT o_orderkey, len(a) AS n, list_min(a) AS first, list_max(a) AS last FROM (SELECT o_orderkey, {_berlin(wall_sql)} AS a FROM orders)")
    add("I17_paired_times", "o_orderkey:i ms:i written_at:t started_at:t",
        lambda s, d: wall(s, d).withColumn("p", clock.span(F.col("day"), F.col("ms") + 999, (F.col("ms") + 86_400_000 - 7_200_000) % 86_400_000, ZONE)).select(
            "o_orderkey", "p.ms", "p.written_at", "p.started_at"),
        f"""SELECT o_orderkey, best.ms, best.w AS written_at, best.s AS started_at FROM (SELECT o_orderkey, min(struct_pack(ms := epoch_ms(w) - epoch_ms(s), w := w, s := s)) AS best
              FROM (SELECT o_orderkey, unnest({_berlin("(o_orderdate + to_milliseconds(m + 999))")}) AS w, s_all FROM (
                SELECT o_orderkey, o_orderdate, m, list_concat({_berlin("(o_orderdate + to_milliseconds(c))")}, {_berlin("(o_orderdate - INTERVAL 1 DAY + to_milliseconds(c))")}) AS s_all
                FROM (SELECT o_orderkey, o_orderdate, o_orderkey * 37 % 14400 * 1000 AS m, (o_orderkey * 37 % 14400 * 1000 + 79200000) % 86400000 AS c FROM orders))) t,
              unnest(s_all) u(s) WHERE epoch_ms(w) - epoch_ms(s) >= -60000 GROUP BY 1)""")
    add("I18_reset_fields", "player_id:i file_stem:s kind:s avg_fps:d raw_fps:d raw_start:b",
        lambda s, d: staged(s, d)["run"].select("player_id", "file_stem", "kind", "avg_fps", F.try_element_at("extra", F.lit("raw.avg_fps")).cast("double").alias("raw_fps"),
                                                F.try_element_at("extra", F.lit("raw.challenge_start")).isNotNull().alias("raw_start")),
        f"""SELECT player_id, stem AS file_stem, CASE WHEN is_reset THEN 'reset' ELSE 'complete' END AS kind, CASE WHEN NOT is_reset THEN 100 + id % 90 END AS avg_fps,
              CASE WHEN is_reset THEN 100 + id % 90 END AS raw_fps, is_reset AS raw_start FROM ({KEPT})""")
    add("I19_extra", "player_id:i file_stem:s deaths:d scale:d midairs:d",
        lambda s, d: staged(s, d)["run"].select("player_id", "file_stem", *(F.try_element_at("extra", F.lit(k)).cast("double").alias(c) for k, c in
                                                (("deaths", "deaths"), ("avg_target_scale", "scale"), ("midairs", "midairs")))),
        f"SELECT player_id, stem AS file_stem, nullif(id % 5, 0) AS deaths, CASE WHEN id % 2 = 1 THEN 1.5 END AS scale, NULL AS midairs FROM ({KEPT})")
    add("I20_weapon_sums", "player_id:i file_stem:s shots:d damage_possible:e", lambda s, d: staged(s, d)["run"],
        f"SELECT player_id, stem AS file_stem, shots, possible AS damage_possible FROM ({KEPT})")
    add("I21_trimmed_names", "player_id:i file_stem:s idx:i bot:s", lambda s, d: staged(s, d)["kill"],
        f"SELECT r.player_id, r.stem AS file_stem, k.ordinal AS idx, k.bot FROM m_kill k JOIN ({KEPT}) r ON r.id = k.run_id")

    def dims(s, d):
        made = ingest.dimensions(staged(s, d))
        parts = [made["scenario"].select(F.lit("scenario").alias("dim"), F.col("hash").alias("key")), made["game_version"].select(F.lit("version"), "label"),
                 made["bot"].select(F.lit("bot"), "name"), made["weapon"].select(F.lit("weapon"), "name"), made["config"].select(F.lit("config"), F.col("horiz_sens").cast("int").cast("string"))]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    add("I24_dimensions", "dim:s key:s", dims,
        f"""SELECT DISTINCT 'scenario' AS dim, md5(CAST(scenario_id AS VARCHAR)) AS key FROM ({KEPT}) UNION SELECT 'version', '3.' || (id % 3) FROM ({KEPT})
            UNION SELECT 'bot', bot FROM m_kill JOIN ({KEPT}) ON id = run_id UNION SELECT 'weapon', weapon FROM m_kill JOIN ({KEPT}) ON id = run_id
            UNION SELECT 'weapon', 'none' FROM ({KEPT}) WHERE n = 0 UNION SELECT 'config', CAST(20 + id % 4 AS VARCHAR) FROM ({KEPT})""")

    def spine(s, d):
        made = ingest.dimensions(staged(s, d))
        rows = ingest.run_rows(staged(s, d))
        return rows.join(made["scenario"], "scenario_id").join(made["game_version"], "game_version_id").join(made["config"].select("config_id", "horiz_sens"), "config_id")

    add("I25_run_spine", "player_id:i file_stem:s kind:s hash:s name:s label:s horiz_sens:d score:d", spine,
        f"""SELECT player_id, stem AS file_stem, CASE WHEN is_reset THEN 'reset' ELSE 'complete' END AS kind, md5(CAST(scenario_id AS VARCHAR)) AS hash, 'Duel ' || scenario_id AS name,
              '3.' || (id % 3) AS label, 20 + id % 4 AS horiz_sens, coalesce(score, 0) AS score FROM ({KEPT})""")
    add("I26_unattributed", "player_id:i file_stem:s written_at:t kills:i",
        lambda s, d: staged(s, d)["unattributed_file"].withColumn("kills", F.json_array_length(F.get_json_object("payload", "$.kills"))),
        f"SELECT player_id, stem AS file_stem, written_at + INTERVAL 999 MILLISECOND AS written_at, n AS kills FROM ({DOC}) WHERE NOT failed AND abort")
    ids = lambda s, d: staged(s, d)["run"].select(ingest.key_id("player_id", "file_stem").alias("run_id"), "file_stem")
    add("I27_run_weapon", "file_stem:s name:s shots:i hits:i damage_done:e damage_possible:e",
        lambda s, d: ingest.weapon_totals(staged(s, d)).join(ids(s, d), ["run_id", "file_stem"]).join(ingest.dimensions(staged(s, d))["weapon"], "weapon_id"),
        f"""SELECT r.stem AS file_stem, w.weapon AS name, w.* EXCLUDE (weapon, run_id) FROM ({weapon_sql}) w JOIN ({KEPT}) r ON r.id = w.run_id
            UNION ALL SELECT stem, 'none', 0, 0, 0, 0 FROM ({KEPT}) WHERE n = 0""")
    add("I28_kill_series", "file_stem:s place:i idx:i at_ms:i ttk:d shots:i",
        lambda s, d: ingest.kill_series(staged(s, d)).join(ids(s, d), ["run_id", "file_stem"]).select("file_stem", F.posexplode("kills").alias("place", "k")).select("file_stem", "place", "k.*"),
        f"SELECT r.stem AS file_stem, k.ordinal AS place, k.ordinal AS idx, k.at_ms, k.ttk, k.shots FROM m_kill k JOIN ({KEPT}) r ON r.id = k.run_id")
    series_sql = f"SELECT r.stem AS file_stem, k.ordinal AS place, k.ordinal AS idx, k.at_ms, k.ttk, k.shots FROM m_kill k JOIN ({KEPT}) r ON r.id = k.run_id"
    twice = lambda s, d: ingest.stage(classified(s, d).unionByName(classified(s, d)))
    add("I25_files_listed_twice", "player_id:i file_stem:s score:d", lambda s, d: ingest.run_rows(twice(s, d)), f"SELECT player_id, stem AS file_stem, coalesce(score, 0) AS score FROM ({KEPT})")
    add("I28_files_listed_twice", "file_stem:s place:i idx:i at_ms:i ttk:d shots:i",
        lambda s, d: ingest.kill_series(twice(s, d)).select("file_stem", F.posexplode("kills").alias("place", "k")).select("file_stem", "place", "k.*"), series_sql)
    add("I29_files_listed_twice", "file_stem:s bots:i kills:i shots:i",
        lambda s, d: ingest.run_bot(twice(s, d)).groupBy("file_stem").agg(F.count("*").alias("bots"), F.sum("kills").alias("kills"), F.sum("shots").alias("shots")),
        f"SELECT r.stem AS file_stem, count(DISTINCT k.bot) AS bots, count(*) AS kills, sum(k.shots) AS shots FROM m_kill k JOIN ({KEPT}) r ON r.id = k.run_id GROUP BY 1")
    add("I30_attached_once", "player_id:i perf_stem:s candidates:i", lambda s, d: ingest.attached(matches(s, d)), f"SELECT player_id, perf_stem, count(*) AS candidates FROM ({MATCHES}) GROUP BY ALL")
    add("I31_json_lists", "file_stem:s place:i ttk:d",
        lambda s, d: staged_kills(s, d).select("file_stem", F.to_json(F.transform("kills", lambda k: k["ttk"])).alias("j")).select(
            "file_stem", F.posexplode(ingest.list_array(F.col("j"), "double")).alias("place", "ttk")), f"SELECT file_stem, place, ttk FROM ({series_sql})")
    add("F10_json_payload", "player_id:i file_stem:s hash:s",
        lambda s, d: staged(s, d)["unattributed_file"].withColumn("hash", F.from_json("payload", "settings struct<hash:string>")["settings"]["hash"]),
        f"SELECT player_id, stem AS file_stem, '' AS hash FROM ({DOC}) WHERE NOT failed AND abort")
    add("I33_pending_perf", "player_id:i perf_stem:s", lambda s, d: ingest.pending(perf_file(s, d), matches(s, d)),
        f"SELECT * FROM ({FILES}) WHERE perf_stem NOT IN (SELECT perf_stem FROM ({MATCHES}))")
    add("I34_ingest_report", "scanned:i todo:i skipped:i runs:i aborts:i failures:i matched:i ambiguous:i orphans:i",
        lambda s, d: ingest.report(names(s, d).unionByName(names(s, d).where("player_id % 2 = 1")), names(s, d), classified(s, d), matches(s, d), perf_file(s, d)),
        f"""SELECT count(*) + count(*) FILTER (WHERE player_id % 2 = 1) AS scanned, count(*) AS todo, count(*) FILTER (WHERE player_id % 2 = 1) AS skipped,
              count(*) FILTER (WHERE NOT failed AND NOT abort) AS runs, count(*) FILTER (WHERE NOT failed AND abort) AS aborts, count(*) FILTER (WHERE failed) AS failures,
              (SELECT count(*) FROM (SELECT perf_stem FROM ({MATCHES}) GROUP BY 1 HAVING count(*) = 1)) AS matched,
              (SELECT count(*) FROM (SELECT perf_stem FROM ({MATCHES}) GROUP BY 1 HAVING count(*) > 1)) AS ambiguous,
              (SELECT count(*) FROM ({FILES}) WHERE perf_stem NOT IN (SELECT perf_stem FROM ({MATCHES}))) AS orphans FROM ({DOC})""")
    add("I23_name_order", "id:i day:s ms:i",
        lambda s, d: names(s, d).withColumn("stem", clock.file_stem(F.col("name"))).select("id", clock.stem_date(F.col("stem")).alias("day"), clock.stem_ms(F.col("stem")).alias("ms")).orderBy("day", "ms"),
        None)
    add("F1_js_trim", "scenario_id:i trimmed:s", lambda s, d: b.scenario(s, d).withColumn("trimmed", text.js_trim(F.col("name"))), "SELECT scenario_id, trimmed FROM m_scenario")
    add("F3_short_hash", "player_id:i id:i short:s", lambda s, d: complete(s, d).withColumn("short", text.short_hash(F.col("scenario_hash"))),
        "SELECT player_id, id, left(scenario_hash, 8) AS short FROM m_complete")

    # ------------------------------------------------------------ performance files
    heads = lambda s, d: decoded(s, d).select("run_id", "scenario_name", "challenge_start_ms", "time_limit", "timescale", F.size("added_bots").alias("bots"),
                                              F.size("bot_max_lives").alias("lives"), F.size("events").alias("events"))
    head_sql = """SELECT h.run_id, 'Duel ' || h.scenario_id AS scenario_name, epoch_ms(h.started_at) AS challenge_start_ms, CAST(CAST(time_limit AS FLOAT) AS DOUBLE) AS time_limit, NULL AS timescale,
                    CASE WHEN h.run_id % 2 = 1 THEN 2 ELSE 0 END AS bots, CASE WHEN h.run_id % 2 = 1 THEN 2 END AS lives, e.n + CASE WHEN h.run_id % 17 = 0 THEN 1 ELSE 0 END AS events
                  FROM m_header h JOIN (SELECT run_id, 4 * count(*) + count(score) + count(overshots) AS n FROM m_tick GROUP BY 1) e USING (run_id)"""
    add("I10_decoded", "run_id:i scenario_name:s challenge_start_ms:i bots:i events:i", heads, head_sql)
    add("I11_absent_as_null", "run_id:i time_limit:d timescale:d lives:i", heads, head_sql)
    add("I12_unknown_events", "run_id:i error:s", lambda s, d: performance.known_only(decoded(s, d), ["run_id"])[1],
        "SELECT DISTINCT run_id, 'event.unknown key=target_size' AS error FROM m_tick WHERE run_id % 17 = 0")
    add("I13_tick_pivot", "run_id:i tick_no:i t:e shots_fired:d shots_hit:d damage_done:d score:e kills:d overshots:d deaths:d", read_ticks,
        "SELECT *, NULL AS deaths FROM m_tick WHERE run_id % 17 <> 0")
    add("I14_reported", "run_id:i has_score:b has_overshots:b has_deaths:b", lambda s, d: performance.reported(read_ticks(s, d), ["run_id"]),
        "SELECT run_id, count(score) > 0 AS has_score, count(overshots) > 0 AS has_overshots, false AS has_deaths FROM m_tick WHERE run_id % 17 <> 0 GROUP BY 1")

    def arrays(s, d):
        from ..operators import views

        made = views.series(read_ticks(s, d), performance.METRICS)
        return made.select("run_id", "has_score", F.posexplode("ticks").alias("place", "k")).select("run_id", "has_score", "place", "k.t", "k.kills")

    add("I32_tick_series", "run_id:i has_score:b place:i t:e kills:d", arrays,
        "SELECT run_id, count(score) OVER (PARTITION BY run_id) > 0 AS has_score, tick_no AS place, t, kills FROM m_tick WHERE run_id % 17 <> 0")

    # ------------------------------------------------------------ catalogue
    diffs = lambda s, d: catalogue.difficulties(fixtures.catalogue_index(s, d))
    d_sql = """SELECT n.*, b.name, b.family, b.season FROM nation n JOIN m_benchmark b ON b.benchmark_id = n.n_regionkey WHERE n_regionkey <> 4"""
    add("K4_family_season", "benchmark_id:i family:s season:d", diffs, f"SELECT n_nationkey AS benchmark_id, family, season FROM ({d_sql})")
    add("K5_share_codes", "benchmark_id:i sharecode:s", diffs, f"SELECT n_nationkey AS benchmark_id, CASE WHEN n_nationkey % 2 = 0 THEN 'KovaaKsRun' || n_nationkey END AS sharecode FROM ({d_sql})")
    problem_sql = """SELECT n_nationkey AS benchmark_id, i AS pos, CASE WHEN i = 1 AND n_nationkey % 3 = 0 THEN 'ladder.falls' WHEN i = 2 AND n_nationkey % 4 = 0 THEN 'ladder.not_number'
                       WHEN i = 2 AND n_nationkey % 5 = 0 THEN 'ladder.flat' END AS problem, 'Strafe ' || ((n_nationkey + i) % 7) AS scenario_name FROM nation, range(4) r(i) WHERE n_nationkey <> 11"""
    add("K6_ladder_problems", "benchmark_id:i pos:i problem:s",
        lambda s, d: catalogue.listed_scenarios(fixtures.catalogue_responses(s, d)).withColumn("problem", rank.ladder_problem(F.col("thresholds"))), problem_sql)
    usable = f"SELECT p.* FROM ({problem_sql}) p JOIN ({d_sql}) d ON d.n_nationkey = p.benchmark_id WHERE p.benchmark_id NOT IN (7, 11) AND problem IS NULL"
    add("K7_catalogue_ladders", "benchmark_id:i scenario_name:s pos:i top:d", lambda s, d: built(s, d)["ladder"].withColumn("top", F.element_at("thresholds", -1)),
        f"SELECT *, (10 + benchmark_id + pos) * 8 AS top FROM ({usable})")
    add("K7_catalogue_skipped", "benchmark_id:i name:s difficulty:s code:s key:s", lambda s, d: built(s, d)["skipped"],
        f"""SELECT n_nationkey AS benchmark_id, name, n_name AS difficulty, CASE WHEN n_nationkey = 11 THEN 'benchmark.empty' ELSE 'benchmark.uneven' END AS code,
              CASE WHEN n_nationkey = 7 THEN '4' END AS key FROM ({d_sql}) WHERE n_nationkey IN (7, 11)
            UNION ALL SELECT p.benchmark_id, d.name, n_name AS difficulty, problem AS code, scenario_name AS key FROM ({problem_sql}) p
              JOIN ({d_sql}) d ON d.n_nationkey = p.benchmark_id WHERE problem IS NOT NULL AND p.benchmark_id NOT IN (7, 11)""")
    add("K7_treeless", "benchmark_id:i", lambda s, d: built(s, d)["treeless"], f"SELECT n_nationkey AS benchmark_id FROM ({d_sql}) WHERE n_nationkey % 6 = 0")
    add("K8_rank_name_problems", "benchmark_id:i rank:s",
        lambda s, d: catalogue.rank_name_problems(diffs(s, d).withColumn("ranks", F.array(F.lit("Iron"), (F.col("benchmark_id") % 3).cast("string"), F.lit("007")))),
        f"SELECT n_nationkey AS benchmark_id, CAST(n_nationkey % 3 AS VARCHAR) AS rank FROM ({d_sql})")
    add("K9_tree_slots", "benchmark_id:i cat_no:i sub_no:i slot_no:i category:s subcategory:s scenario_name:s", lambda s, d: built(s, d)["tree_slot"],
        f"""SELECT p.benchmark_id, CASE WHEN pos = 3 THEN 1 ELSE 0 END AS cat_no, CASE WHEN pos <= 1 THEN 0 ELSE pos - 1 END AS sub_no, CASE WHEN pos = 1 THEN 1 ELSE 0 END AS slot_no,
              CASE WHEN pos = 3 THEN 'Tracking' ELSE 'Clicking' END AS category, CASE WHEN pos <= 1 THEN 'Dynamic' WHEN pos = 2 THEN 'Static' ELSE 'Precise' END AS subcategory, scenario_name
            FROM ({problem_sql}) p WHERE benchmark_id % 6 <> 0 AND benchmark_id IN (SELECT benchmark_id FROM ({usable}))""")
    add("K10_catalogue_order", "scenario_name:s benchmark_id:i candidate_order:i", lambda s, d: built(s, d)["ladder"],
        f"""SELECT scenario_name, benchmark_id, row_number() OVER (PARTITION BY scenario_name ORDER BY CASE WHEN d.family = 'valor' THEN 0 ELSE 2 END, d.season DESC, n_regionkey, n_nationkey) AS candidate_order
            FROM ({usable}) u JOIN ({d_sql}) d ON d.n_nationkey = u.benchmark_id""")

    def stamps(s, d):
        fresh = catalogue.content_hash(built(s, d)["benchmark"], built(s, d)["ladder"])
        old = fresh.select("benchmark_id", F.when(F.col("benchmark_id") % 2 == 0, F.col("content")).otherwise(F.lit("other")).alias("content"),
                           F.expr("TIMESTAMP '2026-01-01 00:00:00'").alias("generated_at"))
        return catalogue.stamped(fresh, old, F.expr("TIMESTAMP '2026-06-01 00:00:00'"))

    add("S8_stamped_catalogue", "benchmark_id:i generated_at:t", stamps,
        f"""SELECT DISTINCT benchmark_id, CASE WHEN benchmark_id % 2 = 0 THEN TIMESTAMP '2026-01-01 00:00:00' ELSE TIMESTAMP '2026-06-01 00:00:00' END AS generated_at FROM ({usable})""")

    # ------------------------------------------------------------ written tables and streams
    add("S5_batch_write", "player_id:i file_stem:s kind:s", _written,
        f"SELECT player_id, stem AS file_stem, CASE WHEN is_reset THEN 'reset' ELSE 'complete' END AS kind FROM ({KEPT})")
    add("S7_export", "player_id:i id:i scenario_id:i score:d", _exported,
        "SELECT * FROM m_progress WHERE scenario_id IN (SELECT scenario_id FROM m_complete GROUP BY 1 HAVING count(*) >= (SELECT avg(n) FROM (SELECT count(*) AS n FROM m_complete GROUP BY scenario_id)))")
    batches = f"""SELECT *, id % 3 AS batch, (id + 1) % 3 AS perf_batch, id % 17 = 0 AS perf_failed FROM ({DOC})"""
    have = "SELECT run_id FROM m_tick GROUP BY 1"
    add("S3_noticed_files", "batch:i file_stem:s is_perf:b outcome:s attempts:i", lambda s, d: ingested(s, d, "ingest_file"),
        f"""WITH files AS (SELECT stem, false AS is_perf, batch, failed, CASE WHEN abort THEN 'abort' WHEN is_reset THEN 'reset' ELSE 'complete' END AS good FROM ({batches})
              UNION ALL SELECT stem, true, perf_batch, perf_failed, 'perf' FROM ({batches}) WHERE id IN ({have}))
            SELECT t.batch, stem AS file_stem, is_perf, CASE WHEN failed THEN 'failed' ELSE good END AS outcome, t.batch - f.batch + 1 AS attempts FROM files f JOIN (VALUES (0), (1), (2)) t(batch) ON t.batch = f.batch OR (failed AND t.batch > f.batch)""")
    add("T1_ingested_runs", "player_id:i file_stem:s kind:s batch:i", lambda s, d: ingested(s, d, "run"),
        f"SELECT player_id, stem AS file_stem, CASE WHEN is_reset THEN 'reset' ELSE 'complete' END AS kind, batch FROM ({batches}) WHERE NOT failed AND NOT abort")
    add("T1_failures", "player_id:i file_stem:s is_perf:b attempts:i", lambda s, d: live.failures(s, streamed(s, d)),
        f"SELECT player_id, stem AS file_stem, false AS is_perf, 3 - batch AS attempts FROM ({batches}) WHERE failed UNION ALL SELECT player_id, stem, true, 3 - perf_batch FROM ({batches}) WHERE perf_failed AND id IN ({have})")
    # The first batch that holds a file and a run it overlaps decides; runs of later ones come too late.
    pairs = f"""SELECT p.player_id, p.stem AS perf_stem, p.perf_batch, p.id AS perf_of, r.id AS run_of, greatest(p.perf_batch, r.batch) AS batch FROM ({batches}) p JOIN ({batches}) r ON r.player_id = p.player_id AND NOT r.failed AND NOT r.abort
                  AND NOT r.is_reset AND r.written_at - INTERVAL 60 SECOND < p.started_at + INTERVAL 1 SECOND AND r.written_at + INTERVAL 999 MILLISECOND > p.started_at WHERE NOT p.perf_failed AND p.id IN ({have})"""
    attached = f"SELECT player_id, perf_stem, batch, count(*) AS candidates FROM (SELECT * FROM ({pairs}) QUALIFY batch = min(batch) OVER (PARTITION BY player_id, perf_stem)) GROUP BY ALL"
    add("I33_attached_as_they_come", "player_id:i perf_stem:s batch:i candidates:i", lambda s, d: ingested(s, d, "run_perf"), attached)
    add("I33_orphans", "player_id:i perf_stem:s", lambda s, d: live.orphans(s, streamed(s, d)),
        f"SELECT player_id, stem AS perf_stem FROM ({batches}) WHERE NOT perf_failed AND id IN ({have}) AND (player_id, stem) NOT IN (SELECT (player_id, perf_stem) FROM ({pairs}))")
    add("T1_tick_series", "perf_stem:s ticks:i has_score:b has_overshots:b has_deaths:b", _streamed_series,
        f"""SELECT perf_stem, count(*) AS ticks, count(m_tick.score) > 0 AS has_score, count(m_tick.overshots) > 0 AS has_overshots, false AS has_deaths FROM
              (SELECT * FROM ({pairs}) QUALIFY count(*) OVER (PARTITION BY perf_of) = 1 AND count(*) OVER (PARTITION BY run_of) = 1) JOIN m_tick ON run_id = perf_of GROUP BY 1""")
    add("T1_reports", "batch:i files:i runs:i aborts:i perfs:i failures:i retried:i matched:i ambiguous:i", lambda s, d: ingested(s, d, "ingest_report"),
        f"""WITH stats AS (SELECT * FROM ({batches})), perfs AS (SELECT * FROM ({batches}) WHERE id IN ({have})), found AS ({attached}), t(batch) AS (VALUES (0), (1), (2))
            SELECT batch, runs + aborts + perfs + failures AS files, * EXCLUDE (batch) FROM (SELECT t.batch,
              (SELECT count(*) FROM stats s WHERE s.batch = t.batch AND NOT failed AND NOT abort) AS runs, (SELECT count(*) FROM stats s WHERE s.batch = t.batch AND NOT failed AND abort) AS aborts,
              (SELECT count(*) FROM perfs p WHERE perf_batch = t.batch AND NOT perf_failed) AS perfs,
              (SELECT count(*) FROM stats s WHERE s.batch <= t.batch AND failed) + (SELECT count(*) FROM perfs p WHERE perf_batch <= t.batch AND perf_failed) AS failures,
              (SELECT count(*) FROM stats s WHERE s.batch < t.batch AND failed) + (SELECT count(*) FROM perfs p WHERE perf_batch < t.batch AND perf_failed) AS retried,
              (SELECT count(*) FROM found f WHERE f.batch = t.batch) AS matched, (SELECT count(*) FROM found f WHERE f.batch = t.batch AND candidates > 1) AS ambiguous FROM t)""")
    add("T5_refreshed", "batch:i runs:i", _refreshed,
        f"SELECT t.batch, (SELECT count(*) FROM ({batches}) r WHERE r.batch <= t.batch AND NOT failed AND NOT abort) AS runs FROM (VALUES (0), (1), (2)) t(batch)")
    add("T2_exactly_once", "player_id:i id:i", _once, "SELECT player_id, id FROM m_run")
    meets = """SELECT p.player_id, 'perf-' || p.id AS perf_stem, r.id AS run_id FROM m_run p JOIN m_complete r ON r.player_id = p.player_id
           AND r.written_at - INTERVAL 60 SECOND < date_trunc('second', p.written_at - INTERVAL 60 SECOND) + INTERVAL 1 SECOND AND r.written_at > date_trunc('second', p.written_at - INTERVAL 60 SECOND)"""
    # Files that met no run by the watermark, ten minutes before the newest run, three hours after their start.
    add("T3_paired_streams", "player_id:i perf_stem:s run_id:i", _paired,
        f"""{meets} UNION ALL SELECT player_id, 'perf-' || id, NULL FROM m_run p WHERE 'perf-' || id NOT IN (SELECT perf_stem FROM ({meets}))
            AND date_trunc('second', written_at - INTERVAL 60 SECOND) + INTERVAL 3 HOUR <= (SELECT max(written_at) FROM m_run) - INTERVAL 10 MINUTE""")
    add("T7_live_form", "player_id:i scenario_id:i pb:d form:d n:i", _live_form,
        """SELECT player_id, scenario_id, max(pb) AS pb, quantile_cont(score, 0.5) FILTER (WHERE k <= 10) AS form, count(*) FILTER (WHERE k <= 10) AS n FROM (
             SELECT *, max(score) OVER (PARTITION BY player_id, scenario_id) AS pb, row_number() OVER (PARTITION BY player_id, scenario_id ORDER BY started_at DESC, id DESC) AS k
             FROM m_complete WHERE score IS NOT NULL) GROUP BY ALL""")
    add("C15_stored_pace", "run_id:i idx:i accumulated:d local:d", _stored_pace, "SELECT * FROM m_pace")
    add("T4_notice", "batch:s runs:i max_id:i", _notices, """SELECT 'even' AS batch, count(*) AS runs, max(id) AS max_id FROM m_run WHERE player_id % 2 = 0
        UNION ALL SELECT 'odd', count(*), max(id) FROM m_run WHERE player_id % 2 = 1""")
    add("T6_live_sessions", "player_id:i runs:i started_at:t ended_at:t", _live_sessions,
        "SELECT player_id, count(*) AS runs, min(written_at) AS started_at, max(written_at) AS ended_at FROM m_session GROUP BY player_id, session_id")
    add("T8_latest_run", "player_id:i latest_id:i newer:b", _live_latest,
        "SELECT player_id, arg_max(id, struct_pack(a := written_at, b := id)) AS latest_id, player_id % 2 = 0 AS newer FROM m_run GROUP BY 1")
    return q


def staged_kills(s, d):
    return ingest.kill_series(staged(s, d))


@b.once
def streamed(s, d):
    """The root of tables that a folder watch has kept over four passes, each a new start of the stream.

    Files land in three portions, a performance file one portion away from its run, before or after it. The last portion
    holds only copies of files that are known by then. Every refresh notes how many runs it saw. A portion is one batch at
    every size, as the SQL numbers them.
    """
    source, root = (_new_folder(s, n) for n in ("landing", "watched"))
    stats = fixtures.documents(s, d)
    named = stats.select(F.col("id").alias("run_id"), F.regexp_replace("name", " Stats.csv$", " Performance.perf").alias("name"))
    perfs = fixtures.performance_files(s, d).join(named, "run_id")

    def refresh(n):
        ingest.read_table(s, root, "run").agg(F.lit(n).alias("batch"), F.count("*").alias("runs")).write.mode("overwrite").parquet(f"{root}/refreshed/part={n}")

    for n in range(4):
        if n < 3:
            fixtures.land(stats.where(F.col("id") % 3 == n), f"{source}/{n}")
            fixtures.land(perfs.where((F.col("run_id") + 1) % 3 == n), f"{source}/{n}")
        else:
            fixtures.land(ingest.read_table(s, root, "run").join(stats.withColumn("file_stem", clock.file_stem(F.col("name"))), ["player_id", "file_stem"]), f"{source}/{n}")
        live.watch(s, source, root, once=True, refresh=refresh, per_batch=None).awaitTermination()
    return root


def ingested(s, d, table):
    """A table of the watched folder with the batch that wrote each row."""
    root = streamed(s, d)
    return ingest.read_table(s, root, table, keep_batch=True).withColumn("batch", F.col("batch_id").cast("int"))


def _streamed_series(s, d):
    """Series of runs that one file overlaps which overlaps no other run."""
    read = lambda name: ingest.read_table(s, streamed(s, d), name)
    pairs = ingest.perf_matches(read("perf_start"), read("run"))
    once = lambda key: pairs.groupBy("player_id", key).agg(F.count("*").alias("n")).where("n = 1").drop("n")
    alone = pairs.select("player_id", "perf_stem", "run_id").join(once("perf_stem"), ["player_id", "perf_stem"]).join(once("run_id"), ["player_id", "run_id"])
    return read("run_series").join(alone, ["player_id", "run_id"]).withColumn("ticks", F.size("ticks"))


def _refreshed(s, d):
    return s.read.parquet(f"{streamed(s, d)}/refreshed")


def _written(s, d):
    root = _new_folder(s, "tables")
    ingest.write_batch(ingest.tables(staged(s, d)), root, 0)
    return ingest.read_table(s, root, "run")


def _exported(s, d):
    root, done = _new_folder(s, "export"), complete(s, d)
    counts = done.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n"))
    usual = counts.select(F.avg("n")).scalar()
    from ..operators import lists, reports, views

    answers = {
        "progress": progress(s, d), "attempts": views.run_attempt(b.run(s, d)), "pb": reports.pb_timeline(progress(s, d)), "rerolls": reports.reroll_rate(b.run(s, d)),
        "distribution": reports.distribution(done), "directory": lists.directory(done), "sessions": views.run_session(b.run(s, d)), "confounds": reports.confounds(progress(s, d)),
    }
    sinks.export_bundle(answers, counts.where(F.col("n") >= usual), root)
    return s.read.parquet(f"{root}/progress")


#: Portions of the events in time order, each a micro-batch of its own.
PORTIONS = 3


@b.once
def _portions(s, d):
    """The folder of the events in as many portions, cut by their times and written one after another."""
    raw, root = b.table(s, d, "events"), _new_folder(s, "portions")
    cuts = raw.agg(*(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), i / PORTIONS, 1000).alias(f"c{i}") for i in range(1, PORTIONS))).first()
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    edges = [None, *cuts, None]
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        part = raw.where((at >= low if low is not None else F.lit(True)) & (at < high if high is not None else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(f"{root}/{i}")
    return root


def _stream(s, d):
    """The events table as a stream of runs, a portion a batch."""
    raw = b.table(s, d, "events")
    fresh = s.readStream.schema(raw.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(_portions(s, d))
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    written = F.col("ts").cast("timestamp")
    return fresh.select(
        (F.col("user_id") % 10).alias("player_id"), F.col("event_id").alias("id"), written.alias("written_at"),
        F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("file_stem"), (k % 10).alias("scenario_id"),
        F.when(F.col("event_type") == "error", "reset").otherwise("complete").alias("kind"),
        (written - F.expr("INTERVAL 60 SECOND")).alias("started_at"), F.when(k % 7 != 6, F.col("value")).alias("score"),
    )


def _drain(s, stream, name, mode, keys=None):
    """Runs a stream over what is there now, stops it after a batch and starts it again; returns what it wrote.

    In update mode the sink merges by ``keys``; in complete mode the newest batch holds every row. Streams with an own state need the RocksDB provider, set for them only.
    """
    root = _new_folder(s, name)

    def append(df, n):
        ingest.write_batch({name: df}, root, n)

    sink = append if keys is None else live.merged_by_key(root, name, keys)
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(setting, None)
    s.conf.set(setting, live.ROCKS)
    try:
        def start():
            return stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(sink)

        first = start().trigger(processingTime="1 hour").start()
        while first.isActive and ingest.commits(s, root) is None:
            first.awaitTermination(0.2)
        first.stop()
        start().trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            s.conf.unset(setting)
        else:
            s.conf.set(setting, before)
    if mode == "complete":
        return ingest.last_batch(s, root, name)
    return ingest.read_table(s, root, name) if keys is None else live.newest_by_key(s, root, name, keys)


def _once(s, d):
    both = _stream(s, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _drain(s, live.once_per_stem(both, "1 day", "written_at").select("player_id", "id"), "once", "append")


def _notices(s, d):
    run = b.run(s, d)
    parts = {"even": run.where("player_id % 2 = 0"), "odd": run.where("player_id % 2 = 1"), "none": run.where("player_id < 0")}
    out = None
    for name, part in parts.items():
        told = live.notice(part).withColumn("batch", F.lit(name))
        out = told if out is None else out.unionByName(told)
    return out


def _live_sessions(s, d):
    """All sessions, those still open at the newest run too."""
    return _drain(s, live.live_sessions(_stream(s, d)), "sessions", "complete")


def _live_latest(s, d):
    newest = _drain(s, live.latest_runs(_stream(s, d)), "latest", "update", ["player_id"])
    shown = newest.select("player_id", (F.col("newest.id") - (F.col("player_id") % 2 == 0).cast("int")).alias("id"))
    return live.newer_mark(newest, shown)


def _paired(s, d):
    """A file for every run, resets too, some of whose files meet no complete run and are handed out alone."""
    runs = _stream(s, d)
    perfs = runs.select("player_id", F.concat(F.lit("perf-"), F.col("id").cast("string")).alias("perf_stem"), F.date_trunc("second", "started_at").alias("challenge_start"))
    return _drain(s, live.pair_streams(runs.select("player_id", "id", "kind", "started_at", "written_at"), perfs, patience="3 hours"), "pairs", "append")


def _live_form(s, d):
    return _drain(s, live.live_form(_stream(s, d)), "form", "update", ["player_id", "scenario_id"])


def _stored_pace(s, d):
    from .curve_queries import pace, points

    root = _new_folder(s, "curves")
    ingest.write_batch({"curve": points(s, d), "pace": pace(s, d)}, root, 0)
    return ingest.read_table(s, root, "pace")
