"""Queries over the quality rules, on model tables in which every rule is broken somewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins, quality
from . import bridge as b
from .registry import Query, query


@b.once
def dirty_run(s, d) -> DataFrame:
    k, done = F.col("hits"), F.col("kind") == "complete"
    late = done & (k == 96)
    return (
        b.run(s, d)
        .withColumn("duration_s", F.when(~(done & (k == 98)), F.col("duration_s")))
        .withColumn("start_ms", F.when(~done & (k == 97), F.lit(0)).otherwise(F.col("start_ms")))
        .withColumn("written_at", F.when(late, F.col("started_at")).otherwise(F.col("written_at")))
        .withColumn("avg_fps", F.when(~done & (k == 95), F.lit(60.0)).otherwise(F.col("avg_fps")))
        .withColumn("shots", F.col("shots") + (k == 94).cast("int"))
    )


@b.once
def dirty_perf(s, d) -> DataFrame:
    run = b.run(s, d)
    cols = ["player_id", F.col("id").alias("run_id"), F.concat(F.lit("perf-"), F.col("id").cast("string")).alias("perf_stem")]
    loose = run.where("kind = 'reset' AND hits = 93").select(*cols)
    twice = run.where("perf_landed AND hits = 92").select("player_id", F.col("id").alias("run_id"), F.lit("perf-again").alias("perf_stem"))
    return b.run_perf(s, d).unionByName(loose).unionByName(twice)


@b.once
def perf_file(s, d) -> DataFrame:
    """A performance file per order run, stamped with the whole second it started; some on a wrong day or scenario."""
    key = F.col("id")
    start = F.col("started_at") + F.when(key % 41 == 0, F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 0 DAY"))
    return b.kill_run(s, d).select(
        "player_id", F.concat(F.lit("perf-"), key.cast("string")).alias("perf_stem"), start.alias("challenge_start"),
        F.when(key % 43 == 0, F.lit(99)).otherwise(F.col("scenario_id")).alias("perf_hash"),
    )


@b.once
def matches(s, d) -> DataFrame:
    runs = b.kill_run(s, d).select("player_id", F.col("id").alias("run_id"), F.col("scenario_id").alias("run_hash"), "started_at", "written_at")
    return joins.overlap_join(perf_file(s, d), runs, ["player_id"], "challenge_start", "started_at", "written_at")


def _arrays(s, d) -> DataFrame:
    """Raw parallel arrays, one cut short in every fiftieth run."""
    from ..operators import views

    made = views.series(b.tick(s, d), ["score", "kills"]).withColumn("t", F.transform("ticks", lambda x: x["t"]))
    score = F.transform("ticks", lambda x: x["score"])
    short = F.slice(score, 1, F.greatest(F.size("ticks") - 1, F.lit(0)))
    return made.select("run_id", "t", F.when(F.col("run_id") % 50 == 0, short).otherwise(score).alias("score"),
                       F.transform("ticks", lambda x: x["kills"]).alias("kills"))


def _totals(s, d) -> DataFrame:
    sums = {"shots_fired": F.sum("shots"), "shots_hit": F.sum("hits"), "shots_missed": F.sum(F.col("shots") - F.col("hits")),
            "kills": F.count(F.lit(1)), "damage_possible": 1200.0 * F.count(F.lit(1))}
    made = b.kill(s, d).groupBy("run_id").agg(*(c.cast("double").alias(n) for n, c in sums.items()))
    return made.withColumn("shots_fired", F.col("shots_fired") + (F.col("run_id") % 37 == 0).cast("int")).withColumn(
        "damage_possible", F.col("damage_possible") + (F.col("run_id") % 3) / 10)


def _numbered(s, d):
    kills = b.kill(s, d).withColumn("index", F.when(F.col("run_id") % 39 == 0, 0).otherwise(F.col("ordinal") + 1))
    totals = kills.groupBy("run_id").agg(
        F.when(F.col("run_id") % 39 == 0, 0).otherwise(F.count(F.lit(1)) + (F.col("run_id") % 47 == 0).cast("int")).alias("kill_count"),
        (F.sum("hits") + (F.col("run_id") % 53 == 0).cast("int")).alias("hit_count"),
    )
    weapons = kills.groupBy("run_id", "weapon").agg(F.sum("hits").alias("hits"))
    return quality.kills_numbered(kills, totals, weapons)


def _closed(s, d):
    """Ticks with a closing overshoot that takes the rest back, missing in every thirteenth run."""
    ticks = b.tick(s, d).select("run_id", "overshots")
    closer = ticks.groupBy("run_id").agg((-F.sum("overshots")).alias("overshots")).where("overshots IS NOT NULL AND run_id % 13 <> 0")
    return quality.overshoot_closed(ticks.unionByName(closer))


DIRTY = """SELECT * REPLACE (CASE WHEN NOT (kind = 'complete' AND hits = 98) THEN duration_s END AS duration_s,
             CASE WHEN kind <> 'complete' AND hits = 97 THEN 0 ELSE start_ms END AS start_ms,
             CASE WHEN kind = 'complete' AND hits = 96 THEN started_at ELSE written_at END AS written_at,
             CASE WHEN kind <> 'complete' AND hits = 95 THEN 60.0 ELSE avg_fps END AS avg_fps,
             shots + CASE WHEN hits = 94 THEN 1 ELSE 0 END AS shots) FROM m_run"""
PERFS = """SELECT player_id, id AS run_id, 'perf-' || id AS perf_stem FROM m_run WHERE perf_landed OR (kind = 'reset' AND hits = 93)
           UNION ALL SELECT player_id, id, 'perf-again' FROM m_run WHERE perf_landed AND hits = 92"""
FILES = """SELECT player_id, 'perf-' || id AS perf_stem, started_at + CASE WHEN id % 41 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS challenge_start,
             CASE WHEN id % 43 = 0 THEN 99 ELSE scenario_id END AS perf_hash FROM m_duel"""
MATCHES = f"""SELECT p.*, r.id AS run_id, r.scenario_id AS run_hash FROM ({FILES}) p JOIN m_duel r ON r.player_id = p.player_id
              AND r.started_at < p.challenge_start + INTERVAL 1 SECOND AND r.written_at > p.challenge_start"""


def _rule(rule, source, key, detail, rest):
    return f"SELECT '{rule}' AS rule, '{source}' AS source, CAST({key} AS VARCHAR) AS key, CAST({detail} AS VARCHAR) AS detail {rest}"


def queries() -> list[Query]:
    q: list[Query] = []
    cols = "rule:s source:s key:s detail:s"
    add = lambda name, build, sql, columns=cols: q.append(query(name, columns, build, sql))

    add("Q1_complete_has_times", lambda s, d: quality.complete_has_times(dirty_run(s, d)),
        _rule("complete has start and duration", "run", "id", "kind", f"""FROM ({DIRTY}) WHERE (kind = 'complete') <> (started_at IS NOT NULL)
              OR (kind = 'complete') <> (start_ms IS NOT NULL) OR (kind = 'complete') <> (duration_s IS NOT NULL)"""))
    add("Q2_ends_after_start", lambda s, d: quality.ends_after_start(dirty_run(s, d)),
        _rule("ends after it starts", "run", "id", "kind", f"FROM ({DIRTY}) WHERE kind = 'complete' AND written_at <= started_at"))
    add("Q3_fps_only_complete", lambda s, d: quality.fps_only_complete(dirty_run(s, d)),
        _rule("frame rate only when complete", "run", "id", "kind", f"FROM ({DIRTY}) WHERE kind <> 'complete' AND avg_fps IS NOT NULL"))
    add("Q4_shots_add_up", lambda s, d: quality.shots_add_up(dirty_run(s, d)),
        _rule("shots are hits and misses", "run", "id", "shots - hits - misses", f"FROM ({DIRTY}) WHERE shots <> hits + misses"))
    add("Q5_no_overlap", lambda s, d: quality.no_overlap(dirty_run(s, d)),
        _rule("runs do not overlap", "run", "a.id", "a.player_id", f"""FROM (SELECT * FROM ({DIRTY}) WHERE kind = 'complete') a WHERE EXISTS (
              SELECT 1 FROM ({DIRTY}) b WHERE b.kind = 'complete' AND b.player_id = a.player_id AND (b.started_at, b.id) < (a.started_at, a.id)
                AND b.written_at > a.started_at)"""))
    add("Q6_perf_belongs", lambda s, d: quality.perf_belongs(dirty_perf(s, d), dirty_run(s, d)),
        _rule("performance of a complete run", "run_perf", "run_id", "NULL", f"FROM ({PERFS}) WHERE run_id NOT IN (SELECT id FROM m_complete)") + " UNION ALL " +
        _rule("one performance per run", "run_perf", "run_id", "n", f"FROM (SELECT run_id, count(*) AS n FROM ({PERFS}) GROUP BY 1 HAVING count(*) > 1)"))
    add("Q7_arrays_aligned", lambda s, d: quality.arrays_aligned(_arrays(s, d), "t", ["score", "kills"]),
        _rule("arrays are aligned", "series", "run_id", "'score'", "FROM (SELECT DISTINCT run_id FROM m_tick WHERE run_id % 50 = 0)"))
    add("Q8_names_trimmed", lambda s, d: quality.names_trimmed(b.scenario(s, d), "scenario"),
        _rule("name is trimmed and not empty", "scenario", "name", "len(name)", "FROM m_scenario WHERE name <> trimmed"))
    add("Q9_unique_key", lambda s, d: quality.violations(
            quality.unique_key(b.run(s, d), "run", ["file_stem"]),
            quality.unique_key(b.table(s, d, "lineitem"), "line", ["l_orderkey", "l_linenumber"])),
        _rule("natural key is unique", "line", "l_orderkey || '|' || l_linenumber", "n", """FROM (SELECT l_orderkey, l_linenumber, count(*) AS n
              FROM lineitem GROUP BY ALL HAVING count(*) > 1)""") + " UNION ALL " +
        _rule("natural key is unique", "run", "file_stem", "n", "FROM (SELECT file_stem, count(*) AS n FROM m_run GROUP BY ALL HAVING count(*) > 1)"))
    add("I30_overlap_join", matches, MATCHES, "player_id:i perf_stem:s run_id:i perf_hash:i run_hash:i")
    add("Q10_perf_match_count", lambda s, d: quality.perf_match_count(matches(s, d), perf_file(s, d)),
        _rule("performance matches one run", "perf", "perf_stem", "n", f"""FROM (SELECT p.perf_stem, count(m.run_id) AS n FROM ({FILES}) p
              LEFT JOIN ({MATCHES}) m USING (player_id, perf_stem) GROUP BY 1) WHERE n <> 1"""))
    add("Q11_orphan_perf", lambda s, d: quality.orphan_perf(perf_file(s, d), matches(s, d)),
        _rule("performance has landed", "perf", "perf_stem", "NULL", f"FROM ({FILES}) WHERE perf_stem NOT IN (SELECT perf_stem FROM ({MATCHES}))"))
    add("Q12_perf_same_scenario", lambda s, d: quality.perf_same_scenario(matches(s, d)),
        _rule("performance and run share a scenario", "perf", "perf_stem", "perf_hash", f"FROM ({MATCHES}) WHERE perf_hash <> run_hash"))
    add("Q13_sums_reconcile", lambda s, d: quality.sums_reconcile(
            b.tick(s, d), _totals(s, d), ["shots_fired", "shots_hit", "shots_missed", "kills"], ["damage_possible"]),
        _rule("ticks add up to the totals", "tick", "run_id", "'shots_fired'", "FROM (SELECT DISTINCT run_id FROM m_tick WHERE run_id % 37 = 0)") + " UNION ALL " +
        _rule("ticks add up to the totals", "tick", "run_id", "'damage_possible'", """FROM (SELECT run_id, count(*) * 1200.0 AS p FROM m_tick GROUP BY 1)
              WHERE CAST(run_id % 3 AS DOUBLE) / 10 > greatest(0.01, 1e-4 * (p + CAST(run_id % 3 AS DOUBLE) / 10))"""))
    add("Q14_kills_numbered", _numbered,
        _rule("kills are numbered and counted", "kill", "run_id", "n", """FROM (SELECT run_id, count(*) AS n FROM m_kill GROUP BY 1)
              WHERE run_id % 39 <> 0 AND run_id % 47 = 0""") + " UNION ALL " +
        _rule("weapon hits are the hits", "run_weapon", "run_id", "n", "FROM (SELECT run_id, sum(hits) AS n FROM m_kill GROUP BY 1) WHERE run_id % 53 = 0"))
    add("Q15_overshoot_closed", _closed,
        _rule("overshoots are taken back once", "tick", "run_id", "'0|' || CAST(n AS INTEGER)", """FROM (SELECT run_id, sum(overshots) AS n FROM m_tick GROUP BY 1)
              WHERE n IS NOT NULL AND run_id % 13 = 0"""))
    add("Q16_ticks_ascend", lambda s, d: quality.ticks_ascend(b.tick(s, d), b.header(s, d)),
        _rule("last tick is near the limit", "tick", "run_id", "NULL", """FROM m_header JOIN (SELECT run_id, max(t) AS e FROM m_tick GROUP BY 1) USING (run_id)
              WHERE end_after_kills IS NULL AND end_after_damage IS NULL AND time_limit < 1000 AND abs(time_limit / coalesce(timescale, 1) - e) > 2"""))
    add("Q17_one_run_per_second", lambda s, d: quality.one_run_per_second(b.run(s, d)),
        _rule("one run written per second", "run", "player_id || '|' || strftime(second, '%Y-%m-%d %H:%M:%S')", "n", """FROM (SELECT player_id,
              date_trunc('second', written_at) AS second, count(*) AS n FROM m_run GROUP BY ALL HAVING count(*) > 1)"""))
    add("Q18_ownership", lambda s, d: quality.ownership(b.run(s, d), dirty_perf(s, d)),
        f"""SELECT 'stats_only' AS what, count(*) AS n FROM m_complete WHERE id NOT IN (SELECT run_id FROM ({PERFS}))
            UNION ALL SELECT 'orphan', count(*) FROM ({PERFS}) WHERE run_id NOT IN (SELECT id FROM m_complete)
            UNION ALL SELECT 'multi', count(*) FROM (SELECT player_id, perf_stem FROM ({PERFS}) GROUP BY ALL HAVING count(*) > 1)""", "what:s n:i")
    add("I36_key_audit", lambda s, d: quality.key_audit(b.run(s, d), {
            "stem": F.col("file_stem"), "score": F.concat_ws("|", "player_id", "scenario_id", F.col("score").cast("string")),
            "second": F.concat_ws("|", "player_id", F.date_format("written_at", "yyyy-MM-dd HH:mm:ss"))}),
        """WITH k AS (SELECT 'stem' AS key, file_stem AS value FROM m_run
                      UNION ALL SELECT 'score', concat_ws('|', player_id, scenario_id, CAST(score AS VARCHAR)) FROM m_run
                      UNION ALL SELECT 'second', concat_ws('|', player_id, strftime(written_at, '%Y-%m-%d %H:%M:%S')) FROM m_run)
           SELECT key, count(DISTINCT value) AS "distinct", count(*) - count(DISTINCT value) AS collisions FROM k GROUP BY 1""", "key:s distinct:i collisions:i")
    add("I35_content_join", lambda s, d: joins.content_join(_perf_sums(s, d), _run_sums(s, d)),
        """SELECT p.id AS perf_id, r.id AS run_id FROM m_duel p JOIN m_duel r ON r.scenario_id = p.scenario_id AND r.player_id = p.player_id
             AND abs(epoch(r.written_at) - epoch(p.started_at)) <= 86400
           JOIN (SELECT run_id, sum(shots) AS s, sum(hits) AS h FROM m_kill GROUP BY 1) a ON a.run_id = p.id
           JOIN (SELECT run_id, sum(shots) AS s, sum(hits) AS h FROM m_kill GROUP BY 1) b ON b.run_id = r.id WHERE a.s = b.s AND a.h = b.h""", "perf_id:i run_id:i")
    return q


def _sums(s, d):
    sums = b.kill(s, d).groupBy(F.col("run_id").alias("id")).agg(F.sum("shots").alias("shots"), F.sum("hits").alias("hits"))
    return b.kill_run(s, d).join(sums, "id")


def _perf_sums(s, d):
    return _sums(s, d).select("player_id", F.col("id").alias("perf_id"), F.col("scenario_id").alias("hash"), "shots", "hits", F.col("started_at").alias("at"))


def _run_sums(s, d):
    return _sums(s, d).select("player_id", F.col("id").alias("run_id"), F.col("scenario_id").alias("hash"), "shots", "hits", "written_at")
