"""Queries over run history: views, lists, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lists, sessions, views
from . import bridge as b
from .registry import Query, query


@b.once
def complete(s, d):
    return views.run_complete(b.run(s, d), b.scenario(s, d), b.game_version(s, d), b.run_perf(s, d))


@b.once
def progress(s, d):
    return views.run_progress(complete(s, d))


@b.once
def session(s, d):
    return views.run_session(b.run(s, d))


@b.once
def played(s, d):
    return sessions.played(session(s, d), complete(s, d))


@b.kept_by("run_id")
def killview(s, d):
    return views.kill_rows(b.kill(s, d), b.kill_run(s, d))


def _series(s, d):
    return views.series(b.tick(s, d), b.METRICS)


PLAYED = """SELECT c.*, s.session_id, s.session_first_run_id FROM m_complete c JOIN (SELECT player_id, id, session_id, session_first_run_id
            FROM m_session) s USING (player_id, id)"""
PER = f"""SELECT player_id, session_id, scenario_id, quantile_cont(score, 0.5) AS median, max(score) AS best
          FROM ({PLAYED}) WHERE score IS NOT NULL GROUP BY ALL"""
FORM = f"""SELECT p.*, lag(best) OVER (PARTITION BY player_id, scenario_id ORDER BY session_id) AS prev_best,
             (SELECT quantile_cont(h.score, 0.5) FROM (
                SELECT score FROM ({PLAYED}) r WHERE r.player_id = p.player_id AND r.scenario_id = p.scenario_id
                  AND r.score IS NOT NULL AND r.session_id < p.session_id ORDER BY started_at DESC, id DESC LIMIT 20) h) AS baseline
           FROM ({PER}) p"""
HISTORY = """SELECT p.*, s.session_id, c.sens_scale, c.horiz_sens, c.vert_sens, c.dpi, c.fov, c.fov_scale
             FROM m_progress p JOIN m_config c USING (config_id) JOIN (SELECT player_id, id, session_id FROM m_session) s USING (player_id, id)"""


@b.once
def history(s, d):
    return lists.history(progress(s, d), b.config(s, d), session(s, d))


def _before_last(s, d):
    """A remembered place in each player's list: the run before the newest."""
    return lists.paged(complete(s, d)).where("row_no = 1 + player_id % 2").select("player_id", "written_at", "id")


def _second_page(by, size=20):
    """The page after the first in the longest list; the cursor is what a reader of the first page holds."""

    def frame(s, d):
        rows = lists.page_table(complete(s, d))
        longest = rows.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by).first()
        if longest is None:
            return lists.page(rows, size=size)
        whose = {c: longest[c] for c in by}
        at = lists.cursor(lists.page(rows, size=size, **whose), size)
        return lists.page(rows, size=size, before=at, **whose) if at else lists.page(rows.limit(0), size=size)

    return frame


def _pages_twice(s, d):
    pages = lists.paged(complete(s, d))
    return lists.merge_pages(pages.unionByName(pages.withColumn("page_no", F.col("page_no") + 1)))


def queries() -> list[Query]:
    q: list[Query] = []
    add = lambda *a: q.append(query(*a))

    add("V1_tick", "run_id:i tick_no:i t:d score:d damage_done:d overshots:d deaths:d",
        lambda s, d: views.tick_rows(_series(s, d), b.METRICS),
        "SELECT *, CAST(NULL AS DOUBLE) AS deaths FROM m_tick")
    add("V2_kill", "player_id:i run_id:i ordinal:i bot:s cheated:b accuracy:d efficiency:d t_offset:d", killview,
        "SELECT * EXCLUDE (cheated), is_cheated AS cheated FROM m_killview")
    add("V3_run_complete", "player_id:i id:i scenario_hash:s scenario_name:s game_version:s has_perf:b score:d", complete,
        "SELECT * FROM m_complete")
    add("V4_run_attempt", "player_id:i id:i scenario_id:i kind:s attempt_no:i resets_before:i",
        lambda s, d: views.run_attempt(b.run(s, d)), "SELECT * FROM m_attempt")
    add("V5_run_progress", "player_id:i id:i completion_no:i prev_score:d pb_before:d best_so_far:d config_changed:b", progress,
        "SELECT * FROM m_progress")
    add("V6_run_session", "player_id:i id:i scenario_id:i kind:s session_id:i position_in_session:i", session,
        "SELECT * FROM m_session")

    # ------------------------------------------------------------ lists
    hist = "player_id:i id:i prev_score:d pb_before:d"
    past = """SELECT c.*, (SELECT arg_max(p.score, struct_pack(a := p.started_at, b := p.id)) FROM m_complete p WHERE p.player_id = c.player_id
                AND p.scenario_id = c.scenario_id AND p.score IS NOT NULL AND (p.started_at, p.id) < (c.started_at, c.id)) AS prev_score,
               (SELECT max(p.score) FROM m_complete p WHERE p.player_id = c.player_id
                AND p.scenario_id = c.scenario_id AND (p.started_at, p.id) < (c.started_at, c.id)) AS pb_before FROM m_complete c"""
    add("L1_attempts_page", "id:i file_stem:s scenario_id:i score:d has_perf:b sens_scale:s horiz_sens:d prev_score:d pb_before:d session_first_run_id:i row_no:i ahead:b",
        lambda s, d: lists.attempts_page(complete(s, d), b.config(s, d), session(s, d)),
        f"""SELECT p.*, c.sens_scale, c.horiz_sens, s.session_first_run_id, row_no > 50 AS ahead
            FROM (SELECT *, row_number() OVER (ORDER BY written_at DESC, id DESC) AS row_no FROM ({past})) p
            JOIN m_config c USING (config_id) JOIN (SELECT player_id, id, session_first_run_id FROM m_session) s USING (player_id, id)
            WHERE row_no <= 51""")
    for name, by in (("L1_page_by_cursor", ["player_id"]), ("L1_scenario_page_by_cursor", ["player_id", "scenario_id"])):
        add(name, "id:i file_stem:s player_id:i scenario_id:i score:d written_at:t row_no:i ahead:b", _second_page(by),
            f"""SELECT * EXCLUDE (row_no), row_no - 20 AS row_no, row_no > 40 AS ahead FROM (SELECT *, row_number() OVER (ORDER BY written_at DESC, id DESC) AS row_no FROM m_complete
                JOIN (SELECT {", ".join(by)} FROM m_complete GROUP BY ALL ORDER BY count(*) DESC, {", ".join(by)} LIMIT 1) USING ({", ".join(by)})) WHERE row_no BETWEEN 21 AND 41""")
    add("L2_previous_score", "player_id:i id:i prev_score:d", lambda s, d: lists.with_history(complete(s, d)), past)
    add("L3_best_before", "player_id:i id:i pb_before:d", lambda s, d: lists.with_history(complete(s, d)), past)
    add("L4_session_name", "player_id:i id:i session_first_run_id:i", session, "SELECT * FROM m_session")
    add("L5_starts_session", "player_id:i id:i is_start:b", lambda s, d: views.starts_session(b.run(s, d)),
        """SELECT x.player_id, x.id, NOT EXISTS (SELECT 1 FROM m_run y WHERE y.player_id = x.player_id
             AND y.written_at >= x.written_at - INTERVAL 30 MINUTE AND (y.written_at, y.id) < (x.written_at, x.id)) AS is_start
           FROM m_run x""")
    add("L6_pages_as_list", "player_id:i file_stem:s page_no:i", _pages_twice,
        """SELECT player_id, file_stem, (row_number() OVER (PARTITION BY player_id ORDER BY written_at DESC, id DESC) - 1) // 50 AS page_no
           FROM m_complete""")
    add("L7_run_by_stem", "player_id:i id:i file_stem:s score:d",
        lambda s, d: lists.rows_by_key(complete(s, d), lists.latest_run(complete(s, d), ["player_id"]), "file_stem"),
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY written_at DESC, id DESC) AS n FROM m_complete) WHERE n = 1")
    add("L8_latest_run", "player_id:i scenario_id:i id:i file_stem:s score:d",
        lambda s, d: lists.latest_run(complete(s, d), ["player_id", "scenario_id"]),
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id, scenario_id ORDER BY written_at DESC, id DESC) AS n FROM m_complete) WHERE n = 1")
    add("L9_played_scenarios", "scenario_id:i hash:s name:s", lambda s, d: lists.played_scenarios(b.scenario(s, d), complete(s, d)),
        "SELECT * FROM m_scenario WHERE scenario_id IN (SELECT scenario_id FROM m_complete)")
    add("L10_scenario_runs", "player_id:i scenario_id:i place:i id:i file_stem:s score:d started_at:t has_perf:b",
        lambda s, d: progress(s, d).withColumn("place", F.col("completion_no")),
        "SELECT *, completion_no AS place FROM m_progress")
    add("L11_scenario_by_hash", "scenario_id:i name:s hash:s",
        lambda s, d: lists.rows_by_key(b.scenario(s, d), complete(s, d).withColumnRenamed("scenario_hash", "hash"), "hash"),
        "SELECT * FROM m_scenario WHERE hash IN (SELECT scenario_hash FROM m_complete)")
    vers = """SELECT *, hash = arg_max(hash, struct_pack(a := last_played, b := hash)) OVER (PARTITION BY player_id, trimmed) AS is_newest FROM (
              SELECT c.player_id, c.scenario_id, s.hash, s.trimmed, count(*) AS runs, max(started_at) AS last_played
              FROM m_complete c JOIN m_scenario s USING (scenario_id) GROUP BY ALL)"""
    add("L12_versions", "player_id:i scenario_id:i hash:s runs:i last_played:t", lambda s, d: lists.versions(b.scenario(s, d), complete(s, d)), vers)
    add("L13_history", "player_id:i id:i file_stem:s score:d started_at:t duration_s:d has_perf:b pb_before:d session_id:i sens_scale:s horiz_sens:d vert_sens:d dpi:d fov:d fov_scale:s",
        history, HISTORY)
    add("L14_directory", "player_id:i scenario_id:i scenario_name:s runs:i pb:d last_played:t place:i score:d",
        lambda s, d: lists.directory(complete(s, d)).select("*", F.posexplode_outer("recent").alias("place", "score")),
        """SELECT a.*, r.n - 1 AS place, r.score FROM (SELECT player_id, scenario_id, scenario_name, scenario_hash, count(*) AS runs,
             max(score) AS pb, max(started_at) AS last_played FROM m_complete GROUP BY ALL) a
           LEFT JOIN (SELECT player_id, scenario_id, score, row_number() OVER (PARTITION BY player_id, scenario_id ORDER BY started_at DESC, id DESC) AS n
             FROM m_complete WHERE score IS NOT NULL) r ON r.player_id = a.player_id AND r.scenario_id = a.scenario_id AND r.n <= 10""")
    add("L15_rank_stream", "player_id:i scenario_id:i scenario_name:s hash:s id:i t:t score:d",
        lambda s, d: lists.rank_stream(b.run(s, d), b.scenario(s, d), b.ladder(s, d)),
        """SELECT player_id, scenario_id, trimmed_name AS scenario_name, scenario_hash AS hash, id, started_at AS t, score FROM m_complete
           WHERE score IS NOT NULL AND trimmed_name IN (SELECT scenario_name FROM m_ladder)""")
    add("L16_played_bests", "player_id:i scenario_name:s pb:d last:t", lambda s, d: lists.played_bests(b.run(s, d), b.scenario(s, d)),
        """SELECT player_id, trimmed_name AS scenario_name, max(score) AS pb, max(started_at) AS last FROM m_complete WHERE score IS NOT NULL GROUP BY ALL""")
    add("L17_run_link", "id:i file_stem:s hash:s",
        lambda s, d: b.run(s, d).join(b.scenario(s, d), "scenario_id"), "SELECT * FROM m_run JOIN m_scenario USING (scenario_id)")
    add("L18_has_runs", "has_runs:b", lambda s, d: lists.has_runs(complete(s, d)), "SELECT count(*) > 0 AS has_runs FROM m_complete")
    add("L19_newer_run", "player_id:i newer:b", lambda s, d: lists.newer_than(complete(s, d), _before_last(s, d)),
        "SELECT DISTINCT player_id, player_id % 2 = 1 AS newer FROM m_complete")
    add("L20_most_played_with_kills", "scenario_id:i runs:i",
        lambda s, d: lists.most_played_with_kills(b.kill_run(s, d), b.kill(s, d)),
        """SELECT scenario_id, count(*) AS runs FROM m_duel WHERE id IN (SELECT l_orderkey FROM lineitem) GROUP BY 1
           ORDER BY runs DESC, scenario_id LIMIT 5""")
    add("S6_read_by_key", "player_id:i id:i score:d",
        lambda s, d: lists.rows_by_key(b.run(s, d), b.run_perf(s, d).withColumnRenamed("run_id", "id"), "id"),
        "SELECT * FROM m_run WHERE perf_landed")

    # ------------------------------------------------------------ sessions
    add("H1_session_edges", "player_id:i session_id:i start:t first_run_id:i next_start:t", lambda s, d: sessions.edges(session(s, d)),
        """SELECT *, lead(start) OVER (PARTITION BY player_id ORDER BY session_id) AS next_start FROM (
             SELECT player_id, session_id, min(written_at) AS start, min(session_first_run_id) AS first_run_id FROM m_session GROUP BY ALL)""")
    add("H2_session_runs", "player_id:i session_id:i id:i scenario_id:i score:d", played, PLAYED)
    add("H3_session_bounds", "player_id:i session_id:i started_at:t ended_at:t runs:i", lambda s, d: sessions.bounds(played(s, d)),
        f"SELECT player_id, session_id, min(started_at) AS started_at, max(written_at) AS ended_at, count(*) AS runs FROM ({PLAYED}) GROUP BY ALL")
    add("H4_session_scenarios", "player_id:i session_id:i scenario_id:i median:d best:d", lambda s, d: sessions.per_scenario(played(s, d)), PER)
    form = lambda s, d: sessions.form(played(s, d))
    add("H5_form_baseline", "player_id:i session_id:i scenario_id:i median:d baseline:d", form, FORM)
    add("H6_previous_session_best", "player_id:i session_id:i scenario_id:i best:d prev_best:d", form, FORM)
    add("H7_session_change", "player_id:i session_id:i change:d", lambda s, d: sessions.change(form(s, d)),
        f"SELECT player_id, session_id, avg(CASE WHEN baseline > 0 THEN (median - baseline) / baseline END) AS change FROM ({FORM}) GROUP BY ALL")
    add("H8_row_change", "player_id:i id:i delta:d is_pb:b", lambda s, d: sessions.row_change(lists.with_history(complete(s, d))),
        f"SELECT *, score - prev_score AS delta, coalesce(score > pb_before, false) AS is_pb FROM ({past})")
    add("H9_list_groups", "player_id:i id:i group_no:i", lambda s, d: sessions.list_groups(played(s, d)),
        f"SELECT *, dense_rank() OVER (PARTITION BY player_id ORDER BY session_id DESC) AS group_no FROM ({PLAYED})")
    add("H10_session_line", "player_id:i session_id:i scenario_id:i best:d delta:d", lambda s, d: sessions.session_line(form(s, d)),
        f"SELECT *, best - prev_best AS delta FROM ({FORM})")
    add("H11_session_breaks", "player_id:i id:i is_break:b session_no:i", lambda s, d: sessions.breaks(history(s, d)),
        f"""SELECT *, coalesce(was <> session_id, false) AS is_break, dense_rank() OVER (PARTITION BY player_id, scenario_id ORDER BY session_id) AS session_no
            FROM (SELECT *, lag(session_id) OVER (PARTITION BY player_id, scenario_id ORDER BY started_at, id) AS was FROM ({HISTORY}))""")
    add("H12_position_effect", "player_id:i position_in_session:i normalised:d",
        lambda s, d: sessions.position_effect(session(s, d), complete(s, d)),
        """SELECT s.player_id, s.position_in_session, avg(c.score / nullif(b.p50, 0)) AS normalised FROM m_session s JOIN m_complete c USING (player_id, id)
           JOIN (SELECT player_id, scenario_id, quantile_cont(score, 0.5) AS p50 FROM m_complete GROUP BY ALL) b
             ON b.player_id = c.player_id AND b.scenario_id = c.scenario_id GROUP BY ALL""")
    add("F5_newest_version", "player_id:i hash:s is_newest:b", lambda s, d: lists.versions(b.scenario(s, d), complete(s, d)), vers)
    return q
