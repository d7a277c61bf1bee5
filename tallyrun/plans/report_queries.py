"""Queries over distributions, progression, ladders and rank composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ladder as rank
from ..functions import numbers, text
from ..operators import composite, ladders, lists, progression, reports, scan, views
from . import bridge as b
from .history_queries import HISTORY, complete, history, killview, progress
from .registry import Query, query
from .tables_sql import fractional, shifted_mean

NOW = "TIMESTAMP '2024-02-15 00:00:00'"


@b.once
def candidates(s, d):
    return ladders.candidates(b.ladder(s, d), b.benchmark(s, d))


def _picks(s, d):
    """Stored choices: every third scenario's number as a benchmark id, some no longer valid, and explicit none."""
    n = F.col("n_nationkey")
    return b.table(s, d, "nation").where(n < 8).select(
        F.concat(F.lit("Strafe "), n.cast("string")).alias("scenario_name"),
        F.when(n % 2 == 0, n % 5).cast("bigint").alias("stored_id"),
        (n == 5).alias("is_none"),
    )


@b.once
def picked(s, d, preferred=None):
    return ladders.pick(candidates(s, d), _picks(s, d), preferred)


PICKED = """SELECT * FROM (SELECT l.*, row_number() OVER (PARTITION BY scenario_name ORDER BY
              CASE WHEN l.benchmark_id = {0} THEN 0 WHEN l.benchmark_id = p.stored_id THEN 1 ELSE 2 END, candidate_order) AS n, p.is_none
            FROM m_ladder l JOIN (SELECT 'Strafe ' || n_nationkey AS scenario_name, n_nationkey = 5 AS is_none,
              CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey % 5 END AS stored_id FROM nation WHERE n_nationkey < 8) p USING (scenario_name)
            WHERE NOT p.is_none OR l.benchmark_id = {0}) WHERE n = 1"""


@b.kept_table
def nodes(s, d):
    return composite.tree(b.tree_slot(s, d), b.ladder(s, d))


@b.once
def stream(s, d):
    return lists.rank_stream(b.run(s, d), b.scenario(s, d), b.tree_slot(s, d))


@b.once
def events(s, d):
    return composite.events(stream(s, d), nodes(s, d))


@b.once
def hot(s, d):
    return scan.hot_groups(b.run(s, d).withColumnRenamed("started_at", "t"), ["player_id"], "t")


@b.once
def as_of(s, d):
    return composite.as_of_ranks(events(s, d), hot=hot(s, d))


@b.once
def values(s, d, mode):
    return composite.history(as_of(s, d), mode, hot(s, d))


@b.once
def bests(s, d):
    return lists.played_bests(b.run(s, d), b.scenario(s, d))


@b.once
def spreads(s, d):
    return composite.spread(events(s, d))


@b.once
def directory(s, d):
    return progression.directory_rows(lists.directory(complete(s, d)))


@b.once
def pb_rank_values(s, d):
    joined = bests(s, d).join(nodes(s, d).where("rated"), "scenario_name")
    r = rank.fractional_rank(F.col("thresholds"), F.col("pb")).alias("r")
    return joined.select("player_id", "benchmark_id", "scenario_name", r).distinct()


def _tree_sql(mode, source, by="", value="r"):
    """Direct evaluation of the tree: ``source`` has player_id, benchmark_id, by..., scenario_name, value."""
    keys = f"player_id, benchmark_id{by}"
    if mode == "strict":
        base = f"""SELECT a.*, n.cat_no, n.sub_no, coalesce(x.{value}, 0) AS v FROM (SELECT DISTINCT {keys} FROM ({source})) a
                   JOIN m_tree n USING (benchmark_id) LEFT JOIN ({source}) x USING ({keys}, scenario_name) WHERE n.rated"""
    else:
        base = f"""SELECT x.*, n.cat_no, n.sub_no, x.{value} AS v FROM ({source}) x JOIN m_tree n USING (benchmark_id, scenario_name)
                   WHERE n.rated AND x.{value} IS NOT NULL"""
    sub = f"SELECT {keys}, cat_no, sub_no, avg(v) AS value FROM ({base}) GROUP BY {keys}, cat_no, sub_no"
    cat = f"SELECT {keys}, cat_no, {shifted_mean('value')} AS value FROM ({sub}) GROUP BY {keys}, cat_no"
    top = f"SELECT {keys}, {shifted_mean('value')} AS value FROM ({cat}) GROUP BY {keys}"
    return f"""SELECT {keys}, 'overall' AS level, 0 AS node_no, value FROM ({top})
               UNION ALL SELECT {keys}, 'category', cat_no, value FROM ({cat})
               UNION ALL SELECT {keys}, 'subcategory', sub_no, value FROM ({sub})"""


INSIDE = """SELECT DISTINCT benchmark_id, 'overall' AS level, 0 AS node_no, scenario_name FROM m_tree WHERE rated
            UNION SELECT benchmark_id, 'category', cat_no, scenario_name FROM m_tree WHERE rated
            UNION SELECT benchmark_id, 'subcategory', sub_no, scenario_name FROM m_tree WHERE rated"""


def _history_sql(mode):
    pb = _tree_sql(mode, "SELECT player_id, benchmark_id, ord, scenario_name, r_pb FROM m_asof", ", ord", "r_pb")
    form = _tree_sql(mode, "SELECT player_id, benchmark_id, ord, scenario_name, r_form FROM m_asof", ", ord", "r_form")
    return f"""SELECT e.player_id, e.benchmark_id, i.level, i.node_no, e.t, e.id, p.value AS pb, f.value AS form, e.ord
               FROM m_event e JOIN ({INSIDE}) i ON i.benchmark_id = e.benchmark_id AND i.scenario_name = e.scenario_name
               JOIN ({pb}) p ON p.player_id = e.player_id AND p.benchmark_id = e.benchmark_id AND p.ord = e.ord AND p.level = i.level AND p.node_no = i.node_no
               JOIN ({form}) f ON f.player_id = e.player_id AND f.benchmark_id = e.benchmark_id AND f.ord = e.ord AND f.level = i.level AND f.node_no = i.node_no"""


BEST_RANKS = f"""SELECT DISTINCT player_id, benchmark_id, scenario_name, {fractional('thresholds', 'pb')} AS r FROM
                 (SELECT player_id, trimmed_name AS scenario_name, max(score) AS pb FROM m_complete WHERE score IS NOT NULL GROUP BY ALL)
                 JOIN m_ladder USING (scenario_name)"""

SPREAD = """SELECT r.*, p.pb FROM (SELECT player_id, benchmark_id, scenario_name, any_value(thresholds) AS thresholds, count(*) AS runs,
              max(t) AS last, min(score) AS worst, quantile_cont(score, 0.1) AS p10, quantile_cont(score, 0.5) AS median,
              quantile_cont(score, 0.9) AS p90 FROM (SELECT *, row_number() OVER (PARTITION BY player_id, benchmark_id, scenario_name
                ORDER BY t DESC, id DESC) AS n FROM m_event) WHERE n <= 10 GROUP BY ALL) r
            JOIN (SELECT player_id, benchmark_id, scenario_name, max(score) AS pb FROM m_event GROUP BY ALL) p
            USING (player_id, benchmark_id, scenario_name)"""
SPREAD_R = f"""SELECT *, {', '.join(fractional('thresholds', x) + ' AS r_' + x for x in composite.STATS)} FROM ({SPREAD})"""

COVER = """SELECT b.player_id, n.benchmark_id, count(DISTINCT n.scenario_name) AS scenarios_played, count(DISTINCT n.sub_no) AS subs_played,
             count(DISTINCT n.cat_no) AS categories_played FROM (SELECT DISTINCT player_id, trimmed_name AS scenario_name FROM m_complete
             WHERE score IS NOT NULL) b JOIN m_tree n USING (scenario_name) WHERE n.rated GROUP BY ALL"""
TOTALS = """SELECT benchmark_id, count(DISTINCT scenario_name) FILTER (WHERE rated) AS scenarios, count(DISTINCT sub_no) FILTER (WHERE rated) AS subs,
              count(DISTINCT cat_no) FILTER (WHERE rated) AS categories FROM m_tree GROUP BY 1"""


def _index_sql(mode):
    return f"""SELECT l.player_id, l.benchmark_id, m.name, m.difficulty, coalesce(c.scenarios_played, 0) AS played, t.scenarios AS total, r.value AS r, l.last,
                      coalesce(c.scenarios_played / t.scenarios, 0) AS share, m.position
               FROM (SELECT player_id, benchmark_id, max(last) AS last FROM (SELECT player_id, trimmed_name AS scenario_name, max(started_at) AS last
                       FROM m_complete WHERE score IS NOT NULL GROUP BY ALL) JOIN m_tree USING (scenario_name) GROUP BY ALL) l
               LEFT JOIN ({COVER}) c USING (player_id, benchmark_id) JOIN ({TOTALS}) t USING (benchmark_id) JOIN m_benchmark m USING (benchmark_id)
               LEFT JOIN (SELECT * FROM ({_tree_sql(mode, BEST_RANKS)}) WHERE level = 'overall') r
                 ON r.player_id = l.player_id AND r.benchmark_id = l.benchmark_id"""


DIRECTORY = """SELECT *, CASE WHEN count(*) OVER (PARTITION BY player_id, scenario_name) > 1 THEN left(scenario_hash, 8) END AS tag,
                 coalesce(len, 0) >= 10 AS full, CASE WHEN pb <> 0 THEN (median - pb) / abs(pb) END AS gap FROM (
                 SELECT a.*, r.median, r.len FROM (SELECT player_id, scenario_id, scenario_name, trimmed_name, scenario_hash, count(*) AS runs,
                   max(score) AS pb, max(started_at) AS last_played FROM m_complete GROUP BY ALL) a
                 LEFT JOIN (SELECT player_id, scenario_id, quantile_cont(score, 0.5) AS median, count(*) AS len FROM (
                   SELECT *, row_number() OVER (PARTITION BY player_id, scenario_id ORDER BY started_at DESC, id DESC) AS n FROM m_complete
                   WHERE score IS NOT NULL) WHERE n <= 10 GROUP BY ALL) r USING (player_id, scenario_id))"""


def queries() -> list[Query]:
    q: list[Query] = []
    add = lambda *a: q.append(query(*a))

    # ------------------------------------------------------------ distributions
    add("D1_distribution", "player_id:i scenario_id:i n:i mean:d p50:d p90:d best:d", lambda s, d: reports.distribution(complete(s, d)),
        """SELECT player_id, scenario_id, count(*) AS n, avg(score) AS mean, quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.9) AS p90,
             max(score) AS best FROM m_complete GROUP BY ALL""")
    rollup = "SELECT run_id, bot, count(*) AS kills, avg(ttk) AS avg_ttk, sum(shots) AS shots, sum(hits) AS hits, sum(damage_done) AS damage_done, sum(damage_possible) AS damage_possible, sum(overshots) AS overshots FROM m_kill GROUP BY ALL"
    add("I29_bot_rollup", "run_id:i bot:s kills:i avg_ttk:d shots:i hits:i damage_done:e damage_possible:e overshots:i",
        lambda s, d: reports.bot_rollup(b.kill(s, d)), rollup)
    mine = f"SELECT r.*, d.player_id, d.scenario_id, r.hits / nullif(r.shots, 0) AS accuracy FROM ({rollup}) r JOIN m_duel d ON d.id = r.run_id"
    add("D2_bot_breakdown", "player_id:i run_id:i bot:s kills:i avg_ttk:d accuracy:d runs:i p50_ttk:d p90_ttk:d best_ttk:d p50_accuracy:d p90_accuracy:d best_accuracy:d",
        lambda s, d: reports.bot_breakdown(reports.bot_rollup(b.kill(s, d)), b.kill_run(s, d)),
        f"""WITH mine AS ({mine}) SELECT m.player_id, m.run_id, m.bot, m.kills, m.avg_ttk, m.accuracy, nullif(count(o.run_id), 0) AS runs,
              quantile_cont(o.avg_ttk, 0.5) AS p50_ttk, quantile_cont(o.avg_ttk, 0.9) AS p90_ttk, min(o.avg_ttk) AS best_ttk,
              quantile_cont(o.accuracy, 0.5) AS p50_accuracy, quantile_cont(o.accuracy, 0.9) AS p90_accuracy, max(o.accuracy) AS best_accuracy
            FROM mine m LEFT JOIN mine o ON o.player_id = m.player_id AND o.scenario_id = m.scenario_id AND o.bot = m.bot AND o.run_id <> m.run_id
            GROUP BY ALL""")
    add("D3_kill_breakdown", "player_id:i run_id:i bot:s others:i p50_ttk:d p90_ttk:d best_ttk:d",
        lambda s, d: reports.kill_breakdown(killview(s, d)),
        """SELECT m.player_id, m.run_id, m.bot, count(*) AS others, quantile_cont(o.ttk, 0.5) AS p50_ttk, quantile_cont(o.ttk, 0.9) AS p90_ttk,
             min(o.ttk) AS best_ttk FROM (SELECT DISTINCT player_id, scenario_id, run_id, bot FROM m_killview) m JOIN m_killview o
             ON o.player_id = m.player_id AND o.scenario_id = m.scenario_id AND o.bot = m.bot AND o.run_id <> m.run_id GROUP BY ALL""")
    add("D4_pb_timeline", "player_id:i scenario_id:i started_at:t score:d", lambda s, d: reports.pb_timeline(progress(s, d)),
        "SELECT * FROM m_progress WHERE pb_before IS NULL OR score > pb_before")
    add("D5_pb_cost", "player_id:i id:i started_at:t score:d attempt_no:i resets_before:i",
        lambda s, d: reports.pb_cost(progress(s, d), views.run_attempt(b.run(s, d))),
        """SELECT p.*, a.attempt_no, a.resets_before FROM m_progress p JOIN (SELECT player_id, id, attempt_no, resets_before FROM m_attempt) a
           USING (player_id, id) WHERE pb_before IS NULL OR score > pb_before""")
    add("D6_reroll_rate", "player_id:i scenario_id:i resets:i completes:i reroll_rate:d", lambda s, d: reports.reroll_rate(b.run(s, d)),
        """SELECT player_id, scenario_id, count(*) FILTER (WHERE kind = 'reset') AS resets, count(*) FILTER (WHERE kind = 'complete') AS completes,
             count(*) FILTER (WHERE kind = 'reset') / count(*) AS reroll_rate FROM m_run GROUP BY ALL""")
    add("D7_score_band", "player_id:i scenario_id:i second:i c:d n:i p50:d p90:d",
        lambda s, d: reports.score_band(b.tick(s, d), b.kill_run(s, d), reports.latest_per_scenario(b.kill_run(s, d))),
        """WITH cum AS (SELECT d.player_id, d.scenario_id, t.run_id, floor(t.t) AS second,
                          sum(t.score) OVER (PARTITION BY t.run_id ORDER BY t.tick_no) AS c FROM m_tick t JOIN m_duel d ON d.id = t.run_id),
                band AS (SELECT player_id, scenario_id, second, count(*) AS n, quantile_cont(c, 0.5) AS p50, quantile_cont(c, 0.9) AS p90
                         FROM cum GROUP BY ALL HAVING count(*) >= 5),
                mine AS (SELECT player_id, scenario_id, second, c FROM cum WHERE run_id IN (SELECT id FROM (SELECT id, row_number() OVER
                           (PARTITION BY player_id, scenario_id ORDER BY started_at DESC, id DESC) AS n FROM m_duel) WHERE n = 1))
           SELECT * FROM mine FULL JOIN band USING (player_id, scenario_id, second)""")
    add("D8_run_with_pb", "player_id:i id:i score:d pb_before:d delta:d completion_no:i", lambda s, d: reports.run_with_pb(progress(s, d)),
        "SELECT *, score - pb_before AS delta FROM m_progress")
    slots = """SELECT player_id, scenario_id, ordinal AS slot, count(*) AS runs, avg(ttk) AS mean, stddev_pop(ttk) AS spread FROM m_killview
               WHERE ttk > 0 GROUP BY ALL"""
    add("D9_slot_stats", "player_id:i scenario_id:i slot:i runs:i mean:d spread:d", lambda s, d: reports.slot_stats(killview(s, d)), slots)
    add("D10_kill_detail", "run_id:i ordinal:i bot:s hits:i shots:i ttk:d",
        lambda s, d: reports.kill_detail(b.kill(s, d)).select("run_id", F.inline("kills")), "SELECT * FROM m_kill")
    add("D12_tick_spread", "player_id:i scenario_id:i tick_no:i spread:d", lambda s, d: reports.tick_spread(b.tick(s, d), b.kill_run(s, d)),
        """SELECT d.player_id, d.scenario_id, t.tick_no, max(t.t) - min(t.t) AS spread FROM m_tick t JOIN m_duel d ON d.id = t.run_id GROUP BY ALL""")
    add("D13_confounds", "player_id:i id:i config_changed:b version_changed:b fps_delta:d", lambda s, d: reports.confounds(progress(s, d)),
        """SELECT *, coalesce(lag(game_version_id) OVER w <> game_version_id, false) AS version_changed, avg_fps - lag(avg_fps) OVER w AS fps_delta
           FROM m_progress WINDOW w AS (PARTITION BY player_id, scenario_id ORDER BY started_at, id)""")
    add("D14_score_formula_error", "run_id:i max_error:d", lambda s, d: reports.score_formula_error(b.tick(s, d)),
        """SELECT run_id, max(abs(c - 10 * k * sqrt(h / nullif(f, 0)))) AS max_error FROM (SELECT run_id, sum(score) OVER w AS c, sum(kills) OVER w AS k,
             sum(shots_hit) OVER w AS h, sum(shots_fired) OVER w AS f FROM m_tick WINDOW w AS (PARTITION BY run_id ORDER BY tick_no)) GROUP BY 1""")
    add("F6_safe_ratio", "player_id:i id:i accuracy:d",
        lambda s, d: b.run(s, d).withColumn("accuracy", numbers.ratio(F.col("hits"), F.col("shots"))),
        "SELECT *, hits / nullif(shots, 0) AS accuracy FROM m_run")

    # ------------------------------------------------------------ progression
    add("P1_config_groups", "player_id:i scenario_id:i label:s horiz_sens:d runs:i best:d median:d first_used:t last_used:t current:b",
        lambda s, d: progression.config_groups(history(s, d)), _groups_sql())
    add("P2_config_slots", "player_id:i scenario_id:i label:s slot:i", lambda s, d: progression.config_groups(history(s, d)), _groups_sql())
    add("P3_best_so_far", "player_id:i id:i best:d worst:d",
        lambda s, d: progression.best_so_far(progression.best_so_far(complete(s, d), "lower").withColumnRenamed("best", "worst")),
        """SELECT *, max(score) OVER w AS best, min(score) OVER w AS worst FROM m_complete
           WINDOW w AS (PARTITION BY player_id, scenario_id ORDER BY started_at, id ROWS UNBOUNDED PRECEDING)""")
    rolled = """SELECT c.*, r.median, coalesce(r.n = 10, false) AS full FROM m_complete c LEFT JOIN (SELECT player_id, id,
                  quantile_cont(score, 0.5) OVER w AS median, count(*) OVER w AS n FROM m_complete WHERE score IS NOT NULL
                  WINDOW w AS (PARTITION BY player_id, scenario_id ORDER BY started_at, id ROWS 9 PRECEDING)) r USING (player_id, id)"""
    add("P4_rolling_median", "player_id:i id:i median:d full:b", lambda s, d: progression.rolling_form(complete(s, d)), rolled)
    add("P5_directory_rows", "player_id:i scenario_id:i tag:s median:d full:b gap:d", directory, DIRECTORY)
    add("P6_name_filter", "player_id:i scenario_id:i scenario_name:s", lambda s, d: progression.filter_by_name(directory(s, d), " RAFE 1"),
        f"SELECT * FROM ({DIRECTORY}) WHERE contains(lower(scenario_name), 'rafe 1')")
    for key, direction, sql_order in (
        ("form", "asc", "gap ASC NULLS LAST, last_played DESC"), ("pb", "desc", "pb DESC NULLS LAST, last_played DESC"),
        ("name", "asc", "trimmed_name, len(scenario_name), scenario_hash"),
    ):
        add(f"P7_sorted_by_{key}", "player_id:i scenario_id:i place:i",
            lambda s, d, key=key, direction=direction: progression.sort_directory(directory(s, d), key, direction),
            f"SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY {sql_order}, scenario_id) AS place FROM ({DIRECTORY})")
    add("P8_benchmarks_of_rows", "player_id:i benchmark_id:i name:s difficulty:s",
        lambda s, d: progression.benchmarks_of(directory(s, d), b.ladder(s, d), b.benchmark(s, d)),
        """SELECT DISTINCT c.player_id, m.benchmark_id, m.name, m.difficulty FROM m_complete c JOIN m_ladder l ON l.scenario_name = c.trimmed_name
           JOIN m_benchmark m USING (benchmark_id)""")
    add("P9_rows_in_benchmark", "player_id:i scenario_id:i which:i",
        lambda s, d: progression.in_benchmark(directory(s, d), b.ladder(s, d), b.benchmark(s, d), 2).withColumn("which", F.lit(2)).unionByName(
            progression.in_benchmark(directory(s, d), b.ladder(s, d), b.benchmark(s, d), 77).withColumn("which", F.lit(77))),
        f"""SELECT *, 2 AS which FROM ({DIRECTORY}) WHERE trimmed_name IN (SELECT scenario_name FROM m_ladder WHERE benchmark_id = 2)
            UNION ALL SELECT *, 77 FROM ({DIRECTORY})""")
    add("P10_pb_ranks", "player_id:i scenario_id:i benchmark_id:i k:i", lambda s, d: progression.pb_ranks(directory(s, d), picked(s, d)),
        f"""SELECT d.player_id, d.scenario_id, p.benchmark_id, len([u FOR u IN thresholds IF u <= pb]) - 1 AS k
            FROM ({DIRECTORY}) d JOIN ({PICKED.format('NULL')}) p ON p.scenario_name = d.trimmed_name WHERE pb IS NOT NULL""")
    add("P11_pb_summary", "player_id:i scenario_id:i pb_id:i runs_since:i played_s:d", lambda s, d: progression.pb_summary(history(s, d)),
        """SELECT player_id, scenario_id, arg_max(id, struct_pack(a := score, b := -completion_no)) FILTER (WHERE score IS NOT NULL) AS pb_id,
             coalesce(max(completion_no) - arg_max(completion_no, struct_pack(a := score, b := -completion_no)) FILTER (WHERE score IS NOT NULL), 0) AS runs_since,
             sum(duration_s) AS played_s FROM m_progress GROUP BY ALL""")
    add("P12_days_since", "player_id:i scenario_id:i days:i",
        lambda s, d: lists.directory(complete(s, d)).withColumn("days", numbers.days_between(F.col("last_played"), F.expr(NOW))),
        f"SELECT player_id, scenario_id, floor(epoch({NOW} - max(started_at)) / 86400) AS days FROM m_complete GROUP BY ALL")
    add("P13_progress_series", "player_id:i scenario_id:i run_no:i score:d best:d median:d full:b k:i vs_pb:d",
        lambda s, d: progression.progress_series(history(s, d), picked(s, d)),
        f"""SELECT p.*, p.completion_no AS run_no, max(p.score) OVER (PARTITION BY p.player_id, p.scenario_id ORDER BY started_at, p.id ROWS UNBOUNDED PRECEDING) AS best,
              r.median, r.full, CASE WHEN p.score IS NOT NULL THEN len([u FOR u IN l.thresholds IF u <= p.score]) - 1 END AS k, p.score - p.pb_before AS vs_pb
            FROM m_progress p JOIN (SELECT player_id, id, median, "full" FROM ({rolled})) r USING (player_id, id)
            LEFT JOIN ({PICKED.format('NULL')}) l ON l.scenario_name = p.trimmed_name""")

    # ------------------------------------------------------------ ladders
    ladder_rows = "SELECT c.player_id, c.id, c.scenario_name AS shown, c.trimmed_name, c.score, l.benchmark_id, l.thresholds, l.candidate_order FROM m_complete c JOIN m_ladder l ON l.scenario_name = c.trimmed_name"

    def on_ladders(s, d):
        named = complete(s, d).withColumn("scenario_name", text.js_trim(F.col("scenario_name")))
        return named.join(candidates(s, d), "scenario_name")

    add("K1_rank_on_ladder", "player_id:i id:i benchmark_id:i k:i next:d next_rank:i gap:d",
        lambda s, d: on_ladders(s, d).where("score IS NOT NULL").select("*", rank.rank_on(F.col("thresholds"), F.col("score")).alias("_k")).select(
            "player_id", "id", "benchmark_id", "_k.*"),
        f"""SELECT *, nxt AS next, nxt - score AS gap, CASE WHEN nxt IS NOT NULL THEN len([u FOR u IN thresholds IF u <= nxt]) - 1 END AS next_rank
            FROM (SELECT *, len([u FOR u IN thresholds IF u <= score]) - 1 AS k, list_min([u FOR u IN thresholds IF u > score]) AS nxt
                  FROM ({ladder_rows}) WHERE score IS NOT NULL)""")
    add("A1_fractional_rank", "player_id:i id:i benchmark_id:i r:d",
        lambda s, d: on_ladders(s, d).withColumn("r", rank.fractional_rank(F.col("thresholds"), F.col("score"))),
        f"SELECT *, {fractional('thresholds', 'score')} AS r FROM ({ladder_rows})")
    add("K2_candidates", "player_id:i scenario_id:i benchmark_id:i candidate_order:i is_default:b",
        lambda s, d: on_ladders(s, d).select("player_id", "scenario_id", "benchmark_id", "candidate_order", "is_default").distinct(),
        """SELECT DISTINCT player_id, scenario_id, benchmark_id, candidate_order, candidate_order = 1 AS is_default
           FROM m_complete c JOIN m_ladder l ON l.scenario_name = c.trimmed_name""")
    add("K10_candidate_order", "scenario_name:s benchmark_id:i candidate_order:i", candidates, "SELECT * FROM m_ladder")
    add("K3_picked_ladder", "scenario_name:s benchmark_id:i preferred:i",
        lambda s, d: picked(s, d).withColumn("preferred", F.lit(-1)).unionByName(picked(s, d, 1).withColumn("preferred", F.lit(1))),
        f"SELECT *, -1 AS preferred FROM ({PICKED.format('NULL')}) UNION ALL SELECT *, 1 FROM ({PICKED.format('1')})")
    names = "['Iron', 'Gold', 'Ruby', 'Master']"
    named = f"""SELECT *, CASE WHEN k = 0 THEN 'Unranked' ELSE {names}[k] END AS name, r - k AS progress, {names}[k + 1] AS nxt
                FROM (SELECT *, CAST(least(floor(r), 4) AS BIGINT) AS k FROM (SELECT c.player_id, c.id, {fractional('thresholds', 'score')} AS r FROM m_complete c
                JOIN ({PICKED.format('NULL')}) p ON p.scenario_name = c.trimmed_name WHERE score IS NOT NULL))"""
    add("K15_rank_of_rows", "player_id:i id:i r:d name:s rank_text:s",
        lambda s, d: ladders.rank_rows(complete(s, d), picked(s, d), b.benchmark(s, d)).select("*", "rank.name"),
        f"""SELECT *, name || ', ' || CAST(floor(progress * 100 + 1e-9) AS INTEGER) || CASE WHEN nxt IS NULL THEN ' % past the top rank' ELSE ' % to ' || nxt END
              AS rank_text FROM ({named})""")
    add("F2_rank_name", "player_id:i id:i k:i name:s progress:d next:s text:s",
        lambda s, d: ladders.rank_rows(complete(s, d), picked(s, d), b.benchmark(s, d)).select(
            "player_id", "id", "rank.*", rank.composite_text(F.col("r")).alias("text")),
        f"SELECT *, nxt AS next, CAST(CAST(floor(100 * r + 0.5) AS BIGINT) AS VARCHAR) AS text FROM ({named})")

    # ------------------------------------------------------------ composite
    add("A2_shifted_mean", "player_id:i scenario_id:i g:d half:d",
        lambda s, d: complete(s, d).where("score >= 0").groupBy("player_id", "scenario_id").agg(
            rank.shifted_mean(F.col("score")).alias("g"), rank.shifted_mean(F.col("score"), 0.5).alias("half")),
        f"""SELECT player_id, scenario_id, {shifted_mean('score')} AS g, pow(avg(sqrt(score + 1)), 2) - 1 AS half
            FROM m_complete WHERE score >= 0 GROUP BY ALL""")
    add("A3_tree", "benchmark_id:i cat_no:i sub_no:i slot_no:i scenario_name:s rated:b top:d", lambda s, d: nodes(s, d).withColumn("top", F.element_at("thresholds", -1)),
        "SELECT *, thresholds[-1] AS top FROM m_tree")
    add("A4_coverage", "player_id:i benchmark_id:i scenarios_played:i scenarios:i subs_played:i subs:i categories_played:i categories:i is_full:b",
        lambda s, d: composite.coverage(nodes(s, d), bests(s, d)),
        f"SELECT *, scenarios_played = scenarios AS is_full FROM ({COVER}) JOIN ({TOTALS}) USING (benchmark_id)")
    for mode in ("provisional", "strict"):
        add(f"A5_tree_{mode}", "player_id:i benchmark_id:i level:s node_no:i value:d",
            lambda s, d, mode=mode: composite.evaluate(nodes(s, d), pb_rank_values(s, d), mode), _tree_sql(mode, BEST_RANKS))
    add("A6_played_stats", "player_id:i scenario_name:s runs:i pb:d last:t top_hash:s", lambda s, d: composite.played_stats(stream(s, d)),
        """SELECT player_id, scenario_name, sum(n) AS runs, max(pb) AS pb, max(last) AS last, arg_min(hash, struct_pack(a := -n, b := first)) AS top_hash FROM (
             SELECT player_id, scenario_name, hash, count(*) AS n, max(score) AS pb, max(t) AS last, min(struct_pack(a := t, b := id)) AS first
             FROM m_stream GROUP BY ALL) GROUP BY ALL""")
    add("A7_as_of_ranks", "player_id:i benchmark_id:i scenario_name:s id:i r_pb:d r_form:d", as_of,
        f"SELECT *, {fractional('thresholds', 'best')} AS r_pb, {fractional('thresholds', 'form')} AS r_form FROM m_event")
    for mode in ("provisional", "strict"):
        add(f"A8_history_{mode}", "player_id:i benchmark_id:i level:s node_no:i id:i pb:d form:d",
            lambda s, d, mode=mode: values(s, d, mode), _history_sql(mode))

    def probes(s, d):
        cats = nodes(s, d).where("rated").select("benchmark_id", F.col("cat_no").alias("node_no")).distinct()
        return events(s, d).select("player_id", "benchmark_id", "t", "id").join(cats, "benchmark_id").withColumn("level", F.lit("category"))

    asked = _tree_sql("strict", "SELECT player_id, benchmark_id, ord, scenario_name, r_pb FROM m_asof", ", ord", "r_pb")
    add("A9_value_at", "player_id:i benchmark_id:i node_no:i id:i pb:d",
        lambda s, d: composite.value_at(values(s, d, "strict"), probes(s, d), "strict", hot(s, d)),
        f"""SELECT v.*, e.id, v.value AS pb FROM ({asked}) v JOIN m_event e ON e.player_id = v.player_id AND e.benchmark_id = v.benchmark_id AND e.ord = v.ord
            WHERE v.level = 'category'""")
    add("A10_node_scenarios", "benchmark_id:i level:s node_no:i scenario_name:s", lambda s, d: composite.node_scenarios(nodes(s, d)), INSIDE)
    add("A11_percentiles", "player_id:i scenario_id:i p10:d p50:d p90:d",
        lambda s, d: scan.percentiles(complete(s, d), ["player_id", "scenario_id"], "score", {"p10": 0.1, "p50": 0.5, "p90": 0.9}),
        """SELECT player_id, scenario_id, quantile_cont(score, 0.1) AS p10, quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.9) AS p90
           FROM m_complete GROUP BY ALL""")
    add("A12_window_spread", "player_id:i benchmark_id:i scenario_name:s runs:i last:t worst:d p10:d median:d p90:d pb:d r_worst:d r_p10:d r_median:d r_p90:d r_pb:d",
        spreads, SPREAD_R)
    long = " UNION ALL ".join(f"SELECT player_id, benchmark_id, '{x}' AS stat, scenario_name, r_{x} AS r FROM ({SPREAD_R})" for x in composite.STATS)
    for mode in ("provisional", "strict"):
        add(f"A13_tree_spread_{mode}", "player_id:i benchmark_id:i level:s node_no:i worst:d p10:d median:d p90:d pb:d",
            lambda s, d, mode=mode: composite.tree_spread(spreads(s, d), nodes(s, d), mode),
            f"""SELECT player_id, benchmark_id, level, node_no, {', '.join(f"max(value) FILTER (WHERE stat = '{x}') AS {x}" for x in composite.STATS)}
                FROM ({_tree_sql(mode, long, ', stat')}) GROUP BY ALL""")
    add("A14_sheet", "player_id:i benchmark_id:i row_no:i level:s scenario_name:s state:s r_median:d r_pb:d body:b stale:s next_at:d next_rank:i next_gap:d pb_score:d all_runs:i played:i total:i top_hash:s",
        lambda s, d: composite.sheet(nodes(s, d), composite.played_stats(stream(s, d)), spreads(s, d),
                                     composite.tree_spread(spreads(s, d), nodes(s, d), "provisional"), F.expr(NOW)),
        _sheet_sql(long))
    add("A15_scenario_chart", "player_id:i benchmark_id:i scenario_name:s n:i score:d best:d median:d full:b k:i",
        lambda s, d: composite.scenario_chart(events(s, d)),
        """SELECT *, form AS median, n >= 10 AS full, len([u FOR u IN thresholds IF u <= score]) - 1 AS k FROM (SELECT *, row_number() OVER
             (PARTITION BY player_id, benchmark_id, scenario_name ORDER BY t, id) AS n FROM m_event)""")
    add("A16_node_chart", "player_id:i benchmark_id:i level:s node_no:i n:i pb_arc:d form_arc:d played:i total:i",
        lambda s, d: composite.node_chart(values(s, d, "provisional"), nodes(s, d), hot(s, d)),
        f"""SELECT h.*, row_number() OVER (PARTITION BY h.player_id, h.benchmark_id, h.level, h.node_no ORDER BY h.ord) AS n, 100 * pb AS pb_arc, 100 * form AS form_arc,
              (SELECT count(DISTINCT x.scenario_name) FROM m_event x JOIN ({INSIDE}) i ON i.benchmark_id = x.benchmark_id AND i.scenario_name = x.scenario_name
                WHERE x.player_id = h.player_id AND x.benchmark_id = h.benchmark_id AND i.level = h.level AND i.node_no = h.node_no AND x.ord <= h.ord) AS played,
              t.total FROM ({_history_sql('provisional')}) h JOIN (SELECT benchmark_id, level, node_no, count(*) AS total FROM ({INSIDE}) GROUP BY ALL) t
              ON t.benchmark_id = h.benchmark_id AND t.level = h.level AND t.node_no = h.node_no""")
    add("A17_rank_bands", "benchmark_id:i rank_no:i at:d rank:s",
        lambda s, d: b.benchmark(s, d).select("benchmark_id", F.posexplode("ranks").alias("_i", "rank")).select(
            "benchmark_id", (F.col("_i") + 1).alias("rank_no"), (100 * (F.col("_i") + 1)).alias("at"), "rank"),
        f"SELECT benchmark_id, i AS rank_no, 100 * i AS at, {names}[i] AS rank FROM m_benchmark, range(1, 5) x(i)")
    add("F7_lane_position", "player_id:i benchmark_id:i scenario_name:s lane:d",
        lambda s, d: pb_rank_values(s, d).withColumn("lane", numbers.lane_position(F.col("r") * 1.5 - 1, F.lit(4))),
        f"SELECT *, least(greatest(r * 1.5 - 1, 0), 5) / 5 AS lane FROM ({BEST_RANKS})")
    add("F8_median", "player_id:i scenario_id:i median:d",
        lambda s, d: lists.directory(complete(s, d)).withColumn("median", numbers.array_median(F.col("recent"))), DIRECTORY)
    add("F9_lower_bound", "player_id:i scenario_name:s benchmark_id:i below:i",
        lambda s, d: bests(s, d).join(b.ladder(s, d), "scenario_name").withColumn("below", numbers.lower_bound(F.col("thresholds"), F.col("pb"))),
        """SELECT player_id, trimmed_name AS scenario_name, benchmark_id, len([u FOR u IN thresholds IF u < max_score]) AS below FROM (
             SELECT player_id, trimmed_name, max(score) AS max_score FROM m_complete WHERE score IS NOT NULL GROUP BY ALL) JOIN m_ladder ON scenario_name = trimmed_name""")
    add("F4_age_text", "player_id:i scenario_id:i age:s",
        lambda s, d: lists.directory(complete(s, d)).withColumn(
            "age", numbers.age_text(numbers.days_between(F.col("last_played"), F.expr(NOW)) * (F.col("scenario_id") * 5 + 1))),
        f"""SELECT *, CASE WHEN days < 60 THEN days || ' d ago' WHEN days < 365 THEN CAST(floor(days / 30.44 + 0.5) AS INTEGER) || ' mo ago'
              ELSE (days // 365) || ' y ago' END AS age FROM (SELECT player_id, scenario_id,
              CAST(floor(epoch({NOW} - last) / 86400) AS BIGINT) * (scenario_id * 5 + 1) AS days FROM (
              SELECT player_id, scenario_id, max(started_at) AS last FROM m_complete GROUP BY ALL))""")

    # ------------------------------------------------------------ index
    for mode in ("provisional", "strict"):
        add(f"K11_index_{mode}", "player_id:i benchmark_id:i name:s difficulty:s played:i total:i r:d last:t share:d",
            lambda s, d, mode=mode: composite.index(nodes(s, d), bests(s, d), b.benchmark(s, d), mode), _index_sql(mode))
    add("K12_family_order", "player_id:i name:s share:d last:t place:i",
        lambda s, d: composite.order_families(composite.index(nodes(s, d), bests(s, d), b.benchmark(s, d), "provisional")),
        f"""SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY share DESC, last DESC, position) AS place FROM (
              SELECT player_id, name, max(share) AS share, max(last) AS last, min(position) AS position FROM ({_index_sql('provisional')}) GROUP BY ALL)""")
    add("K13_search", "benchmark_id:i name:s difficulty:s via:s",
        lambda s, d: composite.search(composite.untouched(nodes(s, d), b.benchmark(s, d)), "aIm strafe 7").withColumn("via", F.concat_ws("|", "via")),
        """SELECT benchmark_id, name, difficulty, array_to_string(list_sort([x FOR x IN names IF (NOT own LIKE '%strafe%' AND lower(x) LIKE '%strafe%') OR
               (NOT own LIKE '%7%' AND lower(x) LIKE '%7%') OR (NOT own LIKE '%aim%' AND lower(x) LIKE '%aim%')]), '|') AS via
           FROM (SELECT b.*, lower(b.name || ' ' || b.difficulty) AS own, list_sort(list(DISTINCT t.scenario_name)) AS names FROM m_benchmark b
                 JOIN m_tree t USING (benchmark_id) GROUP BY ALL)
           WHERE list_bool_and([own LIKE '%' || w || '%' OR len([x FOR x IN names IF lower(x) LIKE '%' || w || '%']) > 0 FOR w IN ['aim', 'strafe', '7']])""")
    add("K14_highlight", "p_partkey:i part:i text:s hit:b", lambda s, d: composite.highlight(b.table(s, d, "part"), "p_partkey", "p_name", "LL re in"),
        f"""WITH c AS (SELECT p_partkey, i, substr(p_name, i, 1) AS ch, {_covered('p_name', ['ll', 're', 'in'])} AS hit
                          FROM (SELECT *, unnest(range(1, len(p_name) + 1)) AS i FROM part)),
                g AS (SELECT *, sum(turn) OVER (PARTITION BY p_partkey ORDER BY i) AS part FROM (SELECT *, CASE WHEN lag(hit) OVER w <> hit THEN 1 ELSE 0 END AS turn
                      FROM c WINDOW w AS (PARTITION BY p_partkey ORDER BY i)))
           SELECT p_partkey, part, string_agg(ch, '' ORDER BY i) AS text, bool_or(hit) AS hit FROM g GROUP BY p_partkey, part""")
    return q


def _covered(text_column, found):
    """Whether character ``i`` lies in an occurrence of one of the words."""
    return "(" + " OR ".join(
        f"(i > {j} AND substr(lower({text_column}), i - {j}, {len(w)}) = '{w}')" for w in found for j in range(len(w))
    ) + ")"


def _groups_sql():
    keys = "player_id, scenario_id, sens_scale, horiz_sens, vert_sens, dpi, fov, fov_scale"
    return f"""WITH g AS (SELECT {keys}, count(*) AS runs, max(score) AS best, quantile_cont(score, 0.5) AS median,
                          min(struct_pack(a := started_at, b := id)) AS f, max(started_at) AS last_used FROM ({HISTORY}) GROUP BY {keys}),
                    n AS (SELECT *, row_number() OVER (PARTITION BY player_id, scenario_id ORDER BY f) AS group_no FROM g),
                    r AS (SELECT *, row_number() OVER (PARTITION BY player_id, scenario_id ORDER BY last_used DESC, group_no DESC) AS rec FROM n)
               SELECT *, 'C' || group_no AS label, f.a AS first_used, rec = 1 AS current,
                      CASE WHEN rec <= 3 THEN count(*) FILTER (WHERE rec <= 3) OVER (PARTITION BY player_id, scenario_id ORDER BY group_no) - 1 END AS slot FROM r"""


def _sheet_sql(long):
    spread_rows = f"""SELECT player_id, benchmark_id, level, node_no, max(value) FILTER (WHERE stat = 'median') AS r_median,
                             max(value) FILTER (WHERE stat = 'pb') AS r_pb FROM ({_tree_sql('provisional', long, ', stat')}) GROUP BY ALL"""
    age = f"epoch({NOW} - s.last) / 86400"
    return f"""
      WITH stats AS (SELECT player_id, scenario_name, sum(n) AS runs, max(pb) AS pb, arg_min(hash, struct_pack(a := -n, b := first)) AS top_hash FROM (
             SELECT player_id, scenario_name, hash, count(*) AS n, max(score) AS pb, min(struct_pack(a := t, b := id)) AS first FROM m_stream GROUP BY ALL) GROUP BY ALL),
           who AS (SELECT DISTINCT player_id, benchmark_id FROM stats JOIN m_slot USING (scenario_name)),
           inside AS ({INSIDE}),
           shown AS (SELECT DISTINCT benchmark_id, 'overall' AS level, 0 AS node_no, -1 AS cat_no, -1 AS sub_no FROM m_slot
                     UNION SELECT benchmark_id, 'category', cat_no, cat_no, -1 FROM m_slot
                     UNION SELECT benchmark_id, 'subcategory', sub_no, cat_no, sub_no FROM m_slot),
           spr AS ({spread_rows}),
           upper_rows AS (SELECT w.player_id, w.benchmark_id, h.level, h.cat_no, h.sub_no, -1 AS slot_no, NULL AS scenario_name,
               CASE WHEN r_pb IS NULL THEN 'unplayed' ELSE 'played' END AS state, r_median, r_pb, r_pb IS NOT NULL AS body,
               NULL AS stale, NULL AS next_at, NULL AS next_rank, NULL AS next_gap, NULL AS pb_score, NULL AS all_runs,
               (SELECT count(*) FROM inside i JOIN stats s USING (scenario_name) WHERE s.player_id = w.player_id AND i.benchmark_id = w.benchmark_id
                  AND i.level = h.level AND i.node_no = h.node_no) AS played,
               (SELECT count(*) FROM inside i WHERE i.benchmark_id = w.benchmark_id AND i.level = h.level AND i.node_no = h.node_no) AS total, NULL AS top_hash
             FROM who w JOIN shown h USING (benchmark_id) LEFT JOIN spr USING (player_id, benchmark_id, level, node_no)),
           lower_rows AS (SELECT w.player_id, w.benchmark_id, 'scenario' AS level, n.cat_no, n.sub_no, n.slot_no, n.scenario_name,
               CASE WHEN NOT n.rated THEN 'unrated' WHEN s.runs IS NULL THEN 'unplayed' ELSE 'played' END AS state, s.r_median, s.r_pb,
               coalesce(s.runs >= 5, false) AS body,
               CASE WHEN {age} > 30 THEN CASE WHEN floor({age}) < 60 THEN CAST(floor({age}) AS INTEGER) || ' d ago' ELSE
                 CAST(floor(floor({age}) / 30.44 + 0.5) AS INTEGER) || ' mo ago' END END AS stale,
               list_min([u FOR u IN n.thresholds IF u > coalesce(p.pb, -1e300)]) AS next_at,
               len([u FOR u IN n.thresholds IF u <= list_min([v FOR v IN n.thresholds IF v > coalesce(p.pb, -1e300)])]) - 1 AS nr,
               p.pb AS pb_score, p.runs AS all_runs, p.top_hash
             FROM who w JOIN m_tree n USING (benchmark_id) LEFT JOIN stats p USING (player_id, scenario_name)
             LEFT JOIN ({SPREAD_R}) s USING (player_id, benchmark_id, scenario_name)),
           every AS (SELECT * FROM upper_rows UNION ALL SELECT player_id, benchmark_id, level, cat_no, sub_no, slot_no, scenario_name, state, r_median, r_pb,
               body, stale, next_at, CASE WHEN next_at IS NOT NULL THEN nr END, CASE WHEN pb_score IS NOT NULL THEN next_at - pb_score END, pb_score, all_runs,
               NULL, NULL, top_hash FROM lower_rows)
      SELECT *, row_number() OVER (PARTITION BY player_id, benchmark_id ORDER BY cat_no, sub_no, slot_no) AS row_no FROM every"""
