"""Queries over curves, baselines, opponents and sampled series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import baseline, bots, curves, reports, series
from . import bridge as b
from .history_queries import killview
from .curve_sql import FITS, PB, RECENT, at_sql, resolve_sql, sample_sql
from .registry import Query, query



@b.kept_by("run_id")
def params(s, d):
    return curves.classify(b.header(s, d), b.tick(s, d), killview(s, d))


@b.kept_by("run_id")
def timed_kills(s, d):
    kills = killview(s, d).select("player_id", "scenario_id", "run_id", "ordinal", "bot", "ttk", "hits", "shots", "t_offset")
    return curves.kill_times(kills, curves.countdown(b.tick(s, d)))


@b.kept_by("run_id")
def points(s, d):
    return curves.curve(params(s, d), b.tick(s, d), timed_kills(s, d))


@b.kept_by("run_id")
def pace(s, d):
    return curves.pace(points(s, d))


@b.once
def runs(s, d):
    return baseline.runs_with_params(b.header(s, d), params(s, d))


@b.kept_table
def resolved(s, d, option):
    return baseline.resolve(runs(s, d), option)


@b.once
def pairs(s, d):
    """Runs with their charted personal best before, curves on both sides."""
    drawn = params(s, d).where("kind <> 'unsupported'").select("run_id")
    return baseline.charted_pairs(resolved(s, d, "pb-before")).join(drawn, "run_id", "left_semi")


@b.kept_table
def recent(s, d):
    drawn = params(s, d).where("kind <> 'unsupported'").select("run_id")
    return baseline.recent(runs(s, d)).join(drawn, "run_id", "left_semi")


@b.kept_table
def windows(s, d):
    """Stored, so that its size is known when it meets the kills: a row for each scenario of a player."""
    return bots.fixed_window(reports.slot_stats(killview(s, d)))


@b.kept_by("run_id")
def engaged(s, d):
    played = b.header(s, d).where("has_perf").select("run_id")
    return bots.engagements(timed_kills(s, d).join(played, "run_id", "left_semi"), windows(s, d))


@b.once
def race(s, d):
    return bots.race_table(engaged(s, d), params(s, d), pairs(s, d))


@b.once
def clock(s, d):
    return bots.clock_table(engaged(s, d), points(s, d), pairs(s, d))


@b.once
def tabs(s, d):
    return bots.bot_tabs(bots.reference_run(b.header(s, d), b.tick(s, d), killview(s, d), params(s, d)), engaged(s, d))


@b.once
def tab_series(s, d):
    return bots.bot_series(tabs(s, d), engaged(s, d), points(s, d), params(s, d), killview(s, d))


@b.once
def chart(s, d):
    ranged = curves.recent_range(points(s, d), recent(s, d))
    return series.chart_data(pace(s, d), resolved(s, d, "pb-before"), ranged, params(s, d), points(s, d))


def _probes(s, d):
    return params(s, d).where("kind <> 'unsupported'").select("run_id", F.explode(F.array(*(F.lit(x / 10) for x in range(-1, 12)))).alias("x"))


def _time_probes(s, d):
    return params(s, d).where("kind <> 'unsupported'").select("run_id", F.explode(F.array(*(F.lit(x * 0.75) for x in range(0, 14)))).alias("t"))


def queries() -> list[Query]:
    q: list[Query] = []
    add = lambda *a: q.append(query(*a))

    add("D11_curve_inputs", "run_id:i score:d time_limit:d end_after_kills:d place:i t:d tick_score:d kills:i first_kill:d",
        lambda s, d: curves.inputs(b.header(s, d), b.tick(s, d), killview(s, d)).select(
            "*", F.posexplode("ticks").alias("place", "_t"), F.size("kill_offsets").alias("kills"), F.get("kill_offsets", F.lit(0)).alias("first_kill")
        ).withColumn("t", F.col("_t.t")).withColumn("tick_score", F.col("_t.score")),
        """SELECT h.*, t.tick_no AS place, t.t, t.score AS tick_score, count(*) OVER (PARTITION BY run_id) AS kills,
             first_value(k.t_offset) OVER (PARTITION BY run_id ORDER BY t.tick_no) AS first_kill
           FROM m_header h JOIN m_tick t USING (run_id) JOIN m_killview k ON k.run_id = h.run_id AND k.ordinal = t.tick_no WHERE has_perf""")
    add("C1_countdown", "run_id:i ticks:i end:d is_countdown:b", lambda s, d: curves.countdown(b.tick(s, d)), 'SELECT *, "end_t" AS "end" FROM m_shape')
    add("C2_kill_times", "run_id:i ordinal:i kill_t:d in_order:b", timed_kills, "SELECT * FROM m_killtime")
    add("C3_curve_kind", "run_id:i kind:s duration_s:d duration_from:s budget:d pool:d bots:i reason:s", params, "SELECT * FROM m_param")
    add("C4_clock_curve", "run_id:i idx:i t:d x:d u:d", lambda s, d: points(s, d).where("kind = 'clock'"), "SELECT * FROM m_curve WHERE kind = 'clock'")
    add("C5_race_curve", "run_id:i idx:i t:d x:d u:d", lambda s, d: points(s, d).where("kind = 'race'"), "SELECT * FROM m_curve WHERE kind = 'race'")
    add("C6_curve", "run_id:i idx:i kind:s t:d x:d u:d", points, "SELECT * FROM m_curve")
    probes = "SELECT run_id, x / 10.0 AS x FROM m_param, range(-1, 12) r(x) WHERE kind <> 'unsupported'"
    add("C7_at_progress", "run_id:i x:d t:d u:d", lambda s, d: curves.at_progress(points(s, d), _probes(s, d)), at_sql(probes, "x", ["t", "u"]))
    tprobes = "SELECT run_id, x * 0.75 AS t FROM m_param, range(0, 14) r(x) WHERE kind <> 'unsupported'"
    add("C8_at_time", "run_id:i t:d x:d u:d", lambda s, d: curves.at_time(points(s, d), _time_probes(s, d)), at_sql(tprobes, "t", ["x", "u"]))
    add("C9_projected", "run_id:i idx:i projected:d",
        lambda s, d: points(s, d).withColumn("projected", numbers.project(F.col("kind"), F.col("budget"), F.col("u"))),
        "SELECT *, CASE WHEN kind = 'race' THEN budget - u ELSE u END AS projected FROM m_curve")
    add("C10_accumulated_pace", "run_id:i idx:i accumulated:d", pace, "SELECT * FROM m_pace")
    add("C11_local_pace", "run_id:i idx:i local:d", pace, "SELECT * FROM m_pace")
    add("C12_comparable", "run_id:i other_id:i fits:b",
        lambda s, d: _neighbours(s, d).withColumn("fits", curves.comparable(F.col("p"), F.col("q"))),
        f"""SELECT a.run_id, b.run_id AS other_id, coalesce({FITS.format(a='a', b='b')}, false) AS fits FROM (SELECT *, lag(run_id) OVER
              (PARTITION BY player_id, scenario_id ORDER BY started_at, run_id) AS before FROM m_param) a JOIN m_param b ON b.run_id = a.before""")
    for name, x in (("rest", None), ("half", 0.5)):
        at = "" if x is None else "0.5"
        u = lambda side: at_sql(f"SELECT {side} AS run_id, run_id AS owner, 0.5 AS x FROM m_pairs", "x", ["u"])
        add(f"C13_readout_{name}", "run_id:i other_id:i value:d unit:s",
            lambda s, d, x=x: curves.readout(pairs(s, d), points(s, d), params(s, d), x),
            "SELECT p.*, a.final - b.final AS value, CASE WHEN a.kind = 'race' THEN 'seconds' ELSE 'points' END AS unit FROM m_pairs p JOIN m_param a ON a.run_id = p.run_id JOIN m_param b ON b.run_id = p.other_id"
            if not at else
            f"""SELECT p.*, CASE WHEN k.kind = 'race' THEN y.u - x.u ELSE x.u - y.u END AS value, CASE WHEN k.kind = 'race' THEN 'seconds' ELSE 'points' END AS unit
                FROM m_pairs p JOIN m_param k ON k.run_id = p.run_id JOIN ({u('run_id')}) x ON x.owner = p.run_id JOIN ({u('other_id')}) y ON y.owner = p.run_id""")
    met = at_sql("SELECT r.other_id AS run_id, r.run_id AS owner, c.idx, c.x FROM m_recent r JOIN m_curve c ON c.run_id = r.run_id", "x", ["u"])
    add("C14_recent_range", "run_id:i idx:i mean:d sd:d count:i", lambda s, d: curves.recent_range(points(s, d), recent(s, d)),
        f"""SELECT owner AS run_id, idx, avg(v) AS mean, stddev_samp(v) AS sd, count(v) AS count FROM (SELECT m.owner, m.idx, m.x,
              CASE WHEN m.x > 0 THEN CASE WHEN k.kind = 'race' THEN k.budget - m.u / m.x ELSE m.u / m.x END END AS v
              FROM ({met}) m JOIN m_param k ON k.run_id = m.run_id) GROUP BY ALL""")

    # ------------------------------------------------------------ baselines
    add("B1_pb_runs", "run_id:i pb_before_id:i pb_id:i", lambda s, d: baseline.pb_runs(runs(s, d)), PB)
    for by in ("best-charted", "recent"):
        order = "r.score DESC, r.started_at, r.run_id" if by == "best-charted" else "r.started_at DESC, r.run_id"
        add(f"B2_walk_{by.replace('-', '_')}", "inspected_id:i run_id:i order_no:i",
            lambda s, d, by=by: baseline.walk_order(runs(s, d), reports.latest_per_scenario(b.kill_run(s, d)).join(
                b.header(s, d).select("run_id", "started_at"), "run_id"), by),
            f"""SELECT l.run_id AS inspected_id, r.run_id, row_number() OVER (PARTITION BY l.run_id ORDER BY {order}) AS order_no
                FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id, scenario_id ORDER BY started_at DESC, run_id DESC) AS n FROM m_runs) WHERE n = 1) l
                JOIN m_runs r USING (player_id, scenario_id) WHERE r.started_at < l.started_at AND r.has_perf{' AND r.score IS NOT NULL' if by == 'best-charted' else ''}""")
    add("B3_recent_comparable", "run_id:i other_id:i order_no:i", lambda s, d: baseline.recent(runs(s, d)), RECENT)
    for option in baseline.LABELS:
        add(f"B4_baseline_{option.replace('-', '_')}", "run_id:i kind:s base_id:i base_score:d reason:s",
            lambda s, d, option=option: resolved(s, d, option), resolve_sql(option))
    flat = f"""SELECT q.*, CASE WHEN k.kind = 'race' THEN (k.budget - q.base_score) * q.x - q.u ELSE q.u - q.base_score * q.x END AS value
               FROM ({at_sql(f"SELECT run_id, base_score, 0.25 AS x FROM ({resolve_sql('pb')}) WHERE kind <> 'none' AND run_id IN (SELECT run_id FROM m_curve)", "x", ["u"])}) q JOIN m_param k USING (run_id)"""
    add("B5_flat_readout", "run_id:i value:d", _flat, flat)
    add("B7_score_delta", "run_id:i diff:d pct:d", lambda s, d: baseline.score_delta(resolved(s, d, "pb"), params(s, d)),
        f"""SELECT run_id, diff, CASE WHEN res <> 0 THEN diff / abs(res) * 100 END AS pct FROM (SELECT r.run_id, r.score - r.base_score AS diff,
              CASE WHEN k.kind = 'race' THEN k.budget - r.base_score ELSE r.base_score END AS res FROM ({resolve_sql('pb')}) r
              LEFT JOIN m_param k USING (run_id) WHERE r.kind <> 'none' AND r.score IS NOT NULL)""")
    add("F11_race_result", "run_id:i result:d", lambda s, d: params(s, d).withColumn(
        "result", numbers.race_result(F.col("kind"), F.col("budget"), F.col("final"))),
        "SELECT run_id, CASE WHEN kind = 'race' THEN budget - final ELSE final END AS result FROM m_param")

    # ------------------------------------------------------------ opponents
    add("E1_clicking", "run_id:i is_clicking:b", lambda s, d: bots.clicking(b.kill(s, d)), "SELECT * FROM m_clicking")
    add("E2_fixed_window", "player_id:i scenario_id:i window_s:d", windows, "SELECT * FROM m_window")
    add("E3_engagements", "run_id:i slot:i bot:s start:d end:d", engaged, 'SELECT *, fin AS "end" FROM m_engaged')
    add("E4_encounters", "run_id:i slot:i bot:s x0:d x1:d", lambda s, d: bots.encounters(engaged(s, d), params(s, d)), "SELECT * FROM m_span")
    add("E5_dead_time", "run_id:i dead_s:d slots:i", lambda s, d: bots.dead_time(engaged(s, d)),
        "SELECT run_id, sum(dead) AS dead_s, count(*) AS slots FROM m_engaged GROUP BY 1")
    add("E6_best_splits", "player_id:i scenario_id:i slots:i slot:i best:d", lambda s, d: bots.best_splits(engaged(s, d)),
        """SELECT player_id, scenario_id, slots, slot, min(fin - start) AS best FROM (SELECT *, count(*) OVER (PARTITION BY run_id) AS slots FROM m_engaged) GROUP BY ALL""")
    add("E7_race_table", "run_id:i slot:i bot:s split:d pace:d baseline:d delta:d best:d delta_best:d", race,
        """SELECT * FROM m_race UNION ALL SELECT a.run_id, -1, NULL, a.dead, NULL, b.dead, b.dead - a.dead, NULL, NULL FROM
             (SELECT run_id, sum(dead) AS dead, count(*) AS n FROM m_engaged WHERE run_id IN (SELECT run_id FROM m_param WHERE kind = 'race') GROUP BY 1) a
             LEFT JOIN m_pairs p ON p.run_id = a.run_id LEFT JOIN (SELECT run_id, sum(dead) AS dead, count(*) AS n FROM m_engaged GROUP BY 1) b
               ON b.run_id = p.other_id AND b.n = a.n""")
    add("E8_clock_table", "run_id:i bot:s time:d encounters:i hits:i shots:i accuracy:d points:d pace:d baseline:d delta:d", clock,
        """SELECT * FROM m_clock UNION ALL SELECT t.run_id, NULL, NULL, greatest(0, k.duration_s - t.t), NULL, NULL, NULL, NULL, e.u - t.p, NULL, NULL, NULL
           FROM (SELECT run_id, sum(time) AS t, sum(points) AS p FROM m_clock GROUP BY 1) t JOIN m_param k USING (run_id)
           JOIN (SELECT run_id, arg_max(u, idx) AS u FROM m_curve GROUP BY 1) e USING (run_id)""")
    add("E9_largest_loss", "run_id:i bot:s place:i delta:d",
        lambda s, d: bots.largest_loss(race(s, d), "slot").unionByName(bots.largest_loss(clock(s, d), "first_slot")),
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY delta, place) AS n FROM (SELECT run_id, bot, slot AS place, delta FROM m_race
             UNION ALL SELECT run_id, bot, first_slot, delta FROM m_clock) WHERE delta < 0) WHERE n = 1""")
    add("E10_bot_numbers", "scenario_id:i bot:s slot_no:i", lambda s, d: bots.bot_numbers(killview(s, d)),
        """SELECT *, (dense_rank() OVER (PARTITION BY scenario_id ORDER BY bot) - 1) % 6 AS slot_no FROM (SELECT DISTINCT scenario_id, bot FROM m_killview)""")
    add("E11_bot_tabs", "player_id:i scenario_id:i kind:s tab_no:i key:s label:s", tabs, "SELECT * FROM m_tab")
    add("E12_bot_series", "player_id:i scenario_id:i run_id:i key:s value:d raw:d", tab_series, "SELECT * FROM m_tabseries")
    add("E12_covered", "player_id:i scenario_id:i covered:i", lambda s, d: bots.covered(tab_series(s, d)),
        "SELECT player_id, scenario_id, count(DISTINCT run_id) AS covered FROM m_tabseries GROUP BY ALL")
    add("E13_scenario_kind", "player_id:i scenario_id:i kind:s budget:d", lambda s, d: bots.scenario_kind(b.header(s, d), params(s, d)),
        """SELECT player_id, scenario_id, coalesce(k.kind, 'unknown') AS kind, k.budget FROM (SELECT DISTINCT player_id, scenario_id FROM m_header)
           LEFT JOIN (SELECT * FROM (SELECT l.player_id, l.scenario_id, p.kind, p.budget, row_number() OVER (PARTITION BY l.player_id, l.scenario_id ORDER BY age) AS n
             FROM m_lastperf l JOIN m_param p USING (run_id) WHERE age <= 5 AND p.kind <> 'unsupported') WHERE n = 1) k USING (player_id, scenario_id)""")

    # ------------------------------------------------------------ sampled series
    add("G1_union_grid", "run_id:i x:d", lambda s, d: series.union_grid(points(s, d), curves.of_pairs(pairs(s, d), points(s, d), "other_id")),
        "SELECT DISTINCT run_id, x FROM (SELECT run_id, x FROM m_curve UNION ALL SELECT p.run_id, c.x FROM m_pairs p JOIN m_curve c ON c.run_id = p.other_id)")
    grid_sql = at_sql("""SELECT run_id, k, CAST(k AS DOUBLE) / 100 AS t FROM (SELECT run_id, unnest(range(0, CAST(floor(e * 100 + 1e-9) AS BIGINT) + 1)) AS k
                     FROM (SELECT run_id, max(t) AS e FROM m_curve GROUP BY 1))""", "t", ["x"])
    add("G2_scrub_grid", "run_id:i steps:i last_k:i low:d high:d mean:d",
        lambda s, d: series.scrub_grid(points(s, d)).groupBy("run_id").agg(
            F.count("*").alias("steps"), F.max("k").alias("last_k"), F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean")),
        f"SELECT run_id, count(*) AS steps, max(k) AS last_k, min(x) AS low, max(x) AS high, avg(x) AS mean FROM ({grid_sql}) GROUP BY run_id")
    add("G3_sampled", "run_id:i x:d accumulated:d local:d",
        lambda s, d: series.sample(pace(s, d), _probes(s, d), ["accumulated", "local"]), sample_sql(probes, "m_pace", ["accumulated", "local"]))
    drawn = ["display", "accumulated", "local", "base_accumulated", "base_local", "recent_mean", "recent_low", "recent_high"]
    add("G4_chart_data", "run_id:i points:i " + " ".join(f"{c}:d" for c in drawn),
        lambda s, d: chart(s, d).groupBy("run_id").agg(F.count("*").alias("points"), *(F.avg(c).alias(c) for c in drawn)), None)
    add("G5_display_units", "run_id:i idx:i display:d", lambda s, d: points(s, d).withColumn(
        "display", numbers.display_x(F.col("kind"), F.col("duration_s"), F.col("x"))),
        "SELECT run_id, idx, CASE WHEN kind = 'clock' THEN x * duration_s ELSE x * 100 END AS display FROM m_curve")
    add("G6_y_bounds", "run_id:i lo:d hi:d", _y_bounds,
        """SELECT run_id, lo, CASE WHEN nxt - hi <= 0.5 * (hi - lo) THEN greatest(hi, nxt) ELSE hi END AS hi FROM (
             SELECT run_id, min(accumulated) AS lo, max(accumulated) AS hi, ceil(max(accumulated) / 50) * 50 AS nxt FROM m_pace GROUP BY 1)""")
    add("G7_extent", "run_id:i lo:d hi:d", lambda s, d: series.extent(pace(s, d), ["accumulated", "local"], 0.25, 0.75),
        """SELECT run_id, least(min(accumulated), min(local)) AS lo, greatest(max(accumulated), max(local)) AS hi FROM m_pace WHERE x >= 0.25 AND x <= 0.75 GROUP BY 1""")
    add("G8_pin_view", "run_id:i bot:s lo:d hi:d", lambda s, d: series.pin_view(bots.encounters(engaged(s, d), params(s, d))),
        """SELECT run_id, bot, CASE WHEN hi > lo AND hi - lo <= 0.6 THEN lo - (hi - lo) * 0.1 END AS lo, CASE WHEN hi > lo AND hi - lo <= 0.6 THEN hi + (hi - lo) * 0.1 END AS hi
           FROM (SELECT run_id, bot, min(x0) AS lo, max(x1) AS hi FROM m_span GROUP BY ALL)""")
    return q


def _neighbours(s, d):
    """Each run with the one before it in its scenario."""
    from ..operators import scan

    packed = params(s, d).withColumn("p", F.struct(*curves.PARAMS))
    walked = scan.running(packed, ["player_id", "scenario_id"], ["started_at", "run_id"], _b=scan.previous(F.struct("run_id", "p")))
    return walked.where("_b IS NOT NULL").withColumn("other_id", F.col("_b.run_id")).withColumn("q", F.col("_b.p"))


def _flat(s, d):
    probes = resolved(s, d, "pb").where("kind <> 'none'").select("run_id", "base_score", F.lit(0.25).alias("x"))
    known = params(s, d).where("kind <> 'unsupported'").select("run_id", "kind", "budget")
    met = curves.at_progress(points(s, d), probes.join(known, "run_id"))
    return baseline.flat_readout(met, F.col("base_score"))


def _y_bounds(s, d):
    span = pace(s, d).groupBy("run_id").agg(F.min("accumulated").alias("_lo"), F.max("accumulated").alias("_hi"))
    nxt = F.ceil(F.col("_hi") / 50) * 50
    return span.select("run_id", numbers.y_bounds(F.col("_lo"), F.col("_hi"), nxt, F.lit(True)).alias("_b")).select("run_id", "_b.*")
