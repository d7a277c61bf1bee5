"""The model tables of ``bridge`` again, as SQL over the driver's views: name to (tables it reads, select)."""



def fractional(t: str, score: str) -> str:
    """Fractional rank of ``score`` on the ladder ``t``, spelled out with list functions."""
    first, last, n = f"{t}[1]", f"{t}[-1]", f"len({t})"
    flat = f"(CASE WHEN {first} = 0 THEN 1 ELSE abs({first}) * 0.1 END)"
    single = f"({first} = {last})"
    lo = f"({first} - CASE WHEN {single} THEN {flat} ELSE list_min([u FOR u IN {t} IF u > {first}]) - {first} END)"
    hi = f"({last} + CASE WHEN {single} THEN {flat} ELSE {last} - list_max([u FOR u IN {t} IF u < {last}]) END)"
    i = f"len([u FOR u IN {t} IF u <= {score}])"
    below = f"(CASE WHEN {i} = 0 THEN {lo} ELSE {t}[{i}] END)"
    above = f"(CASE WHEN {i} = {n} THEN {hi} ELSE {t}[{i} + 1] END)"
    return (
        f"CASE WHEN {t} IS NULL OR {score} IS NULL THEN NULL WHEN {score} < {lo} THEN 0 WHEN {score} >= {hi} THEN {n} + 1 "
        f"ELSE {i} + ({score} - {below}) / ({above} - {below}) END"
    )


def shifted_mean(x: str) -> str:
    return f"exp(avg(ln({x} + 1))) - 1"


TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "m_run": ((), r"""
        SELECT user_id % 10 AS player_id, event_id AS id, 'run-' || event_id AS file_stem, k % 10 AS scenario_id,
               k % 6 AS config_id, k % 2 AS game_version_id, kind, ts AS written_at, started_at,
               epoch_us(started_at - date_trunc('day', started_at)) // 1000 AS start_ms,
               CASE WHEN kind = 'complete' THEN 60.0 END AS duration_s,
               CASE WHEN k % 7 <> 6 THEN value END AS score,
               CASE WHEN kind = 'complete' THEN 100.0 + k END AS avg_fps,
               k AS hits, k % 13 AS misses, k + k % 13 AS shots,
               kind = 'complete' AND k % 11 <> 0 AS perf_landed
        FROM (SELECT *, CASE WHEN kind = 'complete' THEN ts - INTERVAL 60 SECOND END AS started_at
              FROM (SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k,
                           CASE WHEN event_type = 'error' THEN 'reset' ELSE 'complete' END AS kind FROM events))"""),
    "m_scenario": ((), r"""
        SELECT n_nationkey AS scenario_id, md5(n_name) AS hash, 'Strafe ' || (n_nationkey % 8) AS trimmed,
               'Strafe ' || (n_nationkey % 8) || CASE WHEN n_nationkey >= 8 THEN chr(160) ELSE '' END AS name FROM nation"""),
    "m_version": ((), "SELECT r_regionkey AS game_version_id, '3.' || r_regionkey AS label FROM region"),
    "m_config": ((), r"""
        SELECT n_nationkey AS config_id, 'cm/360' AS sens_scale, 20 + (n_nationkey % 4) * 2.5 AS horiz_sens,
               20 + (n_nationkey % 4) * 2.5 AS vert_sens, 800.0 + 400 * (n_nationkey % 4 % 2) AS dpi, 103.0 AS fov,
               'Overwatch' AS fov_scale, 'cross' || n_nationkey AS crosshair FROM nation"""),
    "m_complete": (("m_run", "m_scenario", "m_version"), r"""
        SELECT r.*, s.hash AS scenario_hash, s.name AS scenario_name, s.trimmed AS trimmed_name, v.label AS game_version,
               r.perf_landed AS has_perf
        FROM m_run r JOIN m_scenario s USING (scenario_id) JOIN m_version v USING (game_version_id) WHERE r.kind = 'complete'"""),
    "m_session": (("m_run",), r"""
        SELECT *, row_number() OVER (PARTITION BY player_id, session_id ORDER BY written_at, id) AS position_in_session,
               first_value(id) OVER (PARTITION BY player_id, session_id ORDER BY written_at, id) AS session_first_run_id
        FROM (SELECT *, sum(is_new) OVER (PARTITION BY player_id ORDER BY written_at, id) AS session_id
              FROM (SELECT *, CASE WHEN written_at - lag(written_at) OVER w > INTERVAL 30 MINUTE
                                     OR lag(written_at) OVER w IS NULL THEN 1 ELSE 0 END AS is_new
                    FROM m_run WINDOW w AS (PARTITION BY player_id ORDER BY written_at, id)))"""),
    "m_progress": (("m_complete",), r"""
        SELECT *, row_number() OVER w AS completion_no, lag(score) OVER w AS prev_score,
               max(score) OVER (PARTITION BY player_id, scenario_id ORDER BY started_at, id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb_before,
               max(score) OVER (PARTITION BY player_id, scenario_id ORDER BY started_at) AS best_so_far,
               lag(config_id) OVER w IS NOT NULL AND lag(config_id) OVER w <> config_id AS config_changed
        FROM m_complete WINDOW w AS (PARTITION BY player_id, scenario_id ORDER BY started_at, id)"""),
    "m_attempt": (("m_run",), r"""
        SELECT *, row_number() OVER (PARTITION BY player_id, scenario_id ORDER BY written_at, id) AS attempt_no,
               count(*) FILTER (WHERE kind = 'reset') OVER (PARTITION BY player_id, scenario_id ORDER BY written_at, id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS resets_before FROM m_run"""),
    "m_duel": ((), r"""
        SELECT o_custkey % 20 AS player_id, o_orderkey AS id, 'duel-' || o_orderkey AS file_stem, o_orderkey % 4 AS scenario_id,
               'complete' AS kind, o_orderdate + to_seconds(o_orderkey * 37 % 86400) AS started_at,
               o_orderdate + to_seconds(o_orderkey * 37 % 86400 + 60) AS written_at,
               o_orderkey * 37 % 86400 * 1000 AS start_ms,
               CASE WHEN o_orderkey % 29 <> 0 THEN floor(o_totalprice / 10) / 100 END AS score, o_orderkey % 9 <> 0 AS has_perf
        FROM orders"""),
    "m_line": ((), r"""
        SELECT *, round(sum(ttk) OVER (PARTITION BY l_orderkey ORDER BY ordinal ROWS UNBOUNDED PRECEDING) + 0.25 * (ordinal + 1), 3) AS at_s
        FROM (SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN l_quantity / 10 WHEN ordinal = 0 THEN 1.5 ELSE 2.0 END AS ttk
              FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
                                                 l_extendedprice, l_quantity) - 1 AS ordinal FROM lineitem))"""),
    "m_kill": (("m_line",), r"""
        SELECT l_orderkey AS run_id, ordinal,
               (l_orderkey * 37 % 86400 * 1000 + CAST(round(at_s * 1000) AS BIGINT)) % 86400000 AS at_ms,
               'bot' || (l_suppkey % 7) AS bot, l_returnflag AS weapon, ttk, CAST(l_quantity AS INTEGER) AS shots,
               CAST(floor(l_quantity * (1 - l_discount)) AS INTEGER) AS hits, l_extendedprice * (1 - l_discount) AS damage_done,
               l_extendedprice AS damage_possible, l_partkey % 3 AS overshots,
               CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END AS cheated FROM m_line"""),
    "m_killview": (("m_kill", "m_duel"), r"""
        SELECT k.*, d.player_id, d.scenario_id, k.cheated <> 0 AS is_cheated, k.hits / nullif(k.shots, 0) AS accuracy,
               k.damage_done / nullif(k.damage_possible, 0) AS efficiency, (k.at_ms - d.start_ms) / 1000.0 AS t_offset
        FROM m_kill k JOIN m_duel d ON d.id = k.run_id"""),
    "m_tick": (("m_line",), r"""
        SELECT l_orderkey AS run_id, ordinal AS tick_no, t, CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS shots_fired,
               floor(l_quantity * (1 - l_discount)) AS shots_hit, l_quantity - floor(l_quantity * (1 - l_discount)) AS shots_missed,
               1000.0 * (0.9 + 0.2 * (ordinal % 2)) AS damage_done, 1200.0 AS damage_possible,
               CASE WHEN l_orderkey % 4 >= 2 THEN CASE WHEN ordinal = 0 THEN 999.0 ELSE
                      -(t - lag(t) OVER (PARTITION BY l_orderkey ORDER BY ordinal)) END
                    WHEN l_suppkey % 7 <> 6 THEN l_quantity END AS score,
               1.0 AS kills, CASE WHEN l_partkey % 3 <> 0 THEN l_partkey % 3 END AS overshots
        FROM (SELECT *, round(CASE WHEN l_orderkey % 4 >= 2 THEN at_s + (l_partkey % 4) / 20 - 0.1
                                   ELSE ordinal + 1 + (l_partkey % 7) / 100 END, 3) AS t FROM m_line)"""),
    "m_header": (("m_duel",), r"""
        SELECT player_id, id AS run_id, scenario_id, file_stem, started_at, score, has_perf,
               CASE WHEN scenario_id >= 2 THEN 1000.0 WHEN id % 31 = 0 THEN NULL WHEN id % 5 = 0 THEN CAST(n AS DOUBLE)
                    ELSE n + 1 + CAST(id % 2 AS DOUBLE) * 0.2 END AS time_limit,
               CASE WHEN id % 6 <> 0 THEN 1.0 END AS timescale,
               CASE WHEN scenario_id < 2 AND id % 17 = 3 THEN CAST(n AS DOUBLE) END AS end_after_kills,
               CASE WHEN scenario_id < 2 AND id % 17 = 4 THEN n * 1000.0 END AS end_after_damage, n * 1000.0 AS damage_done
        FROM (SELECT d.*, coalesce(c.n, 0) AS n FROM m_duel d LEFT JOIN
              (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) c ON c.l_orderkey = d.id)"""),
    "m_benchmark": ((), r"""
        SELECT r_regionkey AS benchmark_id, ['Valor', 'Valor S2', 'Aim v3', 'Aim Season 4', 'Solo'][r_regionkey + 1] AS name,
               r_name AS difficulty, r_regionkey AS position, ['valor', 'valor', 'aim', 'aim', 'solo'][r_regionkey + 1] AS family,
               [1, 2, 3, 4, 1][r_regionkey + 1] AS season FROM region"""),
    "m_ladder": (("m_benchmark",), r"""
        SELECT l.*, row_number() OVER (PARTITION BY scenario_name ORDER BY min_pos, season DESC, position) AS candidate_order
        FROM (SELECT n_regionkey AS benchmark_id, 'Strafe ' || (n_nationkey % 8) AS scenario_name, n_nationkey // 5 AS place,
                     CASE WHEN n_nationkey % 8 = 2 THEN [b, b * 2, b * 2, b * 8] WHEN n_nationkey % 8 = 3 THEN [b]
                          ELSE [b, b * 2, b * 4, b * 8] END AS thresholds
              FROM (SELECT *, CAST(5 + n_nationkey % 8 + 2 * n_regionkey AS DOUBLE) AS b FROM nation) WHERE n_nationkey // 5 < 4) l
        JOIN (SELECT *, min(position) OVER (PARTITION BY family) AS min_pos FROM m_benchmark) USING (benchmark_id)"""),
    "m_slot": ((), r"""
        SELECT n_regionkey AS benchmark_id, CASE WHEN p <= 2 THEN 0 ELSE 1 END AS cat_no,
               CASE WHEN p <= 1 THEN 0 WHEN p = 2 THEN 1 WHEN p = 3 THEN 2 ELSE 3 END AS sub_no,
               CASE WHEN p = 1 THEN 1 ELSE 0 END AS slot_no, 'Strafe ' || (n_nationkey % 8) AS scenario_name
        FROM (SELECT *, n_nationkey // 5 AS p FROM nation)
        UNION ALL SELECT n_regionkey, 1, 2, 1, 'Strafe ' || (n_nationkey % 8) FROM nation WHERE n_nationkey // 5 = 1"""),
    "m_tree": (("m_slot", "m_ladder"), """
        SELECT s.*, l.thresholds, l.thresholds IS NOT NULL AS rated FROM m_slot s LEFT JOIN m_ladder l USING (benchmark_id, scenario_name)"""),
    "m_stream": (("m_complete", "m_slot"), """
        SELECT player_id, scenario_id, trimmed_name AS scenario_name, scenario_hash AS hash, id, started_at AS t, score FROM m_complete
        WHERE score IS NOT NULL AND trimmed_name IN (SELECT scenario_name FROM m_slot)"""),
    "m_event": (("m_stream", "m_ladder"), """
        SELECT s.*, l.benchmark_id, l.thresholds, row_number() OVER (PARTITION BY player_id, benchmark_id ORDER BY t, id) AS ord,
               max(score) OVER w AS best, quantile_cont(score, 0.5) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS form
        FROM m_stream s JOIN m_ladder l USING (scenario_name)
        WINDOW w AS (PARTITION BY player_id, benchmark_id, scenario_name ORDER BY t, id)"""),
    "m_asof": (("m_event", "m_tree"), f"""
        SELECT e.player_id, e.benchmark_id, e.ord, e.t, e.id, e.scenario_name AS run_of, n.scenario_name, x.r_pb, x.r_form
        FROM m_event e JOIN (SELECT DISTINCT benchmark_id, scenario_name FROM m_tree WHERE rated) n ON n.benchmark_id = e.benchmark_id
        ASOF LEFT JOIN (SELECT *, {fractional('thresholds', 'best')} AS r_pb, {fractional('thresholds', 'form')} AS r_form FROM m_event) x
          ON x.player_id = e.player_id AND x.benchmark_id = e.benchmark_id AND x.scenario_name = n.scenario_name AND e.ord >= x.ord"""),
    "m_picked": (("m_ladder",), "SELECT * FROM m_ladder WHERE candidate_order = 1"),
}
