"""Hand-worked cases: sessions, form, ladders, composites, curves, clocks, documents and baselines."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyrun.functions import clock, ladder, text
from tallyrun.operators import baseline, catalogue, composite, curves, joins, lists, series, sessions, views

UTC = dt.timezone.utc


def at(day, clock_text):
    return dt.datetime.fromisoformat(f"2026-01-{day:02d} {clock_text}")


RAIL = [
    ("a1", 1, "complete", at(1, "10:02"), 50.0), ("a2", 1, "complete", at(1, "10:04"), 60.0), ("b1", 2, "complete", at(1, "10:06"), 100.0),
    ("a3", 1, "complete", at(2, "10:02"), 70.0), ("a4", 1, "complete", at(2, "10:04"), 80.0), ("b2", 2, "complete", at(2, "10:06"), 90.0),
    ("a5", 1, "complete", at(3, "10:02"), 75.0), ("ax", 1, "reset", at(3, "10:03"), 10.0),
]


@pytest.fixture(scope="module")
def rail(spark):
    made = [(1, i + 1, stem, s, kind, w, w - dt.timedelta(minutes=1) if kind == "complete" else None, score)
            for i, (stem, s, kind, w, score) in enumerate(RAIL)]
    return spark.createDataFrame(
        made, "player_id int, id int, file_stem string, scenario_id int, kind string, written_at timestamp_ntz, started_at timestamp_ntz, score double"
    )


def test_session_form(rail):
    done = rail.where("kind = 'complete'")
    rows = sessions.form(sessions.played(views.run_session(rail), done)).collect()
    got = {(r["session_id"], r["scenario_id"]): (r["median"], r["best"], r["baseline"], r["prev_best"]) for r in rows}
    assert got[(3, 1)] == (75, 75, 65, 80)
    assert got[(2, 1)] == (75, 80, 55, 60)
    assert got[(2, 2)] == (90, 90, 100, 100)


def test_session_gap_is_strict(spark):
    times = ["10:00:00", "10:30:00", "11:00:00", "11:30:01"]
    df = spark.createDataFrame([(1, i, at(1, t)) for i, t in enumerate(times)], "player_id int, id int, written_at timestamp_ntz")
    assert [r["session_id"] for r in views.run_session(df).orderBy("id").collect()] == [1, 1, 1, 2]


def test_previous_score_skips_scoreless_runs(spark):
    df = spark.createDataFrame(
        [(1, 1, i, at(1, f"10:0{i}"), s) for i, s in enumerate([50.0, None, 40.0])],
        "player_id int, scenario_id int, id int, started_at timestamp_ntz, score double",
    )
    got = [(r["prev_score"], r["pb_before"]) for r in lists.with_history(df).orderBy("id").collect()]
    assert got == [(None, None), (50, 50), (50, 50)]


RANKS = [
    ([500.0, 600.0, 700.0, 800.0], {380: 0, 400: 0, 450: 0.5, 500: 1, 550: 1.5, 650: 2.5, 800: 4, 850: 4.5, 900: 5, 950: 5}),
    ([100.0, 200.0, 200.0, 300.0], {200: 3, 150: 1.5, 250: 3.5}),
    ([100.0, 100.0, 200.0, 250.0, 250.0], {0: 0, 50: 0.5, 100: 2, 275: 5.5, 300: 6}),
    ([1000.0], {950: 0.5, 1050: 1.5, 1100: 2}),
    ([0.0], {-0.5: 0.5, 0.25: 1.25}),
]


def test_fractional_rank(spark):
    cases = [(t, float(s), float(r)) for t, marks in RANKS for s, r in marks.items()]
    df = spark.createDataFrame(cases, "t array<double>, s double, want double")
    for r in df.withColumn("got", ladder.fractional_rank(F.col("t"), F.col("s"))).collect():
        assert r["got"] == pytest.approx(r["want"]), r


def test_shifted_mean(spark):
    for values, want in (([0.0] + [5.0] * 11, 4.17), ([8.0] + [3.0] * 11, 3.28)):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        assert round(df.agg(ladder.shifted_mean(F.col("x")).alias("g")).first()["g"], 2) == want


@pytest.fixture(scope="module")
def small_tree(spark):
    names = [("Clicking", 0, 0, "A"), ("Clicking", 0, 0, "B"), ("Clicking", 0, 1, "C"), ("Tracking", 1, 2, "D"), ("Tracking", 1, 2, "Unrated"), ("Tracking", 1, 3, "B")]
    slots = spark.createDataFrame([(1, c, s, i, n) for i, (_, c, s, n) in enumerate(names)], "benchmark_id int, cat_no int, sub_no int, slot_no int, scenario_name string")
    rated = spark.createDataFrame([(1, n, [100.0, 200.0, 300.0]) for n in "ABCD"], "benchmark_id int, scenario_name string, thresholds array<double>")
    return composite.tree(slots, rated)


def test_tree_modes(spark, small_tree):
    ranks = spark.createDataFrame([(1, 1, "A", 2.0), (1, 1, "C", 1.0)], "player_id int, benchmark_id int, scenario_name string, r double")
    for mode, want in (("provisional", {0: 2, 1: 1}), ("strict", {0: 1, 1: 1, 2: 0, 3: 0})):
        got = {r["node_no"]: r["value"] for r in composite.evaluate(small_tree, ranks, mode).where("level = 'subcategory'").collect()}
        assert got == want
    cover = composite.coverage(small_tree, ranks).first()
    assert (cover["scenarios_played"], cover["scenarios"], cover["subs_played"], cover["subs"], cover["categories_played"], cover["categories"]) == (2, 4, 2, 4, 1, 2)


@pytest.mark.parametrize("mode", ["provisional", "strict"])
def test_history_equals_evaluation_and_does_not_depend_on_splitting(spark, small_tree, mode):
    from tallyrun.operators import scan

    rnd = random.Random(5)
    rows = [(p, rnd.choice("ABCD"), 1, i, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i), rnd.random() * 400) for i in range(160) for p in (1,)]
    stream = spark.createDataFrame(rows, "player_id int, scenario_name string, scenario_id int, id int, t timestamp_ntz, score double").cache()
    runs = composite.events(stream, small_tree)
    ranks = composite.as_of_ranks(runs, 5)
    plain = composite.history(ranks, mode).cache()
    hot = scan._measure(stream, ("player_id",), 40)
    split = composite.history(composite.as_of_ranks(runs, 5, hot), mode, hot)
    key = lambda r: (r["level"], r["node_no"], r["id"])
    a = {key(r): (r["pb"], r["form"], r["played"]) for r in plain.collect()}
    b = {key(r): (r["pb"], r["form"], r["played"]) for r in split.collect()}
    assert a.keys() == b.keys()
    assert all(x[0] == pytest.approx(y[0], abs=1e-9) and x[1] == pytest.approx(y[1], abs=1e-9) and x[2] == y[2] for x, y in ((a[k], b[k]) for k in a))
    seen: dict[str, float] = {}
    by_id = {r["id"]: r for r in ranks.collect()}
    for i in range(160):
        seen[by_id[i]["scenario_name"]] = by_id[i]["r_pb"]
        if i % 40 != 39:
            continue
        now = spark.createDataFrame([(1, 1, n, r) for n, r in seen.items()], "player_id int, benchmark_id int, scenario_name string, r double")
        whole = next(r["value"] for r in composite.evaluate(small_tree, now, mode).collect() if r["level"] == "overall")
        assert a[("overall", 0, i)][0] == pytest.approx(whole, abs=1e-9)


# ---------------------------------------------------------------- curves


def race_by_hand(ticks, kills, pool):
    """The curve of a race walked point by point."""
    n, points, done, k = len(kills), [(0.0, 0.0)], 0.0, 0
    for t, damage in ticks:
        done += damage
        while k < n and kills[k] <= t:
            points.append((kills[k], (k + 1) / n))
            k += 1
        if t >= kills[-1]:
            break
        x = max(points[-1][1], done / pool)
        if points[-1][0] != t and x < (k + 1) / n:
            points.append((t, x))
    points += [(kills[j], (j + 1) / n) for j in range(k, n)]
    return points


def test_race_curve_against_a_walk(spark):
    rnd = random.Random(3)
    ticks, kills, races, want = [], [], [], {}
    for run in range(60):
        n = rnd.randint(1, 6)
        times = sorted(round(rnd.random() * 20, 1) + 0.1 for _ in range(n))
        marks = [(float(t), rnd.choice([0.0, 100.0, 250.0])) for t in range(1, int(times[-1]) + 3)]
        races.append((run, 100.0 * n, n))
        kills += [(run, i, t) for i, t in enumerate(times)]
        ticks += [(run, i, t, d) for i, (t, d) in enumerate(marks)]
        want[run] = race_by_hand(marks, times, 100.0 * n)
    got = curves.race_points(
        spark.createDataFrame(races, "run_id int, pool double, bots int"),
        spark.createDataFrame(ticks, "run_id int, tick_no int, t double, damage_done double"),
        spark.createDataFrame(kills, "run_id int, ordinal int, kill_t double"),
    ).collect()
    for run, points in want.items():
        mine = [(r["t"], round(r["x"], 9)) for r in sorted((r for r in got if r["run_id"] == run), key=lambda r: r["idx"])]
        assert mine == [(t, round(x, 9)) for t, x in points]


def test_interpolation_takes_the_first_reach_and_clamps(spark):
    points = spark.createDataFrame([(1, i, x, u) for i, (x, u) in enumerate([(0.0, 0.0), (0.5, 10.0), (0.5, 30.0), (1.0, 40.0)])], "run_id int, idx int, x double, u double")
    probes = spark.createDataFrame([(1, x) for x in (-1.0, 0.25, 0.5, 0.75, 2.0)], "run_id int, x double")
    got = {r["x"]: r["u"] for r in joins.interpolate(points, probes, ["run_id"], "x", ["u"]).collect()}
    assert got == {-1.0: 0.0, 0.25: 5.0, 0.5: 10.0, 0.75: 35.0, 2.0: 40.0}
    open_ended = {r["x"]: r["u"] for r in joins.interpolate(points, probes, ["run_id"], "x", ["u"], clamp=False).collect()}
    assert open_ended[-1.0] is None and open_ended[2.0] is None and open_ended[0.5] == 10.0


def test_chart_series_against_a_loop(spark):
    points = spark.createDataFrame([(1, i, t, t / 10, t * t) for i, t in enumerate([0.0, 1.3, 2.9, 10.0])], "run_id int, idx int, t double, x double, u double")
    got = {r["k"]: r["x"] for r in series.scrub_grid(points, 0.1).collect()}
    assert sorted(got) == list(range(101))
    assert all(got[k] == pytest.approx(k / 100) for k in got)


def test_recent_runs_go_on_past_neighbours_that_do_not_compare(spark):
    """Seventy runs in the next bucket hide three comparable ones; none of the three may be missed."""
    base = dt.datetime(2026, 1, 1)
    durations = [60.3] * 3 + [60.9] * 70 + [60.3]
    params = "struct<kind:string,duration_s:double,budget:double,pool:double,bots:int>"
    rows = [(1, 1, i, base + dt.timedelta(minutes=i), float(i), True, ("clock", d, None, None, None)) for i, d in enumerate(durations)]
    runs = spark.createDataFrame(rows, f"player_id int, scenario_id int, run_id int, started_at timestamp_ntz, score double, has_perf boolean, curve {params}")
    got = [r["other_id"] for r in baseline.recent(runs).where("run_id = 73").orderBy("order_no").collect()]
    assert got == [2, 1, 0]
    best = baseline.best_charted(runs).where("run_id = 73").first()
    assert best["other_id"] == 2


# ---------------------------------------------------------------- clocks, texts, catalogue


def test_clock_changes_in_berlin(spark):
    cases = [
        ("2026.09.19-00.00.41", "23:59:40.000", "2026-09-18T21:59:40", 61.999), ("2026.10.25-00.00.41", "23:59:40.000", "2026-10-24T21:59:40", 61.999),
        ("2026.10.25-02.00.30", "02:59:30.000", "2026-10-25T00:59:30", 60.999), ("2026.10.25-03.00.30", "02:59:40.000", "2026-10-25T01:59:40", 50.999),
        ("2026.10.25-02.10.00", "02:09:00.000", "2026-10-25T00:09:00", 60.999), ("2026.10.25-16.03.10", "16:02:10.243", "2026-10-25T15:02:10.243000", 60.756),
    ]
    df = spark.createDataFrame([(f"x - Challenge - {n}", c, s, d) for n, c, s, d in cases], "stem string, c string, start string, duration double")
    told = df.withColumn("p", clock.span(clock.stem_date(F.col("stem")), clock.stem_ms(F.col("stem")), clock.clock_ms(F.col("c")), "Europe/Berlin"))
    for r in told.select("*", F.date_format("p.started_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("got")).collect():
        assert r["got"].startswith(r["start"]) and r["p"]["ms"] / 1000 == r["duration"], r


def test_names(spark):
    df = spark.createDataFrame([("  Valor S2﻿",), ("Aim Season 4",), ("Solo",), ("Vert v3.5",)], "n string")
    got = [tuple(r) for r in df.select(text.js_trim(F.col("n")), text.family(F.col("n")), text.season(F.col("n"))).collect()]
    assert got == [("Valor S2", "valor", 2.0), ("Aim Season 4", "aim", 4.0), ("Solo", "solo", 1.0), ("Vert v3.5", "vert", 3.5)]


def test_integer_like_rank_name_fails_the_build(spark):
    rows = spark.createDataFrame([("x", ["Iron", "10"])], "name string, ranks array<string>")
    with pytest.raises(Exception, match="rank.reads_as_number key=x value=Iron,10"):
        catalogue.require_rank_names(rows).collect()


def test_countdown_and_pace_start(spark):
    ticks = spark.createDataFrame([(1, 0, 1.0, 999.0, 1.0), (1, 1, 2.0, -1.0, 1.0), (1, 2, 3.5, -1.5, 1.0)], "run_id int, tick_no int, t double, score double, damage_done double")
    assert curves.countdown(ticks).first()["is_countdown"]
    points = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, "clock", None), (1, 1, 1.0, 0.1, 5.0, "clock", None)], "run_id int, idx int, t double, x double, u double, kind string, budget double")
    assert [round(r["accumulated"], 6) for r in curves.pace(points).orderBy("idx").collect()] == [50.0, 50.0]
    assert math.isclose(curves.pace(points).where("idx = 1").first()["local"], 50.0)
