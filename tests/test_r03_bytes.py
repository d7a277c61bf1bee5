"""Findings of round 3 on bytes: the tables of the order runs lie in buckets by run, so that what is made of them is not shuffled."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyrun.operators import bots, joins
from tallyrun.plans import bridge, curve_queries, fixtures
from tallyrun.session import bucketed


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def folder(spark, path):
    day = dt.date(1995, 3, 4)
    orders = [(k, k % 7, day, 1000.0 + k) for k in range(1, 60)]
    lines = [(k, n, k + n, k % 5 + n, day, 100.0 * n, float(n + k % 3), 0.05, "ANR"[n % 3]) for k in range(1, 60) for n in range(1, 1 + k % 6)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_extendedprice double, l_quantity double, l_discount double, "
                          "l_returnflag string").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_run_tables_are_not_shuffled(spark, tmp_path, monkeypatch):
    d, made = folder(spark, tmp_path), []
    for name in ("bucketed", "stored"):
        real = getattr(bridge, name)
        monkeypatch.setattr(bridge, name, lambda df, *args, real=real: made.append((df.columns, exchanges(df))) or real(df, *args))
    assert curve_queries.pace(spark, d).count() > 0 and curve_queries.engaged(spark, d).count() > 0
    assert fixtures.documents(spark, d).count() == 59
    shuffled = [columns for columns, n in made if n]
    assert len(made) >= 10 and all(c == ["player_id", "scenario_id", "window_s"] for c in shuffled)


def test_probes_of_bucketed_points_are_not_shuffled(spark):
    rows = [(r, i, float(t), t / 4, 2.0 * t) for r in range(20) for i, t in enumerate((0, 1, 3, 4))]
    points = bucketed(spark.createDataFrame(rows, "run_id long, idx int, t double, x double, u double"), "run_id", 3)
    asks = bucketed(spark.createDataFrame([(r, 2.0, r) for r in range(20)], "run_id long, t double, no long"), "run_id", 3)
    got = joins.interpolate(points, asks, ["run_id"], "t", ["x", "u"])
    assert exchanges(got) == 0 and got.columns == ["run_id", "t", "no", "x", "u"]
    assert {tuple(r) for r in got.collect()} == {(r, 2.0, r, 0.5, 4.0) for r in range(20)}


def test_points_of_engagements_come_without_a_join(spark):
    curve = [(r, i, float(t), t / 4, 2.0 * t, "clock", 4.0) for r in range(9) for i, t in enumerate((0, 1, 3, 4))]
    points = bucketed(spark.createDataFrame(curve, "run_id long, idx int, t double, x double, u double, kind string, duration_s double"), "run_id", 3)
    rows = [(1, 2, r, s, "b", 3, 4, float(s), s + 1.0) for r in range(9) for s in range(2)] + [(5, 2, 0, 0, "b", 3, 4, 0.0, 1.0)]
    engaged = bucketed(spark.createDataFrame(rows, "player_id long, scenario_id int, run_id long, slot int, bot string, hits int, shots int, start double, `end` double"), "run_id", 3)
    got = bots.points_by_bot(engaged, points)
    by_run = got.groupBy("run_id").agg(F.sum("points").alias("p"))
    assert exchanges(by_run) == 0
    # Rows that share a run and slot each get the points of all of them, as a join by both gave.
    assert sorted((r["run_id"], r["player_id"], r["slot"], r["points"]) for r in got.where("run_id < 2").collect()) == [(0, 1, 0, 4.0), (0, 1, 1, 2.0), (0, 5, 0, 4.0), (1, 1, 0, 2.0), (1, 1, 1, 2.0)]
