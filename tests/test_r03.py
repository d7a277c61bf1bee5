"""Findings of round 3: what is shuffled, what is stored once, and sessions that are still open."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyrun.operators import curves, series
from tallyrun.sources import ingest, stats_document


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def plain_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def usual_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def points(spark):
    rows = [(r, i, float(t), t / 4, r * t * 1.0) for r in (1, 2, 3) for i, t in enumerate((0, 1, 3, 4))]
    return spark.createDataFrame([(*p, "clock", 4.0, None) for p in rows], "run_id long, idx int, t double, x double, u double, kind string, duration_s double, budget double")


def test_recent_range_shuffles_curves_packed(spark):
    recent = spark.createDataFrame([(3, 1), (3, 2), (2, 1)], "run_id long, other_id long")
    plain_plans(spark)
    try:
        got = curves.recent_range(points(spark), recent)
        assert exchanges(got) <= 6
        rows = {(r["run_id"], r["idx"]): (r["mean"], r["sd"], r["count"]) for r in got.collect()}
    finally:
        usual_plans(spark)
    assert rows[3, 0] == (None, None, 0) and len(rows) == 8
    mean, sd, n = rows[3, 1]  # both earlier runs end at 4 and 8
    assert (round(mean, 9), round(sd, 9), n) == (6.0, round(8**0.5, 9), 2)
    assert rows[2, 2][0] == 4.0 and rows[2, 2][2] == 1


def test_chart_steps_are_not_shuffled(spark):
    p = points(spark)
    pace = p.withColumn("accumulated", F.when(F.col("x") > 0, F.col("u") / F.col("x"))).withColumn("local", F.col("u"))
    baseline = spark.createDataFrame([(2, "charted", 1, 4.0), (3, "flat", None, 9.0)], "run_id long, kind string, base_id long, base_score double")
    band = p.where("run_id = 2").select("run_id", "idx", "x", F.col("u").alias("mean"), F.lit(1.0).alias("sd"))
    params = p.select("run_id", "kind", "duration_s").distinct()
    plain_plans(spark)
    try:
        chart = series.chart_data(pace, baseline, band, params, p, 0.1)
        counted = chart.groupBy("run_id").agg(F.count("*").alias("n"))
        assert exchanges(counted) == exchanges(chart) <= 16
        rows = {(r["run_id"], round(r["x"], 6)): r for r in chart.collect()}
    finally:
        usual_plans(spark)
    assert len(rows) == 3 * 41
    at = rows[2, 0.5]
    assert (at["local"], at["base_local"], at["recent_mean"], at["recent_low"], at["display"]) == (4.0, 2.0, 4.0, 3.0, 2.0)
    assert rows[3, 0.5]["base_accumulated"] == 9.0 and rows[1, 0.5]["base_local"] is None


def test_staged_tables_share_one_stored_copy(spark):
    files = spark.createDataFrame([(1, "Duel 1 - Challenge - 2024.01.02-10.00.00 Stats.csv", bytearray(b"nothing"))], "player_id long, name string, content binary")
    staged = ingest.stage(stats_document.classify(stats_document.parse(files.unionByName(files)), "UTC"))
    assert all(exchanges(table) == 0 for table in staged.values())
    assert staged["run"].count() == 0


def test_sessions_still_open_are_listed(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, 8, tzinfo=dt.timezone.utc)
    minutes = [0, 10, 100, 110, 300, 310]
    rows = [(i, start + dt.timedelta(minutes=m), 7, "purchase", 1.0, '{"k": 3}') for i, m in enumerate(minutes)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted((r["started_at"].minute, r["runs"]) for r in entry.queries()["T6_live_sessions"](spark, str(tmp_path)).collect())
    assert got == [(0, 2), (0, 2), (40, 2)]
