from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from tallyrun.operators import reports
from tallyrun.sources import ingest, sinks


def test_settings_that_share_an_id_are_found(spark):
    base = {c: "1" for c in ingest.CONFIG}
    other = base | {ingest.CONFIG[-1]: None}
    schema = ", ".join(f"{c} string" for c in ingest.CONFIG)
    rows = lambda xs: spark.createDataFrame([(1, n, *(x[c] for c in ingest.CONFIG)) for n, x in xs], f"player_id long, file_stem string, {schema}")
    run = spark.createDataFrame([(1, "a", 7), (1, "b", 7), (1, "c", 8)], "player_id long, file_stem string, config_id long")
    config = rows([("x", base), ("y", other)]).drop("player_id").withColumn("config_id", F.when(F.col("file_stem") == "x", 7).otherwise(8).cast("long")).drop("file_stem")
    staged = rows([("a", base), ("b", other), ("c", other)])
    assert [tuple(r) for r in ingest.check_config(run, staged, config).collect()] == [(1, "b", 7)]


def test_catalogue_is_written_in_order(spark):
    benchmark = spark.createDataFrame([(i, f"b{i}") for i in (3, 1, 2, 0)], "position int, name string")
    ladder = spark.createDataFrame([("t", 1), ("s", 2), ("s", 1)], "scenario_name string, candidate_order int")
    root = tempfile.mkdtemp()
    sinks.write_catalogue(benchmark, ladder, root)
    assert sorted(r["position"] for r in spark.read.json(f"{root}/benchmark").collect()) == [0, 1, 2, 3]
    assert sorted((r["scenario_name"], r["candidate_order"]) for r in spark.read.json(f"{root}/ladder").collect()) == [("s", 1), ("s", 2), ("t", 1)]


def test_sketch_is_near_the_exact_distribution(spark):
    rows = spark.range(10_000).select(F.lit(1).alias("player_id"), (F.col("id") % 3).alias("scenario_id"), F.col("id").cast("double").alias("score"))
    exact = {r["scenario_id"]: r for r in reports.distribution(rows).collect()}
    for r in reports.distribution_sketch(rows, 1000).collect():
        of = exact[r["scenario_id"]]
        assert (r["n"], r["best"]) == (of["n"], of["best"]) and abs(r["p50"] - of["p50"]) <= 20 and abs(r["p90"] - of["p90"]) <= 20
