"""Percentiles without the own run, against every owner's own list of the others' values."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrun.operators import reports, scan

WANTED = {"v": {"p50": 0.5, "p90": 0.9, "low": 0.0}, "w": {"q30": 0.3, "top": 1.0}}
random.seed(5)
#: Owners with many, one and no values, tied values, a group of one owner, and one with values of one column only.
ROWS = [(g, random.randrange(9), random.choice([None, 1.0, 2.5, random.random()]), random.choice([None, random.random()])) for g in (1, 1, 1, 2) for _ in range(90)]
ROWS += [(3, 1, 4.0, 1.0), (3, 1, 5.0, None), (4, 1, None, 2.0), (4, 2, None, 3.0), (4, 3, None, None)]


def expected():
    out = {}
    for g, o in {r[:2] for r in ROWS}:
        row, n = {}, None
        for at, (c, points) in enumerate(WANTED.items()):
            rest = [r[2 + at] for r in ROWS if r[0] == g and r[1] != o and r[2 + at] is not None]
            n = (len(rest) or None) if at == 0 else n
            row |= {k: float(np.quantile(rest, p)) if rest else None for k, p in points.items()}
        if any(x is not None for x in row.values()):
            out[g, o] = row | {"others": n}
    return out


@pytest.mark.parametrize("limit", [None, 40])
def test_others_by_brute_force(spark, limit):
    df = spark.createDataFrame(ROWS, "g int, o int, v double, w double")
    if limit:
        spark.conf.set(scan.HOT_ROWS, str(limit))
    try:
        hot = scan._measure(df, ("g",), limit) if limit else None
        assert limit is None or hot.table.count() == 2
        got = reports.percentiles_of_others(df, ["g"], "o", WANTED, hot=hot).collect()
    finally:
        spark.conf.unset(scan.HOT_ROWS)
    want = expected()
    assert len(got) == len(want)
    for r in got:
        for k, x in want[r["g"], r["o"]].items():
            assert r[k] == (x if x is None else pytest.approx(x)), (r, k)


def test_one_numbering_for_all_measures(spark):
    """The breakdown of bots stays within fifteen exchanges, and no owner's values become a list."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    kills = spark.range(200).select(
        (F.col("id") % 20).alias("run_id"), F.lit("b").alias("bot"), F.rand(1).alias("ttk"), F.lit(3).alias("shots"), F.lit(1).alias("hits"),
        *(F.lit(1.0).alias(c) for c in ("damage_done", "damage_possible")), F.lit(0).alias("overshots"))
    runs = spark.range(20).select("id", F.lit(1).alias("player_id"), F.lit(1).alias("scenario_id"))
    try:
        for k, v in zip(old, ("-1", "false")):
            spark.conf.set(k, v)
        plan = reports.bot_breakdown(reports.bot_rollup(kills), runs)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") <= 15 and "collect_list" not in plan
