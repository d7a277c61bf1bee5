"""Findings of round 3 on seconds: how keys, lines and clock texts of stat documents are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrun.functions import clock
from tallyrun.sources import stats_document as sd

KILL = "1,10:00:01.500, bot ,gun,0.5s,3,2,0.667,1,1,1,0,0"


def document(more=(), without=(), start="", newline="\r\n"):
    keys = {k: "1" for k in [*sd.TOTALS, *sd.NUMBERS, *sd.TEXTS]} | {"Hide Gun": "true", "Challenge Start": "10:00:00.000"}
    lines = [sd.KILL_HEADER, KILL, "", "Weapon,Shots,Hits", "gun,3,2,1,1,", "", *(f"{k}:,{v}" for k, v in keys.items() if k not in without), *more]
    return bytearray((start + newline.join(lines)).encode())


def parsed(spark, *documents):
    rows = [(i, f"Duel {i} - Challenge - 2024.01.02-10.01.00 Stats.csv", d) for i, d in enumerate(documents)]
    return sd.parse(spark.createDataFrame(rows, "id int, name string, content binary"))


def test_keys_are_not_compared_one_call_at_a_time(spark):
    plan = parsed(spark, document()).drop("content")._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" not in plan and "regexp_extract" not in plan


def test_values_of_keys(spark):
    odd = ["Score:,7", "Scenario:,a, b:,c", "Deaths", "Da,Score:,9", ":,x", "Score,3", "FOV:,"]
    got = parsed(spark, document(odd), document(odd, newline="\n", start="﻿"), document(without=["Score", "DPI"]), document(["Kills:,x"]), None).orderBy("id").collect()
    for r in got[:2]:
        assert r["errors"] == [] and (r["totals"]["score"], r["settings"]["scenario"], r["totals"]["deaths"], r["settings"]["fov"]) == (7.0, "a, b:,c", 1.0, 0.0)
        assert (r["kills"][0]["ttk"], r["kills"][0]["at_ms"], r["kills"][0]["bot"], len(r["weapons"])) == (0.5, 36_001_500, " bot ", 1)
    assert [(e["code"], e["key"]) for e in got[2]["errors"]] == [("key.absent", "Score"), ("key.absent", "DPI")] and got[2]["totals"]["score"] is None
    assert [(e["code"], e["key"], e["value"]) for e in got[3]["errors"]] == [("key.not_number", "Kills", "x")]
    assert got[4]["kills"] is None and got[4]["totals"]["score"] is None


def test_clock_texts(spark):
    texts = ["10:00:01.500", "99:99:99.999", "1:00:01.500", "10:00:01.5000", "10:00:01,500", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(clock.clock_ms(F.col("t")).alias("ms")).collect()
    assert [r["ms"] for r in rows] == [36_001_500, 362_439_999, None, None, None, None, None]
