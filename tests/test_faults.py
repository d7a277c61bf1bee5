"""Faults of documents and ladders, as codes with their place."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrun.functions import ladder
from tallyrun.functions.faults import fault, first_null, told
from tallyrun.sources import stats_document as doc

WEAPONS = "Weapon,Shots,Hits,Damage Done,Damage Possible,,Sens Scale"
KILL = "1,10:00:00.000,bot,gun,0.5s,3,2,0.6,10,20,1,0,0"


def found(spark, *lines: str, name: str = "x - Challenge - 2026.01.01-10.00.00 Stats.csv"):
    files = spark.createDataFrame([(name, "\n".join(lines).encode())], "name string, content binary")
    return [tuple(e) for e in doc.classify(doc.parse(files), "UTC").first()["errors"]]


def test_text_of_a_fault(spark):
    rows = spark.createDataFrame([("a", 3), ("b", None)], "k string, n int")
    text = told(F.when(F.col("k") == "a", fault("some.code", F.lit(4), F.col("k"), F.col("n"))))
    empty = first_null({"k": F.col("k"), "n": F.col("n")})
    assert [tuple(r) for r in rows.select(text, empty).collect()] == [("some.code line=4 key=a value=3", None), (None, "n")]


def test_sections_that_are_not_there(spark):
    assert found(spark, "nothing")[0] == ("kills.absent", None, None, None)
    assert found(spark, "", doc.KILL_HEADER, KILL)[0] == ("weapons.absent", None, None, None)
    other = doc.KILL_HEADER + ",More"
    assert found(spark, "", other, KILL, WEAPONS)[0] == ("kills.columns", 2, None, other)


def test_rows_name_their_line_and_column(spark):
    got = found(spark, doc.KILL_HEADER, KILL, KILL.replace(",3,", ",three,"), KILL + ",14", KILL.replace("10:00:00.000", "soon"), "", WEAPONS, "gun,1,1,1", "gun,1,1,1,x,", "",
                "Score:,high", "Hide Gun:,maybe", "Scenario:,s", "Hash:,h", "Challenge Start:,10:00:00.000")
    assert ("kill.not_number", 3, "shots", None) in got and ("kill.width", 4, None, "14") in got
    assert ("kill.not_clock", 5, None, "soon") in got
    assert ("weapon.width", 8, None, "4") in got and ("weapon.not_number", 9, "damage_possible", None) in got
    assert ("key.not_number", None, "Score", "high") in got and ("key.not_flag", None, "Hide Gun", "maybe") in got
    assert ("key.absent", None, "Kills", None) in got and ("key.absent", None, "Score", None) not in got


def test_undated_name_and_empty_weapons(spark):
    got = found(spark, doc.KILL_HEADER, "", WEAPONS, "", name="x.csv")
    assert ("weapons.empty", 3, None, None) in got and ("name.undated", None, None, "x.csv") in got


def test_ladders(spark):
    rows = spark.createDataFrame([([],), ([1.0, None],), ([2.0, 1.0],), ([1.0, 1.0],), ([1.0],), ([1.0, 2.0],)], "t array<double>")
    got = [r[0] for r in rows.select(ladder.ladder_problem(F.col("t"))).collect()]
    assert got == ["ladder.empty", "ladder.not_number", "ladder.falls", "ladder.flat", None, None]
