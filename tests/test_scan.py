"""Ordered scans give the same rows whether or not groups are split, on data with one dominant group."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyrun.operators import scan


def rows(n=1200, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = 1 if rnd.random() < 0.7 else rnd.randint(2, 6)
        out.append((key, rnd.randint(0, n // 3), i, None if rnd.random() < 0.2 else round(rnd.random() * 50, 2)))
    return out


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(), "k int, t int, id int, v double").cache()


@pytest.fixture
def hot(spark, data):
    spark.conf.set(scan.HOT_ROWS, "100")
    found = scan._measure(data, ("k",), 100)
    yield found
    spark.conf.unset(scan.HOT_ROWS)


def steps():
    return {
        "n": scan.position(), "s": scan.total(F.col("v")), "sb": scan.total(F.col("v"), "before"), "c": scan.seen(F.col("v")),
        "hi": scan.highest(F.col("v"), "before"), "ht": scan.highest(F.col("v"), "ties"), "he": scan.highest(F.col("v"), "earlier"),
        "lo": scan.lowest(F.col("v")), "l": scan.latest(F.col("v"), "before"), "p": scan.previous(F.col("v")), "o": scan.opening(F.col("id")),
    }


def table(df):
    return sorted(tuple(None if x is None else round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_hot_groups_are_found_and_cut(hot):
    assert 1 in {r["k"] for r in hot.table.collect()} and hot.blocks > 10


def blocks_of(spark, monkeypatch, df, keys, order, limit):
    """Rows of each (group, block) of the tables that running values store."""
    kept = []
    monkeypatch.setattr(scan, "stored", lambda x, real=scan.stored: kept.append(real(x)) or kept[-1])
    spark.conf.set(scan.HOT_ROWS, str(limit))
    try:
        out = scan.running(df, keys, order, "auto", n=scan.position(), e=scan.highest(F.col("v"), "earlier"))
        plain = scan.running(df, keys, order, None, n=scan.position(), e=scan.highest(F.col("v"), "earlier"))
        assert out.exceptAll(plain).isEmpty() and plain.exceptAll(out).isEmpty()
    finally:
        spark.conf.unset(scan.HOT_ROWS)
    return [max(r["count"] for r in k.groupBy(*keys, "_block").count().collect()) for k in kept if "_block" in k.columns], kept


def test_more_than_a_thousand_hot_groups(spark, monkeypatch):
    df = spark.range(30_000).select((F.col("id") % 1500).alias("k"), F.col("id").alias("t"), F.col("id").alias("id"), (F.hash("id") % 50).cast("double").alias("v"))
    most, kept = blocks_of(spark, monkeypatch, df, ["k"], ["t", "id"], 15)
    assert kept[0].count() == 1500 and most and max(most) <= 20


def test_tied_rows_are_split(spark, monkeypatch):
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).alias("t"), F.col("id").alias("id"), F.col("id").cast("double").alias("v"))
    most, _ = blocks_of(spark, monkeypatch, df, ["k"], ["t", "id"], 1000)
    assert most and max(most) <= 1500


@pytest.mark.parametrize("order", [["t", "id"], ["-t", "-id"], ["-t", "id"]])
def test_running_is_the_same_split_or_not(data, hot, order):
    plain = scan.running(data, ["k"], order, None, **steps())
    split = scan.running(data, ["k"], order, hot, **steps())
    assert plain.columns == split.columns
    assert table(plain) == table(split)


def test_running_under_finer_keys(data, hot):
    finer = data.withColumn("m", F.col("id") % 2)
    assert table(scan.running(finer, ["k", "m"], ["t", "id"], None, **steps())) == table(
        scan.running(finer, ["k", "m"], ["t", "id"], hot, **steps())
    )


def test_running_against_a_loop(data):
    got = {(r["k"], r["id"]): r for r in scan.running(data, ["k"], ["t", "id"], None, **steps()).collect()}
    for k in {r[0] for r in rows()}:
        seen = []
        for key, t, i, v in sorted((r for r in rows() if r[0] == k), key=lambda r: (r[1], r[2])):
            r = got[(k, i)]
            before = [x[3] for x in seen if x[3] is not None]
            assert r["n"] == len(seen) + 1
            assert r["hi"] == (max(before) if before else None)
            assert r["l"] == (before[-1] if before else None)
            earlier = [x[3] for x in seen if x[1] < t and x[3] is not None]
            assert r["he"] == (max(earlier) if earlier else None)
            seen.append((key, t, i, v))


def test_rolling_median_split_or_not_and_against_a_loop(data, hot):
    plain = scan.rolling_median(data, ["k"], ["t", "id"], "v", 7, hot=None)
    split = scan.rolling_median(data, ["k"], ["t", "id"], "v", 7, hot=hot)
    assert table(plain) == table(split)
    got = {r["id"]: r for r in plain.collect()}
    tail = []
    for _, _, i, v in sorted((r for r in rows() if r[0] == 1), key=lambda r: (r[1], r[2])):
        if v is None:
            assert got[i]["median"] is None and not got[i]["full"]
            continue
        tail = [*tail, v][-7:]
        assert got[i]["median"] == pytest.approx(statistics.median(tail))
        assert got[i]["full"] == (len(tail) == 7)


def test_percentiles_split_or_not(data, spark):
    spark.conf.set(scan.HOT_ROWS, "100")
    try:
        hot = scan._measure(data.where("v IS NOT NULL"), ("k",), 100)
        points = {"a": 0.1, "b": 0.5, "c": 0.9, "d": 1.0}
        args = (data, ["k"], "v", points)
        plain = scan.percentiles(*args, hot=None, n=F.count(F.lit(1)))
        split = scan.percentiles(*args, hot=hot, n=F.count(F.lit(1)))
        assert table(plain) == table(split.select(*plain.columns))
    finally:
        spark.conf.unset(scan.HOT_ROWS)


def test_null_keys_are_split_too(spark, monkeypatch):
    df = spark.range(4000).select(F.lit(None).cast("int").alias("k"), F.col("id").alias("t"), F.col("id").alias("id"), F.col("id").cast("double").alias("v"))
    most, _ = blocks_of(spark, monkeypatch, df, ["k"], ["t", "id"], 500)
    assert most and max(most) <= 600


def test_small_groups_make_no_list(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert scan.hot_groups(df, ["user_id"], "ts") is None
