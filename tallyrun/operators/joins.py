"""Interval and as-of joins as equi joins and ordered scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan


def overlap_join(
    instants: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    at: str,
    start: str,
    end: str,
    slack: str = "INTERVAL 1 SECOND",
    how: str = "inner",
) -> DataFrame:
    """Joins each ``[at, at + slack)`` with the half-open ``[start, end)`` spans it overlaps, on ``keys``.

    Each span is listed under every day it touches and each instant under its own day, so the join is an equi join on
    ``keys`` and day. An instant on a whole second cannot reach a span that begins on a later day, and it has one day,
    so no pair is lost or doubled.
    """
    listed = spans.withColumn(
        "_day", F.explode(F.sequence(F.to_date(start), F.to_date(end)))
    )
    probes = instants.withColumn("_day", F.to_date(at))
    near = (F.col(start) < F.col(at) + F.expr(slack)) & (F.col(end) > F.col(at))
    left, right = probes.alias("p"), listed.alias("s")
    on = F.col("p._day") == F.col("s._day")
    for key in keys:
        on = on & (F.col(f"p.{key}") == F.col(f"s.{key}"))
    kept = [F.col(f"s.{c}") for c in listed.columns if c not in {*keys, "_day"}]
    return left.join(right, on & near, how).select("p.*", *kept).drop("_day")


def between(left: Column, right: Column, x: Column, name: str, clamp: bool = True) -> Column:
    """A value at ``x`` on the line between two points with their place ``at``; see ``interpolate``."""
    slope = (right[name] - left[name]) * (x - left["at"]) / (right["at"] - left["at"])
    value = left[name] + slope
    if clamp:
        return F.when(left.isNull(), right[name]).when(right.isNull(), left[name]).otherwise(value)
    exact = right["at"] == x
    return F.when(right.isNull(), F.lit(None)).when(exact, right[name]).when(left.isNull(), F.lit(None)).otherwise(value)


def interpolate(
    points: DataFrame,
    probes: DataFrame,
    keys: Sequence[str],
    at: str,
    values: Sequence[str],
    index: str = "idx",
    clamp: bool = True,
    hot: scan.Hot | None | str = None,
) -> DataFrame:
    """Each probe's ``values`` on its group's points, linear along ``at``.

    The point used is the first one whose ``at`` reaches the probe's, so a stretch of equal ``at`` resolves to its
    start. With ``clamp`` a probe past either end takes the end's values, otherwise none; then an exact hit reads its own point
    and a null value on either side leaves a null. Probe columns must not be named as values are.

    Keys get new names until all is answered: a union keeps how both its tables lie by a key only under a new name, and then
    points and probes that lie together already are not shuffled.
    """
    keys, values = list(keys), list(values)
    named = [f"_of_{k}" for k in keys]
    renamed = [F.col(k).alias(n) for k, n in zip(keys, named)]
    if isinstance(hot, scan.Hot):
        hot = scan.Hot(tuple(f"_of_{k}" for k in hot.keys), hot.table.withColumnsRenamed({k: f"_of_{k}" for k in hot.keys}), hot.blocks)
    carried = [c for c in probes.columns if c not in {*keys, at}]
    point = F.struct(F.col(at).alias("at"), *(F.col(v).alias(v) for v in values))
    dots = points.select(*renamed, at, F.lit(1).alias("_what"), F.col(index).alias("_i"), point.alias("_point"))
    asks = probes.select(*renamed, at, F.lit(0).alias("_what"), F.lit(0).alias("_i"), F.struct(*carried, F.lit(0).alias("_")).alias("_ask"))
    both = dots.unionByName(asks, allowMissingColumns=True)
    order = [at, "_what", "_i"]
    seen = scan.running(both, named, order, hot, _left=scan.latest(F.col("_point"), "before"))
    seen = scan.running(seen, named, [f"-{c}" for c in order], hot, _right=scan.latest(F.col("_point"), "before"))
    answered = seen.where("_what = 0")
    left, right, x = F.col("_left"), F.col("_right"), F.col(at)

    return answered.select(
        *(F.col(n).alias(k) for k, n in zip(keys, named)), at, *(F.col(f"_ask.{c}").alias(c) for c in carried), *(between(left, right, x, v, clamp).alias(v) for v in values)
    )


def content_join(perf: DataFrame, runs: DataFrame, window_s: int = 86_400) -> DataFrame:
    """Matches performance files to runs by what they hold: scenario, shots and hits, within a coarse stretch of time.

    Time is cut into cells as long as the stretch and joined with the content, a file with its own cell and the two beside
    it, so that runs with the same sums at other times never meet.
    """
    keys = ["player_id", "hash", "shots", "hits", "_cell"]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    cell = lambda c: F.floor(micros(c) / F.lit(window_s * 1_000_000))
    left = perf.withColumn("_cell", F.explode(F.array(cell("at") - 1, cell("at"), cell("at") + 1)))
    apart = F.abs(micros("written_at") - micros("at"))
    return left.join(runs.withColumn("_cell", cell("written_at")), keys).where(apart <= window_s * 1_000_000).select("perf_id", "run_id")
