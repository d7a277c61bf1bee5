"""Small numeric and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_LIMIT = 1000.0
STALE_DAYS = 30


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def project(kind: Column, budget: Column, rate: Column) -> Column:
    """A spend rate as the score a whole run at that rate would make."""
    return F.when(kind == "race", budget - rate).otherwise(rate)


def display_x(kind: Column, duration: Column, x: Column) -> Column:
    return F.when(kind == "clock", x * duration).otherwise(x * 100)


def race_result(kind: Column, budget: Column, score: Column) -> Column:
    """A race is shown as its time, anything else as its score."""
    return F.when(kind == "race", budget - score).otherwise(score)


def days_between(then: Column, now: Column) -> Column:
    seconds = now.cast("timestamp").cast("double") - then.cast("timestamp").cast("double")
    return F.floor(seconds / 86_400)


def age_text(days: Column) -> Column:
    return (
        F.when(days < 60, F.concat(days.cast("string"), F.lit(" d ago")))
        .when(days < 365, F.concat(F.floor(days / 30.44 + 0.5).cast("string"), F.lit(" mo ago")))
        .otherwise(F.concat(F.floor(days / 365).cast("string"), F.lit(" y ago")))
    )


def lane_position(r: Column, n: Column) -> Column:
    return F.least(F.greatest(r, F.lit(0.0)), n + 1) / (n + 1)


def y_bounds(low: Column, high: Column, nxt: Column, on: Column) -> Column:
    """The drawn range, reaching up to a next rank no further away than half the range."""
    near = on & nxt.isNotNull() & (nxt - high <= 0.5 * (high - low))
    return F.struct(low.alias("lo"), F.when(near, F.greatest(high, nxt)).otherwise(high).alias("hi"))


def array_median(values: Column) -> Column:
    ordered, n = F.array_sort(values), F.size(values)
    mid = F.floor(n / 2).cast("int")
    upper = F.try_element_at(ordered, mid + 1)
    lower = F.when(mid > 0, F.try_element_at(ordered, F.greatest(mid, F.lit(1))))
    return F.when(n == 0, None).when(n % 2 == 1, upper).otherwise((lower + upper) / 2)


def lower_bound(values: Column, target: Column) -> Column:
    """How many entries of a sorted array are below ``target``."""
    return F.size(F.filter(values, lambda v: v < target))
