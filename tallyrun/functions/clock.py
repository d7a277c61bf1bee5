"""Wall-clock expressions: file-name times, clock texts and local readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bound import bound

# File-name suffixes, the time at the end of a stem, and a clock text.
SUFFIX = r"( Stats\.csv| Performance\.perf)$"
STEM_TIME = r"(\d{4})\.(\d{2})\.(\d{2})-(\d{2})\.(\d{2})\.(\d{2})$"
CLOCK = r"^(\d{2}):(\d{2}):(\d{2})\.(\d{3})$"

DAY_MS = 86_400_000
#: A run may end this much before it starts by its clocks, which tick apart.
SLACK_MS = 60_000


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, SUFFIX, "")


def stem_date(stem: Column) -> Column:
    parts = [F.regexp_extract(stem, STEM_TIME, i) for i in (1, 2, 3)]
    return F.try_to_date(F.when(stem.rlike(STEM_TIME), F.concat_ws("-", *parts)), "yyyy-MM-dd")


def stem_ms(stem: Column) -> Column:
    """Milliseconds of the day at the end of the second a stem names."""
    h, m, s = (F.regexp_extract(stem, STEM_TIME, i).try_cast("int") for i in (4, 5, 6))
    return F.when(stem.rlike(STEM_TIME), ((h * 60 + m) * 60 + s) * 1000 + 999)


def clock_ms(text: Column) -> Column:
    h, m, s, ms = (F.substring(text, at, n).try_cast("int") for at, n in ((1, 2), (4, 2), (7, 2), (10, 3)))
    return F.when(text.rlike(CLOCK), ((h * 60 + m) * 60 + s) * 1000 + ms)


def _local(day: Column, ms: Column) -> Column:
    """The reading as if it were UTC, in the session's zone, which must be UTC."""
    return F.timestamp_millis(F.unix_date(day).cast("bigint") * DAY_MS + ms.cast("bigint"))


def instants(day: Column, ms: Column, zone: str) -> Column:
    """Every instant a local reading can mean: two in a repeated hour, one otherwise.

    The two offsets in force a day before and a day after are tried; those that read back the same wall time stay. A
    reading that a clock change skips has none, and takes the shifted instant.
    """
    shift = F.expr("INTERVAL 1 DAY")

    def read(wall: Column) -> Column:
        def under(at: Column) -> Column:
            offset = F.unix_micros(F.from_utc_timestamp(at, zone)) - F.unix_micros(at)
            return F.timestamp_micros(F.unix_micros(wall) - offset)

        tried = F.array_sort(F.array_distinct(F.array(under(wall - shift), under(wall + shift))))
        fits = F.filter(tried, lambda t: F.from_utc_timestamp(t, zone) == wall)
        return bound(fits, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.to_utc_timestamp(wall, zone))))

    return bound(_local(day, ms), read)


def span(day: Column, written_ms: Column, start_ms: Column, zone: str) -> Column:
    """The written and started instants that make the shortest run of at least minus one minute.

    The start may be on the day of the write or on the day before; among equals the earliest write, then start, wins.
    """
    writes = instants(day, written_ms, zone)
    starts = F.concat(instants(day, start_ms, zone), instants(F.date_sub(day, 1), start_ms, zone))
    pairs = F.flatten(
        F.transform(
            writes,
            lambda w: F.transform(
                starts,
                lambda s: F.struct(
                    (F.unix_millis(w) - F.unix_millis(s)).alias("ms"), w.alias("written_at"), s.alias("started_at")
                ),
            ),
        )
    )
    return F.array_min(F.filter(pairs, lambda p: p["ms"] >= -SLACK_MS))
