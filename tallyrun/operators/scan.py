"""Running values over ordered history that stay safe when groups hold most of the rows.

A plain window sends each group to one task. That is the right plan until a group is too large for a task, so every
function here takes a ``Hot`` description of the groups that are: a table of their keys, of any length, joined like any
other. Rows of those groups are dealt into blocks of nearly equal size by ranges of keys and the full order, so that a
group gets as many blocks as its rows need and rows that tie on the leading column are split too. Each block is windowed on
its own, and one summary row per block carries the values of the earlier blocks forward.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

HOT_ROWS = "spark.tallyrun.hotRows"
DEFAULT_HOT_ROWS = 5_000_000

_known: dict[tuple, "Hot | None"] = {}


@dataclass(frozen=True)
class Hot:
    """Groups above the row limit: a table of their keys, and how many blocks all their rows make."""

    keys: tuple[str, ...]
    table: DataFrame  # keys + _n
    blocks: int

    def mark(self, df: DataFrame) -> DataFrame:
        """Adds ``_hot``: true for rows of these groups, else null."""
        listed = self.table.select(*(F.col(k).alias(f"_hot_{k}") for k in self.keys), F.lit(True).alias("_hot"))
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in self.keys))
        return df.join(listed, same, "left").drop(*(f"_hot_{k}" for k in self.keys))


def _is_time(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")


def _bare(name: str) -> str:
    return name.lstrip("-")


def _sort(order: Sequence[str]) -> list[Column]:
    return [F.col(_bare(c)).desc() if c.startswith("-") else F.col(c).asc() for c in order]


def hot_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS, str(DEFAULT_HOT_ROWS)))


def hot_groups(df: DataFrame, keys: Sequence[str], lead: str | None = None) -> Hot | None:
    """Looks for groups above the row limit by one pre-aggregated count over the key columns.

    What is found is remembered per plan. It decides only how the work is split, never the result. ``lead`` is not needed.
    """
    if not keys:
        return None
    known = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), tuple(keys), hot_rows(df))
    if known not in _known:
        _known[known] = _measure(df, tuple(keys), hot_rows(df))
    return _known[known]


def _measure(df: DataFrame, keys: tuple[str, ...], limit: int) -> Hot | None:
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    rows = large.agg(F.sum("_n")).first()[0]
    return None if rows is None else Hot(keys, stored(large), max(2, -(-2 * rows // limit)))


# ---------------------------------------------------------------- running values


@dataclass(frozen=True)
class Step:
    """One running value.

    ``upto`` is where it ends: the "current" row, the row "before" it, all rows with "ties" on the leading order
    column, or only rows strictly "earlier" on it.
    """

    kind: str
    value: Column | None = None
    upto: str = "current"


def position() -> Step:
    return Step("position")


def total(value: Column, upto: str = "current") -> Step:
    return Step("total", value, upto)


def seen(value: Column, upto: str = "current") -> Step:
    """How many non-null values so far."""
    return Step("seen", value, upto)


def highest(value: Column, upto: str = "current") -> Step:
    return Step("highest", value, upto)


def lowest(value: Column, upto: str = "current") -> Step:
    return Step("lowest", value, upto)


def latest(value: Column, upto: str = "current") -> Step:
    """The last non-null value so far."""
    return Step("latest", value, upto)


def previous(value: Column) -> Step:
    """The value on the row before, null included."""
    return Step("previous", value)


def opening(value: Column) -> Step:
    """The value on the group's first row."""
    return Step("opening", value)


def _frame(keys: Sequence[str], order: Sequence[str], upto: str, micros: bool):
    if upto == "ties":
        return Window.partitionBy(*keys).orderBy(*_sort(order[:1]))
    if upto == "earlier":
        lead = F.col(_bare(order[0]))
        lead = F.unix_micros(lead.cast("timestamp")) if micros else lead.cast("bigint")
        by = lead.desc() if order[0].startswith("-") else lead.asc()
        return Window.partitionBy(*keys).orderBy(by).rangeBetween(Window.unboundedPreceding, -1)
    end = 0 if upto == "current" else -1
    return Window.partitionBy(*keys).orderBy(*_sort(order)).rowsBetween(Window.unboundedPreceding, end)


_AGGREGATE = {
    "total": F.sum,
    "seen": F.count,
    "highest": F.max,
    "lowest": F.min,
    "latest": lambda v: F.last(v, ignorenulls=True),
}


def _within(step: Step, keys: Sequence[str], order: Sequence[str], micros: bool) -> Column:
    if step.kind == "position":
        return F.row_number().over(Window.partitionBy(*keys).orderBy(*_sort(order)))
    if step.kind == "previous":
        return F.lag(F.struct(step.value.alias("v"))).over(Window.partitionBy(*keys).orderBy(*_sort(order)))
    if step.kind == "opening":
        return F.first(F.struct(step.value.alias("v"))).over(_frame(keys, order, "current", micros))
    return _AGGREGATE[step.kind](step.value).over(_frame(keys, order, step.upto, micros))


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: Hot | None | str = "auto", **steps: Step
) -> DataFrame:
    """Adds one column per step, computed along ``order`` ("-name" is descending) inside each group of ``keys``.

    Order columns must not be null and should be unique in a group. ``hot.keys`` must be among ``keys``.
    """
    keys, order = list(keys), list(order)
    if hot == "auto":
        hot = hot_groups(df, keys, _bare(order[0]))
    boxed = {"previous", "opening"}
    micros = _is_time(df, _bare(order[0]))
    if hot is None:
        out = df.withColumns({name: _within(step, keys, order, micros) for name, step in steps.items()})
        return out.withColumns({n: F.col(f"`{n}`.v") for n, s in steps.items() if s.kind in boxed} or {})
    marked = hot.mark(df)
    plain = running(marked.where("_hot IS NULL").drop("_hot"), keys, order, None, **steps)
    large = _split(marked.where("_hot").drop("_hot"), keys, order, hot, steps)
    return plain.unionByName(large.select(*df.columns, *(F.col(n).cast(plain.schema[n].dataType).alias(n) for n in steps)))


def _split(df: DataFrame, keys: list[str], order: list[str], hot: Hot, steps: dict[str, Step]) -> DataFrame:
    """``running`` for rows of hot groups only."""
    tied = {n: s for n, s in steps.items() if s.upto in ("ties", "earlier")}
    rest = {n: s for n, s in steps.items() if n not in tied}
    out = _blockwise(df, keys, order, hot, rest) if rest else df
    if not tied:
        return out
    # values up to all or before any of the tied rows: aggregate each value of the leading column, then walk those
    lead, gather = _bare(order[0]), {**_AGGREGATE, "latest": None}
    each = df.groupBy(*keys, lead).agg(*(gather[s.kind](s.value).alias(f"_{n}") for n, s in tied.items()))
    walk = {n: Step("total" if s.kind == "seen" else s.kind, F.col(f"_{n}"), "current" if s.upto == "ties" else "before") for n, s in tied.items()}
    walked = _blockwise(each, keys, order[:1], hot, walk)
    walked = walked.select(*(F.col(k).alias(f"_k_{k}") for k in (*keys, lead)), *(F.coalesce(n, F.lit(0)).alias(n) if s.kind == "seen" else F.col(n) for n, s in tied.items()))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, lead)))
    return out.join(walked, same, "left").drop(*(f"_k_{k}" for k in (*keys, lead)))


_MERGE = {
    "position": F.sum,
    "total": F.sum,
    "seen": F.sum,
    "highest": F.max,
    "lowest": F.min,
    "latest": lambda c: F.last(c, ignorenulls=True),
    "previous": F.last,
    "opening": lambda c: F.first(c, ignorenulls=True),
}


def _blockwise(df: DataFrame, keys: list[str], order: list[str], hot: Hot, steps: dict[str, Step]) -> DataFrame:
    inner = [*keys, "_block"]
    whole = Window.partitionBy(*inner).orderBy(*_sort(order)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def summary(step: Step) -> Column:
        if step.kind == "position":
            return F.count(F.lit(1)).over(whole)
        if step.kind == "previous":
            return F.last(F.struct(step.value.alias("v"))).over(whole)
        if step.kind == "opening":
            return F.first(F.struct(step.value.alias("v"))).over(whole)
        return _AGGREGATE[step.kind](step.value).over(whole)

    dealt = df.repartitionByRange(hot.blocks, *keys, *_sort(order)).withColumn("_block", F.spark_partition_id())
    local = dealt.withColumns(
        {name: _within(step, inner, order, False) for name, step in steps.items()}
        | {f"_all_{name}": summary(step) for name, step in steps.items()}
        | {"_first": F.row_number().over(Window.partitionBy(*inner).orderBy(*_sort(order)))}
    )
    local = stored(local)
    ahead = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = local.where("_first = 1").select(
        *(F.col(k).alias(f"_k_{k}") for k in inner), *(_MERGE[s.kind](F.col(f"_all_{n}")).over(ahead).alias(f"_pre_{n}") for n, s in steps.items()))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in inner))
    joined = local.join(carried, same, "left")

    def combine(name: str, step: Step) -> Column:
        here, before = F.col(f"`{name}`"), F.col(f"_pre_{name}")
        if step.kind in ("position", "seen"):
            return (here + F.coalesce(before, F.lit(0))).cast("int" if step.kind == "position" else "bigint")
        if step.kind == "total":
            return F.coalesce(here + before, here, before)
        if step.kind == "highest":
            return F.greatest(here, before)
        if step.kind == "lowest":
            return F.least(here, before)
        if step.kind == "latest":
            return F.coalesce(here, before)
        if step.kind == "previous":
            return F.coalesce(here, before)["v"]
        return F.coalesce(before, here)["v"]

    return joined.select(*df.columns, *(combine(n, s).alias(n) for n, s in steps.items()))


# ---------------------------------------------------------------- rolling median


def rolling_median(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    window: int,
    out: str = "median",
    full: str | None = "full",
    hot: Hot | None | str = "auto",
) -> DataFrame:
    """Median of the last ``window`` present values; rows without a value get none and do not use up the window.

    Rows of hot groups are numbered, cut into chunks of that number, and each chunk also receives the last
    ``window - 1`` rows of the one before, so every frame is complete inside its chunk.
    """
    keys, order = list(keys), list(order)
    if hot == "auto":
        hot = hot_groups(df, keys, _bare(order[0]))
    flagged = df.withColumn("_absent", F.col(value).isNull())
    groups, along, owner = [*keys, "_absent"], list(order), F.lit(True)
    if hot is not None:
        chunk = max(hot_rows(df), window)
        numbered = running(flagged, groups, order, hot, _pos=position())
        marked = hot.mark(numbered).withColumn("_home", F.when(F.col("_hot"), F.floor((F.col("_pos") - 1) / chunk)).otherwise(F.lit(0)))
        tail = F.col("_hot") & (F.col("_pos") > (F.col("_home") + 1) * chunk - (window - 1))
        flagged = marked.withColumn(
            "_chunk",
            F.explode(F.when(tail, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))),
        )
        groups, along, owner = [*groups, "_chunk"], ["_pos"], F.col("_chunk") == F.col("_home")
    frame = Window.partitionBy(*groups).orderBy(*_sort(along)).rowsBetween(-(window - 1), 0)
    result = flagged.withColumn(out, F.percentile(F.col(value), F.lit(0.5)).over(frame))
    if full:
        result = result.withColumn(full, F.count(F.col(value)).over(frame) == window)
    return result.where(owner).select(*df.columns, out, *([full] if full else []))


# ---------------------------------------------------------------- exact percentiles


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    points: dict[str, float],
    hot: Hot | None | str = "auto",
    **extra: Column,
) -> DataFrame:
    """Exact interpolated percentiles per group at position ``(n - 1) p``, with other aggregates beside them.

    For groups too large for one aggregation buffer the values are counted first (with map-side combine), numbered by
    a running sum along the value, and the two values around each position are picked from that.
    """
    keys = list(keys)
    if hot == "auto":
        hot = hot_groups(df.where(F.col(value).isNotNull()), keys, value)
    exact = {n: F.percentile(F.col(value), F.lit(p)).alias(n) for n, p in points.items()}
    if hot is None:
        return df.groupBy(*keys).agg(*exact.values(), *(c.alias(n) for n, c in extra.items()))
    marked = hot.mark(df)
    normal = marked.where("_hot IS NULL").groupBy(*keys).agg(*exact.values(), *(c.alias(n) for n, c in extra.items()))
    large = marked.where("_hot").drop("_hot")
    picked = counted_percentiles(
        large.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")),
        keys, value, "_n", points, hot,
    )
    if extra:
        picked = large.groupBy(*keys).agg(*(c.alias(n) for n, c in extra.items())).join(picked, keys, "left")
    return normal.unionByName(picked)


def counted_percentiles(
    counts: DataFrame, keys: Sequence[str], value: str, n: str, points: dict[str, float], hot: Hot | None = None
) -> DataFrame:
    """Percentiles from (value, count) rows."""
    keys = list(keys)
    size = counts.groupBy(*keys).agg(F.sum(n).alias("_size"))
    ranked = running(counts, keys, [value], hot, _upto=total(F.col(n))).join(size, keys)
    picks = []
    for name, p in points.items():
        place = (F.col("_size") - 1) * p
        for end, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picks.append(F.min(F.when(F.col("_upto") > rank, F.col(value))).alias(f"_{name}_{end}"))
    folded = ranked.groupBy(*keys, "_size").agg(*picks)
    for name, p in points.items():
        place = (F.col("_size") - 1) * p
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        folded = folded.withColumn(name, lo + (hi - lo) * (place - F.floor(place)))
    return folded.select(*keys, *points)
