"""URL filters by a temporal list join, in DataFrame functions only.

A list's dated entries (added or removed) become validity intervals of each pattern. A capture has a bounded number of
candidate patterns: its address, its path's prefixes, its host and the host's parent domains. Candidates that no list ever
held are dropped; the others meet their list's states in an as-of join: states are carried to the start of every time
bucket in which their pattern is asked for, captures and states of one list, pattern, bucket and salt stand in one ordered
group, and each capture takes the last state at or before its fetch time. Time buckets split a host however many captures
it has; a bucket with very many gets as many salts as it needs, and its states are copied to each.

Patterns: ``url`` (host and path, equal), ``path`` (host and a path prefix that ends at /), ``host`` (equal), ``domain``
(the host or any of its subdomains). The most specific active entry decides; among equals "allow" goes before "block".

Defined cases: a null or unreadable address or a null fetch time has no candidates and no verdict; several changes of a
pattern at one time take effect as one, the removal last; an entry active from the start has its date before all captures;
equal captures are each answered; empty tables give empty results or no hits; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

BUCKET_SECONDS = 7 * 86_400
#: Captures of one pattern and bucket that stand in one group.
GROUP_ROWS = 200_000
#: From the most specific to the least.
KINDS = ("url", "path", "host", "domain")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)


def candidates(h: Column, p: Column) -> Column:
    """array<struct<kind, pattern>> of all list patterns that can match an address."""
    labels, steps = F.split(h, r"\."), F.split(p, "/")
    ways = F.sequence(F.lit(1), F.size(labels))
    domains = F.transform(ways, lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    prefixes = F.filter(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(F.lit("path").alias("kind"), F.concat(h, F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")).alias("pattern"))), lambda x: F.startswith(F.concat(h, p, F.lit("/")), x["pattern"]))
    single = F.array(F.struct(F.lit("url").alias("kind"), F.concat(h, p).alias("pattern")), F.struct(F.lit("host").alias("kind"), h.alias("pattern")))
    return F.when(h != "", F.concat(single, prefixes, domains))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, verdict, low, high) from dated entries (list, kind, pattern, verdict, action, at); ``at`` and bounds are seconds, ``high`` open or null."""
    at_once = entries.where("at IS NOT NULL").groupBy("list", "kind", "pattern", "at").agg(F.min_by("verdict", F.struct("action", "verdict")).alias("verdict"), (F.max("action") == "add").alias("on"))
    nxt = F.lead("at").over(Window.partitionBy("list", "kind", "pattern").orderBy("at"))
    return at_once.withColumn("high", nxt).where("on").select("list", "kind", "pattern", "verdict", F.col("at").alias("low"), "high")


def evaluate(captures: DataFrame, entries: DataFrame, key: str, url: str, at: str, bucket: int = BUCKET_SECONDS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(key, url, at, host, verdict, decided_by, n_active): one row per capture. ``at`` is in seconds."""
    rows = captures.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.col(f"`{at}`").cast("long").alias("at"))
    rows = stored(rows.withColumn("host", F.coalesce(host(F.col("url")), F.lit(""))))
    valid = stored(intervals(entries))
    first, last = rows.agg(F.min("at"), F.max("at")).first()
    pattern, group = ["list", "kind", "pattern"], ["list", "kind", "pattern", "bucket"]
    asked = rows.where("at IS NOT NULL").select("row", "at", F.explode(candidates(F.col("host"), path(F.col("url")))).alias("c")).select("row", "at", "c.kind", "c.pattern")
    asked = asked.join(valid.select(*pattern).distinct(), ["kind", "pattern"]).withColumn("bucket", F.floor(F.col("at") / bucket))
    groups = stored(asked.groupBy(*group).agg(F.ceil(F.count("*") / group_rows).alias("salts")))
    asked = asked.join(groups, group).select(*group, F.pmod(F.xxhash64("row"), F.col("salts")).alias("salt"), "at", F.lit(1).alias("asks"), "row", F.lit(None).cast("struct<verdict:string,high:bigint>").alias("state"))
    begins, ends = F.greatest("low", F.lit(first)), F.least(F.coalesce(F.col("high") - 1, F.lit(last)), F.lit(last))
    carried = valid.join(groups.select(*pattern).distinct(), pattern, "left_semi").where(begins <= ends).withColumn("bucket", F.explode(F.sequence(F.floor(begins / bucket), F.floor(ends / bucket))))
    carried = carried.join(groups, group).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    states = carried.select(*group, "salt", F.greatest("low", F.col("bucket") * bucket).alias("at"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("row"), F.struct("verdict", "high").alias("state"))
    order = Window.partitionBy("list", "kind", "pattern", "bucket", "salt").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    met = asked.unionByName(states).withColumn("state", F.last("state", True).over(order))
    active = met.where("asks = 1 AND state IS NOT NULL AND (state.high IS NULL OR at < state.high)")
    rank = F.expr("CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END")
    strength = F.struct(rank.alias("rank"), (-F.length("pattern")).alias("length"), F.col("state.verdict").alias("verdict"), F.col("list"), F.col("kind"), F.col("pattern"))
    decided = active.groupBy("row").agg(F.min(strength).alias("by"), F.count("*").alias("n_active"))
    by = F.concat_ws("|", "by.list", "by.kind", "by.pattern")
    return rows.join(decided, "row", "left").select(
        F.col("key").alias(key), F.col("url").alias(url), F.col("at").alias(at), F.col("host").alias("host"), F.coalesce("by.verdict", F.lit("none")).alias("verdict"),
        F.when(F.col("by").isNotNull(), by).otherwise("").alias("decided_by"), F.coalesce("n_active", F.lit(0)).alias("n_active"))
