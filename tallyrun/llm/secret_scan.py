"""Secret scans with multipart credential linking, in DataFrame functions only.

Regular expressions find spans of every kind in the whole text; a span's place is the sum of what ``split`` and
``regexp_extract_all`` return before it. Identifiers, secrets and endpoints then meet in an interval join: the scope around
an identifier is cut into cells, a weak candidate looks into its own cell, and a semi join keeps it only where the
complementary parts are there. No pair of parts is ever put out, and a cell bounds what meets.

Kinds: ``assign``, ``access`` and ``hex`` are always reported. ``key40`` (a run of exactly 40 base64 letters) is weak and
reported with an ``access`` identifier in scope; ``endpoint`` (an address) is weak and reported with an ``access``
identifier and a secret (``assign``, ``hex`` or a reported ``key40``) in scope.

Defined cases: a null or empty text has no spans; a text of any length is read whole; equal rows are each answered, also
under one key or a null key; an empty table gives an empty result; other columns are not looked at by ``scan`` and kept by
``redacted``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Fixed patterns. Kind, pattern, group whose length counts, fewest and most letters of it.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, None),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, None),
    ("hex", r"[0-9a-f]{32,}", 0, 32, None),
    ("key40", r"[A-Za-z0-9/+]{40,}", 0, 40, 40),
    ("endpoint", r"https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", 0, 12, None),
)
BASE = ("assign", "access", "hex")
SCOPE = 400
MARK = "[secret]"


def _places(text: Column, pattern: str, group: int) -> Column:
    """array<struct<gap, length, value>>: letters before each match since the last one, of the match, of its group."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("b"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("c"))
    return F.transform(zipped, lambda x: F.struct(F.length(x["a"]).alias("gap"), F.length(x["b"]).alias("length"), F.length(x["c"]).alias("value")))


def found(rows: DataFrame, text: str, *carried: str) -> DataFrame:
    """(row, carried columns, found): what every pattern matches. Rows are numbered and written in one pass, since another
    reading of the input may number them otherwise."""
    c = F.col(f"`{text}`")
    each = [F.struct(F.lit(kind).alias("kind"), F.when(c.rlike(p), _places(c, p, group)).alias("places")) for kind, p, group, _, _ in KINDS]
    number = F.col("row") if "row" in carried else F.monotonically_increasing_id().alias("row")
    return stored(rows.select(number, *[F.col(f"`{x}`") for x in carried if x != "row"], F.filter(F.array(*each), lambda x: x["places"].isNotNull()).alias("found")))


def _parts(matches: DataFrame) -> DataFrame:
    """(row, kind, start, end) of all parts, weak ones too."""
    one = matches.select("row", F.explode("found").alias("x")).select("row", "x.kind", F.posexplode("x.places").alias("n", "p")).where("p.length IS NOT NULL")
    before = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = one.withColumn("end", F.sum(F.col("p.gap") + F.col("p.length")).over(before))
    fits = F.lit(False)
    for kind, _, _, least, most in KINDS:
        fits |= (F.col("kind") == kind) & (F.col("p.value") >= least) & (F.col("p.value") <= most if most else F.lit(True))
    return placed.where(fits).select("row", "kind", (F.col("end") - F.col("p.length")).alias("start"), "end")


def _in_scope(weak: DataFrame, parts: DataFrame, scope: int) -> DataFrame:
    """Rows of ``weak`` that start within ``scope`` letters of one of ``parts`` in the same text."""
    cells = F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))
    near = parts.select(F.col("row").alias("r"), (F.col("start") - scope).alias("low"), (F.col("end") + scope).alias("high"), F.explode(cells).alias("cell"))
    inside = (F.col("row") == F.col("r")) & (F.floor(F.col("start") / scope) == F.col("cell")) & (F.col("start") >= F.col("low")) & (F.col("start") <= F.col("high"))
    return weak.join(near, inside, "left_semi")


def spans(matches: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, kind, start, end) of everything reported in what ``found`` returns."""
    parts = stored(_parts(matches))
    kind = lambda *k: parts.where(F.col("kind").isin(*k))
    access = kind("access")
    keys = _in_scope(kind("key40"), access, scope)
    secrets = kind("assign", "hex").unionByName(keys)
    ends = _in_scope(_in_scope(kind("endpoint"), access, scope), secrets, scope)
    return kind(*BASE).unionByName(keys).unionByName(ends)


def _listed(of: Column) -> Column:
    """kind:start:end, by start, then by kind as listed."""
    return F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(of), lambda x: x.isNotNull())), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: key, n_assign, n_access, n_hex, base (its base spans), spans (all)."""
    matches = found(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "text", "key")
    rank = F.expr("CASE kind " + " ".join(f"WHEN '{k[0]}' THEN {i}" for i, k in enumerate(KINDS)) + " END")
    span = F.struct(F.col("start"), rank.alias("rank"), F.col("end"), F.col("kind"))
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE]
    by_row = spans(matches, scope).groupBy("row").agg(*counts, _listed(F.when(F.col("kind").isin(*BASE), span)).alias("base"), _listed(span).alias("spans"))
    none = {**{f"n_{k}": F.coalesce(f"n_{k}", F.lit(0)) for k in BASE}, "base": F.coalesce("base", F.lit("")), "spans": F.coalesce("spans", F.lit(""))}
    return matches.select("row", "key").join(by_row, "row", "left").withColumns(none).select(F.col("key").alias(key), *none)


def redacted(docs: DataFrame, text: str = "text", count: str | None = None, scope: int = SCOPE, mark: str = MARK) -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``; ``count`` names a column that holds the text's length."""
    columns = docs.columns
    tag = "row" if "row" not in columns else "row_" + "_".join(columns)
    rows = stored(docs.withColumn(tag, F.monotonically_increasing_id()))
    reported = spans(found(rows.select(F.col(f"`{tag}`").alias("row"), F.col(f"`{text}`").alias("text")), "text", "row"), scope)
    order = Window.partitionBy("row").orderBy("start", "end")
    ended = reported.withColumn("before", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    merged = ended.withColumn("part", F.sum(F.when(F.col("start") < F.col("before"), 0).otherwise(1)).over(order)).groupBy("row", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cut = merged.withColumn("from", F.lag("end", 1, 0).over(Window.partitionBy("row").orderBy("start")))
    cuts = cut.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("from", "start"))).alias("cuts"), F.max("end").alias("last")).withColumnRenamed("row", tag)
    t = F.col(f"`{text}`")
    kept = F.concat(F.transform("cuts", lambda x: t.substr((x["from"] + 1).cast("int"), (x["start"] - x["from"]).cast("int"))), F.array(t.substr((F.col("last") + 1).cast("int"), F.length(t))))
    out = rows.join(cuts, tag, "left").withColumn(text, F.when(F.col("cuts").isNull(), t).otherwise(F.array_join(kept, mark)))
    if count and count in columns:
        out = out.withColumn(count, F.when(F.col("cuts").isNull(), F.col(f"`{count}`")).otherwise(F.length(t).cast(docs.schema[count].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in columns])
