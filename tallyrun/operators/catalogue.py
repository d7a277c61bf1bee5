"""Benchmark catalogue: nested JSON to benchmarks, ladders and category trees.

The index lists benchmarks with their difficulties; a response per difficulty lists scenarios with thresholds. Both are
one JSON text per row, so the ETL is parsing, exploding and windows keyed by difficulty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ladder as rank
from ..functions.faults import fault, told
from ..functions.text import INTEGER_LIKE, family, js_trim, number, season, share_code

CATEGORY = "array<struct<categoryName:string,color:string,subcategories:array<struct<subcategoryName:string,scenarioCount:double,color:string>>>>"
INDEX = (
    "benchmarkName string, hidden boolean, color string, difficulties array<struct<difficultyName:string,"
    "kovaaksBenchmarkId:bigint,sharecode:string,rankColors:map<string,string>,categories:" + CATEGORY + ">>"
)
# Thresholds may be numbers or numeric texts; reading them as text keeps both.
RESPONSE = "categories map<string,struct<scenarios:map<string,struct<rank_maxes:array<string>>>>>"


def difficulties(index: DataFrame) -> DataFrame:
    """One row per shown difficulty of ``index(listed, body)``; ``position`` sorts them as listed."""
    parsed = index.select("listed", F.from_json("body", INDEX).alias("b"))
    shown = parsed.where(~F.coalesce("b.hidden", F.lit(False)))
    rows = shown.select("listed", "b.*", F.posexplode("b.difficulties").alias("at", "d")).drop("difficulties")
    name = js_trim(F.col("benchmarkName"))
    ranks = F.map_entries("d.rankColors")
    return rows.select(
        F.col("d.kovaaksBenchmarkId").alias("benchmark_id"), name.alias("name"), F.col("d.difficultyName").alias("difficulty"),
        "listed", F.struct("listed", "at").alias("position"),
        family(name).alias("family"), season(name).alias("season"), share_code(F.col("d.sharecode")).alias("sharecode"),
        F.coalesce("color", F.lit("")).alias("color"), F.transform(ranks, lambda e: e["key"]).alias("ranks"),
        F.coalesce("d.categories", F.array().cast(CATEGORY)).alias("categories"),
    )


def rank_name_problems(rows: DataFrame) -> DataFrame:
    """Difficulties with a rank name that reads as an integer, which JSON objects do not keep in order."""
    bad = F.filter("ranks", lambda r: r.rlike(INTEGER_LIKE))
    return rows.where(F.size(bad) > 0).select("benchmark_id", F.get(bad, F.lit(0)).alias("rank"))


def require_rank_names(rows: DataFrame) -> DataFrame:
    """The same rows; reading one with an integer-like rank name fails."""
    bad = F.exists("ranks", lambda r: r.rlike(INTEGER_LIKE))
    found = fault("rank.reads_as_number", key=F.col("name"), value=F.array_join("ranks", ","))
    checked = F.when(bad, F.raise_error(told(found)).cast("array<string>")).otherwise(F.col("ranks"))
    return rows.withColumn("ranks", checked)


def listed_scenarios(responses: DataFrame) -> DataFrame:
    """Every scenario of ``responses(benchmark_id, body)`` in order, trimmed, with its thresholds as numbers."""
    parsed = responses.select("benchmark_id", F.from_json("body", RESPONSE).alias("r"))
    cats = parsed.select("benchmark_id", F.posexplode(F.map_entries("r.categories")).alias("c", "e"))
    rows = cats.select("benchmark_id", "c", F.posexplode(F.map_entries("e.value.scenarios")).alias("s", "e"))
    order = Window.partitionBy("benchmark_id").orderBy("c", "s")
    none = F.array().cast("array<string>")
    limits = F.transform(F.coalesce("e.value.rank_maxes", none), number)
    return rows.select(
        "benchmark_id", (F.row_number().over(order) - 1).alias("pos"), js_trim(F.col("e.key")).alias("scenario_name"), limits.alias("thresholds")
    )


def build(index: DataFrame, responses: DataFrame) -> dict[str, DataFrame]:
    """``benchmark``, ``ladder``, ``tree_slot``, and what was left out: ``skipped``, with the fault, and ``treeless``."""
    rows = require_rank_names(difficulties(index))
    flat = listed_scenarios(responses)
    # The first of equal names counts.
    nth = Window.partitionBy("benchmark_id", "scenario_name").orderBy("pos")
    named = flat.withColumn("_n", F.row_number().over(nth)).where("_n = 1").drop("_n")
    lengths = named.groupBy("benchmark_id").agg(
        F.array_sort(F.collect_set(F.size("thresholds"))).alias("lengths"), F.count(F.lit(1)).alias("scenarios")
    )
    checked = rows.join(lengths, "benchmark_id", "left")
    size, about = F.size("ranks"), ["benchmark_id", "name", "difficulty"]
    found = F.array_join(F.transform("lengths", lambda x: x.cast("string")), ",")
    problem = F.when(F.coalesce("scenarios", F.lit(0)) == 0, fault("benchmark.empty")).when(
        (F.size("lengths") != 1) | (F.get("lengths", F.lit(0)) != size), fault("benchmark.uneven", key=size, value=found)
    )
    judged = checked.withColumn("problem", problem)
    usable = judged.where("problem IS NULL").drop("problem")
    rated = named.join(usable.select(*about), "benchmark_id").withColumn("problem", rank.ladder_problem(F.col("thresholds")))
    ladder = rated.where("problem IS NULL").select("benchmark_id", "scenario_name", "pos", "thresholds")
    kept = usable.join(ladder.select("benchmark_id").distinct(), "benchmark_id", "left_semi")
    bad = rated.where("problem IS NOT NULL")
    at = F.array_join(F.transform("thresholds", lambda t: F.coalesce(t.cast("string"), F.lit("?"))), ",")
    skipped = judged.where("problem IS NOT NULL").select(*about, "problem.*").unionByName(
        bad.select(*about, fault(F.col("problem"), key=F.col("scenario_name"), value=at).alias("problem")).select(*about, "problem.*")
    ).drop("line")
    slots, treeless = tree(kept, flat)
    return {"benchmark": kept, "ladder": candidate_order(ladder, kept), "tree_slot": slots, "skipped": skipped, "treeless": treeless}


def candidate_order(ladder: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A scenario's benchmarks: families as first listed, the latest season first, then position."""
    first = benchmark.groupBy("family").agg(F.min("listed").alias("family_order"))
    keys = benchmark.join(first, "family").select("benchmark_id", "family_order", "season", "position")
    place = Window.partitionBy("scenario_name").orderBy("family_order", F.col("season").desc(), "position")
    return ladder.join(keys, "benchmark_id").withColumn("candidate_order", F.row_number().over(place)).drop("family_order", "season", "position")


def tree(benchmark: DataFrame, flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slots cut from the flat scenario list by the categories' counts, and difficulties whose counts do not add up."""
    subs = benchmark.select("benchmark_id", F.posexplode("categories").alias("cat_no", "c")).select(
        "benchmark_id", "cat_no", js_trim(F.col("c.categoryName")).alias("category"), F.posexplode("c.subcategories").alias("s", "sub")
    )
    count: Column = F.col("sub.scenarioCount")
    order = Window.partitionBy("benchmark_id").orderBy("cat_no", "s")
    cut = subs.withColumn("sub_no", F.row_number().over(order) - 1).withColumn("to", F.sum(count).over(order))
    cut = cut.withColumn("from", F.col("to") - count)
    fits = subs.groupBy("benchmark_id").agg(
        F.sum(count).alias("counted"), F.every((count >= 0) & (count == F.floor(count))).alias("whole")
    )
    size = flat.groupBy("benchmark_id").agg(F.count(F.lit(1)).alias("slots"))
    judged = benchmark.select("benchmark_id", "name", "difficulty").join(fits, "benchmark_id", "left").join(size, "benchmark_id")
    adds_up = F.coalesce(F.col("whole") & (F.col("counted") == F.col("slots")), F.lit(False))
    good = judged.where(adds_up).select("benchmark_id")
    # Each subcategory names the positions it covers, which makes the slice an equi join.
    named = cut.where(count > 0).join(good, "benchmark_id", "left_semi").select(
        "benchmark_id", "cat_no", "sub_no", "category", js_trim(F.col("sub.subcategoryName")).alias("subcategory"), "from",
        F.explode(F.sequence(F.col("from").cast("int"), (F.col("to") - 1).cast("int"))).alias("pos"),
    )
    slots = named.join(flat.select("benchmark_id", "pos", "scenario_name"), ["benchmark_id", "pos"]).withColumn(
        "slot_no", (F.col("pos") - F.col("from")).cast("int")
    )
    slots = slots.select("benchmark_id", "cat_no", "sub_no", "slot_no", "category", "subcategory", "scenario_name")
    return slots, judged.where(~adds_up).select("benchmark_id", "name", "difficulty", "counted", "slots")


def content_hash(benchmark: DataFrame, ladder: DataFrame) -> DataFrame:
    """One hash per benchmark over its rows in a stable order."""
    lines = ladder.groupBy("benchmark_id").agg(
        F.array_sort(F.collect_list(F.to_json(F.struct("scenario_name", "candidate_order", "thresholds")))).alias("lines")
    )
    joined = benchmark.select("benchmark_id", "name", "difficulty").join(lines, "benchmark_id", "left")
    return joined.select("benchmark_id", F.sha2(F.to_json(F.struct("name", "difficulty", "lines")), 256).alias("content"))


def stamped(fresh: DataFrame, previous: DataFrame, now: Column) -> DataFrame:
    """Content hashes with their time, kept from ``previous(benchmark_id, content, generated_at)`` when unchanged."""
    old = previous.select("benchmark_id", "content", F.col("generated_at").alias("_then"))
    return fresh.join(old, ["benchmark_id", "content"], "left").select(
        "benchmark_id", "content", F.coalesce("_then", now).alias("generated_at")
    )
