"""Ranks combined through a benchmark's category tree, now and as of every run.

A tree has an overall node, categories and subcategories; subcategories hold slots that name scenarios. A subcategory is
the mean of its slots' ranks, a category the shifted geometric mean of its subcategories, the overall that of its
categories. "provisional" counts what was played, "strict" counts the unplayed as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ladder as rank
from ..functions.numbers import age_text, days_between
from . import scan

WHO = ["player_id", "benchmark_id"]
STATS = ["worst", "p10", "median", "p90", "pb"]
FORM_WINDOW = 10
STALE_DAYS = 30


def tree(slots: DataFrame, ladder: DataFrame, flat_for: DataFrame | None = None) -> DataFrame:
    """Slots with their ladder, null where unrated. Benchmarks in ``flat_for`` without slots get one node of all ladders.

    Each slot carries how many rated members its subcategory, its category and the tree have, so that nothing that is
    worked out per player needs to look them up again.
    """
    if flat_for is not None:
        loose = flat_for.select("benchmark_id").join(slots, "benchmark_id", "left_anti")
        stand_in = ladder.join(loose, "benchmark_id", "left_semi").select(
            "benchmark_id", F.lit(0).alias("cat_no"), F.lit(0).alias("sub_no"),
            (F.row_number().over(Window.partitionBy("benchmark_id").orderBy("scenario_name")) - 1).alias("slot_no"),
            "scenario_name",
        )
        slots = slots.unionByName(stand_in)
    rated = ladder.select("benchmark_id", "scenario_name", "thresholds")
    found = slots.join(rated, ["benchmark_id", "scenario_name"], "left").withColumn("rated", F.col("thresholds").isNotNull())
    held = lambda c: F.when(F.col("rated"), F.col(c))
    whole = Window.partitionBy("benchmark_id")
    sized = found.withColumns({
        "scenarios_in_tree": F.size(F.collect_set(held("scenario_name")).over(whole)),
        "cats_in_tree": F.size(F.collect_set(held("cat_no")).over(whole)),
    })
    sized = sized.withColumn("subs_in_cat", F.size(F.collect_set(held("sub_no")).over(Window.partitionBy("benchmark_id", "cat_no"))))
    return sized.withColumn("slots_in_sub", F.count(held("scenario_name")).over(Window.partitionBy("benchmark_id", "sub_no")))


def node_scenarios(nodes: DataFrame) -> DataFrame:
    """The distinct rated scenarios inside every node."""
    held = nodes.where("rated").select("benchmark_id", "cat_no", "sub_no", "scenario_name")
    listed = F.array(
        F.struct(F.lit("overall").alias("level"), F.lit(0).alias("node_no")),
        F.struct(F.lit("category").alias("level"), F.col("cat_no").alias("node_no")),
        F.struct(F.lit("subcategory").alias("level"), F.col("sub_no").alias("node_no")),
    )
    return held.select("benchmark_id", "scenario_name", F.inline(listed)).distinct()


def coverage(nodes: DataFrame, played: DataFrame) -> DataFrame:
    """Played and total rated scenarios, subcategories and categories, for players with anything played in the tree."""
    rated = nodes.where("rated")

    def count(column: str):
        return F.count_distinct(column)

    total = rated.groupBy("benchmark_id").agg(
        count("scenario_name").alias("scenarios"), count("sub_no").alias("subs"), count("cat_no").alias("categories")
    )
    mine = played.select("player_id", "scenario_name").distinct().join(rated, "scenario_name").groupBy(*WHO).agg(
        count("scenario_name").alias("scenarios_played"), count("sub_no").alias("subs_played"),
        count("cat_no").alias("categories_played"),
    )
    return mine.join(total, "benchmark_id").withColumn("is_full", F.col("scenarios_played") == F.col("scenarios"))


def evaluate(nodes: DataFrame, ranks: DataFrame, mode: str, values: dict[str, str] | None = None) -> DataFrame:
    """Every node's values from ``ranks(player_id, benchmark_id, scenario_name, …)``: ``{name: column of ranks}``, all of
    them in one pass.

    A player's ranks in a tree become a map and meet the tree's slots as one array, neither larger than the tree has
    slots; so ``ranks`` is read once, and every level is worked out where they lie. A scenario has one row of ranks.
    """
    values = values or {"value": "r"}
    slots = nodes.where("rated").groupBy("benchmark_id").agg(F.collect_list(F.struct("cat_no", "sub_no", "scenario_name")).alias("_slots"))
    one = F.struct("scenario_name", F.struct(*(F.col(c).alias(n) for n, c in values.items())))
    mine = ranks.groupBy(*WHO).agg(F.map_from_entries(F.collect_list(one)).alias("_mine"))
    filled = mine.join(slots, "benchmark_id").select(*WHO, "_mine", F.inline("_slots"))
    if mode != "strict":
        filled = filled.where(F.map_contains_key("_mine", F.col("scenario_name")))
    found = F.try_element_at("_mine", F.col("scenario_name"))
    unplayed = F.lit(0.0 if mode == "strict" else None)
    filled = filled.select(*WHO, "cat_no", "sub_no", *(F.coalesce(found[n], unplayed).alias(n) for n in values))

    def node(level: str, number: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), number.cast("int").alias("node_no"), *values)

    # Each level keeps the nodes below it as an array no longer than the tree, so the levels are computed once.
    means = [rank.shifted_mean(F.col(n)).alias(n) for n in values]
    subs = filled.repartition(*WHO).groupBy(*WHO, "cat_no", "sub_no").agg(*(F.avg(n).alias(n) for n in values))
    cats = subs.groupBy(*WHO, "cat_no").agg(*means, F.collect_list(node("subcategory", F.col("sub_no"))).alias("below"))
    every = F.concat(F.array(node("category", F.col("cat_no"))), F.col("below"))
    top = cats.groupBy(*WHO).agg(*means, F.flatten(F.collect_list(every)).alias("below"))
    return top.select(*WHO, F.inline(F.concat(F.array(node("overall", F.lit(0))), F.col("below"))))


# ---------------------------------------------------------------- the stream of rated runs


def events(stream: DataFrame, nodes: DataFrame) -> DataFrame:
    """Runs of rated scenarios, once per benchmark whose tree holds the scenario, with its places in that tree."""
    held = ["benchmark_id", "scenario_name"]
    sizes = ["slots_in_sub", "subs_in_cat", "cats_in_tree"]
    places = nodes.where("rated").groupBy(*held, "cat_no", "sub_no").agg(
        F.count(F.lit(1)).alias("w"), *(F.first(c).alias(c) for c in [*sizes, "thresholds"])
    )
    rated = places.groupBy(*held).agg(
        F.first("thresholds").alias("thresholds"), F.collect_list(F.struct("cat_no", "sub_no", "w", *sizes)).alias("places")
    )
    return stream.join(rated, "scenario_name").select(*WHO, "scenario_name", "scenario_id", "id", "t", "score", "thresholds", "places")


def played_stats(stream: DataFrame) -> DataFrame:
    """Runs, best, last run and the most played version of each scenario name (the first seen on a tie)."""
    per = stream.groupBy("player_id", "scenario_name", "hash").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "id")).alias("first"), F.max("score").alias("pb"),
        F.max(F.struct("t", "id")).alias("last"),
    )
    # Earliest first among equal counts: the smallest of (-n, first).
    return per.groupBy("player_id", "scenario_name").agg(
        F.sum("n").alias("runs"), F.max("pb").alias("pb"), F.max("last.t").alias("last"),
        F.min_by("hash", F.struct(-F.col("n"), "first")).alias("top_hash"),
    )


def as_of_ranks(run_events: DataFrame, window: int = FORM_WINDOW, hot: scan.Hot | None = None) -> DataFrame:
    """The rank of each scenario's best and of its form as they stood after each of its runs.

    Without hot groups the runs are partitioned by player and benchmark once; every later window on a scenario,
    subcategory, category or the whole tree is clustered by that already, so ``history`` needs no other shuffle.
    """
    if hot is None:
        run_events = run_events.repartition(*WHO)
    keys, order = [*WHO, "scenario_name"], ["t", "id"]
    rolled = scan.rolling_median(run_events, keys, order, "score", window, "form", None, hot)
    best = scan.running(rolled, keys, order, hot, best=scan.highest(F.col("score")))
    return best.select(
        *keys, *order, "places",
        rank.fractional_rank(F.col("thresholds"), F.col("best")).alias("r_pb"),
        rank.fractional_rank(F.col("thresholds"), F.col("form")).alias("r_form"),
    )


def history(ranks: DataFrame, mode: str, hot: scan.Hot | None = None) -> DataFrame:
    """Every node's value after each run inside it.

    Each run changes one scenario's rank, so every level is a running sum of the changes one level below: no run is
    combined with the other scenarios. Shifted means are averages of ``ln(1 + x)``, which also add up by changes. Runs
    bring their places in the tree along, so the tree itself is not read again.
    """
    strict, order = mode == "strict", ["t", "id"]
    keys = [*WHO, "scenario_name"]
    was = scan.running(
        ranks, keys, order, hot, _pb=scan.previous(F.col("r_pb")), _form=scan.previous(F.col("r_form")), _n=scan.position()
    )
    zero = F.lit(0.0)
    changes = was.select(
        *keys, *order, "places", (F.col("_n") == 1).cast("int").alias("first"),
        (F.col("r_pb") - F.coalesce("_pb", zero)).alias("d_pb"),
        (F.col("r_form") - F.coalesce("_form", zero)).alias("d_form"),
    )

    def climb(rows: DataFrame, node: list[str], size: str) -> DataFrame:
        """Running means of changes ``d_pb, d_form`` with ``add`` members joining."""
        group = [*WHO, *node]
        summed = scan.running(
            rows, group, order, hot,
            s_pb=scan.total(F.col("d_pb")), s_form=scan.total(F.col("d_form")),
            members=scan.total(F.col("add")), played=scan.total(F.col("first")),
        )
        if strict:
            summed = summed.withColumn("members", F.col(size))
        valued = summed.withColumn("m_pb", F.col("s_pb") / F.col("members")).withColumn(
            "m_form", F.col("s_form") / F.col("members")
        )
        return valued.drop("d_pb", "d_form", "add", "s_pb", "s_form", "members")

    def lift(rows: DataFrame, node: list[str], up: list[str], term: bool) -> DataFrame:
        """Changes of each node's value as changes of its parent: one row per run and parent, the nodes kept below it."""
        value = (lambda c: F.log(F.col(c) + 1)) if term else F.col
        seen = scan.running(
            rows.withColumn("x_pb", value("m_pb")).withColumn("x_form", value("m_form")), [*WHO, *node], order, hot,
            _pb=scan.previous(F.col("x_pb")), _form=scan.previous(F.col("x_form")), _n=scan.position(),
        )
        moved = seen.withColumn("add", (F.col("_n") == 1).cast("int")).withColumns(
            {f"d_{c}": F.col(f"x_{c}") - F.coalesce(f"_{c}", zero) for c in ("pb", "form")}
        )
        return moved.groupBy(*WHO, *up, *order).agg(
            F.max("first").alias("first"), F.sum("add").alias("add"), F.sum("d_pb").alias("d_pb"),
            F.sum("d_form").alias("d_form"), F.flatten(F.collect_list("nodes")).alias("below"),
            F.first("subs_in_cat").alias("subs_in_cat"), F.first("cats_in_tree").alias("cats_in_tree"),
        )

    def shown(df: DataFrame, level: str, number: Column, terms: bool) -> DataFrame:
        read = (lambda c: F.exp(F.col(c)) - 1) if terms else F.col
        own = F.array(
            F.struct(
                F.lit(level).alias("level"), number.cast("int").alias("node_no"),
                read("m_pb").alias("pb"), read("m_form").alias("form"), F.col("played").cast("bigint").alias("played"),
            )
        )
        return df.withColumn("nodes", F.concat(own, F.col("below")) if "below" in df.columns else own)

    placed = changes.select(*WHO, *order, "first", "d_pb", "d_form", F.inline("places")).select(
        *WHO, "cat_no", "sub_no", *order, "first", (F.col("first") * F.col("w")).alias("add"),
        (F.col("d_pb") * F.col("w")).alias("d_pb"), (F.col("d_form") * F.col("w")).alias("d_form"),
        "slots_in_sub", "subs_in_cat", "cats_in_tree",
    )
    sub, cat = ["cat_no", "sub_no"], ["cat_no"]
    subs = shown(climb(placed, sub, "slots_in_sub"), "subcategory", F.col("sub_no"), False)
    cats = shown(climb(lift(subs, sub, cat, True), cat, "subs_in_cat"), "category", F.col("cat_no"), True)
    top = shown(climb(lift(cats, cat, [], False), [], "cats_in_tree"), "overall", F.lit(0), True)
    return top.select(*WHO, *order, F.inline("nodes"))


def value_at(values: DataFrame, probes: DataFrame, mode: str, hot: scan.Hot | None = None) -> DataFrame:
    """Each probed node's value at a run: that of the last run inside it up to then, else its value before any run."""
    node = [*WHO, "level", "node_no"]
    kept = values.select(*node, "t", "id", F.lit(0).alias("_ask"), F.struct("pb", "form").alias("_v"))
    asked = probes.select(*node, "t", "id", F.lit(1).alias("_ask"))
    both = kept.unionByName(asked, allowMissingColumns=True)
    found = scan.running(both, node, ["t", "id", "_ask"], hot, _at=scan.latest(F.col("_v"))).where("_ask = 1")
    start = F.lit(0.0) if mode == "strict" else F.lit(None).cast("double")
    return found.select(
        *node, "t", "id", F.coalesce("_at.pb", start).alias("pb"), F.coalesce("_at.form", start).alias("form")
    )


# ---------------------------------------------------------------- spread and sheet


def spread(run_events: DataFrame, window: int = FORM_WINDOW) -> DataFrame:
    """Worst, 10th, 50th and 90th percentile of the last ``window`` runs and the best of all, as scores and as ranks."""
    keys = [*WHO, "scenario_name"]
    newest = Window.partitionBy(*keys).orderBy(F.col("t").desc(), F.col("id").desc())
    recent = run_events.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= window)
    near = recent.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.max("t").alias("last"), F.min("score").alias("worst"),
        *(F.percentile("score", F.lit(p)).alias(n) for n, p in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("o"), "score"))), lambda x: x["score"]).alias("window"),
        F.first("thresholds").alias("thresholds"),
    )
    best = run_events.groupBy(*keys).agg(F.max("score").alias("pb"))
    joined = near.join(best, keys)
    return joined.withColumns({f"r_{s}": rank.fractional_rank(F.col("thresholds"), F.col(s)) for s in STATS})


def tree_spread(spreads: DataFrame, nodes: DataFrame, mode: str) -> DataFrame:
    """Each statistic taken through the tree on its own."""
    return evaluate(nodes, spreads, mode, {s: f"r_{s}" for s in STATS})


def sheet(nodes: DataFrame, played: DataFrame, spreads: DataFrame, node_spreads: DataFrame, now) -> DataFrame:
    """A benchmark's rows in tree order for each player with anything played in it.

    Scenario rows carry state, spread, whether the window is long enough for a body, age when stale, and the next rank
    above the best; the other levels carry the tree's spread and played counts.
    """
    minus = F.lit(-1)

    def entry(level: str, number: Column, cat: Column, sub: Column) -> Column:
        named = {"node_no": number, "cat_no": cat, "sub_no": sub}
        return F.struct(F.lit(level).alias("level"), *(c.cast("int").alias(n) for n, c in named.items()))

    cat, sub = F.col("cat_no"), F.col("sub_no")
    levels = F.array(entry("overall", F.lit(0), minus, minus), entry("category", cat, cat, minus), entry("subcategory", sub, cat, sub))
    several = (F.size(F.collect_set("cat_no").over(Window.partitionBy("benchmark_id"))) > 1).alias("_several")
    listed = (
        nodes.select("benchmark_id", several, F.when(F.col("rated"), F.col("scenario_name")).alias("_held"), levels.alias("_levels"))
        .select("benchmark_id", "_several", "_held", F.inline("_levels"))
        .where("level <> 'category' OR _several")
        .groupBy("benchmark_id", "level", "node_no", "cat_no", "sub_no")
        .agg(F.size(F.collect_set("_held")).alias("total"))
    )
    # A player's scenarios of a tree, as a map and with their rated places: neither is larger than the tree.
    held = nodes.groupBy("benchmark_id", "scenario_name").agg(
        F.collect_set(F.when(F.col("rated"), F.struct("cat_no", "sub_no"))).alias("_places")
    )
    fact = F.struct(F.col("pb").alias("pb_score"), F.col("runs").alias("all_runs"), F.col("last").alias("last_played"), "top_hash")
    mine = played.join(held, "scenario_name").groupBy(*WHO).agg(
        F.map_from_entries(F.collect_list(F.struct("scenario_name", fact))).alias("_facts"), F.collect_list("_places").alias("_places")
    )

    def inside(place: Column) -> Column:
        return (F.col("level") == "overall") | ((F.col("level") == "category") & (place["cat_no"] == cat)) | (place["sub_no"] == sub)

    node = [*WHO, "level", "node_no"]
    upper = (
        mine.select(*WHO, "_places").join(listed, "benchmark_id")
        .withColumn("played", F.size(F.filter("_places", lambda at: F.exists(at, inside))))
        .join(node_spreads, node, "left")
        .select(
            *WHO, "level", "cat_no", "sub_no", minus.alias("slot_no"), F.lit(None).cast("string").alias("scenario_name"),
            F.when(F.col("pb").isNotNull(), "played").otherwise("unplayed").alias("state"),
            *(F.col(s).alias(f"r_{s}") for s in STATS), F.col("pb").isNotNull().alias("body"), "played", "total",
        )
    )
    candles = spreads.select(*WHO, "scenario_name", "runs", "last", *(f"r_{s}" for s in STATS))
    slots = (
        mine.select(*WHO, "_facts").join(nodes, "benchmark_id")
        .withColumn("_fact", F.try_element_at("_facts", F.col("scenario_name")))
        .select(*WHO, *(c for c in nodes.columns if c != "benchmark_id"), "_fact.*")
        .join(candles, [*WHO, "scenario_name"], "left")
    )
    reach = rank.rank_on(F.col("thresholds"), F.coalesce("pb_score", F.lit(float("-inf"))))
    days = days_between(F.col("last"), now)
    exact = (now.cast("timestamp").cast("double") - F.col("last").cast("timestamp").cast("double")) / 86_400
    lower = slots.withColumn("_reach", F.when(F.col("rated"), reach)).select(
        *WHO, F.lit("scenario").alias("level"), "cat_no", "sub_no", "slot_no", "scenario_name",
        F.when(~F.col("rated"), "unrated").when(F.col("runs").isNull(), "unplayed").otherwise("played").alias("state"),
        *(f"r_{s}" for s in STATS), F.coalesce(F.col("runs") >= rank.BODY_MIN, F.lit(False)).alias("body"),
        F.when(F.col("runs").isNotNull() & (exact > STALE_DAYS), age_text(days)).alias("stale"),
        F.col("_reach.next").alias("next_at"), F.col("_reach.next_rank").alias("next_rank"),
        F.when(F.col("pb_score").isNotNull(), F.col("_reach.gap")).alias("next_gap"),
        "pb_score", "all_runs", "last_played", "top_hash",
    )
    rows = upper.unionByName(lower, allowMissingColumns=True)
    place = Window.partitionBy(*WHO).orderBy("cat_no", "sub_no", "slot_no")
    return rows.withColumn("row_no", F.row_number().over(place))


def scenario_chart(run_events: DataFrame, window: int = FORM_WINDOW) -> DataFrame:
    """Every run of a scenario with the best, the form and the rank reached on this ladder."""
    keys, order = [*WHO, "scenario_name"], ["t", "id"]
    hot = scan.hot_groups(run_events, ["player_id"], "t")
    rolled = scan.rolling_median(run_events, keys, order, "score", window, hot=hot)
    walked = scan.running(rolled, keys, order, hot, n=scan.position(), best=scan.highest(F.col("score")))
    return walked.withColumn("k", rank.rank_on(F.col("thresholds"), F.col("score"))["k"])


def node_chart(values: DataFrame, nodes: DataFrame, hot: scan.Hot | None = None) -> DataFrame:
    """Each node's composite (100 r) after each of its runs, with how many of its scenarios were played by then."""
    total = node_scenarios(nodes).groupBy("benchmark_id", "level", "node_no").agg(F.count(F.lit(1)).alias("total"))
    numbered = scan.running(values, [*WHO, "level", "node_no"], ["t", "id"], hot, n=scan.position())
    return numbered.join(total, ["benchmark_id", "level", "node_no"]).withColumn("pb_arc", 100 * F.col("pb")).withColumn(
        "form_arc", 100 * F.col("form")
    )


# ---------------------------------------------------------------- index


def index(nodes: DataFrame, bests: DataFrame, benchmark: DataFrame, mode: str) -> DataFrame:
    """Per player and difficulty with anything played: counts, overall rank of the bests, last run and share played.

    Difficulties a player has not touched are in ``untouched``, once for everybody.
    """
    about = ["name", "difficulty", "position", "scenarios_in_tree", "cats_in_tree"]
    named = nodes.join(benchmark.select("benchmark_id", "name", "difficulty", "position"), "benchmark_id")
    seen = bests.join(named, "scenario_name").withColumn("r", F.when(F.col("rated"), rank.fractional_rank(F.col("thresholds"), F.col("pb"))))
    carried = [F.first(c).alias(c) for c in about]

    def mean(column: str, size: str, shifted: bool) -> Column:
        """Over what was played or, strictly, over all members: unplayed ones add 0 to either sum."""
        term = F.log(F.col(column) + 1) if shifted else F.col(column)
        found = F.avg(term) if mode == "provisional" else F.sum(term) / F.first(size)
        return (F.exp(found) - 1 if shifted else found).alias("r")

    # A player's part of a tree is brought together once; sets and rows are no more than the tree has slots.
    subs = seen.repartition(*WHO).groupBy(*WHO, "cat_no", "sub_no").agg(
        mean("r", "slots_in_sub", False), F.max("last").alias("last"), F.collect_set(F.when(F.col("rated"), F.col("scenario_name"))).alias("played"),
        F.first("subs_in_cat").alias("subs_in_cat"), *carried,
    )
    cats = subs.groupBy(*WHO, "cat_no").agg(
        mean("r", "subs_in_cat", True), F.max("last").alias("last"), F.flatten(F.collect_list("played")).alias("played"), *carried
    )
    top = cats.groupBy(*WHO).agg(
        mean("r", "cats_in_tree", True), F.max("last").alias("last"),
        F.size(F.array_distinct(F.flatten(F.collect_list("played")))).alias("played"), *carried,
    )
    total = F.col("scenarios_in_tree")
    share = F.when(total > 0, F.col("played") / total).otherwise(F.lit(0.0))
    return top.select(*WHO, "name", "difficulty", "position", "played", total.alias("total"), "r", "last", share.alias("share"))


def untouched(nodes: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every difficulty that has a tree, with its rated and named scenarios, as a player without runs sees it."""
    listed = nodes.groupBy("benchmark_id").agg(
        F.count_distinct(F.when(F.col("rated"), F.col("scenario_name"))).alias("total"),
        F.array_sort(F.collect_set("scenario_name")).alias("names"),
    )
    return listed.join(benchmark.select("benchmark_id", "name", "difficulty", "position"), "benchmark_id")


def order_families(index_rows: DataFrame) -> DataFrame:
    """Each player's families: the most complete first, then the most recently played."""
    families = index_rows.groupBy("player_id", "name").agg(
        F.max("share").alias("share"), F.max("last").alias("last"), F.min("position").alias("position")
    )
    place = Window.partitionBy("player_id").orderBy(F.col("share").desc(), F.col("last").desc(), "position")
    return families.withColumn("place", F.row_number().over(place))


def search(catalogue: DataFrame, q: str) -> DataFrame:
    """Difficulties in which every word of ``q`` occurs: in the family, the difficulty or a scenario's name.

    ``via`` lists the scenarios holding a word that the first two do not.
    """
    own = F.lower(F.concat_ws(" ", "name", "difficulty"))
    asked = F.array(*(F.lit(w) for w in q.lower().split())).cast("array<string>")
    named = catalogue.withColumn("_rest", F.filter(asked, lambda w: ~F.contains(own, w)))
    inside = lambda n, w: F.contains(F.lower(n), w)
    found = named.where(F.forall("_rest", lambda w: F.exists("names", lambda n: inside(n, w))))
    return found.withColumn("via", F.filter("names", lambda n: F.exists("_rest", lambda w: inside(n, w)))).drop("_rest")


def highlight(texts: DataFrame, key: str, text: str, q: str) -> DataFrame:
    """Texts cut where the words of ``q`` occur, ignoring case; hits that overlap or touch are one.

    Matches are found by splitting before each occurrence, so only hits become rows, not characters.
    """
    low = F.lower(text)
    found = texts.select(key, text, F.length(text).alias("_len"))
    spans = None
    for w in sorted(set(q.lower().split())):
        before = "(?=" + "".join(f"\\x{{{ord(c):x}}}" for c in w) + ")"
        pieces = texts.select(key, low.startswith(w).alias("_head"), F.posexplode(F.split(low, before)).alias("_i", "_piece"))
        at = scan.running(pieces, [key], ["_i"], None, a=scan.total(F.length("_piece"), "before"))
        starts = at.withColumn("a", F.coalesce("a", F.lit(0))).where((F.col("_i") > 0) | F.col("_head"))
        more = starts.select(key, "a", (F.col("a") + len(w)).alias("b"))
        spans = more if spans is None else spans.unionByName(more)
    if spans is None:
        return found.select(key, F.lit(0).alias("part"), F.col(text).alias("text"), F.lit(False).alias("hit"))
    spans = spans.distinct()
    reach = scan.running(spans, [key], ["a", "b"], None, _reach=scan.highest(F.col("b"), "before"))
    new = (F.col("_reach").isNull() | (F.col("a") > F.col("_reach"))).cast("int")
    islands = scan.running(reach.withColumn("_new", new), [key], ["a", "b"], None, _g=scan.total(F.col("_new")))
    merged = islands.groupBy(key, "_g").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    gone = scan.running(merged, [key], ["a"], None, _end=scan.previous(F.col("b")))
    gaps = gone.select(key, F.coalesce("_end", F.lit(0)).alias("a"), F.col("a").alias("b"), F.lit(False).alias("hit"))
    last = found.join(merged.groupBy(key).agg(F.max("b").alias("_b")), key, "left").select(
        key, F.coalesce("_b", F.lit(0)).alias("a"), F.col("_len").alias("b"), F.lit(False).alias("hit"), "_len", "_b"
    )
    tail = last.where((F.col("a") < F.col("b")) | (F.col("_len") == 0)).drop("_len", "_b")
    pieces = merged.select(key, "a", "b", F.lit(True).alias("hit")).unionByName(gaps.where("a < b")).unionByName(tail)
    numbered = scan.running(pieces, [key], ["a", "b"], None, _p=scan.position())
    return numbered.join(texts.select(key, text), key).select(
        key, (F.col("_p") - 1).alias("part"),
        F.substring(F.col(text), (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int")).alias("text"), "hit",
    )
