"""Interactions of filters: what each step of every order of them removes, from one walk over all subsets.

Each document gets a mask of the filters that it fails. A part's documents fall into at most 2^n cells by mask, which one
pre-aggregated count fills; nothing else about documents is needed. The subsets of filters are visited in Gray-code order,
so that each step switches one filter on or off: only cells that fail it change their counter of active failures, and the
survivors change by the cells whose counter leaves or reaches zero. The survivors of all 32 subsets are kept; a step of an
order is the difference of two of them.

Texts are read once, in tasks, and leave only a digest and a mask. Whether a document is a copy of one with a smaller id
is an equi-join of its digest and id with each digest's smallest id, so that a text with any number of copies is no hot
key. Rows without an id do not go through joins.

Defined cases: a null text is an empty one; a null part is the empty string; a row without an id is no copy and makes no
copies, and has no label; rows that repeat an id count each, and rows of one id and text are not copies of each other; a
document with several labels has one if any says so; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import column, slices

#: Failure conditions: fewest words, least share of distinct words, most share of capitals (percent), signs.
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 100, 80, 10, b"#$%&*|"
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
COUNTS = ("n", "good", "toxic")


def mask(text: bytes, length: int) -> int:
    """The filters A to D that a text of ``length`` code points fails, A in the lowest bit."""
    words = text.split()
    short = len(words) < MIN_WORDS
    repeats = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    shouts = 100 * (len(text) - len(text.translate(None, CAPITALS))) > CAPITAL_PERCENT * length
    signs = len(text.translate(None, SIGNS)) < len(text)
    return short | repeats << 1 | shouts << 2 | signs << 3


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(key, part, digest, mask) of every row, with the filters that look at the text alone."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = column(batch, "text")
            lengths, raw = pc.utf8_length(texts).to_pylist(), texts.cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [column(batch, "key"), column(batch, "part"), pa.array([hashlib.sha256(t).digest() for t in raw], pa.binary()), pa.array(list(map(mask, raw, lengths)), pa.int32())],
                ["key", "part", "digest", "mask"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, part string, digest binary, mask int")


def cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part that fail exactly the filters of the mask."""
    rows = stored(judged(docs, key, text, part))
    named = rows.where("key IS NOT NULL")
    first = named.groupBy("digest").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    joined = named.join(first, ["digest", "key"], "left").join(marks, "key", "left")
    whole = F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + COPY)
    zero = F.lit(0).cast("long")
    listed = joined.select("part", whole.alias("mask"), F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"))
    nameless = rows.where("key IS NULL").select("part", "mask", zero.alias("good"), zero.alias("toxic"))
    return listed.unionByName(nameless).groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def survivors(masks: np.ndarray, weights: np.ndarray, filters: int) -> np.ndarray:
    """[subset, column]: the weights of cells that fail none of the subset's filters, by a Gray-code walk."""
    failures = np.zeros(len(masks), np.int64)
    running = weights.sum(axis=0)
    out = np.zeros((1 << filters, weights.shape[1]), np.int64)
    out[0], subset = running, 0
    for step in range(1, 1 << filters):
        switched = (step & -step).bit_length() - 1
        subset ^= 1 << switched
        hit = (masks >> switched & 1).astype(bool)
        if subset >> switched & 1:
            running = running - weights[hit & (failures == 0)].sum(axis=0)
            failures[hit] += 1
        else:
            failures[hit] -= 1
            running = running + weights[hit & (failures == 0)].sum(axis=0)
        out[subset] = running
    return out


def steps(left: np.ndarray, names: str = FILTERS) -> list[tuple]:
    """A row for every order and step, as differences of survivors ``left[subset] = (n, good, toxic)``."""
    full = (1 << len(names)) - 1
    orders = [tuple(names.index(c) for c in order) for order in permutations(names)]
    removed_in_all = [0] * len(names)
    out = []
    for order in orders:
        subset = 0
        for number, f in enumerate(order, 1):
            after = subset | 1 << f
            removed, good, toxic = (int(x) for x in left[subset] - left[after])
            removed_in_all[f] += removed
            redundant = int(left[0][0] - left[1 << f][0]) - removed
            unique = int(left[full ^ 1 << f][0] - left[full][0])
            out.append(("".join(names[g] for g in order), number, int(left[after][0]), removed, redundant, unique, good, toxic, f))
            subset = after
    return [(*row[:-1], removed_in_all[row[-1]]) for row in out]


RESULT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    A group of the last step holds the cells of one part, at most 32 rows.
    """
    names = ["part", "filter_order", "step", *RESULT]

    def walk(group: tuple, table: pa.Table) -> pa.Table:
        weights = np.stack([table.column(c).to_numpy() for c in COUNTS], axis=1).astype(np.int64)
        rows = steps(survivors(table.column("mask").to_numpy().astype(np.int64), weights, len(FILTERS)))
        columns = list(zip(*rows))
        arrays = [pa.array([group[0].as_py()] * len(rows), pa.string()), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])]
        return pa.Table.from_arrays(arrays, names)

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in RESULT)
    return cells(docs, labels, key, text, part).groupBy("part").applyInArrow(walk, schema)
