"""Chat formatting of reply trees.

Messages name their parent. Self-joins double the reach of every message's pointer to its ancestors, so that trees of any
depth take logarithmically many rounds; from these tables each leaf learns its path's depth and score, the best leaves of
a tree are chosen, and the messages of the chosen paths are enumerated. A path's messages become pieces of one
conversation, in order, with the part that is trained on marked. Reading back goes over sorted pieces with a buffer of
one turn, so that a conversation of any length takes bounded memory.

Template: ``<|turn|>role\\ntext<|end|>\\n``. Control strings inside texts get a backslash after their first letter, and one
more where there are some already; reading takes one away.

Defined cases: a null text or role is empty, a null score 0; of several messages with one id the smallest (role, text)
counts; a parent that is not there makes a root; messages on a cycle belong to no path; equal path scores are ranked by
the smaller leaf; null tree ids are one tree; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import column

TURN, END, TRAINED = "<|turn|>", "<|end|>", "assistant"
#: What follows the first letter of a control string.
REST = r"(?=\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>|/?INST\])"
SALTS = 32


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + REST, r"$1$2\\")


def unescaped(text: str) -> str:
    return re.sub(r"([<\[])\\(\\*)" + REST, r"\1\2", text)


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def _joined(left: DataFrame, right: DataFrame, name: str, how: str = "inner") -> DataFrame:
    """Joins on the tree and ``left``'s message called ``name`` with ``right``'s (t, m)."""
    return left.join(right, left["tree"].eqNullSafe(right["t"]) & (left[name] == right["m"]), how)


def _jumps(nodes: DataFrame) -> list[DataFrame]:
    """Tables (t, m, anc, score): the ancestor 1, 2, 4, ... steps up, and the scores of all messages above m up to it."""
    there = nodes.select(F.col("tree").alias("t"), F.col("node").alias("m"), F.col("score").alias("above"))
    step = _joined(nodes.where("parent IS NOT NULL"), there, "parent").select("tree", F.col("node").alias("m"), F.col("parent").alias("anc"), F.col("above").alias("score"))
    tables, reach, count = [], 1, nodes.count()
    step = stored(step.select(F.col("tree").alias("t"), "m", "anc", "score"))
    while reach <= count and not step.isEmpty():
        tables.append(step)
        far = step.select("t", "m", F.col("anc").alias("a2"), F.col("score").alias("s2")).alias("far")
        near = step.select(F.col("t").alias("tree"), F.col("m").alias("node"), "anc", "score")
        step = stored(_joined(near, far, "anc").select("t", F.col("node").alias("m"), F.col("a2").alias("anc"), (F.col("score") + F.col("s2")).alias("score")))
        reach *= 2
    return tables


def chosen_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, path, position, node, role, text) of the ``best`` paths of each tree by mean score.

    ``messages``: tree, node, parent, role, text, score.
    """
    text = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = messages.where("node IS NOT NULL").groupBy("tree", "node").agg(F.min(text).alias("said"), F.min_by("parent", text).alias("parent"), F.min_by(F.coalesce(F.col("score").cast("double"), F.lit(0.0)), text).alias("score"))
    said = stored(said)
    nodes = said.select("tree", "node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("parent"), "score")
    jumps = _jumps(nodes)
    parents = (jumps[0] if jumps else nodes.limit(0).select(F.col("tree").alias("t"), F.col("parent").alias("anc"))).select("t", F.col("anc").alias("m")).distinct()
    leaves = _joined(nodes, parents, "node", "left_anti").select("tree", F.col("node").alias("leaf"), F.col("node").alias("at"), F.lit(1).cast("long").alias("depth"), "score")
    for k in reversed(range(len(jumps))):
        up = jumps[k].withColumnRenamed("score", "s2")
        far = _joined(leaves, up, "at", "left")
        leaves = far.select("tree", "leaf", F.coalesce("anc", "at").alias("at"), (F.col("depth") + F.when(F.col("anc").isNull(), 0).otherwise(2**k)).alias("depth"), "score", F.coalesce("s2", F.lit(0.0)).alias("s2"), F.col("anc").isNotNull().alias("moved"))
        leaves = leaves.select("tree", "leaf", "at", "depth", (F.col("score") + F.col("s2")).alias("score"))
    ranked = leaves.select("tree", "leaf", "depth", (F.col("score") / F.col("depth")).alias("mean"), F.pmod(F.xxhash64("leaf"), F.lit(SALTS)).alias("salt"))
    order = (F.col("mean").desc(), F.col("leaf"))
    ranked = ranked.withColumn("path", F.row_number().over(Window.partitionBy("tree", "salt").orderBy(*order))).where(F.col("path") <= best)
    ranked = ranked.withColumn("path", F.row_number().over(Window.partitionBy("tree").orderBy(*order))).where(F.col("path") <= best)
    rows = stored(ranked.select("tree", "path", "depth", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up")))
    for k, table in enumerate(jumps):
        higher = _joined(rows, table, "node").select("tree", "path", "depth", F.col("anc").alias("node"), (F.col("up") + 2**k).alias("up"))
        rows = stored(rows.unionByName(higher))
    told = said.select(F.col("tree").alias("t"), F.col("node").alias("m"), "said.role", "said.text")
    return _joined(rows, told, "node").select("tree", "path", (F.col("depth") - 1 - F.col("up")).alias("position"), "node", "role", "text")


def formatted(paths: DataFrame) -> DataFrame:
    """(tree, path, position, piece, loss_from, loss_to): pieces of conversations; bounds of the trained part, equal if none."""
    head, body = F.concat(F.lit(TURN), escaped_role(F.col("role")), F.lit("\n")), escaped(F.col("text"))
    pieces = paths.select("tree", "path", "position", "role", head.alias("head"), body.alias("body"))
    start = F.length("head")
    return pieces.select("tree", "path", "position", F.concat("head", "body", F.lit(END + "\n")).alias("piece"), start.alias("loss_from"), F.when(F.col("role") == TRAINED, start + F.length("body")).otherwise(start).alias("loss_to"))


def conversations(pieces: DataFrame) -> DataFrame:
    """(tree, path, text, loss): whole conversations and the bounds of their trained parts, for texts that fit a row."""
    listed = F.sort_array(F.collect_list(F.struct("position", "piece", "loss_from", "loss_to")))
    whole = pieces.groupBy("tree", "path").agg(listed.alias("x"))
    ends = F.aggregate("x", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x["piece"]))))
    spans = F.filter(F.transform("x", lambda x, i: F.struct((F.get("ends", i) + x["loss_from"]).alias("from"), (F.get("ends", i) + x["loss_to"]).alias("to"))), lambda s: s["from"] < s["to"])
    return whole.withColumn("ends", ends).select("tree", "path", F.array_join(F.transform("x", lambda x: x["piece"]), "").alias("text"), spans.alias("loss"))


class Reader:
    """Reads one conversation back, piece by piece."""

    def __init__(self):
        self.rest, self.turns, self.size = "", 0, 0
        self.said, self.loss, self.loss_chars = hashlib.sha256(), hashlib.sha256(), 0

    def add(self, piece: str, loss_from: int, loss_to: int) -> None:
        self.size += len(piece)
        trained = unescaped(piece[loss_from:loss_to])
        self.loss.update(trained.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(trained)
        self.rest += piece
        while (end := self.rest.find(END + "\n")) >= 0:
            turn, self.rest = self.rest[:end], self.rest[end + len(END) + 1 :]
            role, _, text = turn.removeprefix(TURN).partition("\n")
            self.said.update(f"{unescaped_role(role)}\n{unescaped(text)}\n".encode("utf-8", "surrogatepass"))
            self.turns += 1


def read_back(pieces: DataFrame) -> DataFrame:
    """(tree, path, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation."""
    rows = pieces.repartition("tree", "path").sortWithinPartitions("tree", "path", "position")
    kind = rows.schema["tree"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, out = None, Reader(), []
        names = ["tree", "path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = None
        row = lambda: (*now, reader.turns, reader.said.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.size)
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)
        for batch in batches:
            kinds = [column(batch, "tree").type, pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            for tree, path, piece, a, b in zip(*(column(batch, c).to_pylist() for c in ("tree", "path", "piece", "loss_from", "loss_to"))):
                if now != (tree, path):
                    if now is not None:
                        out.append(row())
                    now, reader = (tree, path), Reader()
                reader.add(piece, a, b)
            if len(out) >= 10_000:
                yield batch_of()
                out = []
        if now is not None:
            out.append(row())
            yield batch_of()

    return rows.mapInArrow(run, f"tree {kind}, path int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
