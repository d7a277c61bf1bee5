"""Phrase mining by dynamic itemset counting over a corpus in cyclic shards.

The corpus is written once as slices of word numbers, each with its own word list, dealt over shards. A step scans one
shard, the next one after it, and so on in a circle. Words are counted from the first step. A longer phrase becomes
active in the step after both its subphrases (without its last word, without its first) have reached the threshold,
wherever in the circle that is, and is counted for one full cycle from there; lengths are so counted side by side. The
steps end when no phrase is in its cycle.

What tells a task which phrases are active is one table of a fixed size: for every bucket of a hash, the step from which
a phrase of the bucket is known to have reached the threshold. The step of a phrase is the latest one of its subphrases'
buckets, so every task and every step derive the same cycle for it without a join. Phrases that share a bucket by chance
begin earlier than they need to, or are counted in vain; no count changes by that. The table is the only thing broadcast.

Counts are added up by phrase in one shuffle a step, together with those that are not through their cycle; finished
phrases leave with their counts if these reach the threshold, since subphrases of a frequent phrase are frequent.

Defined cases: a null text is an empty one, a null language is ``und``; phrases do not cross pieces or texts; a text of any
length is read whole, as a slice of its own if need be; repeated rows count each; ties of scores are ordered by count and
by the phrase's bytes; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import Codes, column, mixed, slices

LONGEST, THRESHOLD, BEST = 5, 100, 2000
#: Shards of the circle, and bytes of text in a slice.
SHARDS, SLICE = 3, 8_000_000
#: Buckets of the table of steps, one byte each, and the mark of those without a frequent phrase.
BUCKETS, NEVER = 1 << 24, 255

BREAK = b"\xff"
FOLD = bytes(ord(BREAK) if chr(c) in ".,;:!?\n\x0b\x0c\r" else c + 32 if ord("A") <= c <= ord("Z") else c for c in range(256))
COUNTS = "part string, words int, since int, phrase string, n long"


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of a text, with a break where a piece ends."""
    return text.translate(FOLD).replace(BREAK, b" " + BREAK + b" ").split()


def sliced(docs: DataFrame, text: str, part: str, shards: int, size: int = SLICE) -> DataFrame:
    """(shard, part, list, codes): word numbers of the texts of one slice and language; 0 is a break, the first word is 1.

    ``list`` has the slice's words, one per line; ``codes`` are little-endian 32-bit numbers.
    """
    rows = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("und")).alias("part"), F.col(text).alias("text")).where("text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in slices(_gathered(batches, size), "text", size):
            by_part: dict[str, list[bytes]] = {}
            for p, t in zip(column(batch, "part").to_pylist(), column(batch, "text").cast(pa.binary()).to_pylist()):
                by_part.setdefault(p, []).append(t)
            rows = []
            for p, texts in by_part.items():
                codes = Codes({BREAK: 0})
                found = [np.fromiter(map(codes.__getitem__, ws), "<u4", len(ws)) for ws in ([*words_of(t), BREAK] for t in texts)]
                rows.append((turn % shards, p, b"\n".join(list(codes)[1:]), np.concatenate(found).tobytes()))
            turn += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int32(), pa.string(), pa.binary(), pa.binary()))], ["shard", "part", "list", "codes"])

    return rows.mapInArrow(run, "shard int, part string, list binary, codes binary")


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Joins small batches until they hold ``size`` bytes, so that slices do not end with a batch."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def word_hashes(part: str, words: list[bytes]) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh3_64_intdigest(part.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def lengthened(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases that go on by a word each."""
    return mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + words)


def buckets_of(hashes: np.ndarray, size: int) -> np.ndarray:
    return (mixed(hashes) >> np.uint64(20)).astype(np.int64) % size


def counted(part: str, words: pa.Array, codes: np.ndarray, known: np.ndarray, step: int, shards: int, longest: int) -> Iterator[pa.RecordBatch]:
    """(part, words, since, phrase, n) of the phrases of a slice that are in their cycle at this step."""
    hashes = np.r_[np.uint64(0), word_hashes(part, words.to_pylist())]
    if step < shards:
        n = np.bincount(codes, minlength=len(words) + 1)[1:]
        yield _rows(part, 1, np.zeros(len(n), np.int64), words.cast(pa.string()), n)
        yield _rows(part, 0, np.zeros(1, np.int64), pa.array([""]), n.sum(keepdims=True))
    # places at which a phrase of the length is active, its hash, and the step it is known from
    place = np.flatnonzero(codes)
    at = np.full(len(codes) + 1, NEVER, np.uint8)
    word = hashes[codes]
    whole = word[place]
    at[place] = known[buckets_of(hashes, len(known))][codes[place]]
    for size in range(2, longest + 1):
        since = np.maximum(at[place], at[place + 1])
        active = since <= step
        place, since, whole = place[active], since[active].astype(np.int64), whole[active]
        if not len(place):
            return
        whole = lengthened(whole, word[place + size - 1])
        now = since > step - shards
        first, began, n = _distinct(whole[now], place[now], since[now], codes, size)
        if len(first):
            yield _rows(part, size, began, pc.binary_join_element_wise(*(words.take(pa.array(codes[first + i] - 1)) for i in range(size)), b" ").cast(pa.string()), n)
        if size < longest:
            at = np.full(len(codes) + 1, NEVER, np.uint8)
            at[place] = np.maximum(known[buckets_of(whole, len(known))], since)


def _rows(part: str, size: int, since: np.ndarray, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    same = [pa.repeat(pa.scalar(part, pa.string()), len(n)), pa.repeat(pa.scalar(size, pa.int32()), len(n))]
    return pa.RecordBatch.from_arrays([*same, pa.array(since.astype(np.int32)), phrase, pa.array(n.astype(np.int64))], ["part", "words", "since", "phrase", "n"])


def _distinct(whole: np.ndarray, place: np.ndarray, since: np.ndarray, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place, since, number of places) of each phrase. Equal hashes are compared word by word."""
    order = np.argsort(whole)
    key, place, since = whole[order], place[order], since[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    n = np.diff(np.r_[starts, len(key)])
    first = place[starts]
    same = np.repeat(first, n)
    if all(np.array_equal(codes[same + i], codes[place + i]) for i in range(size)):
        return first, since[starts], n
    found: dict[bytes, list[int]] = {}
    for p, s in zip(place.tolist(), since.tolist()):
        found.setdefault(codes[p : p + size].tobytes(), [p, s, 0])[2] += 1
    return tuple(np.array(x, np.int64) for x in zip(*found.values()))


def scan(shard: DataFrame, known, step: int, shards: int, longest: int) -> DataFrame:
    """The counts of one shard; ``known`` is the broadcast table of steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(known.value, np.uint8)
        for batch in batches:
            for part, listed, codes in zip(*(column(batch, c).to_pylist() for c in ("part", "list", "codes"))):
                words = pa.array(listed.split(b"\n") if listed else [], pa.binary())
                yield from counted(part, words, np.frombuffer(codes, "<u4").astype(np.int64), table, step, shards, longest)

    return shard.select("part", "list", "codes").mapInArrow(run, COUNTS)


def frequent_buckets(counts: DataFrame, longest: int, threshold: int, size: int) -> np.ndarray:
    """The buckets of all phrases that have reached the threshold and may be part of a longer one; at most ``size``."""
    rows = counts.where(F.col("words").between(1, longest - 1) & (F.col("n") >= threshold)).select("part", "phrase")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for part, phrase in zip(column(batch, "part").to_pylist(), column(batch, "phrase").to_pylist()):
                hashes = word_hashes(part, phrase.encode().split(b" "))
                whole = hashes[:1]
                for i in range(1, len(hashes)):
                    whole = lengthened(whole, hashes[i : i + 1])
                found.add(int(buckets_of(whole, size)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], ["bucket"])

    return rows.mapInArrow(run, "bucket long").distinct().toArrow().column("bucket").to_numpy()


def frequent_phrases(
    docs: DataFrame, text: str = "text", part: str = "lang", longest: int = LONGEST, threshold: int = THRESHOLD, shards: int = SHARDS, buckets: int = BUCKETS, size: int = SLICE
) -> DataFrame:
    """(part, words, phrase, n): all phrases of up to ``longest`` words that occur ``threshold`` times, and as the one of no
    words the number of all words. ``shards`` is at most 40, so that steps fit the table's bytes."""
    spark = docs.sparkSession
    corpus = stored(sliced(docs, text, part, shards, size), "shard")
    known = np.full(buckets, NEVER, np.uint8)
    open_, finished, step = None, [], 0
    while step < shards or bool(((known > step - shards) & (known <= step)).any()):
        sent = spark.sparkContext.broadcast(known.tobytes())
        counts = scan(corpus.where(F.col("shard") == step % shards), sent, step, shards, longest)
        if open_ is not None:
            counts = counts.unionByName(open_)
        counts = stored(counts.groupBy("part", "words", "since", "phrase").agg(F.sum("n").alias("n")))
        sent.destroy()
        reached = frequent_buckets(counts, longest, threshold, buckets)
        known[reached[known[reached] == NEVER]] = step + 1
        last = F.col("since") + shards - 1
        finished.append(counts.where((last <= step) & ((F.col("n") >= threshold) | (F.col("words") == 0))))
        open_ = counts.where(last > step)
        step += 1
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out.select("part", "words", "phrase", "n")


def score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 * a * n / (left * right)), exact up to 37 digits."""
    return F.expr(f"(1000BD * cast({a} AS decimal(17,0)) * cast({n} AS decimal(16,0))) div (cast({left} AS decimal(18,0)) * cast({right} AS decimal(18,0)))")


#: Parts into which a language's phrases are dealt before the best of all are ranked.
DEALT = 64


def collocations(frequent: DataFrame, best: int = BEST, longest: int = LONGEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language, from ``frequent_phrases``."""
    frequent = stored(frequent)
    totals = stored(frequent.where("words = 0").select("part", F.col("n").alias("total")))
    counts = frequent.where("words > 0")
    candidates = counts.where("words > 1").withColumnRenamed("n", "a")

    spans = F.expr(f"filter(flatten(transform(sequence(2, {longest}), s -> transform(sequence(1, {longest}), i -> struct(i AS at, s AS size)))), x -> x.size < words AND x.at + x.size - 1 <= words)")
    inside = candidates.where("words > 2").select("part", "a", F.split("phrase", " ").alias("w"), F.explode(spans).alias("x"))
    inside = inside.select("part", F.array_join(F.slice("w", F.col("x.at"), F.col("x.size")), " ").alias("phrase"), "a").groupBy("part", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(inside, ["part", "phrase"], "left").where("longer IS NULL OR longer < a").drop("longer")

    cuts = kept.select("part", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    left, right = (counts.select("part", F.col("phrase").alias(c), F.col("n").alias(n)) for c, n in (("first", "l"), ("rest", "r")))
    cuts = cuts.join(left, ["part", "first"]).join(right, ["part", "rest"]).join(totals, "part")
    scored = cuts.groupBy("part", "phrase", "a").agg(F.min(F.struct(score("a", "total", "l", "r").alias("score"), "k", "l", "r", "total")).alias("x"))
    order = [F.desc("x.score"), F.desc("a"), "phrase"]
    few = scored.withColumn("place", F.row_number().over(Window.partitionBy("part", F.pmod(F.xxhash64("phrase"), F.lit(DEALT))).orderBy(*order))).where(F.col("place") <= best)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order))).where(F.col("rank") <= best)
    return ranked.select(F.col("part").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "x.l", "x.r", F.col("x.total").alias("n"), "x.score")
