"""Benchmark decontamination over a distributed positional inverted index.

Indexing cuts the documents into segments of a bounded size. A segment stores, for every benchmark term in it, the sorted
list of the term's positions. Searching reads one segment at a time: for every benchmark window it takes the list of the
window's rarest term, shifts it by the term's offset and intersects it with the shifted lists of the other terms, rarer
ones first. What is left are exact phrase matches; places where the three rarest terms stand close to their offsets, but
not all terms do, are proximity matches. How rare a term is, is counted over all segments. Benchmark windows reach the
segments in blocks of a bounded number of words; a larger benchmark makes more blocks, not a larger one. Segments are
searched where they lie, so a frequent word or a passage that many documents share makes no hot key.

Defined cases: a null or empty text has no words and is not contaminated; an item without words has no window, one of
fewer words than a window is one window; equal items each count; equal rows are each answered; an empty table of
documents gives an empty result, an empty benchmark no hits; a null key is kept; of equally rare terms the earlier in the window is taken first; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import Codes, column, slices

WINDOW, SLOP, ANCHORS = 10, 4, 3
#: Words of benchmark windows that are sent to the tasks at a time.
BLOCK_WORDS = 1_000_000
#: Candidate places that a task intersects at a time.
PLACES = 1 << 21

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: For UTF-8: letters in lower case, all that is no word character a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def item_windows(items: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """(item, window, words): the window's digest and its words."""
    words = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(WORD), F.lit(0))
    runs = F.when(F.size("words") > size, F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.slice("words", i, size))).otherwise(F.array("words"))
    cut = items.select(F.col(item).cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)
    return cut.select("item", F.explode(runs).alias("words")).withColumn("window", F.md5(F.concat_ws(" ", "words").cast("binary")))


def _index(docs: DataFrame, key: str, text: str, vocabulary, gap: int) -> DataFrame:
    """One row per segment: the keys and word counts of its documents, their first positions, and lists of positions by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task = vocabulary.value, TaskContext.get().partitionId()
        for n, batch in enumerate(slices(batches, text)):
            words = [(t or "").encode("utf-8", "surrogatepass").translate(FOLD).split() for t in column(batch, text).to_pylist()]
            count = np.array([len(w) for w in words], np.int64)
            first = np.cumsum(count + gap) - count - gap
            total = int(count.sum())
            ids = np.fromiter((known.get(w, -1) for ws in words for w in ws), np.int32, total)
            place = np.arange(total) + np.repeat(first - (np.cumsum(count) - count), count)
            there = ids >= 0
            order = np.argsort(ids[there], kind="stable")
            terms, lengths = np.unique(ids[there], return_counts=True)
            keys = column(batch, key)
            listed = lambda values: pa.array([values])
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{task}-{n}"]), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), listed(count), listed(first), listed(terms.astype(np.int32)), listed(lengths.astype(np.int32)),
                 pa.array([place[there][order].astype("<i4").tobytes()])],
                ["segment", "keys", "n_words", "first", "terms", "lengths", "positions"])

    rows = docs.select(key, text)
    kind = rows.schema[key].dataType.simpleString()
    return stored(rows.mapInArrow(run, f"segment string, keys array<{kind}>, n_words array<long>, first array<long>, terms array<int>, lengths array<int>, positions binary"))


class Segment:
    def __init__(self, first: np.ndarray, n_words: np.ndarray, terms: np.ndarray, lengths: np.ndarray, positions: np.ndarray, vocabulary: int):
        self.first, self.n_words, self.positions = first, n_words, positions
        self.length = np.zeros(vocabulary, np.int64)
        self.length[terms] = lengths
        self.start = np.cumsum(self.length) - self.length
        self.postings = (np.repeat(terms.astype(np.int64), lengths) << 32) | positions

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.within(term, place, 0)

    def within(self, term: np.ndarray, place: np.ndarray, slop: int) -> np.ndarray:
        """Whether the term stands within ``slop`` of the place."""
        wanted = (term << 32) + np.maximum(place - slop, 0)
        at = np.searchsorted(self.postings, wanted)
        found = self.postings[np.minimum(at, len(self.postings) - 1)]
        return (at < len(self.postings)) & (place + slop >= 0) & (found <= (term << 32) + place + slop)


def search(segment: Segment, terms: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, start, exact) of all matches. ``terms`` and ``offsets`` hold each window's terms, rarest first, -1 after the last."""
    if not len(segment.postings):
        return
    rarest = segment.length[terms[:, 0]]
    live = np.flatnonzero(rarest)
    upto = np.cumsum(rarest[live])
    at = 0
    while at < len(live):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PLACES, "right")))
        some = live[at:to]
        size = rarest[some]
        window = np.repeat(some, size)
        inside = np.arange(len(window)) - np.repeat(np.cumsum(size) - size, size)
        start = segment.positions[segment.start[terms[window, 0]] + inside].astype(np.int64) - offsets[window, 0]
        close = np.ones(len(window), bool)
        for j in range(1, min(ANCHORS, terms.shape[1])):
            close &= (terms[window, j] < 0) | segment.within(terms[window, j], start + offsets[window, j], slop)
        window, start = window[close], start[close]
        exact = np.ones(len(window), bool)
        for j in range(1, terms.shape[1]):
            left = np.flatnonzero(exact & (terms[window, j] >= 0))
            exact[left] = segment.has(terms[window[left], j], start[left] + offsets[window[left], j])
        yield window, start, exact
        at = to


def _search(index: DataFrame, sent, slop: int) -> DataFrame:
    """(segment, ord, spans, windows, near): matches of the documents that have any."""
    place = pa.struct([("window", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, terms, offsets, sizes, vocabulary = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: column(batch, c).slice(row, 1).flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
                segment = Segment(get("first"), get("n_words"), get("terms"), get("lengths"), np.frombuffer(column(batch, "positions")[row].as_py(), "<i4"), vocabulary)
                found = list(search(segment, terms, offsets, sizes, slop))
                if not sum(len(w) for w, _, _ in found):
                    continue
                window, start, exact = (np.concatenate(x) for x in zip(*found))
                doc = np.searchsorted(segment.first, start + offsets[window, 0], "right") - 1  # that of the rarest term
                out = {"ord": [], "spans": [], "windows": [], "near": []}
                order = np.lexsort((start, doc))
                for part in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
                    d, hit = int(doc[part[0]]), part[exact[part]]
                    out["ord"].append(d)
                    out["spans"].append(_merged(start[hit] - segment.first[d], sizes[window[hit]]))
                    out["windows"].append([names[w] for w in np.unique(window[hit])])
                    near = part[~np.isin(window[part], window[hit])]
                    first = start[near] - segment.first[d]
                    out["near"].append([{"window": names[w], "start": max(a, 0), "end": min(a + int(sizes[w]), int(segment.n_words[d]))} for w, a in sorted(zip(window[near].tolist(), first.tolist()))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([column(batch, "segment")[row].as_py()] * len(out["ord"])), pa.array(out["ord"], pa.int64()), pa.array(out["spans"], pa.list_(pa.list_(pa.int64()))),
                     pa.array(out["windows"], pa.list_(pa.string())), pa.array(out["near"], pa.list_(place))],
                    ["segment", *out])

    return index.drop("keys").mapInArrow(run, "segment string, ord long, spans array<array<long>>, windows array<string>, near array<struct<window:string,start:long,end:long>>")


def _merged(start: np.ndarray, size: np.ndarray) -> list[list[int]]:
    """Spans (start, end) without overlaps, from sorted ones."""
    out: list[list[int]] = []
    for a, n in zip(start.tolist(), size.tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return out


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
                  size: int = WINDOW, slop: int = SLOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: key, n_words, n_hit, spans of word places hit, items with occurring windows (sorted strings),
    n_near (windows with proximity matches only), near (such windows with all their places, ends exclusive), near_items (the
    items of these windows), contaminated."""
    spark = docs.sparkSession
    windows = stored(item_windows(items, item, item_text, size))
    distinct = windows.select("window", "words").distinct()
    blocks = max(1, -(-(distinct.agg(F.sum(F.size("words"))).first()[0] or 0) // block_words))
    if blocks > 1:
        docs = stored(docs.select(key, text))
    hits, index = None, None
    for block in range(blocks):
        listed = distinct.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).collect()
        codes = Codes()
        coded = [[codes[w.encode()] for w in r["words"]] for r in listed]
        index = _index(docs, key, text, spark.sparkContext.broadcast(dict(codes)), size + 2 * slop + 1)
        counts = index.select(F.explode(F.arrays_zip("terms", "lengths")).alias("x")).groupBy("x.terms").agg(F.sum("x.lengths").alias("n"))
        rare = np.zeros(len(codes), np.int64)
        for r in counts.toLocalIterator():
            rare[r["terms"]] = r["n"]
        terms, offsets = (np.full((len(coded), max(map(len, coded), default=1)), -1, np.int64) for _ in range(2))
        for i, t in enumerate(coded):
            order = sorted(range(len(t)), key=lambda j: (rare[t[j]], j))  # noqa: B023
            terms[i, : len(t)], offsets[i, : len(t)] = [t[j] for j in order], order
        sent = spark.sparkContext.broadcast(([r["window"] for r in listed], terms, offsets, np.array([len(t) for t in coded], np.int64), len(codes)))
        found = stored(_search(index, sent, slop))
        hits = found if hits is None else hits.unionByName(found)
    told = F.concat(F.transform("windows", lambda w: F.struct(w.alias("window"), F.lit(True).alias("exact"))), F.transform(F.array_distinct("near.window"), lambda w: F.struct(w.alias("window"), F.lit(False).alias("exact"))))
    by_item = hits.select("segment", "ord", F.inline(told)).join(windows.select("window", "item"), "window")
    of = lambda exact: F.sort_array(F.collect_set(F.when(F.col("exact") == exact, F.col("item"))))
    by_item = by_item.groupBy("segment", "ord").agg(of(True).alias("items"), of(False).alias("near_items"))
    spans = hits.groupBy("segment", "ord").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("near")).alias("near"))
    covered = F.aggregate(
        F.sort_array("spans"), F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x[1]).alias("end"), (a["n"] + F.greatest(F.lit(0), x[1] - F.greatest(a["end"], x[0]))).alias("n")))["n"]
    listed = index.select("segment", F.posexplode(F.arrays_zip("keys", "n_words")).alias("ord", "x")).select("segment", F.col("ord").cast("long"), F.col("x.keys").alias(key), F.col("x.n_words").alias("n_words"))
    out = listed.join(spans.join(by_item, ["segment", "ord"], "left"), ["segment", "ord"], "left")
    n_hit = F.coalesce(covered, F.lit(0))
    listed_ = lambda name, kind: F.coalesce(name, F.array().cast(kind)).alias(name)
    near = listed_("near", "array<struct<window:string,start:bigint,end:bigint>>")
    return out.select(
        F.col(f"`{key}`"), "n_words", n_hit.alias("n_hit"), listed_("spans", "array<array<long>>"), listed_("items", "array<string>"), F.size(F.array_distinct(near["window"])).cast("long").alias("n_near"),
        near, listed_("near_items", "array<string>"), (n_hit > 0).alias("contaminated"))
