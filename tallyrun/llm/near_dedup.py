"""MinHash near-duplicates with odd sketches.

Every text's set of word shingles is sampled by MinHash. Bands of samples give candidates; the samples are also folded
into a parity bitmap (an odd sketch), and the number of bits in which two bitmaps differ bounds how similar two sets can
be, so that only plausible candidates are confirmed on the full sets. Equal texts are one representative throughout.

Candidates are confirmed in rounds, and components of confirmed links are taken after each, since pairs inside a
component need no confirmation. First every member of a bucket tries the closest of its buckets' smallest members, then
twice the closest member of another component in any of its buckets. What is still in different components, mostly the
fringe of large groups, is compared pair by pair inside tiles of a bounded size, each pair in the first band that it
shares, by odd sketches of the full sets: every bit in which these differ is a differing shingle, so they never reject a
similar pair, and what they leave is confirmed. A pair is thus lost only if it shares no band (about three in a million at
the threshold, fewer above it); links among one bucket's smallest members also need their samples to stay within five
standard deviations of what the threshold expects.

Defined cases: a null, empty or blank text has no shingles and is linked with nothing; fewer words than a shingle make
one shingle; texts of any length are read whole; repeated rows are one representative and all get its component; an empty
table gives an empty result; a row with a null key takes the component of its copies, or null; other columns are not
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import Codes, column, mixed, slices
from .graph import components

SHINGLE, PERCENT = 4, 80
BANDS, ROWS, BITS = 24, 4, 1024
#: Bits of the sketches of full sets.
FULL_BITS = 4096
#: Members of a bucket that are compared with as many others in one tile, copies of members that a task holds at a time, and
#: pairs that it gives out at a time.
TILE, HELD, GIVEN = 1024, 10_000, 100_000
#: Rounds in which members try their closest one.
ROUNDS = 2

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    words = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER).split() for t in texts]
    codes = Codes()
    ids = np.fromiter((codes[w] for ws in words for w in ws), np.int64, sum(map(len, words)))
    word = np.fromiter(map(xxhash.xxh64_intdigest, codes), np.uint64, len(codes))[ids]
    rolling = np.zeros(len(word), np.uint64)
    for i in range(size):
        rolling = rolling * np.uint64(0x9FB21C651E98DF25)
        rolling[: max(0, len(word) - i)] += word[i:]
    rolling, out, at = mixed(rolling), [], 0
    for ws in words:
        n = len(ws)
        if n >= size:
            out.append(np.unique(rolling[at : at + n - size + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(ws), n + 1)][: min(n, 1)], np.uint64))
        at += n
    return out


def _factors(bands: int, rows: int) -> np.ndarray:
    return mixed(np.arange(1, bands * rows + 1)) | np.uint64(1)


def samples(sets: list[np.ndarray], factors: np.ndarray) -> np.ndarray:
    """The smallest value of each set under each hash function; all ones for an empty set."""
    out = np.full((len(sets), len(factors)), ~np.uint64(0))
    for i, s in enumerate(sets):
        for at in range(0, len(s), 512):
            np.minimum(out[i], (factors[:, None] * s[None, at : at + 512]).min(axis=1), out=out[i])
    return out


def odd_sketches(least: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps of samples, as rows of 64-bit numbers."""
    n, k = least.shape
    bit = mixed(least + np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(bits)
    flips = np.bincount((np.arange(n)[:, None] * bits + bit.astype(np.int64)).ravel(), minlength=n * bits).reshape(n, bits) & 1
    return np.packbits(flips.astype(np.uint8), axis=1, bitorder="little").view("<i8")


def most_bits(percent: int, bands: int, rows: int, bits: int) -> int:
    """Bits in which two sketches may differ if their sets may still be similar: five standard deviations of samples, three of bits."""
    k, differ = bands * rows, 1 - percent / 100
    elements = 2 * min(k, k * differ + 5 * math.sqrt(k * differ * (1 - differ)))
    expected = bits / 2 * (1 - (1 - 2 / bits) ** elements)
    return math.ceil(expected + 3 * math.sqrt(expected * elements / bits) + 2)


def signatures(docs: DataFrame, key: str, text: str, size: int, bands: int, rows: int, bits: int) -> DataFrame:
    picked, factors = docs.select(key, text), _factors(bands, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = mixed(np.arange(rows) + 77) | np.uint64(1)
        for batch in slices(batches, text):
            texts = column(batch, text).to_pylist()
            sets = shingles(texts, size)
            least = samples(sets, factors)
            band = (least.reshape(len(sets), bands, rows) * mix).sum(axis=2, dtype=np.uint64)
            band = mixed(band + mixed(np.arange(bands) + 991)).view(np.int64)
            sketch = odd_sketches(least, bits)
            digest = [_digest(t) for t in texts]
            listed = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays(
                [column(batch, key), pa.array(digest, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), listed(band), listed(sketch)], ["key", "digest", "n_shingles", "bands", "sketch"])

    return stored(picked.mapInArrow(run, f"key {picked.schema[key].dataType.simpleString()}, digest binary, n_shingles long, bands array<long>, sketch array<long>"))


def _differing(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _closer(pairs: DataFrame, sketches: DataFrame, most: int) -> DataFrame:
    """(a, b, bits) of pairs whose sketches differ in few bits."""
    one = pairs.join(sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a")
    two = one.join(sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
    return two.select("a", "b", _differing("sa", "sb").alias("bits")).where(F.col("bits") <= most)


def _digest(text: str | None) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join((text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()))


def _texts(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(rep, digest, text) of the representatives in ``wanted`` (rep, digest). Rows under a representative's key with
    another text stay here, and are left out by their digest where texts are read."""
    rows = docs.select(F.col(f"`{key}`").alias("rep"), F.col(f"`{text}`").alias("text"))
    return stored(rows.join(wanted, "rep").groupBy("rep", F.xxhash64("text").alias("raw")).agg(F.first("digest").alias("digest"), F.first("text").alias("text")).drop("raw"))


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs that are similar on their full sets."""
    kind = pairs.schema["a"].dataType.simpleString()
    of = lambda n: texts.select(F.col("rep").alias(n), F.col("digest").alias(f"d{n}"), F.col("text").alias(f"t{n}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "da", "db", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in slices(batches, "ta"):
            for batch in slices([whole], "tb"):
                rows = {c: column(batch, c).to_pylist() for c in ("a", "b", "da", "db", "ta", "tb")}
                texts = {(k, d): t for c in "ab" for k, d, t in zip(rows[c], rows[f"d{c}"], rows[f"t{c}"]) if _digest(t) == d}
                sets = dict(zip(texts, shingles(list(texts.values()), size)))
                similar = []
                for a, da, b, db, ta, tb in zip(*(rows[c] for c in ("a", "da", "b", "db", "ta", "tb"))):
                    x, y = sets.get((a, da)), sets.get((b, db))
                    n = 0 if x is None or y is None or texts[a, da] != ta or texts[b, db] != tb else len(np.intersect1d(x, y, assume_unique=True))
                    similar.append(n > 0 and 100 * n >= percent * (len(x) + len(y) - n))
                yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], ["a", "b"]).filter(pa.array(similar))

    return stored(both.mapInArrow(run, f"a {kind}, b {kind}").distinct())


def full_sketches(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Parity bitmaps of whole sets, as rows of 64-bit numbers."""
    doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    bit = (np.concatenate([*sets, np.zeros(0, np.uint64)]) % np.uint64(bits)).astype(np.int64)
    flips = np.bincount(doc * bits + bit, minlength=len(sets) * bits).reshape(len(sets), bits) & 1
    return np.packbits(flips.astype(np.uint8), axis=1, bitorder="little").view("<i8")


def _full_sketches(texts: DataFrame, size: int) -> DataFrame:
    """(rep, n, sketch) of full sets; n is their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            batch = batch.filter(pa.array([_digest(t) == d for t, d in zip(column(batch, "text").to_pylist(), column(batch, "digest").to_pylist())]))
            sets = shingles(column(batch, "text").to_pylist(), size)
            rows = pa.array(list(full_sketches(sets, FULL_BITS)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([column(batch, "rep"), pa.array([len(x) for x in sets], pa.int64()), rows], ["rep", "n", "sketch"])

    return texts.mapInArrow(run, f"rep {texts.schema['rep'].dataType.simpleString()}, n long, sketch array<long>").dropDuplicates(["rep"])


def _dealt(members: DataFrame) -> tuple[DataFrame, int]:
    """Adds part, copies and parts to members of buckets, and says in how many tasks all their copies are.

    A bucket's members outside its largest component come first in the numbers of parts, ``parts`` of them, and meet every
    part. Those of the largest component meet only these, since pairs inside a component need no comparison.
    """
    named = members.groupBy("bucket", "component").agg(F.count("*").alias("n_component"))
    sizes = named.groupBy("bucket").agg(F.max(F.struct("n_component", "component")).alias("top"), F.sum("n_component").alias("n_all"))
    most, rest = F.col("top.n_component"), F.col("n_all") - F.col("top.n_component")
    sizes = sizes.where(rest > 0).select("bucket", F.col("top.component").alias("largest"), F.ceil(rest / TILE).cast("long").alias("parts"), F.ceil(most / TILE).cast("long").alias("large"))
    inside, number = F.col("component") == F.col("largest"), F.xxhash64("rep")
    placed = members.join(sizes, "bucket").withColumns({
        "part": F.when(inside, F.col("parts") + F.pmod(number, F.col("large"))).otherwise(F.pmod(number, F.col("parts"))),
        "copies": F.when(inside, F.col("parts")).otherwise(F.col("parts") + F.col("large"))})
    return placed.drop("largest", "large"), max(1, -(-(placed.agg(F.sum("copies")).first()[0] or 0) // HELD))


def _copied(placed: DataFrame, tasks: int) -> DataFrame:
    """A copy of each member for every tile that it is in, and the tile's task."""
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    dealt = dealt.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    return dealt.withColumn("task", F.pmod(F.xxhash64("bucket", "low", "high"), F.lit(tasks)))


def _tiles(members: DataFrame, most: int, percent: int, closest: bool, sketches: DataFrame | None = None) -> DataFrame:
    """(a, b, bits) of members of a bucket that lie in different components and may be similar.

    ``members``: bucket, band, size, rep, component, and sketch, n, bands unless ``sketches`` has these by rep. ``closest``: for
    each member a only the closest b whose sketch differs in at most ``most`` bits; else all pairs whose sketches of full
    sets allow the similarity.
    """
    kind = members.schema["rep"].dataType.simpleString()
    placed, tasks = _dealt(members)
    if sketches is not None:
        placed = placed.join(sketches, "rep")
    dealt = _copied(placed, tasks).select("bucket", "low", "high", "part", "band", "rep", "component", "sketch", "n", "bands", "task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).combine_chunks()
        bucket, low, high, part, band, rep, component, n = (rows.column(c).to_numpy() for c in ("bucket", "low", "high", "part", "band", "rep", "component", "n"))
        sketch, bands = (rows.column(c).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(rep), -1) for c in ("sketch", "bands"))
        order = np.lexsort((rep, high, low, bucket))
        new = (np.diff(bucket[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
        for tile in np.split(order, np.flatnonzero(new) + 1):
            left, right = tile[part[tile] == low[tile[0]]], tile[part[tile] == high[tile[0]]]
            for i in tile if closest else left:
                js = tile if closest else right
                js = js[component[js] != component[i]]
                if not closest:
                    js = js[(rep[js] > rep[i]) | (low[i] != high[i])]
                    js = js[(bands[js, : band[i]] != bands[i, : band[i]]).all(axis=1)]
                bits = np.bitwise_count(sketch[js] ^ sketch[i]).sum(axis=1, dtype=np.int64)
                some = bits <= most if closest else bits * (100 + percent) <= (n[js] + n[i]) * (100 - percent)
                js, bits = js[some], bits[some]
                if len(js) and closest:
                    js, bits = js[[np.argmin(bits)]], bits[[np.argmin(bits)]]
                if len(js):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(js), rep[i])), pa.array(rep[js]), pa.array(bits)], ["a", "b", "bits"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in run(batches):
            found.append(batch)
            held += batch.num_rows
            if held >= GIVEN:
                yield from pa.Table.from_batches(found).combine_chunks().to_batches()
                found, held = [], 0
        if found:
            yield from pa.Table.from_batches(found).combine_chunks().to_batches()

    return dealt.groupBy("task").applyInArrow(gathered, f"a {kind}, b {kind}, bits long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    for n in "ab":
        pairs = pairs.join(labels.select(F.col("node").alias(n), F.col("component").alias(f"c{n}")), n, "left")
    return pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """One row per document: key, n_shingles, component_id (the smallest key reachable), kept. Keys are whole numbers."""
    found = signatures(docs, key, text, size, bands, rows, bits)
    reps = stored(found.where("n_shingles > 0").groupBy("digest").agg(F.min("key").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    keyed = reps.where(F.col("rep").isNotNull())
    most = most_bits(percent, bands, rows, bits)

    placed = keyed.select("rep", F.posexplode("bands").alias("band", "bucket"))
    buckets = placed.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("size")).where("size > 1")
    members = stored(placed.join(buckets, "bucket"))
    stars = stored(_closer(members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), keyed, most))
    crowded = members.where("size > 2").select("rep").union(stars.select("a")).union(stars.select("b")).distinct()
    texts = _texts(docs, key, text, keyed.select("rep", "digest").join(crowded, "rep", "left_semi"))

    pairs = _ordered(stars.groupBy("b").agg(F.min_by("a", F.struct("bits", "a")).alias("a")))
    tested = stored(pairs)
    edges = _confirmed(tested, texts, size, percent)
    labels = stored(components(edges))
    for turn in range(ROUNDS + 1):
        last = turn == ROUNDS
        named = members.where("size > 2").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        mixed_ = named.where("rep <> hub").groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
        open_ = stored(named.join(mixed_, "bucket", "left_semi").select("bucket", "band", "size", "rep", "component"))
        if last:
            sketches = _full_sketches(texts.join(open_.select("rep").distinct(), "rep", "left_semi"), size).join(keyed.select("rep", "bands"), "rep")
        else:
            sketches = keyed.select("rep", "sketch", F.lit(0).cast("long").alias("n"), F.array(F.lit(0).cast("long")).alias("bands"))
        close = _tiles(open_, most, percent, not last, sketches)
        direct = _apart(stars, labels)
        if last:
            pairs = close.select("a", "b").unionByName(direct.select("a", "b"))
        else:
            both = close.unionByName(direct).unionByName(direct.select(F.col("b").alias("a"), F.col("a").alias("b"), "bits"))
            pairs = both.groupBy("a").agg(F.min_by("b", F.struct("bits", "b")).alias("b"))
        pairs = stored(_ordered(pairs).join(tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            continue
        tested = tested.unionByName(pairs)
        edges = stored(edges.unionByName(_confirmed(pairs, texts, size, percent)))
        labels = stored(components(edges))

    named = reps.select("digest", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    alone = F.col("n_shingles") == 0
    out = found.select("key", "n_shingles", F.when(alone, F.lit(None)).otherwise(F.col("digest")).alias("digest")).join(named, "digest", "left")
    component = F.when(alone, F.col("key")).otherwise(F.col("component"))
    return out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("key") == component, component.isNull()).alias("kept"))
