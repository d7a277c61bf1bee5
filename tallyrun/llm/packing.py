"""Sum-of-squares packing of token sequences.

A document becomes pieces of at most ``capacity`` tokens (only longer ones are cut). Full pieces are sequences by
themselves. The others are dealt by a hash into groups of a bounded number of pieces; inside a group every piece goes
where the sum of the squared numbers of open bins per residual gap becomes smallest. What a group leaves in open bins
goes on to a second round over all groups, which packs the larger mixture the same way and gives the rest of its open
bins, largest piece first, to the tightest gap. Groups grow in number with the input, never in size, and only lengths are
shuffled, never tokens.

Defined cases: a null or empty text is one piece with the end token alone; a text of any length is read whole and cut
into pieces, the shorter one first; equal rows are packed each for itself; an empty table gives an empty result; a null
key is kept; other columns of the input are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import column, slices

CAPACITY = 2048
#: Pieces that one task packs at a time.
GROUP = 1 << 16
END_OF_TEXT = "<|endoftext|>"
#: A run of white space that goes to the contract's library; the faster one fails on runs of about a million.
BLANKS = 100_000
LONG_RUN = re.compile(rf"\s{{{BLANKS}}}")


class Tokens:
    """Token ids of texts as little-endian 32-bit bytes, in which the vocabulary's special token counts as such."""

    def __init__(self, vocabulary: str, ranks: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        with open(public_tokenizers.path(ranks), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def of(self, text: str) -> bytes:
        return np.array(self._whole(text) if END_OF_TEXT in text or (len(text) >= BLANKS and LONG_RUN.search(text)) else self._fast(text), "<u4").tobytes()

    def _whole(self, text: str) -> list[int]:
        return self.full.encode(text, add_special_tokens=False).ids

    def _fast(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as failure:  # a panic of the library is no Exception
            if isinstance(failure, Exception) or type(failure).__name__ == "PanicException":
                return self._whole(text)
            raise


@lru_cache(1)
def tokens(vocabulary: str, ranks: str) -> Tokens:
    return Tokens(vocabulary, ranks)


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0,
           vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(key, piece, start, length, ids): the token ids of every piece as little-endian unsigned 32-bit numbers.

    ``ranks`` holds the vocabulary of ``vocabulary`` in the faster library's form; both give the same ids.
    """
    rows = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = tokens(vocabulary, ranks), np.array([end], "<u4").tobytes()
        for batch in slices(batches, text):
            row, number, start, length, ids = [], [], [], [], []
            for i, t in enumerate(column(batch, text).to_pylist()):
                all_ids = known.of(t or "") + last
                size = len(all_ids) // 4
                at, k = 0, 0
                while at < size:
                    to = at + ((size - at) % capacity or capacity)
                    row.append(i)
                    number.append(k)
                    start.append(at)
                    length.append(to - at)
                    ids.append(all_ids[4 * at : 4 * to])
                    at, k = to, k + 1
            yield pa.RecordBatch.from_arrays(
                [column(batch, key).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                [key, "piece", "start", "length", "ids"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, piece int, start long, length long, ids binary")


class Bins:
    """Open bins by residual gap."""

    def __init__(self, capacity: int):
        self.capacity, self.count, self.open, self.size = capacity, np.zeros(capacity + 1, np.int64), [[] for _ in range(capacity + 1)], 0

    def place(self, length: int, gap: int) -> int:
        """Puts a piece into a bin with this gap, ``capacity`` for a new one; returns the bin."""
        if gap == self.capacity:
            found, self.size = self.size, self.size + 1
        else:
            found = self.open[gap].pop()
            self.count[gap] -= 1
        if gap > length:
            self.open[gap - length].append(found)
            self.count[gap - length] += 1
        return found

    def least_squares(self, length: int) -> int:
        """The gap whose use makes the sum of squared counts smallest; the tightest of equals, an open bin before a new one."""
        count = self.count
        gaps = np.flatnonzero(count[length:]) + length
        new = 2 * count[self.capacity - length] + 1 if length < self.capacity else 0
        if not len(gaps):
            return self.capacity
        left = gaps - length
        change = 1 - 2 * count[gaps] + np.where(left > 0, 2 * count[left] + 1, 0)
        best = int(np.argmin(change))
        return int(gaps[best]) if change[best] <= new else self.capacity

    def tightest(self, length: int) -> int:
        gaps = self.count[length:] > 0
        first = int(np.argmax(gaps)) if len(gaps) else 0
        return first + length if len(gaps) and gaps[first] else self.capacity


def packed(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece, and the gap left in each bin."""
    bins, at = Bins(capacity), np.zeros(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        at[i] = bins.place(n, bins.least_squares(n))
    gap = np.full(bins.size, capacity, np.int64)
    np.subtract.at(gap, at, lengths)
    return at, gap


def repacked(lengths: np.ndarray, at: np.ndarray, gap: np.ndarray, capacity: int) -> np.ndarray:
    """Gives the pieces of open bins, largest first, to the tightest gap; keeps full bins."""
    loose = np.flatnonzero(gap[at] > 0)
    loose = loose[np.argsort(-lengths[loose], kind="stable")]
    bins = Bins(capacity)
    out = at.copy()
    for i in loose.tolist():
        out[i] = len(gap) + bins.place(int(lengths[i]), bins.tightest(int(lengths[i])))
    return out if bins.size < int((gap > 0).sum()) else at


def pack(rows: DataFrame, order: list[str], length: str = "length", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id`` (a number) and ``offset`` to pieces. ``order`` names columns that tell pieces apart.

    Rows that are equal in all of them change places freely. A round reads what the one before has written, and deals its
    rows by their place there, so that equal rows make no large group. ``group`` is below half a million.
    """
    columns = rows.columns
    rows = stored(rows)
    full = rows.where(F.col(length) >= capacity).withColumns({"sequence_id": F.monotonically_increasing_id() * 4, "offset": F.lit(0).cast("long")})
    loose = rows.where(F.col(length) < capacity)
    first = _round(loose, order, length, capacity, group, 1, last=False)
    second = _round(first.where(F.col("open")).select(*columns), order, length, capacity, group, 2, last=True)
    out = full.select(*columns, "sequence_id", "offset")
    for part in (first.where(~F.col("open")), second):
        out = out.unionByName(part.select(*columns, "sequence_id", "offset"))
    return out


def _round(rows: DataFrame, order: list[str], length: str, capacity: int, group: int, mark: int, last: bool) -> DataFrame:
    groups = max(1, -(-rows.count() // group))
    dealt = rows.withColumn("dealt", F.pmod(F.xxhash64(F.lit(mark), F.monotonically_increasing_id()), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long, open boolean"

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).drop_columns(["dealt"])
        sizes = table.column(length).to_numpy()
        by = pd.DataFrame({"spread": (sizes * 2654435761) % 1009, **{c: table.column(c).to_numpy(zero_copy_only=False) for c in order}})
        turn = by.sort_values(list(by.columns), kind="stable").index.to_numpy()
        table, sizes = table.take(pa.array(turn)), sizes[turn]
        at, gap = packed(sizes, capacity)
        if last:
            at, gap = repacked(sizes, at, gap, capacity), None
        inside = np.argsort(at, kind="stable")
        before = np.cumsum(sizes[inside]) - sizes[inside]
        starts = np.r_[True, at[inside][1:] != at[inside][:-1]]
        offset = np.empty(len(sizes), np.int64)
        offset[inside] = before - np.maximum.accumulate(np.where(starts, before, 0))
        names = pa.array(((key[0].as_py() << 20) + np.unique(at, return_inverse=True)[1]) * 4 + mark)
        open_ = np.zeros(len(sizes), bool) if last else gap[at] > 0
        out = table.append_column("sequence_id", names).append_column("offset", pa.array(offset)).append_column("open", pa.array(open_))
        yield from out.combine_chunks().to_batches()

    return stored(dealt.groupBy("dealt").applyInArrow(run, schema))


def sequences(packed_pieces: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """(sequence_id, ids): each sequence's tokens in order. A sequence is bounded by the capacity."""
    whole = packed_pieces.join(ids.select(key, "piece", "ids"), [key, "piece"])
    joined = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return whole.groupBy("sequence_id").agg(F.concat(F.lit(b""), F.aggregate(joined, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))).alias("ids"))
