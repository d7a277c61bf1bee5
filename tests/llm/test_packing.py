from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyrun.llm import packing

from .helpers import LONG, ROWS, documents

WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ids_of = lambda t: [*WHOLE.encode(t or "", add_special_tokens=False).ids, 0]


@settings(max_examples=150, deadline=None)
@given(st.text() | st.text(alphabet=" \n\t\r'sdabé1²<|endoftext>  \x1c\x85"))
def test_same_ids_as_the_tokenizer(text):
    got = np.frombuffer(packing.tokens("byte_bpe_50k.json", "byte_bpe_50k.tiktoken").of(text), "<u4").tolist()
    assert [*got, 0] == ids_of(text)


def test_special_token():
    test = "a <|endoftext|> b"
    assert [*np.frombuffer(packing.tokens("byte_bpe_50k.json", "byte_bpe_50k.tiktoken").of(test), "<u4").tolist(), 0] == ids_of(test)


@pytest.mark.parametrize("blank", [" ", "\t", "\n", " \n"])
def test_long_runs_of_blanks(blank):
    test = "ab" + blank * (2_000_000 // len(blank)) + "x"
    known = packing.tokens("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    assert [*np.frombuffer(known.of(test), "<u4").tolist(), 0] == ids_of(test)
    assert known._fast(test) == known._whole(test)


def test_pieces_and_places(spark):
    rows = packing.pack(packing.pieces(documents(spark)).withColumn("crc", F.crc32("ids")), ["doc_id", "piece", "crc"]).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["crc"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"] <= 4 * 2048
    wanted = sorted(len(ids_of(t)) for _, t in ROWS)
    assert sum(wanted) == sum(r["length"] for r in rows)
    whole = sorted(by_doc[4], key=lambda r: r["piece"])
    assert np.frombuffer(b"".join(r["ids"] for r in whole), "<u4").tolist() == ids_of(LONG)
    assert [r["start"] for r in whole] == np.cumsum([0, *(r["length"] for r in whole[:-1])]).tolist()
    assert all(r["length"] == 2048 for r in whole[1:])
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_doc[1]) == 2 and len(by_doc[None]) == 2


def test_sequences_hold_the_tokens(spark):
    docs = documents(spark, [(i, f"text number {i} " * (i % 40)) for i in range(50)])
    ids = packing.pieces(docs, capacity=64)
    placed = packing.pack(ids.drop("ids"), ["doc_id", "piece"], capacity=64)
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.sequences(placed, ids).collect()}
    for r in placed.collect():
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == ids_of(f"text number {r['doc_id']} " * (r["doc_id"] % 40))[r["start"] : r["start"] + r["length"]]


def test_sum_of_squares_choice():
    bins = packing.Bins(10)
    rng = random.Random(3)
    for _ in range(300):
        length = rng.randint(1, 9)
        chosen = bins.least_squares(length)
        squares = {}
        for gap in [g for g in range(length, 10) if bins.count[g]] + [10]:
            after = bins.count.copy()
            if gap < 10:
                after[gap] -= 1
            if gap > length:
                after[gap - length] += 1
            squares[gap] = int((after[1:10] ** 2).sum())
        assert squares[chosen] == min(squares.values())
        bins.place(length, chosen)


@pytest.mark.parametrize("group", [200, 100_000])
def test_few_sequences(spark, group):
    rng = random.Random(5)
    sizes = [(i, 0, min(2047, int(rng.lognormvariate(6, 1)) + 1)) for i in range(4000)]
    placed = packing.pack(spark.createDataFrame(sizes, "doc_id long, piece int, length long"), ["doc_id", "piece"], group=group)
    least = -(-sum(s for _, _, s in sizes) // 2048)
    assert placed.count() == 4000
    assert placed.select("sequence_id").distinct().count() <= 1.02 * least + 2


def test_equal_rows_make_no_large_group(spark):
    rows = packing.pack(spark.createDataFrame([(None, 0, 3)] * 3000, "doc_id long, piece int, length long"), ["doc_id", "piece"], group=100)
    assert rows.count() == 3000 and rows.schema["sequence_id"].dataType.simpleString() == "bigint"
    assert rows.select("sequence_id").distinct().count() <= 40
    assert rows.select("sequence_id", "offset").distinct().count() == 3000


def test_empty(spark):
    assert packing.pack(packing.pieces(documents(spark, [])), ["doc_id", "piece"]).count() == 0
