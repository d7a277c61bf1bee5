from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tallyrun.llm import near_dedup
from tallyrun.llm.graph import components

from .helpers import ROWS, documents


def shingle_set(text, size=4):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(docs, percent=80):
    sets = [(i, shingle_set(t)) for i, t in docs]
    low = {i: i for i, _ in docs}
    find = lambda i: i if low[i] == i else find(low[i])
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                low[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    docs = []
    for group in range(14):
        base = [word() for _ in range(rng.choice([3, 4, 12, 40, 120]))]
        for _ in range(rng.randint(1, 12)):
            copy = [word() if rng.random() < rng.choice([0, 0.01, 0.03]) else w for w in base]
            docs.append((len(docs) * 3 % 1009, " ".join(copy) if rng.random() < 0.8 else "\n".join(w.upper() for w in copy)))
    rng.shuffle(docs)
    got = near_dedup.near_duplicates(documents(spark, docs))
    assert sorted(tuple(r) for r in got.collect()) == brute(docs)


def test_links_beyond_the_hub(spark):
    """A chain in which only neighbours are similar, in one bucket with a hub that is like none of the later ones."""
    words = [f"v{i}" for i in range(200)]
    docs = [(k, " ".join(words[3 * k : 3 * k + 80])) for k in range(25)]
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(documents(spark, docs)).collect()) == brute(docs)


def test_tiles_split_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 4)
    rows = [(5, 1, 12, i, i // 2, [i] * 16, 100_000, [i if i < 10 else 3, 5]) for i in range(12)]
    members = spark.createDataFrame(rows, "bucket long, band int, size long, rep long, component long, sketch array<long>, n long, bands array<long>")
    same_band_before = {(3, 10), (3, 11), (10, 11)}
    got = sorted((r["a"], r["b"]) for r in near_dedup._ordered(near_dedup._tiles(members, 1000, 80, False)).collect())
    assert got == [(a, b) for a in range(12) for b in range(a + 1, 12) if a // 2 != b // 2 and (a, b) not in same_band_before]
    assert near_dedup._tiles(members, 1000, 80, False).count() == len(got)
    near = {r["a"]: r["bits"] for r in near_dedup._tiles(members, 1000, 80, True).groupBy("a").agg({"bits": "min"}).withColumnRenamed("min(bits)", "bits").collect()}
    assert near == {i: min(16 * (i ^ j).bit_count() for j in range(12) if j // 2 != i // 2) for i in range(12)}


@pytest.mark.parametrize("stragglers", [1, 200])
def test_tasks_hold_few_copies(spark, monkeypatch, stragglers):
    monkeypatch.setattr(near_dedup, "TILE", 4)
    monkeypatch.setattr(near_dedup, "HELD", 50)
    members = spark.createDataFrame([(5, i, max(0, i - 200 + stragglers)) for i in range(201)], "bucket long, rep long, component long")
    held = [r["count"] for r in near_dedup._copied(*near_dedup._dealt(members)).groupBy("task").count().collect()]
    assert max(held) < 200
    assert stragglers > 1 or sum(held) == 200 + 1 + 50


def test_sketches_bound_similarity():
    rng = np.random.default_rng(4)
    factors = near_dedup._factors(24, 4)
    most = near_dedup.most_bits(80, 24, 4, 1024)
    shared = [rng.integers(0, 2**63, 800).astype(np.uint64) for _ in range(60)]
    pairs = [(np.concatenate([s, rng.integers(0, 2**63, 100).astype(np.uint64)]), np.concatenate([s, rng.integers(0, 2**63, 100).astype(np.uint64)])) for s in shared]
    a, b = (near_dedup.odd_sketches(near_dedup.samples([p[k] for p in pairs], factors), 1024).view(np.uint64) for k in (0, 1))
    differ = np.bitwise_count(a ^ b).sum(axis=1)
    assert differ.max() <= most and 20 < differ.mean() < 60
    far = near_dedup.odd_sketches(near_dedup.samples(shared, factors), 1024).view(np.uint64)
    assert (np.bitwise_count(far[1:] ^ far[:-1]).sum(axis=1) > most).all()


def test_full_sketches_never_reject_similar_sets():
    rng = np.random.default_rng(9)
    for n in (1, 9, 40, 300, 3000, 30_000):
        whole = np.unique(rng.integers(0, 2**63, 2 * n).astype(np.uint64))
        for share in (0.5, 0.7, 0.79, 0.8, 0.81, 0.95, 1.0):
            cut = round(n * 2 * share / (1 + share))
            a, b = whole[:n], whole[n - cut : 2 * n - cut]
            both = len(np.intersect1d(a, b))
            x, y = near_dedup.full_sketches([a, b], 4096).view(np.uint64)
            bits = int(np.bitwise_count(x ^ y).sum())
            assert bits <= len(a) + len(b) - 2 * both
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert bits * 180 <= (len(a) + len(b)) * 20


def test_cases(spark):
    got = near_dedup.near_duplicates(documents(spark))
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert len(rows) == len(ROWS)
    assert [r for r in rows if r[0] in (1, 5)] == [(1, 57, 1, True), (1, 57, 1, True), (5, 57, 1, False)]
    assert {r for r in rows if r[0] in (2, 3, 6)} == {(2, 0, 2, True), (3, 0, 3, True), (6, 0, 6, True)}
    assert {r for r in rows if r[0] in (7, 8)} == {(7, 1, 7, True), (8, 1, 7, False)}
    assert {r for r in rows if r[0] is None} == {(None, 57, 1, False), (None, 0, None, True)}
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (300, 300)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 150: 100, 200: 100}
