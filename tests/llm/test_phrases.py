from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyrun.llm import phrases

from .helpers import LONG, PLAIN, ROWS, documents

WORDS = ["aa", "Bb", "cc", "dd", "e\xe9", "f\x1cf", "gg|", "HH"]


def brute_counts(rows, longest):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, " ".join(words[i : i + k])) for i in range(len(words) - k + 1))
    return counts, totals


def brute(rows, threshold, best=2000, longest=5):
    counts, totals = brute_counts(rows, longest)
    found = {key: a for key, a in counts.items() if a >= threshold and " " in key[1]}
    out = []
    for lang in {lang for lang, _ in found}:
        scored = []
        for (of, phrase), a in found.items():
            if of != lang or any(o == lang and len(p) > len(phrase) and f" {phrase} " in f" {p} " and b >= a for (o, p), b in found.items()):
                continue
            w = phrase.split(" ")
            cuts = [(1000 * a * totals[lang] // (counts[lang, " ".join(w[:k])] * counts[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
            low, k = min(cuts)
            scored.append((-low, -a, phrase.encode(), counts[lang, " ".join(w[:k])], counts[lang, " ".join(w[k:])]))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:best], 1)]
    return sorted(out)


def corpus(seed, n=150):
    rng = random.Random(seed)
    said = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(2, 7))) for _ in range(12)]
    text = lambda: "".join(rng.choice([rng.choice(said), rng.choice(WORDS)]) + rng.choice([" ", " ", "  ", ". ", "\t", "\n", "!?", ""]) for _ in range(rng.randint(0, 12)))
    return [(rng.choice(["x", "x", "y", None, "und"]), rng.choice([text(), text(), text(), None])) for _ in range(n)]


@pytest.mark.parametrize(("seed", "threshold", "shards", "buckets", "size"), [(1, 3, 3, 1 << 16, 200), (2, 8, 4, 3, 100), (3, 5, 1, 64, 10_000), (4, 2, 7, 7, 50), (5, 20, 2, 1, 300)])
def test_against_brute_force(spark, seed, threshold, shards, buckets, size):
    """Few buckets make most phrases share one, and slices of a few texts many steps in which phrases begin."""
    rows = corpus(seed)
    docs = spark.createDataFrame([(t, g, "a", 1, 2) for g, t in rows], "text string, lang string, part string, n long, words long").repartition(5)
    frequent = phrases.frequent_phrases(docs, threshold=threshold, shards=shards, buckets=buckets, size=size)
    counts, totals = brute_counts(rows, 5)
    got = {(r["part"], r["phrase"]): r["n"] for r in frequent.where("words > 0").collect()}
    want = {k: n for k, n in counts.items() if n >= threshold}
    assert got == want
    assert {r["part"]: r["n"] for r in frequent.where("words = 0").collect()} == {k: n for k, n in totals.items() if n or any(g == k and t for g, t in ((g or "und", t) for g, t in rows))}
    assert sorted(map(tuple, phrases.collocations(frequent).collect())) == brute(rows, threshold)
    assert sorted(map(tuple, phrases.collocations(frequent, best=4).collect())) == brute(rows, threshold, best=4)


def test_each_phrase_has_one_full_cycle():
    """At every step that begins after its subphrases are known, a phrase has the same first step and is counted in its cycle."""
    words, codes = pa.array([b"a", b"b"]), np.array([1, 2, 1, 2, 0, 1, 1])
    known = np.full(1 << 12, phrases.NEVER, np.uint8)
    known[phrases.buckets_of(phrases.word_hashes("x", words.to_pylist()), len(known))] = [2, 4]
    rows = lambda step: (r for batch in phrases.counted("x", words, codes, known, step, 3, 5) for r in batch.to_pylist())
    seen = {step: {(r["phrase"], r["since"]): r["n"] for r in rows(step) if r["words"] == 2} for step in range(9)}
    assert seen[2] == seen[3] | {("a a", 2): 1} == {("a a", 2): 1} and ("a b", 4) not in seen[3]
    assert seen[4] == {("a a", 2): 1, ("a b", 4): 2, ("b a", 4): 1}
    assert seen[5] == seen[6] == {("a b", 4): 2, ("b a", 4): 1}
    assert seen[7] == seen[8] == {}


def test_equal_hashes_are_told_apart():
    codes = np.array([1, 2, 0, 3, 4, 0, 1, 2])
    place, since = np.array([0, 3, 6]), np.array([1, 1, 1])
    got = zip(*(x.tolist() for x in phrases._distinct(np.zeros(3, np.uint64), place, since, codes, 2)))
    assert sorted(got) == [(0, 1, 2), (3, 1, 1)]


def test_exact_scores(spark):
    rng = random.Random(9)
    rows = [tuple(rng.randint(1, 10**rng.randint(1, 15)) for _ in range(4)) for _ in range(300)]
    rows += [(a, n, a * n, 1000) for a, n in ((10**8, 10**8 - 1), (3, 5))] + [(10**15, 10**15, 1, 10**15), (10**14 + 1, 10**15, 10**15, 10**14 + 1)]
    rows = [r for r in rows if 1000 * r[0] * r[1] // (r[2] * r[3]) < 2**63]
    found = spark.createDataFrame(rows, "a long, n long, l long, r long").select("a", "n", "l", "r", phrases.score("a", "n", "l", "r").alias("score")).collect()
    assert all(r["score"] == 1000 * r["a"] * r["n"] // (r["l"] * r["r"]) for r in found)


def test_cases(spark):
    docs = documents(spark)
    found = phrases.frequent_phrases(docs, threshold=2)
    counts, _ = brute_counts([("en", t) for _, t in ROWS], 5)
    assert {(r["phrase"], r["n"]) for r in found.where("words > 0").collect()} == {(p, n) for (_, p), n in counts.items() if n >= 2}
    assert phrases.collocations(phrases.frequent_phrases(documents(spark, []))).count() == 0
    assert phrases.collocations(phrases.frequent_phrases(documents(spark, [(1, None), (2, ""), (3, " .,\n")]))).count() == 0
    long = documents(spark, [(1, LONG), (2, PLAIN * 3)]).withColumn("lang", F.lit(None).cast("string"))
    want = brute([(None, LONG), (None, PLAIN * 3)], 3)
    assert sorted(map(tuple, phrases.collocations(phrases.frequent_phrases(long, threshold=3, size=1000)).collect())) == want
