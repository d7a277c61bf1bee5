from __future__ import annotations

import random
import re
from collections import Counter
from hashlib import md5

import pytest

from tallyrun.llm import decontaminate

from .helpers import ROWS, documents

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
words_of = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, size):
    words, hit, found = words_of(text), set(), set()
    for item, t in items:
        ws = words_of(t)
        n = min(size, len(ws))
        windows = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [10_000, 25])
def test_against_brute_force(spark, block_words):
    rng = random.Random(11)
    vocabulary = ["the", "Of", "and", "x1", "été", "B-c", "q"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(0, 12))) for i in range(12)] + [(90, None), (91, ""), (92, "!!"), (93, "the Of"), (94, "the of"), (None, "x1 x1 x1")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, "the"), (101, "the"), (None, "THE of")]
    got = decontaminate.decontaminate(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), size=4, block_words=block_words)
    rows = sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got.collect()), key=str)
    named = [(i, t) for i, t in items if i is not None]
    wanted = []
    for i, t in docs:
        n, hit, found = brute(t, [(k if k is not None else "null", x) for k, x in items], 4)
        wanted.append((i, n, hit, tuple(f for f in found if f != "null"), hit > 0))
    assert len(named) == len(items) - 1
    assert rows == sorted(wanted, key=str)


def test_proximity(spark):
    items = spark.createDataFrame([(1, "aa bb cc dd ee ff gg hh ii jj")], "item_id long, text string")
    docs = documents(spark, [(1, "aa bb cc dd ee ff gg hh ii jj"), (2, "aa bb cc XX dd ee ff gg hh ii jj"), (3, "jj aa"), (4, "aa bb zz zz zz zz zz zz zz zz zz zz cc")])
    rows = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, items).collect()}
    assert {k: (r["n_hit"], r["n_near"]) for k, r in rows.items()} == {1: (10, 0), 2: (0, 1), 3: (0, 0), 4: (0, 0)}
    assert [(x["start"], x["end"]) for x in rows[2]["near"]] in ([(0, 10)], [(1, 11)]) and rows[2]["near_items"] == ["1"] and rows[2]["items"] == []
    assert rows[1]["near"] == rows[3]["near"] == [] and rows[1]["near_items"] == [] and rows[1]["items"] == ["1"]


def near_brute(docs, items, size, slop):
    """Windows by document whose rarest term stands where the two next ones are close to their places, but never whole."""
    words = [words_of(t) for _, t in docs]
    counts = Counter(w for ws in words for w in ws)
    windows = set()
    for _, t in items:
        ws = words_of(t)
        windows |= {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()
    out = []
    for ws in words:
        found = {}
        for win in windows:
            order = sorted(range(len(win)), key=lambda j: (counts[win[j]], j))
            if any(tuple(ws[i : i + len(win)]) == win for i in range(len(ws))):
                continue
            for at in (i for i, w in enumerate(ws) if w == win[order[0]]):
                start = at - order[0]
                if all(any(w == win[j] and abs(i - start - j) <= slop for i, w in enumerate(ws)) for j in order[1:3]):
                    found.setdefault(" ".join(win), set()).add((max(start, 0), min(start + len(win), len(ws))))
        out.append(found)
    return out


@pytest.mark.parametrize("block_words", [10_000, 40])
def test_proximity_against_brute_force(spark, block_words):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("the of and x1 q w e r t y".split()) for _ in range(n))
    items = [(i, text(rng.randint(0, 12))) for i in range(12)]
    docs = [(i, text(rng.randint(0, 40))) for i in range(50)]
    got = decontaminate.decontaminate(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), size=6, slop=2, block_words=block_words)
    wanted = near_brute(docs, items, 6, 2)
    assert sum(map(len, wanted)) > 20
    for r in got.collect():
        found = {}
        for x in r["near"]:
            found.setdefault(x["window"], set()).add((x["start"], x["end"]))
        assert found == {md5(w.encode()).hexdigest(): at for w, at in wanted[r["doc_id"]].items()} and r["n_near"] == len(found)
        assert r["near_items"] == sorted({str(i) for i, t in items for w in wanted[r["doc_id"]] if f" {w} " in f" {t} " and (len(w.split()) == 6 or t == w)})


def test_cases(spark):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    got = decontaminate.decontaminate(documents(spark), items)
    assert got.count() == len(ROWS)
    assert sorted(r["doc_id"] for r in got.where("contaminated").collect()) == [7, 8]
    none = decontaminate.decontaminate(documents(spark), items.limit(0))
    assert none.count() == len(ROWS) and none.where("contaminated").count() == 0
    assert decontaminate.decontaminate(documents(spark, []), items).count() == 0
