"""Operators in DataFrame functions: secrets, shards, URL filters."""

from __future__ import annotations

import random
import re
import struct
from collections import Counter, defaultdict

import xxhash

from tallyrun.llm import secret_scan, sharding, url_filters

from .helpers import ROWS, documents

PATTERNS = {"assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+"),
            "key40": re.compile("[A-Za-z0-9/+]{40,}"), "endpoint": re.compile(r"https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+")}


def brute(text, scope=400):
    found = {k: [m.span() for m in p.finditer(text or "") if {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32, "key40": lambda m: len(m[0]) == 40, "endpoint": lambda m: len(m[0]) >= 12}[k](m)] for k, p in PATTERNS.items()}
    near = lambda s, parts: any(a - scope <= s <= b + scope for a, b in parts)
    found["key40"] = [s for s in found["key40"] if near(s[0], found["access"])]
    found["endpoint"] = [s for s in found["endpoint"] if near(s[0], found["access"]) and near(s[0], found["assign"] + found["hex"] + found["key40"])]
    order = list(PATTERNS)
    listed = sorted((a, order.index(k), b, k) for k, spans in found.items() for a, b in spans)
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in listed)


PARTS = ["password=", "Token: '", "api_key", "SECRET =", "AKIAABCDEFGHIJKL12", "AKIA12", "a1" * 17, "abcdefgh", "é🙂", " ", "\n", "https://s3.example.com/x", "Ab/+" * 10, "x" * 500, "=", ":"]


def test_secrets_against_brute_force(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(500)]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan(documents(spark, list(enumerate(texts)))).collect()}
    assert [(t, got[i], brute(t)) for i, t in enumerate(texts) if got[i] != brute(t)][:2] == []


def test_weak_parts_need_company(spark):
    key, access, end = "Ab/+" * 10, "AKIAABCDEFGHIJKL12", "https://s3.example.com/x"
    texts = [f"{key} {end}", f"{access} {key} {end}", f"{access} {end}", f"{access} {'. ' * 300} {key}", f"{access} token=abcdefgh {end}"]
    got = {r["doc_id"]: [s.split(":")[0] for s in r["spans"].split(",") if s] for r in secret_scan.scan(documents(spark, list(enumerate(texts)))).collect()}
    assert got == {0: [], 1: ["access", "key40", "endpoint"], 2: ["access"], 3: ["access"], 4: ["access", "assign", "endpoint"]}


def test_secret_cases(spark):
    docs = documents(spark, [*ROWS, (20, "see password=abcdefgh1 and 🙂 AKIAABCDEFGHIJKL12"), (20, "see password=abcdefgh1")])
    assert secret_scan.scan(docs).count() == len(ROWS) + 2
    out = secret_scan.redacted(docs, count="n_chars")
    assert out.columns == docs.columns and out.count() == len(ROWS) + 2
    assert sorted((r["text"], r["n_chars"], r["row"]) for r in out.where("doc_id = 20").collect()) == [("see [secret]", 12, "z"), ("see [secret] and 🙂 [secret]", 27, "z")]
    assert Counter(r["text"] for r in out.where("doc_id IS NULL OR doc_id < 20").collect()) == Counter(t for _, t in ROWS)
    empty = documents(spark, [])
    assert secret_scan.scan(empty).count() == 0 and secret_scan.redacted(empty).count() == 0


def test_shards_against_brute_force(spark):
    import math

    weights = [1.0, 2.0, 0.5, 1.0]
    rows = [(i * 7919, "t") for i in range(2000)] + [(5, "t"), (5, "t")]

    def score(key, j, w):
        seed = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        part = ((xxhash.xxh64_intdigest(struct.pack("<i", j), seed) >> 11) + 0.5) / 2**53
        return -math.log(part) / w

    got = sharding.placed(documents(spark, rows).select("doc_id"), "doc_id", weights, grown=1.0).collect()
    slots = defaultdict(list)
    for r in got:
        scores = [score(r["doc_id"], j, w) for j, w in enumerate(weights)]
        assert r["shard"] == scores.index(min(scores))
        more = [*scores, score(r["doc_id"], 4, 1.0)]
        assert r["grown_shard"] == more.index(min(more)) and r["grown_shard"] in (r["shard"], 4)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == len(rows)
    assert 0.3 < len(slots[1]) / len(rows) < 0.6


def test_shard_cases(spark):
    got = sharding.placed(documents(spark).select("doc_id", "text"), "doc_id", [1.0, 1.0], grown=1.0)
    assert got.count() == len(ROWS)
    assert len({r["shard"] for r in got.where("doc_id IS NULL").collect()}) == 1
    assert sharding.placed(documents(spark, []).select("doc_id"), "doc_id", [1.0]).count() == 0


ENTRIES = "list string, kind string, pattern string, verdict string, action string, at long"


def test_url_filters_at_fetch_time(spark):
    entries = spark.createDataFrame([
        ("spam", "host", "a.example.com", "block", "add", 100), ("spam", "host", "a.example.com", "block", "remove", 200), ("spam", "host", "a.example.com", "block", "add", 300),
        ("good", "path", "a.example.com/en/", "allow", "add", 150), ("parked", "domain", "example.org", "block", "add", 50), ("one", "url", "b.example.org/x", "allow", "add", 60),
        ("both", "host", "c.example.net", "block", "add", 10), ("both", "host", "c.example.net", "block", "remove", 10), ("none", "host", "x", "block", "add", None)], ENTRIES)
    asked = [(1, "http://a.example.com/q", 99), (2, "http://a.example.com/q", 100), (3, "https://u@A.example.com:8/en/1?x#y", 199), (4, "http://a.example.com/en", 199), (5, "http://a.example.com/q", 200),
             (6, "http://a.example.com/q", 10_000_000), (7, "http://sub.example.org/x", 50), (8, "http://b.example.org/x?q", 70), (9, "http://notexample.org/", 70), (10, "http://c.example.net/", 20), (11, None, 5), (12, "nonsense", 5),
             (13, "http://a.example.com/q", None), (14, "http://sub.example.org", 49), (2, "http://a.example.com/q", 100), (None, "http://a.example.com/q", 100)]
    captures = spark.createDataFrame([(*a, "k") for a in asked], "id long, url string, at long, kind string")
    answer = lambda **how: sorted(((r["id"], r["verdict"], r["decided_by"], r["n_active"]) for r in url_filters.evaluate(captures, entries, "id", "url", "at", **how).collect()), key=str)
    got = answer()
    assert answer(bucket=30, group_rows=1) == got
    spam, parked = ("block", "spam|host|a.example.com", 1), ("block", "parked|domain|example.org", 1)
    no = ("none", "", 0)
    wanted = {1: no, 3: ("allow", "good|path|a.example.com/en/", 2), 4: ("allow", "good|path|a.example.com/en/", 2), 5: no, 6: spam, 7: parked, 8: ("allow", "one|url|b.example.org/x", 2), 9: no, 10: no, 11: no, 12: no, 13: no, 14: no}
    assert got == sorted([*((k, *v) for k, v in wanted.items()), (2, *spam), (2, *spam), (None, *spam)], key=str)
    assert url_filters.evaluate(captures.limit(0), entries, "id", "url", "at").count() == 0
    assert url_filters.evaluate(captures, entries.limit(0), "id", "url", "at").where("n_active > 0").count() == 0
