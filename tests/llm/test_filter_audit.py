from __future__ import annotations

import random
import re
from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyrun.llm import filter_audit

from .helpers import LONG, PLAIN, documents

LABELS = "doc_id long, quality long, toxic long, lang string, n long"


def brute(rows, labels):
    """rows: (doc_id, text, part); filters applied to lists of documents, order by order."""
    rows = [(i, t or "", p or "") for i, t, p in rows]
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in (0, 1))

    def fails(i, t):
        w = re.findall("[^\x20\x09-\x0d]+", t)
        return {c for c, bad in zip("ABCDE", (
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)),
            i is not None and any(j is not None and j < i and u == t for j, u, _ in rows))) if bad}

    out, failing = {}, [(i, p, fails(i, t)) for i, t, p in rows]
    for part in {p for _, _, p in rows}:
        docs, shapley = [(i, f) for i, p, f in failing if p == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone = docs, []
            for step, c in enumerate(order, 1):
                now = [(i, f) for i, f in left if c in f]
                left = [(i, f) for i, f in left if c not in f]
                shapley[c] += len(now)
                out[part, "".join(order), step] = [len(left), len(now), sum(c in f for _, f in gone), sum(f == {c} for _, f in docs), sum(i in good for i, _ in now), sum(i in toxic for i, _ in now)]
                gone += now
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def result(spark, rows, labels):
    docs = documents(spark, [(i, t) for i, t, _ in rows]).drop("lang")
    langs = spark.createDataFrame([(t, i, p) for i, t, p in rows], "text string, doc_id long, lang string") if rows else docs.selectExpr("text", "doc_id", "shard AS lang")
    found = filter_audit.audit(langs.selectExpr("*", "1 AS mask", "'x' AS part", "2 AS n").repartition(3), spark.createDataFrame([(*x, "x", 1) for x in labels], LABELS))
    assert found.columns == ["part", "filter_order", "step", *filter_audit.RESULT] and found.schema["step"].dataType.simpleString() == "int"
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    return set(got)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 31), st.integers(0, 50), st.integers(0, 9)), min_size=1, max_size=32, unique_by=lambda x: x[0]))
def test_walk(cells):
    masks, weights = np.array([c[0] for c in cells]), np.array([c[1:] for c in cells])
    left = filter_audit.survivors(masks, weights, 5)
    for subset in range(32):
        assert left[subset].tolist() == weights[(masks & subset) == 0].sum(axis=0).tolist()


def test_against_brute_force(spark):
    rng = random.Random(4)
    parts = [PLAIN, PLAIN + " " + PLAIN.upper(), " ".join(f"w{i}" for i in range(120)), " ".join(f"w{i}" for i in range(120)) + " 5 %", "AB CD " * 70, "x|y", "", None, LONG, "é " * 101]
    rows = [(rng.choice([i, i, i, None, 7]), rng.choice(parts), rng.choice(["en", "de", None, ""])) for i in range(60)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 60, 2)] + [(7, 0, 1), (7, 1, 0), (None, 1, 1)]
    assert result(spark, rows, labels) == brute(rows, labels)


def test_cases(spark):
    assert result(spark, [], []) == set()
    one = result(spark, [(1, None, None)], [])
    assert one == brute([(1, None, None)], []) and len(one) == 600 and {r[0] for r in one} == {""}
    many = [(i, "same text", "en") for i in range(300)]
    assert result(spark, many, [(0, 1, 0), (1, 1, 1)]) == brute(many, [(0, 1, 0), (1, 1, 1)])
