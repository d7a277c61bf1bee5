"""Rows that every operator must stand: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

RNG = random.Random(7)
LONG = " ".join(RNG.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(i % 977) for i in range(40_000))
PLAIN = " ".join(f"word{i}" for i in range(60))
ROWS = [(1, PLAIN), (2, None), (3, ""), (4, LONG), (1, PLAIN), (None, PLAIN), (5, PLAIN), (6, " \n\t "), (7, "one two"), (8, "one two"), (9, "æ🙂 ÄB\nAb " * 30), (None, None)]
SCHEMA = "doc_id long, text string, kept string, n_words string, row string, segment int, piece double, shard string, lang string, source string, n_chars long"


def documents(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "x", "y", "z", 1, 0.5, "s", "en", "src", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def lines(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
