from __future__ import annotations

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyrun.llm import chat

MESSAGES = "tree long, node long, parent long, role string, text string, score double, path string, t int"
CONTROLS = ["<|end|>", "<|turn|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "a", "\n", "|", ">", "s>", "é🙂", "n"]


def forest(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], MESSAGES).repartition(4)


def test_escapes_are_reversible_and_hide_controls(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(CONTROLS) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", chat.escaped(F.col("text")).alias("hid"), chat.escaped_role(F.col("text")).alias("role")).collect()
    for r in rows:
        assert chat.unescaped(r["hid"]) == r["text"] and chat.unescaped_role(r["role"]) == r["text"]
        assert not any(c in r["hid"] for c in CONTROLS[:8]) and "\n" not in r["role"]


@settings(max_examples=200)
@given(st.text(alphabet="<[|/s>INTYed\\_a", max_size=30))
def test_unescaping_leaves_plain_text(text):
    import re

    hidden = re.sub(r"([<\[])(\\*)" + chat.REST, lambda m: m[1] + m[2] + "\\", text)
    assert chat.unescaped(hidden) == text


def brute(rows, best):
    """Paths by mean score, from messages without repeats or cycles."""
    by_tree = {}
    for tree, node, parent, role, text, score in rows:
        by_tree.setdefault(tree, {})[node] = (parent, role or "", text or "", score or 0.0)
    out = {}
    for tree, nodes in by_tree.items():
        leaves = set(nodes) - {p for p, *_ in nodes.values() if p in nodes}
        paths = []
        for leaf in leaves:
            path, at = [], leaf
            while at in nodes:
                path.append(at)
                at = nodes[at][0]
            paths.append((-sum(nodes[n][3] for n in path) / len(path), leaf, path[::-1]))
        for k, (_, _, path) in enumerate(sorted(paths)[:best]):
            out[tree, k + 1] = [(n, nodes[n][1], nodes[n][2]) for n in path]
    return out


def test_paths_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for tree in [*range(12), None]:
        for node in range(rng.randint(1, 40)):
            rows.append((tree, node, rng.choice([None, *range(node)][-3:]) if node else rng.choice([None, 99]), rng.choice(["user", "assistant", None]), rng.choice(["a", None, "</s> b"]), rng.choice([None, 0.5, 1.0, 2.0])))
    rows += [(50, i, i - 1 if i else None, "user", f"m{i}", 1.0) for i in range(130)]  # a deep chain
    for best in (1, 3):
        got = {}
        for r in chat.chosen_paths(forest(spark, rows), best).collect():
            got.setdefault((r["tree"], r["path"]), []).append((r["position"], r["node"], r["role"], r["text"]))
        assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == brute(rows, best)
        assert all([x[0] for x in sorted(v)] == list(range(len(v))) for v in got.values())


def test_formatted_and_read_back(spark):
    said = [("system", "be <s> kind"), ("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]"), ("use\nr\\", "🙂<|end|>\n"), ("assistant", "fin \\<|end|>")]
    rows = [(3, i, i - 1 if i else None, role, text, 0.0) for i, (role, text) in enumerate(said)]
    pieces = chat.formatted(chat.chosen_paths(forest(spark, rows)))
    (got,) = chat.read_back(pieces).collect()
    loss = "".join(t for r, t in said if r == "assistant")
    assert (got["n_turns"], got["loss_chars"]) == (5, len(loss))
    assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
    assert got["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    (whole,) = chat.conversations(pieces).collect()
    assert len(whole["text"]) == got["formatted_chars"]
    assert [chat.unescaped(whole["text"][a:b]) for a, b in whole["loss"]] == [t for r, t in said if r == "assistant"]


def test_cases(spark):
    rows = [(1, 0, None, "user", "q", None), (1, 0, None, "user", "q", None), (1, 1, 0, None, None, 1.0), (2, 5, 6, "user", "cycle", 1.0), (2, 6, 5, "user", "cycle", 1.0), (3, None, 1, "user", "lost", 1.0), (4, 7, 7, "user", "own parent", 1.0), (None, 1, None, "user", "x" * 200_000, 1.0)]
    got = sorted(((r["tree"], r["n_turns"], r["formatted_chars"]) for r in chat.read_back(chat.formatted(chat.chosen_paths(forest(spark, rows)))).collect()), key=str)
    assert got == sorted([(1, 2, 22 + 17), (4, 1, 31), (None, 1, 200_021)], key=str)
    empty = forest(spark, rows).limit(0)
    assert chat.read_back(chat.formatted(chat.chosen_paths(empty))).count() == 0
