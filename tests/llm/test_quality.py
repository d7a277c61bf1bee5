from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyrun.llm import quality

from .helpers import PLAIN, ROWS, documents, lines


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text)}
    seen, out["n_dup_lines"], out["dup_line_chars"] = set(), 0, 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            if line in seen:
                out["n_dup_lines"] += 1
                out["dup_line_chars"] += len(re.sub("[\x20\x09-\x0d]", "", line))
            seen.add(line)
    for n in (3, 8):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        later, twice, out[f"dup{n}_grams"] = set(), set(), 0
        for i, g in enumerate(grams):
            if g in grams[:i]:
                later |= set(range(i, i + n))
                out[f"dup{n}_grams"] += 1
            if grams.count(g) > 1:
                twice |= set(range(i, i + n))
        out[f"dup{n}_chars"] = sum(len(words[i]) for i in later)
        if n == 8:
            out["n_repeat_words"] = len(twice)
    return out


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab #\n\té ", max_size=120), st.lists(st.sampled_from(["a", "b", "a b c d e f g h i", "\n"]), max_size=12).map(" ".join)), max_size=5))
def test_against_brute_force(texts):
    got = quality.measured(texts, (3, 8))
    for i, t in enumerate(texts):
        assert {k: int(v[i]) for k, v in got.items()} == brute(t)


def test_cases(spark):
    docs = documents(spark)
    got = quality.measure(docs)
    assert got.count() == len(ROWS)
    assert {(r["doc_id"], r["n_words"], r["kept"]) for r in got.collect() if r["doc_id"] in (1, 2, 3, 6, None)} == {(1, 60, True), (2, 0, False), (3, 0, False), (6, 0, False), (None, 60, True), (None, 0, False)}
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    assert lines(kept, "doc_id", "kept") == sorted([(1, "x"), (1, "x"), (None, "x"), (5, "x"), (4, "x")], key=str)
    assert quality.measure(documents(spark, [])).count() == 0


def test_verdict(spark):
    again = PLAIN + "\n" + " ".join(f"own{i}" for i in range(90)) + "\n" + PLAIN
    once = PLAIN + "\n" + " ".join(f"own{i}" for i in range(900)) + "\n" + PLAIN
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.measure(documents(spark, [(1, again), (2, once), (3, "few words")])).collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (True, False)}


def repeating(n, percent):
    """Words of five letters, of which this part lies in 30 later repeats of n words; no n + 1 words are said twice."""
    parts = [" ".join(f"r{i:02d}{chr(97 + j)}x" for j in range(n)) for i in range(30)]
    said = [w for i, p in enumerate(parts) for w in f"{p} a{i:04d} {p} b{i:04d}".split()]
    return " ".join(said + [f"{i:05d}" for i in range(int(3000 * n / percent) - len(said))])


def test_every_length_decides(spark):
    lengths = tuple(quality.NGRAM_PERCENT)
    for n, percent in quality.NGRAM_PERCENT.items():
        x = quality.measured([repeating(n, percent + 0.5), repeating(n, percent - 0.5)], lengths)
        over = [[m for m, p in quality.NGRAM_PERCENT.items() if 100 * x[f"dup{m}_chars"][i] > p * x["word_chars"][i]] for i in (0, 1)]
        assert over == [[n], []] and x[f"dup{n}_grams"].tolist() == [30, 30]
        failed, kept = quality.judged(x, quality.NGRAM_PERCENT, quality.LINE_CHARS_PERCENT)
        assert failed.tolist() == [False, False] and kept.tolist() == [False, True]
    line = "Ten words of a line that are said twice here"
    brief = " ".join(f"o{i:02d}" for i in range(60))
    got = quality.measure(documents(spark, [(1, f"{line}\n{brief}\n{line}")])).first()
    assert 100 * got["dup10_chars"] > 10 * got["word_chars"] and got["kept"]
