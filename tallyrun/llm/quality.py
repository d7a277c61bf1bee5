"""Repetition coverage: how much of a text lies in n-grams and lines that the same text has had before.

Words are numbered, n-grams of every length get rolling 64-bit hashes in numpy, and equal hashes inside one text mark
repeats. A task holds one slice of texts at a time and there is no shuffle, so no key can be hot.

Defined cases: a null or empty text has no words and fails the base rules; a text of any length is read whole; repeated
rows are judged alike, each for itself; an empty table gives an empty result; other columns of the input are not looked
at by ``measure`` and pass unchanged through ``kept_documents``. Ids are not looked at: null and equal ones are like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Codes, column, mixed, slices

#: The most that a text may have of its characters in repeated n-grams of a length (percent), and in repeated lines. A later
#: 10-gram lies in later 5-grams, so that only limits that fall with the length let each length decide.
NGRAM_PERCENT = {5: 20, 6: 18, 7: 16, 8: 14, 9: 12, 10: 10}
#: Lengths above the shortest judge texts of at least so many repeated n-grams: one line said twice is much of a short text.
LEAST_REPEATED = 20
LINE_CHARS_PERCENT = 20
#: Base rules.
MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30

SPACE = " \t\n\x0b\x0c\r"
BLANK = dict.fromkeys(map(ord, SPACE))
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")


def _repeats(hashes: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of n-grams that occur twice or more, and of those among them that are not the first."""
    places = np.flatnonzero(valid)
    order = np.argsort(hashes[places], kind="stable")
    key = hashes[places][order]
    same = key[1:] == key[:-1]
    later, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[1:] = same
    any_[1:] |= same
    any_[:-1] |= same
    return places[order[any_]], places[order[later]]


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measured(texts: list[str | None], lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """The counts of each text, and ``dup<n>_chars`` for each n-gram length."""
    texts = [t or "" for t in texts]
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    count = np.array([len(w) for w in words], np.int64)
    total = int(count.sum())
    codes = Codes()
    flat = [w for ws in words for w in ws]
    ids = np.fromiter(map(codes.__getitem__, flat), np.int64, total)
    chars = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in codes), np.int64, len(codes))[ids] if total else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), count)
    left = np.repeat(np.cumsum(count), count) - np.arange(total)  # words from here to the end of the text
    out = {"n_words": count, "word_chars": np.bincount(doc, chars, len(texts)).astype(np.int64)}
    out["n_symbols"] = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
    lines = [_lines(t) for t in texts]
    out["n_dup_lines"], out["dup_line_chars"] = (np.array([x[i] for x in lines], np.int64) for i in (0, 1))
    word = mixed(ids)
    rolling = np.zeros(total, np.uint64)
    salt = mixed(doc + np.int64(1) * 2**40)
    out["n_repeat_words"] = np.zeros(len(texts), np.int64)
    for n in range(1, max(*lengths, WINDOW) + 1):
        rolling *= np.uint64(0x100000001B3 * 2**8 + 0x6D)
        rolling[: max(0, total - n + 1)] += word[n - 1 :]
        if n not in lengths and n != WINDOW:
            continue
        found, later = _repeats(rolling ^ salt, left >= n)
        if n == WINDOW:
            out["n_repeat_words"] = np.bincount(doc[_covered(found, n, total)], minlength=len(texts)).astype(np.int64)
        if n in lengths:
            inside = _covered(later, n, total)
            out[f"dup{n}_grams"] = np.bincount(doc[later], minlength=len(texts)).astype(np.int64)
            out[f"dup{n}_chars"] = np.bincount(doc[inside], chars[inside], len(texts)).astype(np.int64)
    return out


def _lines(text: str) -> tuple[int, int]:
    seen, again, chars = set(), 0, 0
    for line in text.split("\n"):
        if line in seen:
            again, chars = again + 1, chars + len(line.translate(BLANK))
        elif line.strip(SPACE):
            seen.add(line)
    return again, chars


def judged(x: dict[str, np.ndarray], ngram_percent: dict[int, int], line_percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)."""
    failed = (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > REPEAT_PERCENT * x["n_words"])
    kept = ~failed & (100 * x["dup_line_chars"] <= line_percent * x["word_chars"])
    for n, percent in ngram_percent.items():
        few = x[f"dup{n}_grams"] < (LEAST_REPEATED if n > min(ngram_percent) else 0)
        kept &= few | (100 * x[f"dup{n}_chars"] <= percent * x["word_chars"])
    return failed, kept


def measure(
    docs: DataFrame, key: str = "doc_id", text: str = "text", ngram_percent: dict[int, int] | None = None, line_percent: int = LINE_CHARS_PERCENT
) -> DataFrame:
    """One row per document: the key, all counts, ``base_failed`` and ``kept``."""
    percent = ngram_percent or NGRAM_PERCENT
    lengths = tuple(sorted(percent))
    names = [*COUNTS, *(f"dup{n}_{what}" for n in lengths for what in ("chars", "grams"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            x = measured(column(batch, text).to_pylist(), lengths)
            failed, kept = judged(x, percent, line_percent)
            yield pa.RecordBatch.from_arrays([column(batch, key), *(pa.array(x[n]) for n in names), pa.array(failed), pa.array(kept)], [key, *names, "base_failed", "kept"])

    rows = docs.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean")


def kept_documents(docs: DataFrame, text: str = "text", ngram_percent: dict[int, int] | None = None, line_percent: int = LINE_CHARS_PERCENT) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    percent = ngram_percent or NGRAM_PERCENT
    lengths = tuple(sorted(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            _, kept = judged(measured(column(batch, text).to_pylist(), lengths), percent, line_percent)
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
