"""The pipeline against its stages' brute-force versions, and what each stage keeps."""

from __future__ import annotations

import random
import tempfile

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from .helpers import ROWS, documents
from .test_decontaminate import brute as hits
from .test_near_dedup import brute as groups
from .test_packing import ids_of

ITEM = "which of these five curious animals sleeps longest during the cold dark winter"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(21)
    text = lambda n: " ".join(f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(900)}" for _ in range(n))
    rows = [(i, text(rng.randint(25, 300))) for i in range(60)]
    rows += [(100 + i, t + (" tail" if i % 2 else "")) for i, (_, t) in enumerate(rows[:20])]  # copies and near copies
    rows += [(200, "too short"), (201, None), (202, ""), (203, "again and again " * 40)]
    rows += [(300, f"{text(40)} {ITEM.upper()} {text(40)}"), (301, f"{text(60)} password=abcdefgh12 {text(30)}")]
    folder = tempfile.mkdtemp(prefix="tallyrun-pipeline-")
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], columns).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, "short item"), (3, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs.write.parquet(path := tempfile.mkdtemp() + "/d")
        docs = spark.read.parquet(path)
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    texts = dict(rows)
    assert set(texts) - set(seen["quality rules"]) == {200, 201, 202, 203}
    kept = {i for i, _, _, k in groups([(i, texts[i]) for i in seen["quality rules"]]) if k}
    assert set(seen["near duplicates"]) == kept and 100 not in kept
    clean = {i for i in kept if not hits(texts[i], [(1, ITEM), (2, "short item")], 10)[1]}
    assert set(seen["benchmark decontamination"]) == clean == kept - {300}
    assert set(seen["secret scans"]) == clean
    assert {i for i in clean if seen["secret scans"][i] != texts[i]} == {301} and "abcdefgh12" not in seen["secret scans"][301]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {i: len(ids_of(t)) for i, t in seen["secret scans"].items()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "piece", "length", "ids_crc32").collect()} == {tuple(r) for r in out.select("doc_id", "piece", "length", "ids_crc32").collect()}


def test_every_stage_stands_odd_rows(spark, corpus):
    folder, _ = corpus
    for name, stage in corpus_pipeline.STAGES:
        for rows in (ROWS, []):
            docs = documents(spark, rows)
            out = stage(spark, docs, folder)
            if name != "best-fit packing":
                assert out.columns == docs.columns
            if not rows:
                assert out.count() == 0
            elif name == "near duplicates":
                assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 0, 1, 2, 3, 4, 6, 7, 9]  # rows without an id stay together
            elif name in ("secret scans", "benchmark decontamination"):
                assert out.count() == len(rows)


def test_rows_without_an_own_id(spark, corpus):
    """Contaminated rows go and clean ones stay, whatever ids they share; so do repeated rows."""
    folder, _ = corpus
    clean, bad = "one clean text of a few words " * 3, f"before {ITEM} after"
    rows = [(None, clean), (None, bad), (1, clean + "more"), (1, bad), (2, clean), (2, clean), (3, bad), (3, bad), (None, None), (4, "")]
    docs = documents(spark, rows)
    kept = corpus_pipeline.benchmark_decontamination(spark, docs, folder)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted((r for r in rows if r[1] != bad), key=str)
    assert corpus_pipeline.benchmark_decontamination(spark, documents(spark, []), folder).count() == 0
