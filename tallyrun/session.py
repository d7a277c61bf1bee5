"""Session settings and the shared folder that cuts lineage."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build(app: str, master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return shipped(builder.getOrCreate())


def shipped(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, which need not run where it lies or have it installed."""
    here = Path(__file__).resolve().parent
    if not any(f.endswith(f"/{here.name}.zip") for f in spark.sparkContext.listFiles):
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='tallyrun-code-')}/{here.name}", "zip", here.parent, here.name)
        spark.sparkContext.addPyFile(archive)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees, from ``spark.checkpoint.dir``; a local one only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = tempfile.mkdtemp(prefix="tallyrun-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later steps read files instead of repeating the lineage, and survive lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """Writes a table that many queries read to the shared folder, once, and reads it back.

    Unlike a checkpoint it keeps column pruning, filters and size estimates for the queries that follow. ``by`` names a
    column of few values that gets a folder for each.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tallyrun/table-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, dealt: bool = False) -> DataFrame:
    """As ``stored``, as a table of as many buckets by ``key``: joins, groups and windows by it read it without a shuffle.

    ``dealt`` says that the rows lie together by ``key`` already, as those made from tables with equal buckets do.
    """
    name = f"tallyrun_{uuid.uuid4().hex[:12]}"
    rows = df if dealt else df.repartition(buckets, key)
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", f"{shared_folder(df.sparkSession).rstrip('/')}/tallyrun/{name}").saveAsTable(name)
    return df.sparkSession.table(name)
