"""The operators' registered queries, each over its whole table, and their SQL where it can state them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from . import bpe, chat, decontaminate, filter_audit, html_text, near_dedup, packing, phrases, quality, secret_scan, sharding, url_filters, warc
from .common import table


def chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations are trees in which every message answers the one before."""
    said = table(spark, folder, "conversations").select(F.col("conv_id").alias("tree"), "turn", "role", "text")
    tricky = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "tree long, turn long, role string, text string")
    rows = said.unionByName(tricky).withColumn("node", F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long"))
    messages = rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
    return chat.read_back(chat.formatted(chat.chosen_paths(messages))).drop("path").withColumnRenamed("tree", "conv_id")


def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    rows = packing.pieces(table(spark, folder, "documents"))
    rows = rows.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(rows, ["doc_id", "piece", "ids_crc32"])


#: The captures' first fetch time, and the days over which they spread.
FIRST_FETCH, DAYS = 1_700_000_000, 180


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries of four lists about the pages' own hosts and addresses, dealt by digests."""
    seen = pages.where("url IS NOT NULL").select(url_filters.host(F.col("url")).alias("host"), url_filters.path(F.col("url")).alias("path")).where("host <> ''").distinct()
    number = lambda c: F.conv(F.substring(F.md5(c.cast("binary")), 1, 6), 16, 10).cast("long")
    day = lambda n, plus: F.lit(FIRST_FETCH) + (n % 60 + plus) * 86_400
    hosts = seen.select("host").distinct().withColumn("n", number(F.col("host")))
    parents = hosts.select(F.substring_index("host", ".", -3).alias("host")).distinct().withColumn("n", number(F.col("host")))
    entry = lambda rows, when, name, kind, pattern, verdict, action, at: rows.where(when).select(
        F.lit(name).alias("list"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(verdict).alias("verdict"), F.lit(action).alias("action"), at.alias("at"))
    addresses = seen.withColumn("n", number(F.concat("host", "path")))
    h, n = F.col("host"), F.col("n")
    parts = [
        entry(hosts, n % 3 == 0, "spam", "host", h, "block", "add", day(n, 0)),
        entry(hosts, n % 6 == 0, "spam", "host", h, "block", "remove", day(n, 60)),
        entry(hosts, n % 12 == 0, "spam", "host", h, "block", "add", day(n, 90)),
        entry(parents, n % 2 == 0, "parked", "domain", h, "block", "add", day(n, 20)),
        entry(hosts, n % 4 == 1, "trusted", "path", F.concat(h, F.lit("/en/")), "allow", "add", day(n, 10)),
        entry(addresses, n % 20 == 0, "reports", "url", F.concat("host", "path"), "block", "add", day(n, 5)),
        entry(addresses, n % 40 == 0, "reports", "url", F.concat("host", "path"), "block", "remove", day(n, 45)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.lit(FIRST_FETCH) + F.pmod(F.col("page_id") * 7919, F.lit(DAYS * 86_400)))
    return url_filters.evaluate(captures, list_entries(pages), "page_id", "url", "fetched")


def html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_text(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(table(spark, folder, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


#: Forty shards of equal weight, and one more when they grow.
SHARDS = 40


def rendezvous_sharding(spark: SparkSession, folder: str) -> DataFrame:
    bytes_ = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, folder, "documents").select("doc_id", (F.octet_length(bytes_) + 16).cast("long").alias("size"), F.crc32(bytes_).alias("text_crc32"))
    return sharding.placed(rows, "doc_id", [1.0] * SHARDS, grown=1.0).withColumn("law", F.lit("key"))


def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated", "n_near")


def warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    to = f"{shared_folder(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    warc.write_archives(pages, to)
    kind = pages.schema["page_id"].dataType
    found = warc.payloads(warc.read_archives(spark, to))
    return found.select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.measure(table(spark, folder, "documents"))


def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(phrases.frequent_phrases(table(spark, folder, "documents")))


def filter_interactions(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def byte_level_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_formatting": chat_formatting,
        "op2_best_fit_packing": best_fit_packing,
        "op3_url_filters": url_filter,
        "op4_benchmark_decontamination": benchmark_decontamination,
        "op5_warc": warc_archives,
        "op6_minhash_near_dedup": minhash_near_dedup,
        "op7_secret_scans": secret_scans,
        "op8_html_extraction": html_extraction,
        "op9_rendezvous_sharding": rendezvous_sharding,
        "op10_quality_rules": quality_rules,
        "op11_phrase_collocation_mining": phrase_collocations,
        "op12_filter_interaction_audit": filter_interactions,
        "op13_byte_level_bpe": byte_level_bpe,
    }
