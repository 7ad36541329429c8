"""The operators of this package as queries over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder
from . import (
    contamination,
    interactions,
    language,
    licenses,
    lines,
    negatives,
    pieces,
    pii,
    quality,
    simhash,
    toolcalls,
    urls,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, d, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_language_id")
def op5(spark: SparkSession, d: str) -> DataFrame:
    return language.predict_languages(table(spark, d, "documents"))


@query("op3_quality_rules")
def op3(spark: SparkSession, d: str) -> DataFrame:
    found = quality.judge(table(spark, d, "documents"), table(spark, d, "labels"))
    return found.select("doc_id", *quality.STATISTICS, "base_failed", "kept")


@query("op6_benchmark_decontamination")
def op6(spark: SparkSession, d: str) -> DataFrame:
    found = contamination.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select("doc_id", "item_id", "covered", "windows", "changed")


@query("op9_pii")
def op9(spark: SparkSession, d: str) -> DataFrame:
    found = pii.find(table(spark, d, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("exact", lambda x: x["k"] == kind)).cast("bigint").alias(f"n_{pii.KINDS[kind]}")

    counts = map(count, (pii.EMAIL, pii.IP, pii.CARD, pii.PHONE))
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.span_text(F.col("exact")), 256).alias("base_sha256"),
        pii.span_text(F.col("spans")).alias("spans"),
    )


@query("op8_license_scan", licenses.oracle_sql())
def op8(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan(table(spark, d, "documents").select("doc_id", "text")).drop("text")


@query("op1_url_filters", urls.oracle_sql())
def op1(spark: SparkSession, d: str) -> DataFrame:
    return urls.judge(table(spark, d, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op10_chat_formatting", toolcalls.ORACLE)
def op10(spark: SparkSession, d: str) -> DataFrame:
    linked = toolcalls.link(toolcalls.dialogue(table(spark, d, "conversations")), spark.sql(toolcalls.REPLY))
    return linked.withColumn("errors", F.array_join("errors", ","))


@query("op2_sentencepiece")
def op2(spark: SparkSession, d: str) -> DataFrame:
    coded = pieces.encode(table(spark, d, "documents").select("doc_id", "text"))
    return coded.select("doc_id", "n_tokens", "ids_sha256", "exact")


@query("op4_line_dedup", lines.ORACLE)
def op4(spark: SparkSession, d: str) -> DataFrame:
    return lines.line_report(table(spark, d, "documents"))


@query("op11_hard_negatives", negatives.ORACLE)
def op11(spark: SparkSession, d: str) -> DataFrame:
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return negatives.hard_negatives(rows, anchors=F.col("vec_id") % 100 == 0)


@query("op12_filter_audit", interactions.ORACLE)
def op12(spark: SparkSession, d: str) -> DataFrame:
    return interactions.filter_interactions(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op13_warc", warc.ORACLE)
def op13(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(
        F.col("page_id").alias("id"), F.col("url").alias("uri"), F.col("html").cast("binary").alias("payload")
    )
    found = warc.round_trip(spark, pages, f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}")
    return found.select(
        warc.page_of(F.col("id")).cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        warc.page_of(F.col("refers_to")).cast("bigint").alias("refers_to"),
    )
