"""Documents to training tokens: five stages, each over all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from isobar.llm import contamination, language, lines, pieces, simhash
from isobar.storage import shared_folder


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents in which no language is recognised."""
    return language.keep_known(docs)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out every line that repeats, or nearly repeats, one before it."""
    return lines.drop_repeated_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return simhash.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that hold an item of the benchmark."""
    return contamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text's pieces, and whether decoding gives the text again."""
    coded = pieces.encode(docs)
    return coded.select("doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", "exact")


STAGES = [
    ("language_id", known_language),
    ("line_dedup", new_lines),
    ("simhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", no_benchmark),
    ("sentencepiece", tokens),
]

#: Fingerprints, components and pieces are beyond SQL; the tests hold each stage against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between is written to the shared folder."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
