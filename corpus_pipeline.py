"""A corpus pipeline of five stages; each stage works on all that the one before it kept.

Documents that the quality classifier rejects go; of each group of near-copies the one with the smallest
doc_id stays; repeated passages lose their words; documents with a benchmark passage go; what
is left is encoded. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.llm.bpe import bpe_encode
from plantpulse.llm.decontamination import decontaminate
from plantpulse.llm.jaccard_join import near_duplicates, with_sets
from plantpulse.llm.quality_classifier import quality_classifier
from plantpulse.llm.staging import own_name, staged
from plantpulse.llm.substring_dedup import substring_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _rows(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*(F.col(f"row.`{c}`") for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier, learnt from ``labels``, finds good and not toxic."""
    return _rows(quality_classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("kept"), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: one row with the group's smallest doc_id. Documents without words all stay."""
    found = near_duplicates(docs)
    heads = found.filter(F.col("group").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id")))
    one = staged(heads.groupBy("group").agg(F.min("key").alias("key"), F.first("doc_id").alias("head")), "heads")
    keyed = with_sets(docs, docs.columns)
    chosen = keyed.join(one, (keyed["key"] == one["key"]) & F.col(f"row.doc_id").eqNullSafe(one["head"]), "left_semi")
    # rows that repeat a head, with the same words, are further copies of it
    return _rows(chosen.dropDuplicates(["key"]).select("row").union(keyed.filter("key is null").select("row")), docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the words of repeated 35-word windows out of ``text``, and n_chars follows."""
    before = own_name(docs, "whole_text")
    cut = substring_dedup(docs.withColumn(before, F.col("text")))
    n_chars = F.when(F.col("text").eqNullSafe(F.col(before)), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return cut.withColumn("n_chars", n_chars).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a hit."""
    return _rows(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter(F.size("hits") == 0), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their number."""
    return bpe_encode(docs, carry=["doc_id"]).select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality), ("jaccard_join", near_copies), ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_leaks), ("bpe", tokens)]

#: A fitted classifier is nothing that SQL can express; tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
