"""Named queries: each applies one operator to its whole table; the pipeline runs several in turn."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from plantpulse.llm.bpe import bpe_round_trip
from plantpulse.llm.chat_format import chains, formatted, read_back
from plantpulse.llm.collocations import collocations
from plantpulse.llm.decontamination import decontaminate, n_hit
from plantpulse.llm.jaccard_join import near_duplicates
from plantpulse.llm.language_id import identify, learnt_groups
from plantpulse.llm.lm_scoring import lm_scores
from plantpulse.llm.merkle_manifest import COLUMNS, digest_of, fold, merkle_manifest, siblings_digest
from plantpulse.llm.oracle import SQL
from plantpulse.llm.quality_classifier import quality_classifier
from plantpulse.llm.quality_rules import quality_rules
from plantpulse.llm.substring_dedup import removals, text_key
from plantpulse.llm.token_counts import token_counts
from plantpulse.llm.toxicity import learnt_toxicity, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = removals(docs).select("key", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
    return docs.select("doc_id", text_key().alias("key")).join(found, "key").drop("key")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_table(spark, sf_dir, "documents"), carry=["doc_id"]).select("row.doc_id", *bpe_digests())


def bpe_digests() -> list[Column]:
    return [F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
            F.sha2("decoded", 256).alias("decoded_sha256")]


CONTROL_SAMPLE = "</s>[INST] ok [/INST]"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sample = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_SAMPLE).alias("text"))
    back = read_back(formatted(chains(turns.unionByName(sample))))
    both = back.select("tree", "text", "turns", F.array_join("trained", "").alias("lost"))
    return both.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("row.doc_id", "n_words", n_hit().alias("n_hit"), "items").select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ["doc_id"]).select(
        "row.doc_id", "score", "kept")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=90, shingle=3).select("doc_id", "n_shingles", "component_id")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scores(_table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("row.doc_id", "n_words", F.round("log_score", 3).alias("log_score"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn(
        "held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2)
    model = learnt_groups(docs.filter(~F.col("held_out")))
    return identify(docs, model, ["doc_id", "held_out"]).select("row.doc_id", "row.held_out", "lang_pred", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, of its sentences and of the longest; a token goes where most of it lies."""
    found = token_counts(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select(
        "row.doc_id", "n_tokens", F.size("by_section").cast("long").alias("n_sections"), "crossing",
        F.coalesce(F.array_max("by_section"), F.lit(0.0)).cast("long").alias("most_tokens"),
        F.sha2(F.array_join(F.transform("by_section", lambda x: x.cast("long").cast("string")), " "), 256).alias("sections_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row proven against the root; every seventh after its n_chars was altered."""
    docs = _table(spark, sf_dir, "documents")
    altered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    shown = F.when(altered, digest_of([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS]))
    found = merkle_manifest(docs.withColumn("shown", shown), carry=["doc_id", "shown"])
    return found.select("row.doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"),
                        fold(F.coalesce("row.shown", "leaf"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn(
        "held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0)
    model = learnt_toxicity(docs.filter(~F.col("held_out")), _table(spark, sf_dir, "labels"))
    found = toxicity(docs, model, ["doc_id", "held_out"])
    return found.select("row.doc_id", "row.held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir).withColumn("ids_sha256", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)).drop("ids")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (pipeline, op1_substring_dedup, op2_bpe, op3_chat_format, op4_quality_rules, op5_decontamination, op6_quality_classifier, op7_jaccard_join,
                                   op8_lm_scoring, op9_language_id, op10_token_counts, op11_collocations, op12_merkle_manifest, op13_toxicity)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
