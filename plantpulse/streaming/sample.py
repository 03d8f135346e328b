"""The streams fed by the sample events file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.bindings import ROTATING_CLASS, SAMPLE_DDL, bind_sample, raw_telemetry, telemetry
from plantpulse.sources.shared import shared_dir
from plantpulse.streaming import telemetry as streams


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.read_feed(spark, sf_dir, SAMPLE_DDL["events"], "events.parquet")


def _telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(_events(spark, sf_dir))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = streams.ingest(raw_telemetry(_events(spark, sf_dir)), ("event_id", "source_timestamp"))
    return good.select("event_id", F.lit(None).cast("string").alias("reject_reason")).unionByName(
        bad.select("event_id", "reject_reason"))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth message is sent twice; one copy must come out."""
    copies = F.when(F.col("telemetry_id") % 10 == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    doubled = _telemetry(spark, sf_dir).withColumn("copy_no", F.explode(copies))
    return streams.deduplicated(doubled, "telemetry_id", ["telemetry_id", "asset_id", "recorded_at"])


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wh = bind_sample(spark, sf_dir)
    assets = wh.current_assets().join(wh["dim_asset_class"], "asset_class_id").select(
        "asset_id", "asset_name", (F.col("class_name") == ROTATING_CLASS).alias("rotating"))
    return streams.alerts(_telemetry(spark, sf_dir), assets)


def _in_files(spark: SparkSession, sf_dir: str, part: Column, n: int) -> DataFrame:
    """The readings as a feed of n files that arrive one after the other, each a batch."""
    folder = shared_dir(spark, "feed")
    rows = spark.read.schema(SAMPLE_DDL["events"]).parquet(f"{sf_dir}/events.parquet")
    for k in range(n):
        rows.filter(part == k).coalesce(1).write.mode("append").parquet(folder)
    return telemetry(streams.read_feed(spark, folder, SAMPLE_DDL["events"], files_per_batch=1))


def stream_late_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files that each hold readings of the whole month: most of the second and third are late."""
    _, late = streams.late_rows_kept(_in_files(spark, sf_dir, F.col("event_id") % 3, 3).select("telemetry_id", "asset_id", "recorded_at"))
    return late


def stream_silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five files of six days each and one of the last reading: assets silent for two days and more."""
    day = F.dayofmonth("ts")
    return streams.silent_assets(_in_files(spark, sf_dir, F.floor((day - 1) / 6), 6))


STREAMS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "stream_ingest": stream_ingest,
    "stream_hourly": lambda spark, d: streams.hourly_windows(_telemetry(spark, d)).withColumns(
        {c: F.col(c).cast("double") for c in ("latest_health_score", "avg_failure_probability")}),
    "stream_sliding": lambda spark, d: streams.sliding_temperature(_telemetry(spark, d)),
    "stream_session": lambda spark, d: streams.anomaly_sessions(_telemetry(spark, d)),
    "stream_dedup": stream_dedup,
    "stream_late_kept": stream_late_kept,
    "stream_silent": stream_silent,
    "stream_alerts": stream_alerts,
    "stream_state": lambda spark, d: streams.live_state(_telemetry(spark, d)),
    "stream_late": lambda spark, d: streams.late_rows(_telemetry(spark, d)).agg(
        F.sum("rows_seen").alias("rows_seen"), F.sum("late_rows").alias("late_rows")),
}
