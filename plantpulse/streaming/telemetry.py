"""Telemetry streams: ingest, windows, sessions, deduplication, alerts, live state, late rows.

Watermarks need a zoned timestamp, so the NTZ event time is cast on the way in and cast
back on the way out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plantpulse.functions.dates import wall_micros
from plantpulse.functions import bands
from plantpulse.functions.numeric import half_up, ratio_or_null
from plantpulse.operators.ordered import session_slots, sessions_of_slots
from plantpulse.plans.gold import health_of_hour, hour_moments
from plantpulse.sources import bronze
from plantpulse.streaming.run import BATCH, ddl, drain_append, drain_partials, drain_update, for_each_batch, read_or_empty

TS = "event_time"


def read_feed(spark: SparkSession, folder: str, schema: str, file_name: str = "*.parquet",
              files_per_batch: int | None = None) -> DataFrame:
    """File stream of parquet files of one folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_name)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def with_event_time(stream: DataFrame, column: str, delay: str) -> DataFrame:
    return stream.withColumn(TS, F.col(column).cast("timestamp")).withWatermark(TS, delay)


def _ntz(column: str) -> Column:
    return F.col(column).cast("timestamp_ntz")


def ingest(raw: DataFrame, keep: tuple[str, ...], folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Parse messages; good rows and rejects go to their own tables. One parse per batch row."""
    parsed = bronze.parse_telemetry(raw, keep=keep)

    def split(batch: DataFrame, batch_id: int, base: str) -> None:
        outcome = F.when(F.col("reject_reason").isNull(), "accepted").otherwise("rejected")
        (batch.withColumn("outcome", outcome).write.mode("overwrite")
         .partitionBy("outcome").parquet(f"{base}/out/{BATCH}={batch_id}"))

    base = for_each_batch(parsed, "append", "stream-ingest", split, folder)
    out = read_or_empty(raw.sparkSession, f"{ddl(parsed)}, {BATCH} BIGINT, outcome STRING", f"{base}/out")
    good = bronze.accepted(out.filter(F.col("outcome") == "accepted"), "raw_payload").drop("outcome", BATCH)
    return good, bronze.rejected(out.filter(F.col("outcome") == "rejected"), "raw_payload", keep)


def hourly_windows(telemetry: DataFrame, delay: str = "2 hours", folder: str | None = None) -> DataFrame:
    """Hourly health per asset, open hours included (update mode). Later than ``delay``, rows are left out."""
    rows = with_event_time(telemetry, "recorded_at", delay)
    agg = rows.groupBy(F.window(TS, "1 hour"), "asset_id").agg(*hour_moments())
    out = agg.select(_ntz("window.start").alias("hour_timestamp"), "asset_id", *health_of_hour())
    return drain_update(out, ["hour_timestamp", "asset_id"], "stream-hourly", folder)


def sliding_temperature(telemetry: DataFrame, delay: str = "2 hours", folder: str | None = None) -> DataFrame:
    """24-hour mean temperature per asset, every hour, windows that are still open included.

    The stream keeps sums per hour; the sliding windows repeat one row per asset-hour 24
    times, not every reading.
    """
    rows = with_event_time(telemetry.filter(F.col("temperature_c").isNotNull()), "recorded_at", delay)
    hourly = rows.groupBy(F.window(TS, "1 hour"), "asset_id").agg(F.sum("temperature_c").alias("s"), F.count("temperature_c").alias("n"))
    sums = drain_update(hourly.select(_ntz("window.start").alias("hour"), "asset_id", "s", "n"), ["hour", "asset_id"], "stream-sliding", folder)
    ends = F.sequence(F.expr("hour + INTERVAL 1 HOUR"), F.expr("hour + INTERVAL 24 HOURS"), F.expr("INTERVAL 1 HOUR"))
    slid = sums.withColumn("window_end", F.explode(ends)).groupBy("window_end", "asset_id").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return slid.select("window_end", "asset_id", half_up(ratio_or_null(F.col("s"), F.col("n")), 2).alias("avg_temperature_c"),
                       F.col("n").alias("readings"))


def anomaly_sessions(telemetry: DataFrame, gap_minutes: int = 720, folder: str | None = None) -> DataFrame:
    """Sessions of anomalous readings per asset, the open ones included.

    Every batch is reduced to gap-long slots of an asset before anything is shuffled, and sessions
    are put together from slots: a hot asset is a few rows, and late readings count.
    """
    rows = telemetry.filter(F.col("is_anomalous")).select("asset_id", "recorded_at")
    parts = drain_partials(rows, "stream-session", lambda batch: session_slots(batch, ["asset_id"], "recorded_at", gap_minutes), folder)
    slots = parts.groupBy("asset_id", "__slot").agg(
        F.min("__first").alias("__first"), F.max("__last").alias("__last"), F.sum("__n").alias("__n"))
    found = sessions_of_slots(slots, ["asset_id"], gap_minutes, at_gap=False)
    return found.select("asset_id", "session_start", (F.col("last_reading") + F.expr(f"INTERVAL {gap_minutes} MINUTES")).alias("session_end"), "readings")


def deduplicated(telemetry: DataFrame, key: str, columns: list[str], delay: str = "2 hours",
                 folder: str | None = None) -> DataFrame:
    """First copy of every message id within the watermark."""
    rows = with_event_time(telemetry, "recorded_at", delay).dropDuplicatesWithinWatermark([key])
    return drain_append(rows.select(*columns), "stream-dedup", folder)


def alerts(telemetry: DataFrame, assets: DataFrame, folder: str | None = None) -> DataFrame:
    """Anomalous readings enriched from the asset dimension (stream-static join, no state)."""
    rows = telemetry.join(assets, "asset_id").filter(
        bands.is_anomaly(F.col("health_score"), F.col("vibration_mm_s"), F.col("rotating")))
    out = rows.select("telemetry_id", "asset_id", "asset_name", "recorded_at", F.col("health_score").cast("double").alias("health_score"))
    return drain_append(out, "stream-alerts", folder)


def live_state(telemetry: DataFrame, folder: str | None = None) -> DataFrame:
    """Latest reading per asset, kept up to date by every batch.

    A stateful ``max_by`` rather than per-group Python: rows of a batch are reduced per
    asset in their own task, and the state is one row per asset.
    """
    rank = F.struct("recorded_at", "telemetry_id")
    row = F.struct("recorded_at", F.col("health_score").cast("double").alias("health_score"),
                   F.col("failure_probability").cast("double").alias("failure_probability"), "rul_days", "is_anomalous")
    agg = telemetry.groupBy("asset_id").agg(F.max_by(row, rank).alias("r"))
    return drain_update(agg.select("asset_id", "r.*"), ["asset_id"], "stream-state", folder)


def late_rows(telemetry: DataFrame, delay_hours: int = 2, folder: str | None = None) -> DataFrame:
    """Rows, and rows older than the watermark of the batches before, per micro-batch.

    The newest time so far stays a column (``newest`` runs over all earlier batches), so no
    zone of the driver can shift it, and a batch reads the one batch before it.
    """
    spark = telemetry.sparkSession
    kind = "rows_seen BIGINT, late_rows BIGINT, newest TIMESTAMP_NTZ"

    def account(batch: DataFrame, batch_id: int, base: str) -> None:
        earlier = read_or_empty(spark, f"{kind}, {BATCH} BIGINT", f"{base}/out").filter(F.col(BATCH) == batch_id - 1)
        before = earlier.agg(F.max("newest")).scalar()  # null at the start
        late = F.col("recorded_at") < before - F.expr(f"INTERVAL {delay_hours} HOURS")
        counts = batch.agg(F.count(F.lit(1)).alias("rows_seen"), F.count_if(late).alias("late_rows"),
                           F.max("recorded_at").alias("newest")).withColumn("newest", F.greatest("newest", before))
        counts.write.mode("overwrite").parquet(f"{base}/out/{BATCH}={batch_id}")

    base = for_each_batch(telemetry.select("recorded_at"), "append", "stream-late", account, folder)
    return read_or_empty(spark, f"{kind}, {BATCH} BIGINT", f"{base}/out")


def late_rows_kept(telemetry: DataFrame, delay_hours: int = 2, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(per batch: rows seen, late rows and the newest time so far; the late rows themselves with their batch).

    A row is late if it is older than the newest time of all earlier batches less the delay. A batch that is run
    again overwrites what it left.
    """
    spark = telemetry.sparkSession
    kind = "rows_seen BIGINT, late_rows BIGINT, newest TIMESTAMP_NTZ"

    def keep(batch: DataFrame, batch_id: int, base: str) -> None:
        earlier = read_or_empty(spark, f"{kind}, {BATCH} BIGINT", f"{base}/figures").filter(F.col(BATCH) == batch_id - 1)
        before = earlier.agg(F.max("newest")).scalar()  # null at the start
        late = F.coalesce(F.col("recorded_at") < before - F.expr(f"INTERVAL {delay_hours} HOURS"), F.lit(False))
        batch.filter(late).write.mode("overwrite").parquet(f"{base}/late/{BATCH}={batch_id}")
        figures = batch.agg(F.count(F.lit(1)).alias("rows_seen"), F.count_if(late).alias("late_rows"),
                            F.max("recorded_at").alias("newest")).withColumn("newest", F.greatest("newest", before))
        figures.write.mode("overwrite").parquet(f"{base}/figures/{BATCH}={batch_id}")

    base = for_each_batch(telemetry, "append", "stream-late-kept", keep, folder)
    return (read_or_empty(spark, f"{kind}, {BATCH} BIGINT", f"{base}/figures"),
            read_or_empty(spark, f"{ddl(telemetry)}, {BATCH} BIGINT", f"{base}/late"))


def silent_assets(telemetry: DataFrame, silent_hours: int = 48, delay: str = "2 hours", folder: str | None = None) -> DataFrame:
    """asset_id, silent_since, told_at: assets without a reading for so long after one, told when the watermark gets there or the next reading comes.

    State per asset is the time of its last reading, with a timer in event time that every newer reading sets again. An
    asset is told once: when the timer runs out, or when a later reading shows that it should have.
    """
    gap = silent_hours * 3_600_000

    def told(asset: int, since: list[int]) -> pd.DataFrame:
        at = pd.Series(since, dtype="int64")
        return pd.DataFrame({"asset_id": pd.Series([asset] * len(at), dtype="int64"), "silent_since": pd.to_datetime(at, unit="ms"),
                             "told_at": pd.to_datetime(at + gap, unit="ms")})

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield told(key[0], [last])
            return
        times = np.sort(np.concatenate([[state.get[0]] if state.exists else [], *(f["at_ms"].to_numpy() for f in frames)]).astype(np.int64))
        since = times[:-1][np.diff(times) >= gap]
        state.update((int(times[-1]),))
        state.setTimeoutTimestamp(max(int(times[-1]) + gap, state.getCurrentWatermarkMs() + 1))
        if len(since):
            yield told(key[0], since.tolist())

    rows = with_event_time(telemetry, "recorded_at", delay).select("asset_id", TS, F.floor(wall_micros(F.col("recorded_at")) / 1000).cast("long").alias("at_ms"))
    out = rows.groupBy("asset_id").applyInPandasWithState(
        watch, "asset_id long, silent_since timestamp_ntz, told_at timestamp_ntz", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return drain_append(out, "stream-silent", folder)
