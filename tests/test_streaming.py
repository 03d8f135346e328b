"""Streams that see several files, late rows and duplicates."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from plantpulse.sources.shared import shared_dir
from plantpulse.streaming import telemetry as streams

DDL = ("telemetry_id BIGINT, asset_id BIGINT, recorded_at TIMESTAMP_NTZ, temperature_c DECIMAL(6,2), vibration_mm_s DECIMAL(8,4), pressure_psi DECIMAL(7,2), "
       "health_score DECIMAL(5,2), failure_probability DECIMAL(3,2), rul_days INT, is_anomalous BOOLEAN")


@pytest.fixture
def feed(spark, tmp_path):
    """Four files arriving in order; the last one brings a reading of the first hour.

    Spark drops late rows by the watermark of the batch before last, hence the file between.
    """
    batches = [[(1, 0, 5), (2, 0, 40)], [(3, 6, 0), (3, 6, 0)], [(6, 6, 30)], [(4, 0, 59), (5, 10, 0)]]
    for i, rows in enumerate(batches):
        data = [(k, 1, dt.datetime(2025, 1, 1, h, m), 20.0 + k, 1.0, 30.0 + k, 90.0, 0.1, 10, True) for k, h, m in rows]
        df = spark.createDataFrame(data, DDL.replace("DECIMAL(6,2)", "DOUBLE").replace("DECIMAL(8,4)", "DOUBLE").replace("DECIMAL(7,2)", "DOUBLE")
                                   .replace("DECIMAL(5,2)", "DOUBLE").replace("DECIMAL(3,2)", "DOUBLE"))
        typed = df.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in DDL.split(", ")])
        typed.coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        newest = max((tmp_path / "feed").glob("*.parquet"), key=os.path.getmtime)
        os.utime(newest, (1_700_000_000 + 100 * i,) * 2)
    return lambda: streams.read_feed(spark, str(tmp_path / "feed"), DDL, files_per_batch=1)


def test_late_reading_is_left_out_and_open_windows_are_there(feed):
    got = {r.hour_timestamp.hour: r.avg_temperature_c for r in streams.hourly_windows(feed()).collect()}
    assert got == {0: 21.5, 6: 24.0, 10: 25.0}


def test_late_rows_are_counted(feed):
    rows = streams.late_rows(feed()).agg(F.sum("rows_seen"), F.sum("late_rows")).first()
    assert tuple(rows) == (7, 1)


def test_duplicates_across_rows(feed):
    got = streams.deduplicated(feed(), "telemetry_id", ["telemetry_id"])
    assert sorted(r.telemetry_id for r in got.collect()) == [1, 2, 3, 5, 6]


def test_live_state_over_batches(feed):
    row = streams.live_state(feed()).first()
    assert row.recorded_at == dt.datetime(2025, 1, 1, 10) and row.health_score == 90.0


def test_sessions_over_batches_with_late_and_open_ones(feed):
    got = [(r.session_start.hour, r.readings) for r in streams.anomaly_sessions(feed(), gap_minutes=60).collect()]
    assert sorted(got) == [(0, 3), (6, 3), (10, 1)]


def test_sliding_windows_run_to_the_last_open_one(feed):
    rows = {r.window_end: (r.avg_temperature_c, r.readings) for r in streams.sliding_temperature(feed()).collect()}
    assert rows[dt.datetime(2025, 1, 1, 1)] == (21.5, 2) and rows[dt.datetime(2025, 1, 2, 10)] == (25.0, 1) and len(rows) == 34


def test_state_is_compacted_by_run(spark, feed, tmp_path):
    folder = str(tmp_path / "job")
    first = streams.live_state(feed(), folder).collect()
    assert streams.live_state(feed(), folder).collect() == first  # nothing new: the state of the run before
    assert [r.upto for r in spark.read.parquet(f"{folder}/state").select("upto").distinct().collect()] == [3]


def test_empty_feed(spark, tmp_path):
    (tmp_path / "none").mkdir()
    feed = lambda: streams.read_feed(spark, str(tmp_path / "none"), DDL)
    for job in (streams.hourly_windows, streams.sliding_temperature, streams.anomaly_sessions, streams.live_state, streams.late_rows):
        assert job(feed()).collect() == []


def test_a_stopped_stream_goes_on(spark, tmp_path):
    """Same folder, one more file: the new rows are added once and the old ones not again."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "job")
    rows = spark.createDataFrame([(i, f'{{"deviceId": "d{i}", "metric": "m", "value": {i}}}') for i in range(4)] + [(9, "oops")],
                                 "event_id bigint, raw_payload string").withColumn(
        "source_timestamp", F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))
    for ids, good_rows, bad_rows in ((("0", "1", "9"), 2, 1), (("2", "3"), 4, 1)):
        rows.filter(F.col("event_id").isin(*ids)).coalesce(1).write.mode("append").parquet(source)
        feed = streams.read_feed(spark, source, "event_id BIGINT, raw_payload STRING, source_timestamp TIMESTAMP_NTZ")
        good, bad = streams.ingest(feed, ("event_id", "source_timestamp"), folder)
        assert (good.count(), bad.count()) == (good_rows, bad_rows)
    assert sorted(r.event_id for r in good.collect()) == [0, 1, 2, 3] and bad.first().reject_reason == "not json"


def test_shared_dir_needs_a_setting_on_a_cluster(spark):
    class Conf:
        def get(self, key, default=None):
            return self.value

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host"

    Session.conf.value = None
    with pytest.raises(ValueError):
        shared_dir(Session, "x")
    Session.conf.value = "hdfs://shared/"
    assert shared_dir(Session, "x").startswith("hdfs://shared/x-")
