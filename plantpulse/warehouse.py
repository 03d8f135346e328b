"""A named set of tables; plans take one of these and never a path."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.functions.dates import as_date, as_ntz, date_sk
from plantpulse.schemas import TABLES
from plantpulse.operators.latest import latest_per_key
from plantpulse.sources.tables import read_table, read_table_or

Maker = Callable[["Warehouse"], DataFrame]

# Columns that carry a fact's time, and how: a filter on each reaches the scan
# (a yyyymmdd partition column prunes folders, a date or timestamp skips row groups).
TIME_COLUMNS: dict[str, tuple[tuple[str, str], ...]] = {
    "fct_production_log": (("production_date", "date"), ("date_sk", "date_sk")),
    "fct_maintenance_log": (("completed_date", "date"), ("action_date_sk", "date_sk")),
    "fct_asset_telemetry": (("recorded_at", "ntz"), ("date_sk", "date_sk")),
    "agg_asset_hourly_health": (("hour_timestamp", "ntz"), ("hour_date", "date")),
}


def latest_hours(wh: Warehouse) -> DataFrame:
    """The last hourly row of every asset; (asset, hour) is the table's key, so no ties."""
    return latest_per_key(wh["agg_asset_hourly_health"], ["asset_id"], "hour_timestamp",
                          ["latest_health_score", "avg_failure_probability", "min_rul_days"])


class Warehouse:
    """Tables by name, built when first asked for.

    ``wh["fct_production_log"]`` gives the frame. A table can come from parquet
    (:meth:`open`), from frames at hand, or from functions that derive it.
    """

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame | Maker],
                 time_columns: Mapping[str, tuple[tuple[str, str], ...]] = TIME_COLUMNS):
        self.spark = spark
        self._makers = dict(tables)
        self._time_columns = dict(time_columns)
        self._frames: dict[str, DataFrame] = {}

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> "Warehouse":
        """All declared tables under ``root/<layer>/<table>``."""
        def reader(name: str) -> Maker:
            return lambda wh: read_table(wh.spark, root, name)

        def latest(wh: Warehouse) -> DataFrame:
            """Kept by the loads; a warehouse that has no such table yet derives it from the hours."""
            return read_table_or(wh.spark, root, "agg_asset_latest_health", latest_hours(wh))

        return cls(spark, {name: reader(name) for name in TABLES} | {"agg_asset_latest_health": latest})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            made = self._makers[name]
            self._frames[name] = made if isinstance(made, DataFrame) else made(self)
        return self._frames[name]

    def __contains__(self, name: str) -> bool:
        return name in self._makers

    def with_tables(self, **tables: DataFrame | Maker) -> "Warehouse":
        """A copy with some tables replaced or added."""
        return Warehouse(self.spark, {**self._makers, **tables}, self._time_columns)

    def between(self, name: str, start: dt.date | str, end: dt.date | str) -> DataFrame:
        """Rows of a fact from day ``start`` to day ``end``, both included."""
        first, last = as_date(start), as_date(end)
        keep: Column = F.lit(True)
        df = self[name]
        for column, kind in self._time_columns[name]:
            if column not in df.columns:
                continue
            c = F.col(column)
            if kind == "date_sk":
                keep = keep & c.between(date_sk(first), date_sk(last))
            elif kind == "ntz":
                keep = keep & (c >= first.cast("timestamp_ntz")) & (c < F.date_add(last, 1).cast("timestamp_ntz"))
            else:
                keep = keep & c.between(first, last)
        return df.filter(keep)

    def last_days(self, name: str, as_of: dt.date | str, days: int) -> DataFrame:
        """Rows from ``as_of - days`` up to ``as_of``, which plays today's date."""
        end = dt.date.fromisoformat(str(as_of))
        return self.between(name, end - dt.timedelta(days=days), end)

    def last_hours(self, name: str, as_of: dt.datetime | str, hours: int) -> DataFrame:
        """Rows from ``as_of - hours`` up to ``as_of``, which plays the current time."""
        end = dt.datetime.fromisoformat(str(as_of))
        start = end - dt.timedelta(hours=hours)
        stamp = next(c for c, kind in self._time_columns[name] if kind == "ntz")
        return self.between(name, start.date(), end.date()).filter(
            (F.col(stamp) >= as_ntz(start)) & (F.col(stamp) <= as_ntz(end)))

    def current_assets(self) -> DataFrame:
        return self["dim_asset"].filter(F.col("is_current"))

    def service_log(self) -> DataFrame:
        """Work orders of the telemetry assets: ``fct_service_log`` where a site keeps one apart."""
        return self["fct_service_log" if "fct_service_log" in self else "fct_maintenance_log"]

    def asset_versions(self) -> DataFrame:
        """All versions of the assets, current and past."""
        return self["dim_asset_versions" if "dim_asset_versions" in self else "dim_asset"]

    def production_assets(self) -> DataFrame:
        """Assets that production rows refer to: ``dim_machine`` where a site keeps one apart."""
        if "dim_machine" in self:
            return self["dim_machine"].filter(F.col("is_current"))
        return self.current_assets()
