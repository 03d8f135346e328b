"""Generated and literal dimensions: calendar, spines, small code tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.functions.dates import as_date, date_sk
from plantpulse.schemas import TABLES

# Code tables.
WORK_ORDER_TYPES = [
    (1, "Unplanned Emergency", "UE"),
    (2, "Planned Predictive", "PP"),
    (3, "Planned Preventive", "PM"),
    (4, "Inspection", "INSP"),
]
FAILURE_CODES = [
    (1, "Mechanical", "Bearing", "Misalignment"),
    (2, "Mechanical", "Bearing", "Lubrication"),
    (3, "Mechanical", "Seal", "Wear"),
    (4, "Mechanical", "Coupling", "Failure"),
    (5, "Mechanical", "Impeller", "Erosion"),
    (6, "Electrical", "Motor", "Winding"),
    (7, "Electrical", "Motor", "Connection"),
    (8, "Electrical", "Sensor", "Calibration"),
    (9, "Electrical", "Power Supply", "Voltage"),
    (10, "Operational", "Overload", "Capacity"),
    (11, "Operational", "Temperature", "Overheating"),
    (12, "Operational", "Contamination", "Foreign Object"),
]


def _sql_literal(value: object) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def literal_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """INSERT ... VALUES as a frame: a local relation whose size the planner knows.

    For the fixed code tables of this module; values are numbers and strings.
    """
    columns = [c.split() for c in ddl.split(", ")]
    values = ", ".join("(" + ", ".join(_sql_literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(name for name, _ in columns)
    typed = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in columns)
    return spark.sql(f"SELECT {typed} FROM VALUES {values} AS t({names})")


def work_order_types(spark: SparkSession) -> DataFrame:
    return literal_table(spark, WORK_ORDER_TYPES, TABLES["dim_work_order_type"].ddl)


def failure_codes(spark: SparkSession) -> DataFrame:
    rows = [(*code, f"{code[2]}: {code[3]}") for code in FAILURE_CODES]
    return literal_table(spark, rows, TABLES["dim_failure_code"].ddl)


def date_dimension(spark: SparkSession, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """One row per calendar day with the derived labels."""
    return calendar_labels(
        spark.range(1).select(F.explode(F.sequence(as_date(start), as_date(end))).alias("full_date")))


def calendar_labels(days: DataFrame) -> DataFrame:
    """Calendar columns for a frame holding ``full_date``."""
    d = F.col("full_date")
    return days.select(
        date_sk(d).alias("date_sk"), d, F.date_format(d, "EEEE").alias("day_of_week"),
        F.date_format(d, "MMMM").alias("month_name"), F.quarter(d).alias("quarter"), F.year(d).alias("year"))


def spine_by_bounds(bounds: DataFrame, start: str, end: str, step: str, into: str) -> DataFrame:
    """Entity x time grid: each row of ``bounds`` is repeated for every step in [start, end].

    The grid is made inside each entity's row, so no cross join and no global sequence.
    """
    return bounds.withColumn(into, F.explode(F.sequence(F.col(start), F.col(end), F.expr(f"INTERVAL {step}"))))


def time_spine(entities: DataFrame, start: str, end: str, step: str, into: str = "spine_ts") -> DataFrame:
    """Grid over one common range; the end bound is included."""
    bounds = entities.withColumn("__from", F.lit(start).cast("timestamp_ntz")) \
        .withColumn("__to", F.lit(end).cast("timestamp_ntz"))
    return spine_by_bounds(bounds, "__from", "__to", step, into).drop("__from", "__to")


def repeat_rows(df: DataFrame, count: str, into: str) -> DataFrame:
    """Repeat each row ``count`` times numbered from 1; rows with a count below 1 vanish."""
    return (df.filter(F.col(count) >= 1)
            .withColumn(into, F.explode(F.sequence(F.lit(1), F.col(count).cast("int")))))
