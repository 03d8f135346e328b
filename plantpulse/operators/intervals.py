"""Range joins at reading level, by bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.functions.dates import wall_micros


def trailing_join(points: DataFrame, readings: DataFrame, key: str, point_time: str, reading_time: str, hours: int) -> DataFrame:
    """Points with each reading of the same key in the ``hours`` before them: point - hours <= reading < point.

    Time is cut into bins as long as the range, so a range meets two bins: points stand in both, readings
    in their own, and the join is one on (key, bin) with the exact bounds checked after. Spark hashes or sorts it and splits
    a bin that is too large; there is no nested loop. Of the readings' columns the key is left out.
    """
    length = hours * 3_600_000_000
    at, seen = F.col("__at"), F.col("__seen")
    left = points.withColumn("__at", wall_micros(F.col(point_time)))
    last = F.floor((at - 1) / F.lit(length))
    left = left.withColumn("__bin", F.explode(F.array(last - 1, last)))
    right = readings.withColumn("__seen", wall_micros(F.col(reading_time))).withColumn("__bin", F.floor(seen / F.lit(length)))
    return left.join(right, [key, "__bin"]).filter((seen >= at - F.lit(length)) & (seen < at)).drop("__at", "__seen", "__bin")
