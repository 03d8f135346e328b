"""The Python function surface: grouped, vectorised and table functions.

Each is a small helper that Spark feeds in Arrow batches; native expressions do the same
work in the main paths and the tests hold both equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.functions.bands import STANDARD_PERFORMANCE

OEE_SCHEMA = "plant_name STRING, availability DOUBLE, performance DOUBLE, quality DOUBLE, oee DOUBLE"


def _round6(x: float) -> float:
    return float(int(x * 1e6 + 0.5)) / 1e6


def oee_of_group(rows: pd.DataFrame) -> pd.DataFrame:
    """OEE of one plant from its daily sums."""
    planned, actual = rows["planned"].sum(), rows["actual"].sum()
    made, lost = rows["produced"].sum(), rows["scrapped"].sum()
    available = actual / planned if planned > 0 else 0.0
    good = (made - lost) / made if made > 0 else 0.0
    return pd.DataFrame([{
        "plant_name": rows["plant_name"].iloc[0], "availability": _round6(available), "performance": STANDARD_PERFORMANCE,
        "quality": _round6(good), "oee": _round6(available * STANDARD_PERFORMANCE * good)}])


def oee_by_group(daily: DataFrame) -> DataFrame:
    """Applies :func:`oee_of_group` per plant; takes one row per plant and day, so groups are bounded."""
    return daily.groupBy("plant_name").applyInPandas(oee_of_group, OEE_SCHEMA)


def health_band_udf():
    """Vectorised health band of a score column."""
    @F.pandas_udf("string")
    def band(scores: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in scores:
            out = pd.Series("immediate", index=s.index, dtype="object")
            out[s >= 75] = "attention"
            out[s >= 90] = "excellent"
            out[s.isna()] = None
            yield out

    return band


def steps_udtf():
    """Table function: the numbers 1..n, for repeating rows."""
    @F.udtf(returnType="step INT")
    class Steps:
        def eval(self, n: int):
            for i in range(1, (n or 0) + 1):
                yield (i,)

    return Steps
