"""Reshaping: wide to long, type matrix, nested documents in bounded chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot_metrics(wide: DataFrame, ids: Sequence[str], metrics: dict[str, str],
                    name: str = "sensor_type", value: str = "value") -> DataFrame:
    """One row per non-null metric; ``metrics`` maps column to metric name. No shuffle."""
    ready = wide.select(*ids, *[F.col(c).cast("double").alias(m) for c, m in metrics.items()])
    return ready.unpivot(list(ids), list(metrics.values()), name, value).filter(F.col(value).isNotNull())


def count_matrix(df: DataFrame, keys: Sequence[str], column: str, names: dict[object, str]) -> DataFrame:
    """Counts per key with one column per listed value."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(column) == v).alias(n) for v, n in names.items()])


def gather_chunks(df: DataFrame, keys: Sequence[str], chunk: Column, item: Column, order: Column,
                  into: str) -> DataFrame:
    """Sorted array of items per key and chunk; ``chunk`` bounds how many rows share an array."""
    pairs = F.sort_array(F.collect_list(F.struct(order.alias("o"), item.alias("i"))))
    return (df.groupBy(*keys, chunk.alias("chunk_no")).agg(pairs.alias("__pairs"))
            .withColumn(into, F.transform("__pairs", lambda p: p["i"])).drop("__pairs"))
