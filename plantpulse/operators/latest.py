"""Latest row per key, first rows per key, top rows overall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.functions.dates import wall_micros

_INTEGERS = ("byte", "short", "integer", "long")


def order_key(time: Column, number: Column) -> Column:
    """A time and an integer that breaks its ties, as one decimal(38,0); null where the time is.

    Microseconds and all 64 bits of the integer fit. Unlike a struct, a hash aggregate can hold it.
    """
    micros = wall_micros(time).cast("decimal(18,0)") * F.lit(str(2 * 10 ** 19)).cast("decimal(20,0)")
    return (micros + (number.cast("decimal(20,0)") + F.lit(str(2 ** 63)).cast("decimal(20,0)"))).cast("decimal(38,0)")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str],
                   tie_break: Sequence[str] = ()) -> DataFrame:
    """The row with the greatest ``order`` value of every key.

    An aggregate, not a window: each task keeps one row per key before the shuffle, so a
    key holding a third of the table still sends one row per task. With ``order`` unique
    per key every column has its own primitive ``max_by`` (hash aggregate). A time with one
    integer as tie-break becomes one decimal and stays in a hash aggregate too; any other
    tie-break packs the row into a struct, ordered by (order, tie-break).
    """
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    if len(tie_break) == 1 and kinds[order] == "timestamp_ntz" and kinds[tie_break[0]] in _INTEGERS:
        keyed = df.select(*keys, order, *columns, order_key(F.col(order), F.col(tie_break[0])).alias("__key"))
        return keyed.groupBy(*keys).agg(F.max(order).alias(order), *[F.max_by(c, "__key").alias(c) for c in columns])
    if not tie_break:
        return df.groupBy(*keys).agg(F.max(order).alias(order),
                                     *[F.max_by(c, order).alias(c) for c in columns])
    rank = F.struct(order, *tie_break)
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(order, *columns), rank).alias("__row"))
    return packed.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in [order, *columns]])


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
               rank: str = "row_no") -> DataFrame:
    """The first ``n`` rows of every key in the given order, numbered from 1.

    The bound on ``row_number`` makes Spark cut each task's rows to ``n`` per key before
    the shuffle, so no key's rows are gathered whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def top_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """ORDER BY ... LIMIT n (planned as a per-task top-k and one merge)."""
    return df.orderBy(*order).limit(n)


def total_of_listed(listed: DataFrame, value: Column, into: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of an already limited result."""
    return listed.withColumn(into, F.sum(value).over(Window.partitionBy(F.lit(0))))


def head_with_rest(df: DataFrame, order: Sequence[Column], n: int = 10, rest: str = "rows_not_shown") -> DataFrame:
    """The first ``n`` rows, each carrying how many rows follow them."""
    following = df.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0))).scalar()
    return top_rows(df, order, n).withColumn(rest, following)


def arg_max(df: DataFrame, keys: Sequence[str], measure: str, id_column: str, columns: Sequence[str]) -> DataFrame:
    """Row with the greatest measure per key; equal measures go to the smallest id."""
    rank = F.struct(F.col(measure), -F.col(id_column))
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(measure, id_column, *columns), rank).alias("__row"))
    return packed.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in [measure, id_column, *columns]])
