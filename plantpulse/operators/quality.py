"""Data-quality jobs: keys, references, ranges, allowed values, gaps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child keys without a parent, with how many rows carry them.

    The child is reduced to distinct keys before the join, so the shuffle carries keys,
    not rows, and a hot key is one row.
    """
    keys = (child.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("orphan_key"))
            .agg(F.count(F.lit(1)).alias("child_rows")))
    return keys.join(parent.select(F.col(parent_key).alias("orphan_key")), "orphan_key", "left_anti")


def unmatched_both_ways(left: DataFrame, right: DataFrame, key: str, left_name: str, right_name: str) -> DataFrame:
    """Keys of either side that the other lacks, with their row counts, reading each side once."""
    def keys(df: DataFrame, into: str) -> DataFrame:
        return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("orphan_key")).agg(F.count(F.lit(1)).alias(into))

    both = keys(left, "__l").join(keys(right, "__r"), "orphan_key", "full_outer")
    return both.filter(F.col("__l").isNull() | F.col("__r").isNull()).select(
        "orphan_key", F.coalesce("__l", "__r").alias("child_rows"),
        F.when(F.col("__l").isNotNull(), left_name).otherwise(right_name).alias("reference"))


def count_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One pass over the table: rows and, per rule, how many break it (NULL counts as kept)."""
    counts = df.agg(F.count(F.lit(1)).alias("rows_checked"),
                    *[F.count_if(F.coalesce(~ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    return counts.unpivot(["rows_checked"], list(rules), "rule", "violations")


def missing_slots(spine: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid positions without a fact row."""
    return spine.join(facts.select(*keys).distinct(), list(keys), "left_anti")


def key_report(df: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """One row: check, rows, violations (rows beyond the first of their key, and rows with a null in it)."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    bare = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in key))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                      F.coalesce(F.sum(F.when(bare, F.col("n")).otherwise(F.col("n") - 1)), F.lit(0)).alias("violations")).select(
        F.lit(name).alias("check"), "rows", "violations")


def reference_report(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """One row: check, rows that refer, violations (their parent is missing). Both sides are one row per key first."""
    uses = child.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(F.col(parent_key).alias("k"), F.lit(True).alias("there")).distinct()
    return uses.join(known, "k", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("there").isNull(), F.col("n"))), F.lit(0)).alias("violations")).select(
        F.lit(name).alias("check"), "rows", "violations")
