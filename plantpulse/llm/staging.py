"""Intermediate tables in the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plantpulse.sources.shared import materialise, shared_dir


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Writes a table and reads it back: later jobs restart from files that outlive any executor."""
    return materialise(df, f"llm-{purpose}")


def bucketed(df: DataFrame, key: str, purpose: str) -> DataFrame:
    """The same, dealt into as many buckets by key as shuffles have partitions: joins on key don't move it again.

    The rows should already be grouped by key, so each bucket is written by one task.
    """
    spark, name = df.sparkSession, f"{purpose}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", shared_dir(spark, f"llm-{purpose}"))
     .saveAsTable(name))
    table = spark.table(name)
    table.schema  # resolved: the plan keeps files and buckets when the name goes
    spark.sql(f"DROP TABLE {name}")
    return table


class Scratch:
    """Tables that are only needed until a later one is written: leaving the block deletes them.

    They are managed tables of a database of their own, placed in the shared folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.name = spark, f"llm_{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        self.spark.sql(f"CREATE DATABASE {self.name} LOCATION '{shared_dir(self.spark, 'llm-scratch')}'")
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.sql(f"DROP DATABASE {self.name} CASCADE")

    def table(self, df: DataFrame, purpose: str, bucket_by: str | None = None) -> DataFrame:
        name, writer = f"{self.name}.{purpose}_{uuid.uuid4().hex}", df.write.option("compression", "zstd")
        if bucket_by:
            writer = writer.bucketBy(int(self.spark.conf.get("spark.sql.shuffle.partitions")), bucket_by)
        writer.saveAsTable(name)
        return self.spark.table(name)


def own_name(df: DataFrame, wanted: str) -> str:
    """A column name that no column of the input has (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
