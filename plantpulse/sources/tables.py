"""Read, append and overwrite warehouse tables as laid-out parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.operators.latest import latest_per_key
from plantpulse.schemas import TABLES
from plantpulse.sources.shared import materialise

#: Partitions of a table that is kept by key.
BUCKETS = 64


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{TABLES[name].layer}/{name}"


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan a table with its declared schema (no inference, so no extra pass over the files)."""
    return spark.read.schema(TABLES[name].ddl).parquet(table_path(root, name))


def read_table_or(spark: SparkSession, root: str, name: str, otherwise: DataFrame | None = None) -> DataFrame:
    """The table, or where nothing was written yet the other frame (None: no rows)."""
    try:
        return read_table(spark, root, name)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TABLES[name].ddl) if otherwise is None else otherwise


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project and cast to the declared columns; a missing column becomes NULL."""
    target = df.sparkSession.createDataFrame([], TABLES[name].ddl).schema
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in target
    ])


def laid_out(df: DataFrame, name: str) -> DataFrame:
    """Cluster rows for the write: one range of (partition, sort) keys per task, sorted inside.

    Range partitioning on the partition column *and* the sort columns spreads one hot
    asset or one hot day over many tasks, where hashing would put it into one file.
    """
    spec = TABLES[name]
    keys = [*spec.partition_by, *spec.sort_by]
    if not keys:
        return df
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def append_table(df: DataFrame, root: str, name: str) -> None:
    """INSERT INTO: add rows in the table's layout."""
    spec = TABLES[name]
    laid_out(conform(df, name), name).write.mode("append").partitionBy(*spec.partition_by).parquet(
        table_path(root, name))


def overwrite_table(df: DataFrame, root: str, name: str) -> None:
    """INSERT OVERWRITE.

    A partitioned table replaces only the partitions present in ``df`` (so a daily job
    can be re-run after a lost executor), an unpartitioned one is replaced whole.
    """
    spec = TABLES[name]
    mode = "dynamic" if spec.partition_by else "static"
    (laid_out(conform(df, name), name).write.mode("overwrite")
     .option("partitionOverwriteMode", mode).partitionBy(*spec.partition_by).parquet(table_path(root, name)))


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def merge_latest(changes: DataFrame, root: str, name: str, order: str) -> None:
    """Keyed merge: of every key the row with the greatest ``order`` stays, a change before a kept row of the same order.

    Only buckets that hold a changed key are read and rewritten, each whole and at once, so
    a merge that is run again gives the same table.
    """
    spark, spec = changes.sparkSession, TABLES[name]
    (key,) = spec.key
    own = [c for c in spark.createDataFrame([], spec.ddl).columns if c not in (key, order, "bucket")]
    newest = materialise(changes.groupBy(key).agg(F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in own])
                         .withColumn("bucket", bucket_of(key)), "changes")
    touched = [r.bucket for r in newest.select("bucket").distinct().collect()]  # at most BUCKETS numbers
    kept = read_table_or(spark, root, name).filter(F.col("bucket").isin(touched))
    both = conform(newest, name).withColumn("turn", F.lit(1)).unionByName(kept.withColumn("turn", F.lit(0)))
    merged = latest_per_key(both, [key, "bucket"], order, own, ["turn"])
    overwrite_table(materialise(merged, "merged"), root, name)  # the buckets are read before they are replaced


def preview_text(spark: SparkSession, path: str, lines: int = 5) -> DataFrame:
    """First lines of a text file, in file order."""
    return spark.read.text(path).limit(lines)


def save_messages(messages: DataFrame, root: str) -> None:
    append_table(messages, root, "conversation_history")


def load_conversation(spark: SparkSession, root: str, conversation_id: str,
                      last: int | None = None) -> DataFrame:
    """Messages of one conversation in time order, optionally only the last ``last``."""
    rows = read_table(spark, root, "conversation_history").filter(F.col("conversation_id") == conversation_id)
    if last is not None:
        rows = rows.orderBy(F.col("timestamp").desc(), F.col("message_id").desc()).limit(last)
    return rows.orderBy("timestamp", "message_id")
