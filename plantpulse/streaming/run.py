"""Run a streaming query over what is available and read its result table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.sources.shared import shared_dir

BATCH = "batch_id"


def _finish(query) -> None:
    query.awaitTermination()


def drain_append(stream: DataFrame, purpose: str, folder: str | None = None) -> DataFrame:
    """Append mode into parquet files. The file sink's commit log makes a retried batch count once.

    ``folder`` holds output and checkpoint: give the same one again and the query goes on
    where it stopped. Without it every run starts afresh in the shared folder.
    """
    spark = stream.sparkSession
    base = folder or shared_dir(spark, purpose)
    _finish(stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def for_each_batch(stream: DataFrame, mode: str, purpose: str, handle: Callable[[DataFrame, int, str], None],
                   folder: str | None = None) -> str:
    """Run ``handle(batch, batch_id, folder)`` per micro-batch; returns the folder.

    A batch id can be handled twice after a failure, so handlers overwrite a path named
    by the id.
    """
    base = folder or shared_dir(stream.sparkSession, purpose)

    def call(batch: DataFrame, batch_id: int) -> None:
        handle(batch, batch_id, base)

    _finish(stream.writeStream.outputMode(mode).foreachBatch(call).option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True).start())
    return base


def _write_batch(batch: DataFrame, batch_id: int, base: str) -> None:
    batch.write.mode("overwrite").parquet(f"{base}/out/{BATCH}={batch_id}")


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def read_or_empty(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """A table that batches wrote, or no rows where none did (an empty feed)."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def drain_update(stream: DataFrame, keys: Sequence[str], purpose: str, folder: str | None = None) -> DataFrame:
    """Update mode: every batch's changed rows, of which the newest per key is the state.

    Each run ends with a compact state table named by its last batch, and starts from the one before:
    a read never goes over older batches again.
    """
    base = for_each_batch(stream, "update", purpose, _write_batch, folder)
    spark, values = stream.sparkSession, [c for c in stream.columns if c not in keys]
    changes = read_or_empty(spark, f"{ddl(stream)}, {BATCH} BIGINT", f"{base}/out")
    states = read_or_empty(spark, f"{ddl(stream)}, upto BIGINT", f"{base}/state")
    done, last = (t.agg(F.coalesce(F.max(c), F.lit(-1))).first()[0] for t, c in ((states, "upto"), (changes, BATCH)))
    if last > done:
        rows = changes.filter(F.col(BATCH) > done).unionByName(states.filter(F.col("upto") == done).withColumnRenamed("upto", BATCH))
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("__row"))
        newest.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in values]).write.mode("overwrite").parquet(f"{base}/state/upto={last}")
        states = read_or_empty(spark, f"{ddl(stream)}, upto BIGINT", f"{base}/state")
    return states.filter(F.col("upto") == max(last, done)).drop("upto")


def drain_partials(stream: DataFrame, purpose: str, reduce: Callable[[DataFrame], DataFrame], folder: str | None = None) -> DataFrame:
    """``reduce`` of each batch, all batches together: for results that later code can put together."""
    def write(batch: DataFrame, batch_id: int, base: str) -> None:
        _write_batch(reduce(batch), batch_id, base)

    base = for_each_batch(stream, "append", purpose, write, folder)
    spark = stream.sparkSession
    kind = ddl(reduce(spark.createDataFrame([], stream.schema)))
    return read_or_empty(spark, f"{kind}, {BATCH} BIGINT", f"{base}/out").drop(BATCH)
