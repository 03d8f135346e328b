"""Session settings the jobs are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Broadcasts are left to Spark's own size check; anything larger is joined by shuffle,
# and skewed shuffle partitions are split at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Call-site capture costs a stack walk per Column call; it only decorates error texts.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def local_session(cpus: int | str, name: str, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
               .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", memory))
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
