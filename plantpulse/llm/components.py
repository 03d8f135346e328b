"""Connected components of a link table, by alternating star contractions.

Every round hangs the larger neighbours of a node, then the smaller ones, on its smallest neighbour; the
number of rounds is logarithmic in practice. A round is two aggregations and joins, its table is
staged, and only two numbers per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.staging import staged


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, component) of every node of links (a, b); component is the smallest id that links reach."""
    edges = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _print(edges)
    for _ in range(max_rounds):
        edges = staged(_small_star(_large_star(edges)), "edges")
        now = _print(edges)
        if now == before:
            roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(
        F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()
