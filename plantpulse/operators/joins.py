"""Star joins along the declared relationships, point-in-time joins, semi-joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.schemas import RELATIONSHIPS, Relationship
from plantpulse.warehouse import Warehouse


def join_path(fact: str, dimension: str,
              columns_of: Callable[[str], Sequence[str]] | None = None) -> list[Relationship]:
    """Shortest chain of relationships from a fact to a dimension.

    With ``columns_of`` given, only edges whose key the child rows really have count.
    """
    frontier: list[tuple[str, list[Relationship]]] = [(fact, [])]
    seen = {fact}
    while frontier:
        table, path = frontier.pop(0)
        if table == dimension:
            return path
        for edge in RELATIONSHIPS:
            if edge.child != table or edge.parent in seen:
                continue
            if columns_of is None or edge.child_key in columns_of(table):
                seen.add(edge.parent)
                frontier.append((edge.parent, [*path, edge]))
    raise ValueError(f"no relationship leads from {fact} to {dimension}")


def star_join(wh: Warehouse, fact: str, columns: dict[str, Sequence[str]], rows: DataFrame | None = None,
              how: str = "left") -> DataFrame:
    """A fact with columns of any tables it leads to.

    ``columns`` maps table to the columns wanted from it; tables in between are joined
    for their keys only. No broadcast is forced: Spark picks it from the measured size
    of each dimension and shuffles otherwise.
    """
    df = wh[fact] if rows is None else rows
    prefix = "__k_"
    reached: set[str] = {fact}
    edges: list[Relationship] = []
    for table in columns:
        for edge in join_path(fact, table, lambda t: df.columns if t == fact else wh[t].columns):
            if edge.parent not in reached:
                reached.add(edge.parent)
                edges.append(edge)
    needed: dict[str, list[str]] = {e.parent: [e.parent_key] for e in edges}
    for e in edges:
        if e.child != fact and e.child_key not in needed[e.child]:
            needed[e.child].append(e.child_key)
    for edge in edges:
        dim = wh[edge.parent]
        if "is_current" in dim.columns:
            dim = dim.filter(F.col("is_current"))
        wanted = [c for c in columns.get(edge.parent, ()) if c not in df.columns]
        keys = [F.col(k).alias(f"{prefix}{edge.parent}_{k}") for k in needed[edge.parent]]
        dim = dim.select(*keys, *[F.col(c) for c in wanted])
        left = edge.child_key if edge.child == fact else f"{prefix}{edge.child}_{edge.child_key}"
        df = df.join(dim, df[left] == dim[f"{prefix}{edge.parent}_{edge.parent_key}"], how)
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


@dataclass(frozen=True)
class FactPart:
    """What a drill-across takes from one fact: its keys, its month, and sums over its rows."""

    fact: str
    keys: tuple[str, ...]
    month: Column
    measures: dict[str, Column]  # aggregates that can be summed again
    assets: str = "current_assets"  # the warehouse's method that gives the assets its rows refer to


def drill_across(wh: Warehouse, parts: Sequence[FactPart], grain: dict[str, Sequence[str]]) -> DataFrame:
    """Measures of several facts side by side, per month and dimension columns (table to columns).

    Facts never meet row by row: each is summed by its own keys, taken along the relationships, summed again at the
    shared grain, and only those rows are put together (a null is a value of the grain like any other). A dimension
    with two rows for a key would multiply what it joins, so that is refused first.
    """
    place = [c for columns in grain.values() for c in columns]
    reduced, sound = [], set()
    for part in parts:
        own = wh.with_tables(dim_asset=getattr(wh, part.assets)())
        rows = wh[part.fact].groupBy(*part.keys, part.month.alias("month")).agg(*[c.alias(n) for n, c in part.measures.items()])
        for table in grain:
            for edge in join_path(part.fact, table, lambda t, have=rows.columns, fact=part.fact: have if t == fact else own[t].columns):
                if (part.assets, edge.parent) not in sound:
                    _refuse_fan_out(own, edge)
                    sound.add((part.assets, edge.parent))
        joined = star_join(own, part.fact, grain, rows=rows)
        reduced.append(joined.groupBy(*place, "month").agg(*[F.sum(n).alias(n) for n in part.measures]))
    names = [n for part in parts for n in part.measures]
    side_by_side = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reduced)
    return side_by_side.groupBy(*place, "month").agg(*[F.max(n).alias(n) for n in names])  # one value each


def _refuse_fan_out(wh: Warehouse, edge: Relationship) -> None:
    dim = wh[edge.parent]
    if "is_current" in dim.columns:
        dim = dim.filter(F.col("is_current"))
    twice = dim.groupBy(edge.parent_key).count().filter("count > 1").first()
    if twice is not None:
        raise ValueError(f"{edge.parent} has {twice['count']} rows for {edge.parent_key} {twice[edge.parent_key]}")


def place_assets(assets: DataFrame, wh: Warehouse, columns: Sequence[str]) -> DataFrame:
    """Assets with their process, line and plant columns (inner joins)."""
    process, line, plant = wh["dim_process"], wh["dim_line"], wh["dim_plant"]
    placed = (assets.join(process.select("process_id", "process_name", "process_type", "line_id"), "process_id")
              .join(line.select("line_id", "line_name", "plant_id", "hourly_revenue"), "line_id")
              .join(plant.select("plant_id", "plant_name"), "plant_id"))
    return placed.select("asset_id", *columns)


def at_time(facts: DataFrame, versions: DataFrame, key: str, ts: str, columns: Sequence[str]) -> DataFrame:
    """Facts with the dimension version valid at their time: start <= t and (open or t < end)."""
    v = versions.select(F.col(key).alias("__key"), "scd_start_date", "scd_end_date", *columns)
    valid: Column = (F.col(key) == F.col("__key")) & (F.col("scd_start_date") <= F.col(ts)) & (
        F.col("scd_end_date").isNull() | (F.col(ts) < F.col("scd_end_date")))
    return facts.join(v, valid, "inner").drop("__key", "scd_start_date", "scd_end_date")


def keep_known(requested: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Requested rows whose key exists (semi-join)."""
    return requested.join(known.select(key), key, "left_semi")
