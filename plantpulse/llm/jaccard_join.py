"""Jaccard join on word shingles by prefix filters under several global orders.

Documents with equal shingle sets are one class from the start. The shingles of a class are put in order
three times, each time rare ones first (by a fixed-size count sketch) and then by another hash. Two
sets as similar as asked share a token among the first ``n - ceil(t n) + 1`` of either under *every*
order. Candidates come from shared tokens of the first order, within the bounds that sizes and places
set, must then also share tokens under the other orders, and only what passes all is
verified on the exact sets.

A group of copies is not expanded into pairs. In the first round each token's class that is nearest to
the start of its order (the least edited text) is the pivot of all others that hold the token; linked
classes become components. The second round takes what may still be missing: all candidates from
different components. Links inside a component change nothing, so the components are exact. ``class_links``
gives all links between classes, those inside components too, with the documents of each class, and
``link_counts`` the number of each document's links.

Where all holders of a token meet, they are dealt by set size (linked sets are near in size) and in blocks on
both sides: a token that very many classes share is spread over a grid of tasks.

Defined results: documents without words (null, empty) have an empty set and are linked with nothing; equal
sets are linked; repeated rows are equal sets; a null id is never the smallest unless it is alone; an
empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.llm import text_hash as th
from plantpulse.llm.components import components
from plantpulse.llm.mapping import beside
from plantpulse.llm.staging import Scratch, staged

PERCENT, SHINGLE, ORDERS = 80, 5, 3
SKETCH_BITS, SKETCH_ROWS, SEGMENTS = 23, 2, 64
BLOCK = 1000  # holders of a token that meet as many others in one place


def shingle_sets(texts: pa.Array, shingle: int, kind: th.Alphabet = th.LOWERED) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles (shorter texts: of the whole)."""
    for words in th.slices(texts, kind):
        bounds, grams = words.bounds, th.runs(words.hashes, shingle)
        for a, b in zip(bounds[:-1], bounds[1:]):
            n = b - a
            yield np.unique(grams[a:b - shingle + 1] if n >= shingle else th.runs(words.hashes[a:b], n) if n else grams[:0])


def set_key(found: np.ndarray) -> str | None:
    """128 bits that stand for a set; None for the empty one."""
    if not len(found):
        return None
    one, two = (int(th.mix(found ^ np.uint64(seed)).sum()) for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
    return f"{one:016x}{two:016x}"


def with_sets(docs: DataFrame, carry: list[str], shingle: int = SHINGLE) -> DataFrame:
    """``row``, n_shingles and key (null for an empty set)."""
    def measure(texts: pa.Array) -> list[pa.Array]:
        sets = list(shingle_sets(texts, shingle))
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.string())]
    return beside(docs, lambda: measure, "n_shingles bigint, key string", carry)


def classes(docs: DataFrame, scratch: Scratch, shingle: int = SHINGLE) -> DataFrame:
    """(key, cid, n, text): one text of each set, bucketed by key; cid numbers the classes."""
    rows = with_sets(docs, ["text"], shingle).filter("key is not null")
    one = rows.groupBy("key").agg(F.first("n_shingles").alias("n"), F.first("row.text").alias("text"))
    return scratch.table(one.select("key", F.monotonically_increasing_id().alias("cid"), "n", "text"), "classes", "key")


def _cells(found: np.ndarray) -> list[np.ndarray]:
    return [((found >> np.uint64(8 + 24 * r)) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64) for r in range(SKETCH_ROWS)]


def frequency_sketch(table: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """log2 of how many classes share a cell: SKETCH_ROWS rows of 2**SKETCH_BITS bytes, whatever the input's size.

    It only sets the order of shingles, so cells shared by chance cost time, not results.
    """
    width = (1 << SKETCH_BITS) // SEGMENTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.int32)
        for whole in batches:
            for first in range(0, whole.num_rows, 2000):
                found = np.concatenate(list(shingle_sets(whole.column(0).slice(first, 2000), shingle)))
                for row, cells in zip(total, _cells(found)):
                    at, n = np.unique(cells, return_counts=True)
                    row[at] += n.astype(np.int32)
        yield _segments(range(SKETCH_ROWS * SEGMENTS), total.reshape(SKETCH_ROWS * SEGMENTS, width))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.frombuffer(zlib.decompress(packed.as_buffer()), np.int32)
                total[segment] = total.get(segment, 0) + values.astype(np.int64)
        if total:
            yield _segments(list(total), [np.log2(v + 1).astype(np.uint8) for v in total.values()])

    schema = "segment int, counts binary"
    parts = (table.select("text").mapInArrow(count, schema).repartition(SKETCH_ROWS * SEGMENTS, "segment").mapInArrow(add, schema))
    out = np.zeros((SKETCH_ROWS * SEGMENTS, width), np.uint8)
    for segment, packed in parts.collect():  # a fixed number of fixed-size rows
        out[segment] = np.frombuffer(zlib.decompress(packed), np.uint8)
    return out.reshape(SKETCH_ROWS, 1 << SKETCH_BITS)


def _segments(numbers, values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(numbers, pa.int32()), pa.array([zlib.compress(np.ascontiguousarray(v).tobytes(), 1) for v in values], pa.binary())],
        names=["segment", "counts"])


def prefix_size(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def prefixes(table: DataFrame, percent: int, shingle: int, orders: int) -> DataFrame:
    """(cid, key, n, p1, p2, ...): the prefix tokens of each class, in order, under each order.

    p1 has whole hashes; the others 32 bits of them, which can only let more pass.
    """
    rare = table.sparkSession.sparkContext.broadcast(frequency_sketch(table, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = rare.value
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                lists: list[list[np.ndarray]] = [[] for _ in range(orders)]
                for found in shingle_sets(batch.column(3), shingle):
                    common = np.minimum.reduce([row[c] for row, c in zip(sketch, _cells(found))]).astype(np.uint64) << np.uint64(56)
                    size = prefix_size(len(found), percent)
                    for k in range(orders):
                        place = common | (th.mix(found + np.uint64(k + 1)) >> np.uint64(8))
                        near = np.argpartition(place, size - 1)[:size]
                        tokens = found[near[np.argsort(place[near])]]
                        lists[k].append(tokens.view(np.int64) if not k else (tokens >> np.uint64(32)).astype(np.uint32).view(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), *map(_nested, lists)],
                    names=["cid", "key", "n", *(f"p{k + 1}" for k in range(orders))])

    kinds = ", ".join(f"p{k + 1} array<{'int' if k else 'long'}>" for k in range(orders))
    return table.select("cid", "key", "n", "text").mapInArrow(run, f"cid long, key string, n long, {kinds}")


def _nested(lists: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))


def _may_link(x: str, y: str, percent: int) -> Column:
    """Bounds that sizes and places of a first shared token set on the overlap."""
    return F.expr(f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n) and "
                  f"{100 + percent} * least({x}.n - {x}.pos, {y}.n - {y}.pos) >= {percent} * ({x}.n + {y}.n)")


def _ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, prefix: DataFrame, table: DataFrame, percent: int, shingle: int, orders: int) -> DataFrame:
    """The candidate pairs (a, b) that also share tokens under the other orders and then really are links."""
    rest = [f"p{k + 1}" for k in range(1, orders)]
    sides = {s: prefix.select(F.col("cid").alias(s), F.col("key").alias(f"key_{s}"), *(F.col(p).alias(f"{p}_{s}") for p in rest))
             for s in "ab"}
    both = pairs.join(sides["a"], "a").join(sides["b"], "b")
    for p in rest:
        both = both.filter(F.arrays_overlap(f"{p}_a", f"{p}_b"))
    texts = {s: table.select(F.col("key").alias(f"key_{s}"), F.col("text").alias(f"text_{s}")) for s in "ab"}
    loaded = both.select("a", "b", "key_a", "key_b").join(texts["a"], "key_a").join(texts["b"], "key_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(shingle_sets(batch.column(2), shingle), shingle_sets(batch.column(3), shingle)):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return loaded.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def _shared_postings(prefix: DataFrame, scratch: Scratch) -> DataFrame:
    """(token, cid, n, pos) of the first order's tokens that more than one class has."""
    postings = prefix.select("cid", "n", F.posexplode("p1").alias("pos", "token"))
    many = postings.groupBy("token").count().filter("count > 1").select("token")
    return scratch.table(postings.join(many, "token"), "postings")


def _meetings(postings: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) among the holders of each token; of holders with a ``component`` only those of different ones.

    Sizes of linked sets lie at most one band apart. Within a token, blocks of the one side meet blocks of the other.
    """
    width = max(math.log(100 / percent), 1e-3) * 1.0001  # a little wider, so rounding cannot part linked sizes
    blocks = postings.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = postings.join(blocks, "token").withColumn("band", F.floor(F.log(F.col("n")) / width)).withColumn(
        "block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    all_blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = rows.withColumn("own", F.col("band")).withColumn("other", all_blocks).withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    y = rows.withColumn("other", F.col("block")).drop("block").withColumn("block", all_blocks)
    met = x.alias("x").join(y.alias("y"), ["token", "band", "block", "other"]).filter("x.own < band or x.cid < y.cid").filter(_may_link("x", "y", percent))
    if "component" in postings.columns:
        met = met.filter("x.component <> y.component")
    return _ordered_pairs(met.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")))


def linked_classes(table: DataFrame, scratch: Scratch, percent: int = PERCENT, shingle: int = SHINGLE, orders: int = ORDERS) -> DataFrame:
    """(cid, component) of every class that has a link to another; component is its smallest cid."""
    prefix = scratch.table(prefixes(table, percent, shingle, orders), "prefixes")
    shared = _shared_postings(prefix, scratch)
    check: Callable[[DataFrame], DataFrame] = lambda pairs: verified(pairs, prefix, table, percent, shingle, orders)

    pivots = shared.groupBy("token").agg(F.min(F.struct("pos", "n", "cid")).alias("y"))
    first = scratch.table(_ordered_pairs(
        shared.alias("x").join(pivots, "token").filter(F.col("x.cid") != F.col("y.cid")).filter(_may_link("x", "y", percent))
        .select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))), "pairs")
    links = scratch.table(check(first), "links")
    groups = components(links)

    named = shared.join(groups.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    apart = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("token")
    open_ = scratch.table(named.join(apart, "token"), "open")
    second = scratch.table(_meetings(open_, percent).join(first, ["a", "b"], "left_anti"), "pairs")
    if second.isEmpty():
        return groups.withColumnRenamed("id", "cid")
    return components(links.union(check(second))).withColumnRenamed("id", "cid")


def class_links(docs: DataFrame, identity: str = "doc_id", percent: int = PERCENT, shingle: int = SHINGLE,
                orders: int = ORDERS) -> tuple[DataFrame, DataFrame]:
    """Members (identity, n_shingles, cid) and all links (a, b), a < b, between different classes.

    Documents of one class have equal sets and are linked with each other; cid is null without words.
    """
    with Scratch(docs.sparkSession) as scratch:
        table = classes(docs, scratch, shingle)
        prefix = scratch.table(prefixes(table, percent, shingle, orders), "prefixes")
        pairs = scratch.table(_meetings(_shared_postings(prefix, scratch), percent), "pairs")
        links = staged(verified(pairs, prefix, table, percent, shingle, orders), "links")
        rows = with_sets(docs, [identity], shingle).select(F.col(f"row.{identity}").alias(identity), "n_shingles", "key")
        return staged(rows.join(table.select("key", "cid"), "key", "left").drop("key"), "members"), links


def link_counts(docs: DataFrame, identity: str = "doc_id", percent: int = PERCENT, shingle: int = SHINGLE, orders: int = ORDERS) -> DataFrame:
    """identity, n_shingles and n_links, the number of other rows that each row is linked with."""
    members, links = class_links(docs, identity, percent, shingle, orders)
    sizes = members.filter("cid is not null").groupBy("cid").agg(F.count("*").alias("size"))
    ends = links.select(F.col("a").alias("cid"), F.col("b").alias("other")).union(links.select(F.col("b").alias("cid"), F.col("a").alias("other")))
    met = ends.join(sizes.select(F.col("cid").alias("other"), "size"), "other").groupBy("cid").agg(F.sum("size").alias("met"))
    totals = sizes.join(met, "cid", "left").select("cid", (F.col("size") - 1 + F.coalesce("met", F.lit(0))).alias("n_links"))
    return members.join(totals, "cid", "left").select(identity, "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def group_of_sets(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, orders: int = ORDERS) -> DataFrame:
    """(key, group): for every set of shingles the number of its connected group."""
    with Scratch(docs.sparkSession) as scratch:
        table = classes(docs, scratch, shingle)
        groups = linked_classes(table, scratch, percent, shingle, orders)
        own = table.select("key", "cid").join(groups, "cid", "left")
        return staged(own.select("key", F.coalesce("component", "cid").alias("group")), "groups")


def near_duplicates(docs: DataFrame, identity: str = "doc_id", percent: int = PERCENT, shingle: int = SHINGLE,
                    orders: int = ORDERS) -> DataFrame:
    """identity, n_shingles, key, group (both null without words) and component_id, the smallest identity of the group."""
    rows = staged(with_sets(docs, [identity], shingle).select(F.col(f"row.{identity}").alias(identity), "n_shingles", "key"), "sets")
    grouped = group_of_sets(docs, percent, shingle, orders)
    smallest = rows.filter("key is not null").groupBy("key").agg(F.min(identity).alias("least"))
    by_group = smallest.join(grouped, "key")
    least = by_group.groupBy("group").agg(F.min("least").alias("component_id"))
    known = by_group.join(least, "group").select("key", "group", "component_id")
    return rows.join(known, "key", "left").select(
        identity, "n_shingles", "key", "group", F.when(F.col("key").isNull(), F.col(identity)).otherwise(F.col("component_id")).alias("component_id"))
