"""Merkle manifest of a table: a tree for each group of rows, and a tree over the groups' roots.

Every row is a leaf, the SHA-256 of its columns. Leaves are numbered within their group and cut into aligned
blocks of ``2**HEIGHT``. A block keeps each of its levels as one string of hex digests: fixed-width substrings
of a level hash to the level above, and the substring that flanks a node's own is its sibling. The block's
last level is one digest, a node of the next round, until a group is one block; then the groups' roots are
numbered and treated likewise. On the way back every block hands its own path to its nodes.

No group is gathered: numbers come from range partitions and their sizes, a task sees blocks of bounded size, and a
round has ``2**HEIGHT`` times fewer rows than the one before. Texts are read once and never shuffled. The driver
gets the size of the largest group.

Defined results: null columns are ``-``; null groups are a group of their own, the first; rows with equal order ascend by
leaf, null order first; repeated rows are leaves of their own; a lone leaf is its group's root; an empty table gives
no rows; other columns don't matter, the carried ones stay in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.llm.staging import staged

HEIGHT = 10
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
_NODES = 1 << HEIGHT
#: The level above a level: each pair of digests, or the odd last one, hashed.
_ABOVE = (f"cast(array_join(transform(slice(sequence(0, {_NODES // 2 - 1}), 1, cast((octet_length({{0}}) + 127) div 128 as int)), "
          "i -> sha2(substring({0}, i * 128 + 1, 128), 256)), '') as binary)").format("element_at(acc, -1)")
_LEVELS = f"aggregate(slice(sequence(1, {HEIGHT}), 1, steps), array(level), (acc, k) -> concat(acc, array({_ABOVE})))"
#: L or R for the side on which the sibling stands, then its digest, nothing if there is none.
_SIBLINGS = (f"transform(slice(sequence(0, {HEIGHT - 1}), 1, steps), t -> concat(if(shiftright(node.pos, t) % 2 = 1, 'L', 'R'), "
             "cast(substring(levels[t], (shiftright(node.pos, t) ^ 1) * 64 + 1, 64) as string)))")


def digest_of(columns: list[Column]) -> Column:
    """SHA-256 over the columns, each with its length in bytes before it."""
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
                             for c in columns)).cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.when(p.startswith("L"), F.concat(F.substring(p, 2, 64), acc))
                                                         .otherwise(F.concat(acc, F.substring(p, 2, 64))).cast("binary"), 256))


def siblings_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda p: F.substring(p, 2, 64)), "").cast("binary"), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with idx, from 0 in each group ``g``, and n, the group's size."""
    told = rows.withColumn("copy", F.monotonically_increasing_id())  # equal rows may stand in several ranges
    placed = staged(told.repartitionByRange("g", *order, "copy").sortWithinPartitions("g", *order, "copy")
                    .withColumn("place", F.monotonically_increasing_id()).drop("copy"), "placed")
    part = F.shiftright("place", 33).alias("part")  # rows of a range follow each other from part << 33 on
    sizes = placed.groupBy("g", part).agg(F.count("*").alias("size"), F.min("place").alias("first"))
    whole = Window.partitionBy("g")
    offsets = sizes.select("g", "part", "first", F.sum("size").over(whole).alias("n"),
                           (F.sum("size").over(whole.orderBy("part")) - F.col("size")).alias("before"))
    return placed.withColumn("part", part).join(offsets, ["g", "part"]).withColumn("idx", F.col("place") - F.col("first") + F.col("before")).drop(
        "part", "place", "first", "before")


def rounds_of_blocks(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """From nodes (g, idx, n, digest, item): the blocks of every round, and (g, digest) of the roots."""
    largest, out = nodes.agg(F.max("n")).first()[0] or 1, []
    while True:
        depth = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
        grouped = nodes.groupBy("g", F.shiftright("idx", HEIGHT).alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct(
            (F.col("idx") % _NODES).cast("int").alias("pos"), "digest", "item"))).alias("nodes"))  # at most 2**HEIGHT of them
        blocks = (grouped.withColumn("steps", F.least(F.lit(HEIGHT), depth)).withColumn("level", F.array_join("nodes.digest", "").cast("binary"))
                  .withColumn("levels", F.expr(_LEVELS)))
        out.append(staged(blocks.select("g", "block", "n", "steps", "levels", F.transform("nodes", lambda x: x.dropFields("digest")).alias("nodes")), "blocks"))
        top = F.element_at("levels", -1).cast("string").alias("digest")
        if largest <= _NODES:
            return out, out[-1].select("g", top)
        largest = -(-largest // _NODES)
        nodes = out[-1].select("g", F.col("block").alias("idx"), F.ceil(F.col("n") / _NODES).alias("n"), top, F.lit(0).alias("item"))


def paths(blocks: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(item, path, ...) of every node of the first round; ``tops`` has g, path and what all nodes of a group inherit."""
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for level in reversed(blocks):
        rows = level.join(above, ["g", "block"]).select("*", F.explode("nodes").alias("node"))
        inherited = [c for c in above.columns if c not in ("block", "path")]
        above = rows.select(*inherited, (F.shiftleft("block", HEIGHT) + F.col("node.pos")).alias("block"), F.col("node.item").alias("item"),
                            F.concat(F.expr(_SIBLINGS), "path").alias("path"))
        if level is not blocks[0]:
            above = above.drop("item")
    return above


def merkle_manifest(docs: DataFrame, columns: list[str] | None = None, group: str = "lang", order: str = "doc_id",
                    carry: list[str] | None = None) -> DataFrame:
    """``row``, leaf, subroot, root and path: the siblings from the leaf up to the root, each behind its side."""
    group_key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    leaves = staged(docs.select(group_key.alias("g"), F.col(f"`{order}`").alias("place_of"), digest_of([F.col(f"`{c}`") for c in columns or COLUMNS]).alias("digest"),
                                F.struct(*(F.col(f"`{c}`") for c in (docs.columns if carry is None else carry))).alias("row")), "leaves")
    nodes = numbered(leaves, ["place_of", "digest"]).select("g", "idx", "n", "digest", F.struct("row", F.col("digest").alias("leaf")).alias("item"))
    blocks, subroots = rounds_of_blocks(nodes)
    groups = numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("member"), "digest"), ["member"])
    over, root = rounds_of_blocks(groups.select("g", "idx", "n", "digest", F.struct("member", "digest").alias("item")))
    of_groups = paths(over, root.select("g", F.array().cast("array<string>").alias("path"), F.col("digest").alias("root")))
    tops = of_groups.select(F.col("item.member").alias("g"), "path", "root", F.col("item.digest").alias("subroot"))
    return paths(blocks, tops).select("item.row", "item.leaf", "subroot", "root", "path")
