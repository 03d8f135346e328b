"""The manifest against a tree built in plain Python."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from plantpulse.llm import merkle_manifest as module
from plantpulse.llm.merkle_manifest import COLUMNS, fold, merkle_manifest, siblings_digest
from tests.llm.conftest import SCHEMA


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row) -> str:
    return sha("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS))


def tree(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels: list[list[str]], at: int) -> list[str]:
    out = []
    for level in levels[:-1]:
        out.append(level[at ^ 1] if at ^ 1 < len(level) else "")
        at //= 2
    return out


def brute(rows):
    """Sorted (doc_id, leaf, subroot, root, siblings' digest)."""
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([leaf for _, leaf in sorted(((r["doc_id"] is not None, r["doc_id"] or 0), leaf_of(r)) for r in rows if r["lang"] == g)]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        ids = [d for d, _ in sorted(((r["doc_id"] is not None, r["doc_id"] or 0), leaf_of(r)) for r in rows if r["lang"] == g)]
        for at, (known, doc) in enumerate(ids):
            path = "".join(siblings(trees[g], at) + siblings(top, k))
            out.append((doc if known else None, trees[g][0][at], trees[g][-1][0], top[-1][0], sha(path)))
    return sorted(out, key=repr)


def check(spark, docs):
    found = merkle_manifest(docs, carry=docs.columns)
    rows = found.select("row", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof"), fold(F.col("leaf"), F.col("path")).alias("folded")).collect()
    got = sorted(((r.row.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in rows), key=repr)
    assert got == brute([r.asDict() for r in docs.collect()])
    assert all(r.folded == r.root for r in rows)
    assert not rows or rows[0].row.asDict().keys() == {c for c in docs.columns}


def test_awkward_rows(spark, awkward):
    check(spark, awkward)


@pytest.mark.parametrize("n", [1, 2, 3, 1024, 1025, 2500])
def test_sizes_around_a_block(spark, n):
    """One group of n rows and a small one: partial blocks and more than one round."""
    rows = [(3 * i - 50, f"text {i}", "en", "s", i, 0, 0, 0, 0) for i in range(n)] + [(i, None, None, None, None, 0, 0, 0, 0) for i in range(3)]
    check(spark, spark.createDataFrame(rows, SCHEMA).repartition(3))


def test_one_row_for_most_of_the_table(spark):
    rows = [(7, "same", "en", "s", 4, 0, 0, 0, 0)] * 1500 + [(i, f"t{i}", f"l{i % 5}", "s", 4, 0, 0, 0, 0) for i in range(500)]
    check(spark, spark.createDataFrame(rows, SCHEMA).repartition(4))


def test_empty_table(spark, empty):
    out = merkle_manifest(empty)
    assert out.columns == ["row", "leaf", "subroot", "root", "path"] and out.collect() == []


def test_tampering_is_seen(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", i, 0, 0, 0, 0) for i in range(40)], SCHEMA)
    found = merkle_manifest(docs, carry=["doc_id"])
    wrong = found.filter(fold(F.sha2(F.lit("other"), 256), F.col("path")) == F.col("root"))
    assert wrong.count() == 0 and module.HEIGHT == 10
