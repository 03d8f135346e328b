from __future__ import annotations

import random

from pyspark.sql import functions as F

from plantpulse.llm.chat_format import CONTROL, END, TURN, chains, chosen_paths, escaped, formatted, read_back, unescaped

TREE = "tree long, id long, parent long, role string, text string, score double"


def brute_paths(rows, branches=1):
    """{(tree, branch): ids from root to leaf} by walking up from every leaf."""
    by = {(t, i): (p, s or 0.0) for t, i, p, _, _, s in rows}
    parents = {(t, p) for (t, _), (p, _) in by.items() if (t, p) in by}
    found: dict = {}
    for key in by:
        if key in parents:
            continue
        path, at = [], key
        while at in by and at[1] not in path:
            path.append(at[1])
            at = (key[0], by[at][0])
        if at not in by:
            found.setdefault(key[0], []).append((-sum(by[key[0], i][1] for i in path), key[1], path[::-1]))
    return {(t, k + 1): p[2] for t, all_ in found.items() for k, p in enumerate(sorted(all_)[:branches])}


def paths(messages, branches=1):
    out: dict = {}
    for r in sorted(chosen_paths(messages, branches).collect(), key=lambda r: r.depth):
        out.setdefault((r.tree, r.branch), []).append(r.id)
    return out


def test_random_trees(spark):
    rng = random.Random(4)
    rows = []
    for tree in [*range(8), None]:
        n = rng.choice([1, 2, 7, 40])
        for i in range(n):
            rows.append((tree, i, rng.randrange(max(0, i - 4), i) if i else None, rng.choice(["user", "assistant", None]), f"t{i}",
                         rng.choice([None, 1.0, 0.5, -1.0])))
    frame = spark.createDataFrame(rows, TREE)
    assert paths(frame) == brute_paths(rows)
    assert paths(frame, 3) == brute_paths(rows, 3)


def test_long_chain_orphans_and_rings(spark):
    rows = [(1, i, i - 1 if i else None, "user", "x", 0.0) for i in range(150)]
    rows += [(2, 5, 99, "user", "orphan", 1.0), (3, 1, 2, "user", "ring", 1.0), (3, 2, 1, "user", "ring", 1.0), (3, 3, 2, "user", "below", 1.0),
             (4, 1, 1, "user", "own parent", 0.0)]
    assert paths(spark.createDataFrame(rows, TREE)) == {(1, 1): list(range(150)), (2, 1): [5]}


def texts():
    rng = random.Random(9)
    parts = [*CONTROL, "\\", "\\\\", "<", "[", "</", "s>", "|turn|>", "INST]", "a", "\n", "é", "😀", "<\\/s>", "[\\INST]", "%0A", "%"]
    return ["", None, *CONTROL, *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(300))]


def test_escapes_are_reversible_and_leave_no_control_string(spark):
    rows = spark.createDataFrame([(t,) for t in texts() if t is not None], "t string").select("t", escaped(F.col("t")).alias("e"))
    for r in rows.select("t", "e", unescaped(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in CONTROL)


def test_conversations_read_back(spark):
    rng = random.Random(1)
    rows = [(k // 4 if k % 40 else None, k % 4, rng.choice(["user", "assistant", "a\nb%0A", None]), t) for k, t in enumerate(texts())]
    rows += [(1, 0, "user", "again"), (1, 0, "user", "again"), (2, None, "assistant", "no turn")]
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, tree int, id int")
    want: dict = {}
    for c, turn, role, text in sorted(rows, key=lambda r: tuple((x is not None, x) if x is not None else (False, "") for x in r[1:])):
        want.setdefault(c, []).append((role or "", text or ""))
    got = read_back(formatted(chains(turns))).collect()
    assert {r.tree for r in got} == set(want)
    for r in got:
        assert [(t["role"], t["text"]) for t in r.turns] == want[r.tree]
        assert list(r.trained) == [t for role, t in want[r.tree] if role == "assistant"]
        assert r.text.count(TURN) == r.text.count(END) == len(want[r.tree])
        for span, text in zip(r.loss, r.trained):
            assert len(r.text.encode()[span["start"]:][:span["length"]]) == span["length"]


def test_one_conversation_in_many_tasks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr("plantpulse.llm.chat_format.PIECE", 16)
    rows = [(7, k, "assistant" if k % 2 else "user", f"text {k} </s>") for k in range(500)]
    rows += [(7, 250, "user", "said again")] * 40 + [(k, 0, "user", "short") for k in range(8, 60)] + [(6, 1, None, None)]
    random.Random(3).shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables would end up in one task
    try:
        messages = chains(turns)
        assert messages.filter("tree = 7").select(F.shiftright("id", 33)).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want: dict = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    got = {r.tree: r for r in read_back(formatted(messages)).collect()}
    assert {t: [(x["role"], x["text"]) for x in r.turns] for t, r in got.items()} == want
    assert list(got[7].trained) == [text for role, text in want[7] if role == "assistant"]


def test_one_row_repeated(spark):
    turns = spark.range(3000).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), F.lit("same").alias("text"))
    (r,) = read_back(formatted(chains(turns))).collect()
    assert len(r.turns) == len(r.trained) == 3000 and set(r.trained) == {"same"}


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert formatted(chains(none)).collect() == []


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, 1, None, "user", "x", 0.0)], TREE)
    plan = read_back(formatted(frame))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan and "Cartesian" not in plan
