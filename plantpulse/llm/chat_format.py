"""Chat formatting of reply trees, with DataFrame functions only.

Messages name their parent. Self-joins that double the distance they reach give every message its root,
its depth and the score of its path in a logarithmic number of rounds; only ids and scores are
joined, not texts, and each round's table is staged. Leaves are ranked by their path's score, the best
``branches`` paths of each tree are chosen, and walking back over the same doubled steps lists the messages
of each. A path becomes one conversation: one text, and the byte ranges under the loss mask.

Template: ``<|turn|>role\\ntext</s>`` for each turn. Control strings inside texts are broken by a backslash
behind their first character; a broken one gets one more, so removing one backslash from
each restores every text.

Defined results: null texts and roles count as empty; a message whose parent is missing is a root; messages
in a ring of replies (or below one) have no root and belong to no path; ties between leaves go to
the smaller id; a repeated id is one message per row, so ids must be unique in their tree (``chains`` gives
such ids to plain turn tables, with repeated rows as turns of their own); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.llm.staging import staged

TURN, END = "<|turn|>", "</s>"
# Strings that the template or common chat models give a meaning to.
CONTROL = ("<|turn|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
           "<|endoftext|>", "<|startoftext|>")
TRAINED_ROLE = "assistant"
MAX_ROUNDS = 40
PIECE = 4096  # turns of a path whose sizes are added up in one window
TEXT_PREFIX = 64  # characters of a text that take part in dealing turns to tasks by range


def _rest_of_controls() -> str:
    return "|".join(sorted({"".join("\\" + c if c in r"[]|<>/\.^$*+?(){}" else c for c in s[1:]) for s in CONTROL}))


# What starts a control string, any backslashes put there before, and (looking ahead) its rest.
ESCAPE = rf"([<\[])(\\*)(?={_rest_of_controls()})"
UNESCAPE = rf"([<\[])\\(\\*)(?={_rest_of_controls()})"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPE), F.lit(r"$1\\$2"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(UNESCAPE), F.lit("$1$2"))


def _one_line(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _many_lines(role: Column) -> Column:
    return unescaped(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def _same(left: str, right: str, key: str = "id") -> Column:
    """The same message: trees may be null, ids that are null meet nothing."""
    return F.col(f"{left}.tree").eqNullSafe(F.col(f"{right}.tree")) & (F.col(f"{left}.{key}") == F.col(f"{right}.id"))


def rooted(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, id, depth, total) of the messages that have a root, total being their path's score; and the steps.

    Step k has (tree, id, up): the message 2**k above. Round k knows of each message how many
    messages its path has within 2**k steps, their score, and what comes above them.
    """
    ids = messages.select("tree", "id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"))
    state = staged(ids.alias("m").join(ids.alias("p"), _same("m", "p", "parent"), "left").select(
        "m.tree", "m.id", F.col("p.id").alias("up"), "m.total", F.lit(1).cast("long").alias("n")), "rooted")
    steps: list[DataFrame] = []
    left = state.filter("up is not null").count()
    for _ in range(MAX_ROUNDS):
        if not left:
            break
        steps.append(state.filter("up is not null").select("tree", "id", "up"))
        climbed = state.filter("up is not null").alias("m").join(state.alias("p"), _same("m", "p", "up")).select(
            "m.tree", "m.id", F.col("p.up").alias("up"), (F.col("m.total") + F.col("p.total")).alias("total"),
            (F.col("m.n") + F.col("p.n")).alias("n"))
        state = staged(state.filter("up is null").union(climbed), "rooted")  # rounds join what is still below its root
        before, left = left, state.filter("up is not null").count()
        if left == before:
            break  # what is left goes round in rings
    return state.filter("up is null").select("tree", "id", (F.col("n") - 1).alias("depth"), "total"), steps


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, branch, total, id, depth): the messages of the best paths; branch 1 is the best."""
    nodes, steps = rooted(messages)
    parents = messages.select("tree", F.col("parent").alias("id")).filter("id is not null").distinct()
    leaves = nodes.alias("n").join(parents.alias("p"), _same("n", "p"), "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("total"), "id")
    path = leaves.withColumn("branch", F.row_number().over(best)).filter(F.col("branch") <= branches).select("tree", "branch", "total", "id")
    for step in reversed(steps):
        above = path.alias("m").join(step.alias("s"), _same("m", "s")).select("m.tree", "m.branch", "m.total", F.col("s.up").alias("id"))
        path = staged(path.union(above), "path")  # read twice by the next step: without a cut plans would double
    return path.alias("m").join(nodes.alias("n"), _same("m", "n")).select("m.tree", "m.branch", "m.total", "m.id", "n.depth")


def _starts(path: DataFrame, turns: DataFrame) -> DataFrame:
    """The paths' messages with ``start``, the bytes of all turns before them.

    Sizes are added up within pieces of a path and then over the pieces' totals; texts stay where they are.
    """
    size = (F.octet_length("head") + F.octet_length("body") + len(END)).cast("long")
    sizes = turns.select("tree", "id", size.alias("size"))
    rows = path.alias("m").join(sizes.alias("w"), _same("m", "w")).select(
        "m.*", "w.size", F.floor(F.col("m.depth") / PIECE).alias("piece"))
    inside = Window.partitionBy("tree", "branch", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("tree", "branch").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("tree", "branch", "piece").agg(F.sum("size").alias("size")).select(
        "tree", "branch", "piece", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    local = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same_piece = F.col("m.tree").eqNullSafe(F.col("t.tree")) & (F.col("m.branch") == F.col("t.branch")) & (F.col("m.piece") == F.col("t.piece"))
    return local.alias("m").join(totals.alias("t"), same_piece).select(
        "m.tree", "m.branch", "m.total", "m.id", "m.depth", (F.col("t.base") + F.col("m.within")).alias("start"))


def formatted(messages: DataFrame, branches: int = 1, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """(tree, branch, total, text, loss): one row per chosen path; loss has byte ranges array<struct<start, length>>."""
    role = F.coalesce(F.col("role"), F.lit(""))
    turns = messages.select(
        "tree", "id", F.concat(F.lit(TURN), _one_line(role), F.lit("\n")).alias("head"),
        escaped(F.coalesce(F.col("text"), F.lit(""))).alias("body"), (role == trained_role).alias("trained"))
    starts = staged(_starts(staged(chosen_paths(messages, branches), "paths"), turns), "starts")
    placed = starts.alias("m").join(turns.alias("w"), _same("m", "w")).select(
        "m.tree", "m.branch", "m.total", "m.depth", "w.head", "w.body", "w.trained", (F.col("m.start") + F.octet_length("w.head")).alias("start"))
    rows = placed.groupBy("tree", "branch", "total").agg(F.array_sort(F.collect_list(
        F.struct("depth", F.concat("head", "body", F.lit(END)).alias("turn"), "trained", "start", F.octet_length("body").cast("long").alias("length")))).alias("t"))
    return rows.select(
        "tree", "branch", "total", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("text"),
        F.transform(F.filter("t", lambda x: x["trained"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss"))


def read_back(conversations: DataFrame) -> DataFrame:
    """turns (array<struct<role, text>>) and trained (array of the texts under the mask), out of text and loss alone."""
    parts = conversations.select("*", F.split("text", END).alias("parts"), F.col("text").cast("binary").alias("bytes"))
    cut = F.transform(F.slice("parts", 1, F.size("parts") - 1), lambda p: F.substring_index(p, "\n", 1))
    heads = parts.withColumn("heads", cut)
    return heads.select(
        *conversations.columns,
        F.transform("heads", lambda h, i: F.struct(
            _many_lines(F.substring(h, F.lit(len(TURN) + 1), F.length(h))).alias("role"),
            unescaped(F.substring(F.get("parts", i), F.length(h) + 2, F.length(F.get("parts", i)))).alias("text"))).alias("turns"),
        F.expr("transform(loss, s -> cast(substring(bytes, cast(s.start as int) + 1, cast(s.length as int)) as string))").alias("masked"),
    ).withColumn("trained", F.transform("masked", unescaped)).drop("masked")


def chains(turns: DataFrame, tree: str = "conv_id") -> DataFrame:
    """Plain turn tables as trees without branches: messages follow each other by turn, role and text.

    The whole table is sorted by range, so a long conversation lies in many tasks, and ids rise along that order; a
    message's parent is the one before it, wherever that is (in another tree it is none). Equal rows
    are counted before they move and told apart again once they are in order.
    """
    rows = turns.select(F.col(tree).alias("tree"), "turn", "role", "text").groupBy("tree", "turn", "role", "text").agg(F.count("*").alias("n"))
    dealt = rows.repartitionByRange("tree", "turn", "role", F.substring("text", 1, TEXT_PREFIX)).sortWithinPartitions("tree", "turn", "role", "text")
    each = dealt.select("tree", "role", "text", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    placed = staged(each.select("tree", "role", "text", F.monotonically_increasing_id().alias("id")), "turns")  # ids are fixed by the table
    task = F.shiftright("id", 33)  # the part of such an id that counts tasks
    lasts = placed.groupBy(task.alias("task")).agg(F.max("id").alias("last"))
    before = lasts.select((F.lead("task").over(Window.orderBy("task"))).alias("task"), "last")  # one row per task of the sort
    parent = F.when(F.col("id") == F.shiftleft(F.col("task"), 33), F.col("last")).otherwise(F.col("id") - 1)
    return placed.withColumn("task", task).join(F.broadcast(before), "task", "left").select(
        "tree", "id", parent.alias("parent"), "role", "text", F.lit(None).cast("double").alias("score"))
