"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Every text is measured inside its own row, so nothing is shuffled. Repeated three-word windows are
found by sorting one long per window (hash bits above, position below) and comparing the words
of equal neighbours.

Defined results: a null or empty text has no words, all counts 0 and fails the base; repeated rows are
judged one by one; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Common short function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that for with as was on it this by are be at from "
    "der die und das von zu mit den ist im ein eine nicht sich auf des dem für "
    "le la les de des et un une en du que qui dans pour par sur au avec est "
    "el los las y una se del al con su lo como más"
).split()
SYMBOLS = "#*$%&|<>"
_BLANK = "\t\n\x0b\x0c\r "


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high``; a bound of None doesn't count."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


# Production thresholds, over the metrics that ``measured`` gives.
RULES = (
    Rule("words", "n_words", MIN_WORDS, None),
    Rule("word_length", "word_chars / n_words", 2.5, 12),
    Rule("symbols", "n_symbols / n_words", None, 0.3),
    Rule("shouting", "n_shouts / n_words", None, 0.3),
    Rule("stop_words", "n_stop_words / n_words", 0.05, None),
    Rule("same_lines", "n_dup_lines / n_lines", None, 0.5),
)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text that rules may use."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    words = text.select("doc_id", "text", F.btrim("text", F.lit(_BLANK)).alias("body")).select(
        "doc_id", "text",
        F.when(F.col("body") == "", F.array().cast("array<string>"))
        .otherwise(F.split("body", "[\\x09-\\x0D ]+")).alias("w"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    sized = words.select(
        "doc_id", "w", F.size("w").alias("n"), F.expr("shiftleft(1L, length(bin(cast(size(w) as long))))").alias("room"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_shouts"),
        F.expr(f"cast(size(filter(w, x -> lower(x) in ({stop}))) as long)").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    counts = [c for c in sized.columns if c not in ("w", "room", "n")]
    # high bits: hash of the window that starts at word i; low bits: i
    packed = sized.select(*counts, "w", "n", "room", F.expr(
        "sort_array(if(n < 3, cast(array() as array<bigint>), transform(sequence(0, n - 3), i -> "
        "coalesce((xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)) & (-room)) | i, 0L))))").alias("p"))
    # equal high bits: the two longs differ below ``room`` only
    close = "((get(p, j {0} 1) ^ x) between 0L and room - 1)"
    likely = packed.select(*counts, "w", "n", "room", F.expr(
        f"filter(p, (x, j) -> {close.format('-')} or {close.format('+')})").alias("c"))
    same = " and ".join(
        f"get(w, cast(get(c, j {{0}} 1) & (room - 1) as int) + {k}) = get(w, cast(x & (room - 1) as int) + {k})" for k in range(3))
    repeated = likely.select(*counts, "n", F.expr(
        f"sort_array(transform(filter(c, (x, j) -> ({same.format('-')}) or ({same.format('+')})), "
        "x -> coalesce(x & (room - 1), 0L)))").alias("at"))
    return repeated.select(
        *counts, F.col("n").cast("long").alias("n_words"),
        F.expr("aggregate(transform(at, (x, j) -> least(3L, coalesce(get(at, j + 1) - x, 3L))), 0L, (a, b) -> a + b)")
        .alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def compiled(rule: Rule) -> Column:
    """Whether a row keeps the rule; a ratio without a denominator keeps it."""
    top, _, bottom = (x.strip() for x in rule.metric.partition("/"))
    value = F.col(top).cast("double")
    value = F.when(F.col(bottom) != 0, value / F.col(bottom)) if bottom else value
    bounds = []
    if rule.low is not None:
        bounds.append(value >= float(rule.low))
    if rule.high is not None:
        bounds.append(value <= float(rule.high))
    return F.coalesce(reduce(lambda a, b: a & b, bounds, F.lit(True)), F.lit(True))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: its counts, base_failed, kept, and the names of the rules it broke."""
    return measured(docs).select(
        "*", base_failed().alias("base_failed"),
        F.filter(F.array(*(F.when(~compiled(r), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull()).alias("broken"),
    ).withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
