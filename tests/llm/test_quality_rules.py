from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from plantpulse.llm.quality_rules import RULES, STOP_WORDS, Rule, quality_rules
from tests.llm.conftest import awkward_texts, frame, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def brute(doc, text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, windows = len(w), [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    many = Counter(windows)
    repeat = len({i + k for i, x in enumerate(windows) if many[x] > 1 for k in range(3)})
    symbols, dup, chars = len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(map(len, w))
    failed = n < 50 or 100 * repeat > 50 * n
    good = not failed and 2.5 <= chars / n <= 12 and symbols <= 0.3 * n and text.count("!") <= 0.3 * n and dup <= 0.5 * len(lines) \
        and sum(x.lower() in STOP_WORDS for x in w) >= 0.05 * n
    return doc, n, chars, symbols, dup, repeat, failed, good


def test_against_brute_force(spark):
    rng = random.Random(2)
    texts = awkward_texts()
    for i in range(80):
        w = words(rng, rng.randrange(150), rng.choice([2, 8, 30, 2000]))
        w = [rng.choice([x, x, "the", "and", x + "$", "Hey!!"][:rng.randrange(1, 7)]) for x in w]
        texts.append((300 + i, "".join(x + rng.choice([" ", "\n", "\t", "\n\n"]) for x in w)))
    got = Counter(tuple(r) for r in quality_rules(frame(spark, texts)).select(*COLUMNS).collect())
    assert got == Counter(brute(*t) for t in texts)


def test_plan_is_one_projection_without_python(spark, awkward):
    plan = quality_rules(awkward)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Join" not in plan and "Aggregate" not in plan and "MapIn" not in plan


def test_names_of_broken_rules(spark):
    text = " ".join(f"word{i} the" for i in range(40))
    rows = quality_rules(frame(spark, [(1, text), (2, text.replace("the", "xyz")), (3, text + "$" * 60)])).collect()
    assert {r.doc_id: list(r.broken) for r in rows} == {1: [], 2: ["stop_words"], 3: ["symbols"]}


def test_own_table_of_rules(spark):
    rows = quality_rules(frame(spark, [(1, "the a " * 40)]), (Rule("few", "n_words", None, 10),)).collect()
    assert rows[0].broken == ["few"] and not rows[0].kept


def test_empty_table(empty):
    assert quality_rules(empty).collect() == []


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.name)
def test_rules_have_a_bound(rule):
    assert rule.low is not None or rule.high is not None
