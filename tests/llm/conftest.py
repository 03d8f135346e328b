"""Documents with every awkward case, and helpers shared by the operators' tests."""

from __future__ import annotations

import random

import pytest

CLASHING = ["row", "key", "kept", "n_words"]  # names that operators use for their own columns
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHING)


def words(rng: random.Random, n: int, vocabulary: int = 40) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward_texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(7)
    long = " ".join(words(rng, 12_000, 3_000))
    passage = " ".join(words(rng, 60, 10_000))
    base = words(rng, 200, 10_000)
    near = [[*base[:i], f"edit{i}", *base[i + 1:]] for i in (20, 90, 150)]
    texts = [(1, None), (2, ""), (3, " \t\n "), (4, "One two"), (5, "one two"), (6, "Straße É x\x1cy z\x0bw <b> $$ !"), (7, long),
             (8, f"start here {passage} and one end"), (9, f"another\n\nstart {passage}"), (10, " ".join(base)), (11, "  ".join(base)),
             *((12 + i, " ".join(n)) for i, n in enumerate(near)), (20, "same line\nsame line\nother"), (20, "same line\nsame line\nother"),
             (21, "a b c " * 70), (None, "no id here"), (None, None), (22, "x" * 3000), (23, "日本語 のテキスト です"), (24, "THE the The " * 30)]
    return texts


def frame(spark, texts, schema: str = SCHEMA):
    n = len(CLASHING)
    return spark.createDataFrame([(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"src{k % 3}",
                                   None if t is None else len(t), *range(n)) for k, (i, t) in enumerate(texts)], schema)


@pytest.fixture(scope="session")
def awkward(spark):
    return frame(spark, awkward_texts()).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
