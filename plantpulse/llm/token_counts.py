"""Token counts of the sections of documents, by offsets of one encoding of the whole.

A document is encoded once, so counts are those of the text as a model will see it. The tokens of a
byte-level vocabulary are the text's bytes in order; their lengths give every token's span, and
byte places give characters. Spans meet the sections (disjoint, in order) in a sorted interval join
inside the row: nothing is shuffled, and no token becomes a row. A token that crosses a boundary goes by
an explicit rule: to the section of its ``first`` or ``last`` character, to the one with ``most`` of its
characters (ties: the earlier), or ``split`` in proportion to characters.

Defined results: a null or empty text has no tokens; sections that are null, empty or outside the text
get 0; characters in no section count as ``outside``; repeated rows are counted one by one; an empty
table gives no rows; the input's columns stay in ``row``.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.mapping import beside

VOCABULARY = "byte_bpe_50k.tiktoken"
#: A sentence or line is over behind this.
BREAK = re.compile(r"[.!?]\s|\n")
RULES = ("first", "last", "most", "split")


class Counter:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and last character of each token."""
        ids = self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        ends = np.cumsum(self.length[ids])
        character = np.cumsum((np.frombuffer(text.encode("utf-8"), np.uint8) & 0xC0) != 0x80) - 1
        return character[ends - self.length[ids]], character[ends - 1]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def allocate(first: np.ndarray, last: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, float, int]:
    """(tokens of each section, tokens outside all, tokens that touch two sections or one and the outside).

    Tokens are first..last characters inclusive; sections are start..end - 1, disjoint and in order.
    """
    n = len(start)
    counts = np.zeros(n + 1)
    if not len(first):
        return counts[:n], 0.0, 0
    # pieces that characters can lie in: gap 0, section 0, gap 1, section 1, ..., gap n
    edges = np.stack([start, end], axis=1).ravel()
    low, high = np.searchsorted(edges, first, side="right"), np.searchsorted(edges, last, side="right")
    crossing = low != high
    owner = np.where(np.arange(2 * n + 1) % 2 == 1, np.arange(2 * n + 1) // 2, n)
    whole = ~crossing if rule in ("most", "split") else np.ones(len(first), bool)
    counts += np.bincount(owner[(high if rule == "last" else low)[whole]], minlength=n + 1)
    for t in np.flatnonzero(~whole):
        cuts = np.concatenate([[first[t]], edges[low[t]:high[t]], [last[t] + 1]])
        share = np.bincount(owner[low[t]:high[t] + 1], weights=np.diff(cuts), minlength=n + 1)
        if rule == "split":
            counts += share / share.sum()
        else:
            counts[_earliest_most(owner[low[t]:high[t] + 1], share)] += 1
    return counts[:n], float(counts[n]), int(crossing.sum())


def _earliest_most(pieces: np.ndarray, share: np.ndarray) -> int:
    best = share[pieces].max()
    return int(next(p for p in pieces if share[p] == best))


def token_counts(docs: DataFrame, sections: str | None = None, rule: str = "most", path: str | None = None,
                 carry: list[str] | None = None) -> DataFrame:
    """``row``, n_tokens, by_section (array<double>), outside, crossing.

    ``sections`` names a column of array<struct<start, end>>; without it every sentence or line, with
    what ends it, is a section.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or public_tokenizers.path(VOCABULARY)
    both = F.struct(F.col("text").alias("text"), (F.col(sections) if sections else F.lit(None).cast("array<struct<start:bigint,end:bigint>>")).alias("s"))

    def make():
        own = counter(path)

        def count(values: pa.Array) -> list[pa.Array]:
            texts, given = values.field(0).to_pylist(), values.field(1).to_pylist() if sections else [None] * len(values)
            totals, parts, outside, crossing = [], [], [], []
            for text, spans in zip(texts, given):
                start, end = _broken(text or "") if not sections else _clean(spans, len(text or ""))
                first, last = own.spans(text) if text else (np.empty(0, np.int64),) * 2
                counts, out, crossed = allocate(first, last, start, end, rule)
                if sections:
                    counts = _in_place(counts, spans, len(text or ""))
                totals.append(len(first))
                parts.append(counts)
                outside.append(out)
                crossing.append(crossed)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0)))
            return [pa.array(totals, pa.int64()), lists, pa.array(outside, pa.float64()), pa.array(crossing, pa.int64())]
        return count

    carried = docs.columns if carry is None else carry
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("kept"), both.alias("value"))
    found = beside(kept, make, "n_tokens bigint, by_section array<double>, outside double, crossing bigint", ["kept"], text="value")
    return found.select(F.col("row.kept").alias("row"), "n_tokens", "by_section", "outside", "crossing")


def _broken(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sections that end behind each break and at the text's end."""
    cuts = [0, *(m.end() for m in BREAK.finditer(text)), len(text)]
    edges = np.unique(np.array(cuts, np.int64))
    return edges[:-1], edges[1:]


def _usable(span: dict | None, n: int) -> bool:
    return bool(span) and span["start"] is not None and span["end"] is not None and max(span["start"], 0) < min(span["end"], n)


def _disjoint(spans: list | None, n: int) -> list[tuple[int, int, int]]:
    """(start, end, place) of the sections that hold characters, by start, cut to the text.

    Where sections overlap the one that starts first (then: ends first, then: is given first) has the
    characters; a section that is left none counts nothing.
    """
    out, reached = [], 0
    for start, end, i in sorted((max(s["start"], 0), min(s["end"], n), i) for i, s in enumerate(spans or ()) if _usable(s, n)):
        start = max(start, reached)
        if start < end:
            out.append((start, end, i))
            reached = end
    return out


def _clean(spans: list | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    own = _disjoint(spans, n)
    return tuple(np.array([s[k] for s in own], np.int64) for k in (0, 1))


def _in_place(counts: np.ndarray, spans: list | None, n: int) -> np.ndarray:
    """Counts in the order of the given sections, 0 for those without characters."""
    out = np.zeros(len(spans or ()))
    for count, (_, _, i) in zip(counts, _disjoint(spans, n)):
        out[i] = count
    return out
