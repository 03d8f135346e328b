"""Oracle SQL: every checkable query again, written independently for DuckDB."""

from __future__ import annotations

from oracle import assets, gold, maintenance, messages, production, questions
from oracle.prelude import PRELUDE

_PARTS = (production, assets, gold, maintenance, questions, messages)


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for part in _PARTS:
        for name, body in part.SQL.items():
            out[name] = f"WITH {PRELUDE}{body}"
    return out
