"""Run named queries on Spark and their oracle on DuckDB and compare values exactly."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SAMPLE_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
                 "benchmark labels conversations").split()


def session() -> SparkSession:
    from plantpulse.session import local_session

    return local_session(os.environ.get("TEST_CPUS", "8"), "tests")


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in SAMPLE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v: object) -> object:
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def difference(spark: SparkSession, con: duckdb.DuckDBPyConnection, query, sql: str, sf_dir: str) -> str | None:
    """None when names, kinds and values agree, else a short description."""
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    kinds = {"double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE",
             "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    spark_kinds = {f.name: kinds.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    duck_kinds = {d[0]: str(d[1]) for d in cur.description}
    wrong = {n: (spark_kinds[n], duck_kinds[n]) for n in names if spark_kinds[n] != duck_kinds[n]}
    a, b = _rows(df.columns, got), _rows(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y)]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}"
    if wrong:
        return f"types {wrong}"
    return "empty" if not a else None


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark, con = session(), oracle(sf)
    checks, sqls = entry.queries(), entry.oracle_sql()
    print("without query:", sorted(set(sqls) - set(checks)))
    for name, query in checks.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if name in sqls:
                out = difference(spark, con, query, sqls[name], sf) or "ok"
            else:
                out = f"rows only: {query(spark, sf).count()}"
        except Exception as exc:  # noqa: BLE001
            out = "FAIL " + str(exc)[:700]
        print(f"{name:32s} {time.time() - t:6.2f}s {out}", flush=True)
