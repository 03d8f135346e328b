"""One asset, machine, part and conversation holding a third of all rows: results stay whole."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tests.compare import SAMPLE_TABLES, difference, oracle

SOURCE = "/root/testdata/sf0.001"
HOT = {
    "events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id) FROM t",
    "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey) FROM t",
    "lineitem": "SELECT * REPLACE (CASE WHEN l_linenumber % 3 = 0 THEN 7 ELSE l_suppkey END AS l_suppkey, "
                "CASE WHEN l_linenumber % 3 = 1 THEN 11 ELSE l_partkey END AS l_partkey) FROM t",
    "conversations": "SELECT CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id END AS conv_id, CASE WHEN conv_id % 3 = 0 THEN "
                     "row_number() OVER (PARTITION BY conv_id % 3 = 0 ORDER BY conv_id, turn) - 1 ELSE turn END AS turn, role, text FROM t",
}
NAMES = ["feature_store", "anomaly_sessions", "vibration_outliers", "latest_prediction", "actual_runtime", "top_parts",
         "conv_alternating", "conv_context", "conv_export_rows", "flow_edges", "recent_by_asset", "oee_by_plant"]


@pytest.fixture(scope="module")
def hot_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("hot")
    con = duckdb.connect()
    for name in SAMPLE_TABLES:
        source = f"SELECT * FROM '{SOURCE}/{name}.parquet'"
        query = f"WITH t AS ({source}) {HOT[name]}" if name in HOT else source
        con.execute(f"COPY ({query}) TO '{folder}/{name}.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_skewed_results_match(spark, hot_dir, name):
    assert difference(spark, oracle(hot_dir), entry.queries()[name], entry.oracle_sql()[name], hot_dir) is None
