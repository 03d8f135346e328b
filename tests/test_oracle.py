"""Every named query against its oracle on the smallest sample."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from oracle import oracle_sql
from plantpulse.registry import queries
from tests.compare import difference, oracle

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQLS = queries(), oracle_sql()
# Legitimately without rows on the smallest sample.
MAY_BE_EMPTY = {"vibration_trend", "maintenance_history_asset", "plant_current", "oee_mean_of_ratios", "kpi_oee_delta",
                "downtime_by_line", "maintenance_history", "spend_on_kind", "dq_keys", "overdue_preventive", "unknown_devices"}


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


def test_every_oracle_has_a_query():
    assert set(SQLS) <= set(QUERIES)


def test_few_queries_lack_an_oracle():
    assert set(QUERIES) - set(SQLS) == {"hot_sensors_approx", "factory_tree", "conv_export", "failure_scores"}


@pytest.mark.parametrize("name", sorted(SQLS))
def test_matches_oracle(spark, con, name):
    found = difference(spark, con, QUERIES[name], SQLS[name], SF)
    assert found is None or (found == "empty" and name in MAY_BE_EMPTY), found


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5
