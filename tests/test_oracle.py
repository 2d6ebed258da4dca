"""All registered queries against DuckDB.

``python -m spendscope_checks.compare <folder>`` compares them over other folders.
"""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
from spendscope_checks import queries, sql
from spendscope_checks.compare import differences, duck

from .conftest import SF_DIR

@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", queries.names())
def test_same_rows_as_duckdb(spark, con, name):
    assert differences(queries.run(name, spark, SF_DIR), con, sql.oracle(name)) == []


def test_every_query_has_a_statement():
    own = set(queries.names())
    # Other packages may register more queries, some of which no statement can express.
    assert own <= set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_flagship(spark):
    assert entry_point.entry(spark).columns == ["dim", "key", "dbus", "cost", "serverless_cost", "classic_cost"]
