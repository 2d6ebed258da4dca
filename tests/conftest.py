from __future__ import annotations

import sys
from datetime import date, datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from spendscope.session import local_session  # noqa: E402
from spendscope.sources.registry import AnalysisWindow, SourceTables  # noqa: E402
from spendscope.sources.sample_tables import sample_tables  # noqa: E402
from spendscope.sources.schemas import schema_of  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sample(spark) -> SourceTables:
    return sample_tables(spark, SF_DIR)


@pytest.fixture(scope="session")
def window() -> AnalysisWindow:
    return AnalysisWindow(date(2025, 11, 18), date(2026, 2, 16), datetime(2026, 2, 17, 12), 30)


@pytest.fixture(scope="session")
def make(spark):
    """Rows given as dicts (nested ones too), as a table of the declared schema."""

    def fill(schema, row):
        return tuple(
            fill(f.dataType, row.get(f.name) or {}) if hasattr(f.dataType, "fields") else row.get(f.name)
            for f in schema.fields
        )

    def build(name: str, rows: list[dict]):
        schema = schema_of(name)
        return spark.createDataFrame([fill(schema, row) for row in rows], schema)

    return build


@pytest.fixture(scope="session")
def frame(spark):
    """Rows given as tuples, with a DDL schema."""
    return lambda ddl, rows: spark.createDataFrame(rows, ddl)
