"""What the bound sources contain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import SourceTables

# ---- fixed values -------------------------------------------------------------
SAMPLE_ROWS = 5
# Column that dates the rows of a source.
DATED_BY = {
    "usage": "usage_date",
    "clusters": "change_time",
    "node_timeline": "start_time",
    "query_history": "start_time",
}
# -------------------------------------------------------------------------------


def source_profile(tables: SourceTables) -> DataFrame:
    """Row count and date range of each bound source."""

    def profile(name: str) -> DataFrame:
        dated = DATED_BY.get(name)
        day = F.to_date(dated) if dated else F.lit(None).cast("date")
        return tables[name].agg(
            F.lit(name).alias("source"),
            F.count("*").alias("row_count"),
            F.min(day).alias("min_date"),
            F.max(day).alias("max_date"),
        )

    return reduce(DataFrame.unionByName, [profile(name) for name in tables.names()])


def distinct_values(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """The values of a column, or the first ``limit`` of them."""
    values = df.select(column).distinct()
    return values if limit is None else values.orderBy(column).limit(limit)


def sample_rows(df: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Any few rows."""
    return df.limit(rows)
