"""Query statistics, spill, shuffle and query text patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import (
    gigabytes,
    in_period_times,
    join_count,
    lacks_filter,
    preview,
    rounded,
    seconds,
    selects_star,
    total,
)
from ..sources.registry import AnalysisWindow

# ---- fixed values -------------------------------------------------------------
TOP_QUERIES = 10
LONG_QUERY_MS = 5000
COSTLY_STATEMENTS = ("SELECT", "INSERT", "MERGE", "UPDATE", "DELETE", "CREATE", "COPY")
EXCESSIVE_JOINS = 5
LARGE_RESULT_ROWS = 10_000_000
PATTERN_SEVERITY = {
    "select_star": "medium",
    "no_where_clause": "high",
    "excessive_joins": "medium",
    "large_result_sets": "medium",
}
UPSIZE_SPILL_GB = 1
SHUFFLE_MIN_GB = 0.1
TOP_SHUFFLE = 10
PREVIEW_CHARS = 200
# -------------------------------------------------------------------------------


def in_window(history: DataFrame, window: AnalysisWindow) -> DataFrame:
    return history.filter(in_period_times(F.col("start_time"), window))


def user_stats(history: DataFrame, window: AnalysisWindow) -> DataFrame:
    """Queries, rows, files and durations of each user."""
    return (
        in_window(history, window)
        .filter(F.col("executed_by").isNotNull())
        .groupBy(F.col("executed_by").alias("user"))
        .agg(
            F.count("*").alias("query_count"),
            F.sum("read_rows").alias("total_rows_read"),
            F.sum("read_files").alias("total_files_read"),
            F.sum("total_task_duration_ms").alias("ms"),
            F.avg("total_task_duration_ms").alias("avg_ms"),
        )
        .select(
            "user",
            "query_count",
            "total_rows_read",
            "total_files_read",
            seconds(F.col("ms")).alias("total_duration_seconds"),
            rounded(seconds(F.col("avg_ms")), 3).alias("avg_duration_seconds"),
        )
    )


def longest_queries(history: DataFrame, window: AnalysisWindow, limit: int | None = TOP_QUERIES) -> DataFrame:
    """The longest statements that move or read data; without a limit, all that are long, in any order."""
    found = in_window(history, window).filter(
        (F.col("total_task_duration_ms") > LONG_QUERY_MS) & F.col("statement_type").isin(*COSTLY_STATEMENTS)
    )
    if limit is not None:
        found = found.orderBy(F.col("total_task_duration_ms").desc(), "statement_id").limit(limit)
    return found.select(
        "statement_id",
        F.col("executed_by").alias("user"),
        F.col("compute.warehouse_id").alias("warehouse_id"),
        "statement_type",
        "read_rows",
        "read_files",
        seconds(F.col("total_task_duration_ms")).alias("duration_seconds"),
        "start_time",
    )


def text_flags(queries: DataFrame, max_joins: int = EXCESSIVE_JOINS) -> DataFrame:
    """Flags on the statement text and the rows read."""
    text = F.col("statement_text")
    return queries.select(
        "*",
        selects_star(text).alias("select_star"),
        lacks_filter(text).alias("no_where_clause"),
        (join_count(text) >= max_joins).alias("excessive_joins"),
        F.coalesce(F.col("read_rows") > LARGE_RESULT_ROWS, F.lit(False)).alias("large_result_sets"),
    )


def select_totals(history: DataFrame, window: AnalysisWindow, max_joins: int = EXCESSIVE_JOINS) -> DataFrame:
    """One row: the SELECTs of the period, and how many of them show each pattern."""
    selects = in_window(history, window).filter(F.col("statement_type") == "SELECT")
    return text_flags(selects.select("statement_text", "read_rows"), max_joins).agg(
        F.count("*").alias("select_count"), *[F.count_if(F.col(p)).alias(p) for p in PATTERN_SEVERITY]
    )


def pattern_counts(totals: DataFrame) -> DataFrame:
    """The patterns that SELECTs show, as (pattern, count)."""
    counts = totals.unpivot([], list(PATTERN_SEVERITY), "pattern", "count")
    return counts.filter(F.col("count") > 0)


def pattern_findings(counts: DataFrame) -> DataFrame:
    severity = F.lit(None).cast("string")
    for pattern, level in PATTERN_SEVERITY.items():
        severity = F.when(F.col("pattern") == pattern, level).otherwise(severity)
    return counts.select(F.col("pattern").alias("type"), severity.alias("severity"), "count")


def disk_spill(history: DataFrame, window: AnalysisWindow) -> DataFrame:
    """Spilling queries per warehouse."""
    per_warehouse = (
        in_window(history, window)
        .filter((F.col("spilled_local_bytes") > 0) & F.col("compute.warehouse_id").isNotNull())
        .groupBy(F.col("compute.warehouse_id").alias("warehouse_id"))
        .agg(
            F.count("*").alias("spill_frequency"),
            F.max("spilled_local_bytes").alias("max_bytes"),
            F.sum("spilled_local_bytes").alias("bytes"),
        )
    )
    return per_warehouse.select(
        "warehouse_id",
        "spill_frequency",
        rounded(gigabytes(F.col("max_bytes")), 2).alias("max_spilled_gb"),
        rounded(gigabytes(F.col("bytes")), 2).alias("total_spilled_gb"),
        (gigabytes(F.col("max_bytes")) > UPSIZE_SPILL_GB).alias("needs_upsize"),
    )


def spill_summary(spill: DataFrame) -> DataFrame:
    return spill.agg(
        F.coalesce(F.sum("spill_frequency"), F.lit(0)).alias("total_spill_queries"),
        F.coalesce(F.bool_or("needs_upsize"), F.lit(False)).alias("has_significant_spill"),
    )


def shuffle_heavy(history: DataFrame, window: AnalysisWindow) -> DataFrame:
    """Queries that shuffle much."""
    gb = gigabytes(F.col("shuffle_read_bytes"))
    return in_window(history, window).filter((F.col("shuffle_read_bytes") > 0) & (gb > SHUFFLE_MIN_GB)).select(
        F.col("compute.warehouse_id").alias("warehouse_id"),
        "statement_id",
        F.col("executed_by").alias("user"),
        preview("statement_text", PREVIEW_CHARS).alias("statement_preview"),
        "shuffle_read_bytes",
        rounded(gb, 2).alias("shuffle_gb"),
        F.coalesce(seconds(F.col("total_task_duration_ms")), F.lit(0.0)).alias("duration_seconds"),
        F.coalesce("read_rows", F.lit(0)).alias("read_rows"),
    )


def top_shuffle(heavy: DataFrame, limit: int = TOP_SHUFFLE) -> DataFrame:
    return heavy.orderBy(F.col("shuffle_read_bytes").desc(), "statement_id").limit(limit)


def shuffle_by_warehouse(heavy: DataFrame) -> DataFrame:
    warehouse = F.coalesce(F.nullif("warehouse_id", F.lit("")), F.lit("unknown"))
    return heavy.groupBy(warehouse.alias("warehouse_id")).agg(
        F.count("*").alias("query_count"), total("shuffle_gb").alias("total_shuffle_gb")
    )


def query_totals(stats: DataFrame, selects: DataFrame) -> DataFrame:
    """One row: queries of all users, SELECTs, and how many of these show each pattern."""
    columns = ["select_count", *PATTERN_SEVERITY]
    found = selects.select(F.struct(*columns)).scalar()
    return stats.agg(F.coalesce(F.sum("query_count"), F.lit(0)).alias("query_count")).select(
        "query_count", *[found[c].alias(c) for c in columns]
    )
