"""Writes analysis results to files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import total


def report_summary(recommendations: DataFrame, projection: DataFrame) -> DataFrame:
    """One row: number and sum of the recommendations, and the monthly cost."""
    return recommendations.agg(
        F.count("*").alias("total_recommendations"),
        total("estimated_savings").alias("estimated_total_savings"),
    ).select(
        "*",
        projection.select("estimated_monthly_cost").scalar().alias("estimated_monthly_cost"),
    )


def sort_key(name: str) -> Column:
    """A column to sort by; a leading minus means largest first."""
    return F.col(name[1:]).desc() if name.startswith("-") else F.col(name).asc()


def in_file_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows dealt by ranges of the order and sorted in each: files in the order of their names give it."""
    keys = [sort_key(name) for name in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)


def write_results(
    results: Mapping[str, DataFrame],
    folder: str,
    fmt: str = "json",
    mode: str = "errorifexists",
    orders: Mapping[str, Sequence[str]] | None = None,
) -> None:
    """Write each result to its own folder, as JSON lines or parquet.

    ``orders`` names the results whose order counts, with their columns (a leading minus means
    largest first); operators leave sorting to this. No task sorts more than its range.
    """
    for name, df in results.items():
        order = (orders or {}).get(name)
        ordered = in_file_order(df, order) if order else df
        ordered.write.mode(mode).format(fmt).save(f"{folder}/{name}")


def file_bounds(spark: SparkSession, folder: str, column: str, fmt: str = "parquet") -> DataFrame:
    """(file, rows, least, greatest) of a written result, by a column of its order."""
    written = spark.read.format(fmt).load(folder).withColumn("file", F.col("_metadata.file_name"))
    return written.groupBy("file").agg(
        F.count("*").alias("rows"), F.min(column).alias("least"), F.max(column).alias("greatest")
    )
