"""Projections, named top lists and expected savings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import ratio, rounded, total
from ..sources.registry import AnalysisWindow
from .usage import TOP_ITEMS
from .versions import latest_clusters

# ---- fixed values -------------------------------------------------------------
DAYS_PER_MONTH = 30
# -------------------------------------------------------------------------------


def monthly_projection(totals: DataFrame, window: AnalysisWindow) -> DataFrame:
    """Totals with monthly estimates and the serverless share."""
    factor = DAYS_PER_MONTH / max(window.period_days, 1)
    share = ratio(F.col("serverless_cost"), F.col("total_cost")) * 100
    return totals.select(
        "*",
        F.lit(window.period_days).alias("period_days"),
        rounded(F.col("total_dbus") * factor, 2).alias("estimated_monthly_dbus"),
        rounded(F.col("total_cost") * factor, 2).alias("estimated_monthly_cost"),
        rounded(share, 1).alias("serverless_percentage"),
    )


def _named(df: DataFrame, key: str, name: str, source: int) -> DataFrame:
    given = F.col(name).isNotNull() & (F.col(name) != "")
    return df.filter(given).select(F.col(key).alias("id"), F.col(name).alias("name"), F.lit(source).alias("source"))


def cluster_names(clusters: DataFrame, cluster_costs: DataFrame) -> DataFrame:
    """(id, name) of clusters; a configured name wins over one from costs."""
    configured = _named(latest_clusters(clusters), "cluster_id", "cluster_name", 1)
    return (
        configured.unionByName(_named(cluster_costs, "cluster_id", "cluster_name", 2))
        .groupBy("id")
        .agg(F.min_by("name", "source").alias("name"))
    )


def name_top_items(
    top: DataFrame,
    jobs: DataFrame,
    cluster_costs: DataFrame,
    clusters: DataFrame,
    warehouses: DataFrame,
) -> DataFrame:
    """Top lists with names; a configured cluster name wins over one from costs.

    The top lists hold a few rows per dimension, so the names are cut down to those
    first.
    """

    def wanted(df: DataFrame, dim: str, key: str) -> DataFrame:
        ids = top.filter(F.col("dim") == dim).select(F.col("id").alias(key))
        return df.join(ids, key, "left_semi")

    # Of several names of a job, that of the last row by cost counts.
    by_job = (
        wanted(jobs, "job", "job_id")
        .filter(F.col("job_name").isNotNull() & (F.col("job_name") != ""))
        .groupBy("job_id")
        .agg(F.max_by("job_name", "job_rank").alias("name"))
        .select(F.lit("job").alias("dim"), F.col("job_id").alias("id"), "name")
    )
    by_cluster = cluster_names(
        wanted(clusters, "cluster", "cluster_id"), wanted(cluster_costs, "cluster", "cluster_id")
    ).select(F.lit("cluster").alias("dim"), "id", "name")
    by_warehouse = _named(
        wanted(warehouses, "warehouse", "warehouse_id"), "warehouse_id", "warehouse_name", 1
    ).select(F.lit("warehouse").alias("dim"), "id", "name")
    names = by_job.unionByName(by_cluster).unionByName(by_warehouse)
    return top.join(names, ["dim", "id"], "left").select("dim", "rank", "id", "name", "dbus", "cost")


def expected_savings(warehouse_issues: DataFrame) -> DataFrame:
    """One row: savings that the warehouse findings promise."""
    return warehouse_issues.agg(total("estimated_savings").alias("potential_savings"))
