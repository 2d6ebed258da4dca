"""Interactive cluster cost and cluster configuration findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import is_job_cluster, total
from .versions import latest_clusters

# ---- fixed values -------------------------------------------------------------
VERY_LARGE_WORKERS = 20
LARGE_WORKERS = 10
HIGH_MIN_WORKERS = 2
# -------------------------------------------------------------------------------


def cluster_usage_cost(priced: DataFrame) -> DataFrame:
    return (
        priced.filter(F.col("cluster_id").isNotNull())
        .groupBy("cluster_id")
        .agg(total("usage_quantity").alias("total_dbus"), total("dollar_cost").alias("total_cost"))
    )


def clusters_with_names(per_cluster: DataFrame, clusters: DataFrame) -> DataFrame:
    """Add the latest name and owner, where the cluster is known."""
    names = latest_clusters(clusters).select(
        "cluster_id", "cluster_name", F.col("owned_by").alias("owner")
    )
    return per_cluster.join(names, "cluster_id", "left").select(
        "cluster_id", "cluster_name", "owner", "total_dbus", "total_cost"
    )


def cluster_costs_of(rollup: DataFrame) -> DataFrame:
    """The same as ``cluster_usage_cost``, out of the cost by dimension."""
    return rollup.filter(F.col("dim") == "cluster").select(
        F.col("key").alias("cluster_id"), F.col("dbus").alias("total_dbus"), F.col("cost").alias("total_cost")
    )


def interactive_cluster_costs(per_cluster: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cost of the clusters that no job run started.

    Usage is summed before the join, so the join sees one row per cluster.
    """
    return clusters_with_names(per_cluster, clusters).filter(~is_job_cluster(F.col("cluster_name")))


def issue(
    domain: str,
    kind: str,
    when: Column,
    resource_id: Column,
    resource_name: Column,
    owner: Column,
    severity: Column | str,
    description: Column,
    cost: Column,
    savings: Column,
    metric: Column,
) -> Column:
    """One finding as a struct, NULL where ``when`` does not hold."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(
        when,
        F.struct(
            F.lit(domain).alias("domain"),
            F.lit(kind).alias("type"),
            resource_id.cast("string").alias("resource_id"),
            resource_name.cast("string").alias("resource_name"),
            owner.cast("string").alias("owner"),
            as_column(severity).alias("severity"),
            description.alias("description"),
            cost.cast("double").alias("cost"),
            savings.cast("double").alias("estimated_savings"),
            metric.cast("double").alias("metric"),
        ),
    )


def raise_issues(df: DataFrame, issues: list[Column], *keep: str) -> DataFrame:
    """A row per finding that applies, in the given order."""
    found = F.array_compact(F.array(*issues))
    return df.select(*keep, F.posexplode(found).alias("issue_order", "issue")).select(
        *keep, "issue_order", "issue.*"
    )


def cluster_issues(clusters: DataFrame, cluster_costs: DataFrame) -> DataFrame:
    """Configuration findings of clusters that no job run started.

    Clusters without a row in ``cluster_costs`` had no usage and count as free.
    """
    costs = cluster_costs.select(
        "cluster_id", F.col("owner").alias("cost_owner"), F.col("total_cost").alias("cost")
    )
    named = (
        latest_clusters(clusters)
        .filter(~is_job_cluster(F.col("cluster_name"), ignore_case=True))
        .join(costs, "cluster_id", "left")
        .withColumn("cost", F.coalesce("cost", F.lit(0.0)))
        .withColumn("owner", F.coalesce(F.nullif("cost_owner", F.lit("")), "owned_by"))
    )
    given = lambda c: F.coalesce(F.col(c), F.lit(0))
    workers = (
        F.when(given("worker_count") != 0, F.col("worker_count"))
        .otherwise(given("max_autoscale_workers"))
    )
    fixed_size = (
        (given("worker_count") != 0)
        & (given("min_autoscale_workers") == 0)
        & (given("max_autoscale_workers") == 0)
    )

    def finding(kind, when, severity, text, metric):
        return issue(
            "cluster", kind, when, F.col("cluster_id"), F.col("cluster_name"), F.col("owner"),
            severity, text, F.col("cost"), F.lit(None), metric,
        )

    return raise_issues(
        named,
        [
            finding(
                "no_autotermination",
                F.col("auto_termination_minutes") == 0,
                "high",
                F.lit("Never terminates by itself when idle"),
                F.col("auto_termination_minutes"),
            ),
            finding(
                "no_autoscaling",
                fixed_size,
                "medium",
                F.format_string("Keeps %d workers whatever the load", F.col("worker_count")),
                F.col("worker_count"),
            ),
            finding(
                "oversized",
                workers >= LARGE_WORKERS,
                F.when(workers >= VERY_LARGE_WORKERS, "high").otherwise("medium"),
                F.format_string("May use up to %d workers", workers),
                workers,
            ),
            finding(
                "high_min_workers",
                given("min_autoscale_workers") > HIGH_MIN_WORKERS,
                "low",
                F.format_string("Never scales below %d workers", F.col("min_autoscale_workers")),
                F.col("min_autoscale_workers"),
            ),
        ],
    ).drop("issue_order")
