"""Latest version per key of slowly changing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import availability, is_job_cluster, uses_spot


def latest_version(
    df: DataFrame, keys: Sequence[str], changed: str, ties: Sequence[Column] = ()
) -> DataFrame:
    """The newest row of each key.

    Spark keeps one row per key and input partition before the shuffle, so a key with
    very many versions costs no more than any other.
    """
    order = [F.col(changed).desc_nulls_last(), *ties]
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_version", newest).filter("_version = 1").drop("_version")


def latest_clusters(clusters: DataFrame) -> DataFrame:
    return latest_version(clusters, ["cluster_id"], "change_time", [F.col("cluster_name"), F.col("owned_by")])


def latest_jobs(jobs: DataFrame) -> DataFrame:
    return latest_version(
        jobs, ["workspace_id", "job_id"], "change_time", [F.col("name"), F.col("creator_user_name")]
    )


def cluster_listing(clusters: DataFrame) -> DataFrame:
    """Latest configuration of every cluster."""
    return latest_clusters(clusters).select(
        "cluster_id",
        "cluster_name",
        "owned_by",
        "create_time",
        "delete_time",
        "driver_node_type",
        "worker_node_type",
        "worker_count",
        "min_autoscale_workers",
        "max_autoscale_workers",
        "auto_termination_minutes",
        "enable_elastic_disk",
        "cluster_source",
        "dbr_version",
        "change_time",
    )


def job_cluster_capacity(clusters: DataFrame) -> DataFrame:
    """Capacity type of the clusters that job runs started.

    Versions under another name are left out before the newest is picked.
    """
    return latest_clusters(clusters.filter(is_job_cluster(F.col("cluster_name")))).select(
        "cluster_id",
        "cluster_name",
        availability().alias("availability"),
        uses_spot().alias("uses_spot"),
    )
