"""Warehouse cost, configuration findings and running state."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import (
    hours_running,
    in_period_times,
    moment,
    rounded,
    settled,
    since,
    total,
    total_if,
    whole_units,
)
from ..sources.registry import AnalysisWindow
from .clusters import issue, raise_issues
from .versions import latest_version

# ---- fixed values -------------------------------------------------------------
LONG_AUTO_STOP_MINUTES = 30
LARGE_SIZES = ("2X-LARGE", "3X-LARGE", "4X-LARGE")
CLASSIC_MIN_COST = 5
NO_AUTO_STOP_SHARE = 0.2
LONG_AUTO_STOP_SHARE = 0.1
OVERSIZED_SHARE = 0.25
SERVERLESS_SHARE = 0.15
LONG_RUNNING_HOURS = 1
UPSCALED_MIN_CLUSTERS = 2
UPSCALED_HOURS = 0.5
IDLE_RUNNING_MINUTES = 30
IDLE_QUERY_HOURS = 2
# -------------------------------------------------------------------------------


def warehouse_configs(warehouses: DataFrame) -> DataFrame:
    """One row per warehouse; the newest where the table keeps versions."""
    if "change_time" in warehouses.columns:
        warehouses = latest_version(warehouses, ["warehouse_id"], "change_time", [F.col("warehouse_name")])
    return warehouses.select(
        "warehouse_id",
        "warehouse_name",
        "warehouse_type",
        "warehouse_size",
        "min_clusters",
        "max_clusters",
        "auto_stop_minutes",
        "created_by",
    )


def warehouse_costs(priced: DataFrame) -> DataFrame:
    return (
        priced.filter(F.col("warehouse_id").isNotNull())
        .groupBy("warehouse_id", "is_serverless", "sku_name")
        .agg(total("usage_quantity").alias("total_dbus"), total("dollar_cost").alias("total_cost"))
    )


def warehouse_cost_rollup(costs: DataFrame) -> DataFrame:
    serverless = F.coalesce(F.col("is_serverless"), F.lit(False))
    return costs.groupBy("warehouse_id").agg(
        total("total_dbus").alias("total_dbus"),
        total("total_cost").alias("total_cost"),
        total_if(serverless, "total_cost").alias("serverless_cost"),
        total_if(~serverless, "total_cost").alias("classic_cost"),
    )


def warehouse_costs_of(rollup: DataFrame) -> DataFrame:
    """The same per warehouse, out of the cost by dimension."""
    return rollup.filter(F.col("dim") == "warehouse").select(
        F.col("key").alias("warehouse_id"),
        F.col("dbus").alias("total_dbus"),
        F.col("cost").alias("total_cost"),
        "serverless_cost",
        "classic_cost",
    )


def merge_costs(configs: DataFrame, rollup: DataFrame) -> DataFrame:
    """Configurations with costs; warehouses that only have costs are kept too."""
    known = configs.withColumn("_known", F.lit(True))
    money = ("total_dbus", "total_cost", "serverless_cost", "classic_cost")
    unknown_name = F.concat(F.lit("Unknown ("), F.col("warehouse_id"), F.lit(")"))
    return known.join(rollup, "warehouse_id", "full_outer").select(
        "warehouse_id",
        F.when(F.col("_known"), F.col("warehouse_name")).otherwise(unknown_name).alias("warehouse_name"),
        "warehouse_type",
        "warehouse_size",
        "min_clusters",
        "max_clusters",
        "auto_stop_minutes",
        *[F.coalesce(m, F.lit(0.0)).alias(m) for m in money],
    )


def by_cost(merged: DataFrame) -> DataFrame:
    return merged.orderBy(F.col("total_cost").desc(), "warehouse_id")


def recent_events(events: DataFrame, window: AnalysisWindow, limit: int | None = None) -> DataFrame:
    """The events of the period, or the latest ``limit`` of them.

    Counts per hour tell how far back to read, so that the sort does not take
    ``limit`` rows from every input partition.
    """
    in_window = events.filter(in_period_times(F.col("event_time"), window))
    if limit is None:
        return in_window
    hours = in_window.groupBy(F.date_trunc("hour", "event_time").alias("hour")).agg(F.count("*").alias("n"))
    # One row per hour of the period reaches this window.
    later = Window.orderBy(F.col("hour").desc()).rowsBetween(Window.unboundedPreceding, -1)
    needed = hours.withColumn("later", F.coalesce(F.sum("n").over(later), F.lit(0))).filter(F.col("later") < limit)
    return (
        in_window.filter(F.col("event_time") >= needed.agg(F.min("hour")).scalar())
        .orderBy(F.col("event_time").desc(), "warehouse_id", "event_type", "cluster_count")
        .limit(limit)
    )


def warehouse_issues(merged: DataFrame) -> DataFrame:
    """Configuration findings per warehouse."""
    cost, auto_stop = F.col("total_cost"), F.col("auto_stop_minutes")
    size, kind = F.upper("warehouse_size"), F.upper("warehouse_type")

    def finding(type_, when, severity, text, share, metric):
        return issue(
            "warehouse", type_, when, F.col("warehouse_id"),
            F.coalesce(F.nullif("warehouse_name", F.lit("")), "warehouse_id"), F.lit(None),
            severity, text, cost, settled(cost * share), metric,
        )

    return raise_issues(
        merged,
        [
            finding(
                "no_auto_stop",
                auto_stop == 0,
                "high",
                F.lit("Stays up until somebody stops it"),
                NO_AUTO_STOP_SHARE,
                auto_stop,
            ),
            finding(
                "long_auto_stop",
                auto_stop > LONG_AUTO_STOP_MINUTES,
                "medium",
                F.format_string("Waits %d idle minutes before it stops", auto_stop),
                LONG_AUTO_STOP_SHARE,
                auto_stop,
            ),
            finding(
                "oversized",
                (cost > 0) & size.isin(*LARGE_SIZES),
                "medium",
                F.concat(F.lit("Size "), size, F.lit(" may exceed the need")),
                OVERSIZED_SHARE,
                F.lit(None),
            ),
            finding(
                "serverless_candidate",
                kind.contains("CLASSIC") & ~kind.contains("SERVERLESS") & (cost > CLASSIC_MIN_COST),
                "low",
                F.lit("Classic type with notable cost"),
                SERVERLESS_SHARE,
                F.lit(None),
            ),
        ],
    ).drop("issue_order")


def running_now(events: DataFrame) -> DataFrame:
    """RUNNING events that no later event of the warehouse follows; ties all stay.

    The comparison is with one row per warehouse, not with every other event.
    """
    newest = events.groupBy(F.col("warehouse_id").alias("w")).agg(F.max("event_time").alias("newest"))
    return events.filter(F.col("event_type") == "RUNNING").join(
        newest,
        (F.col("warehouse_id") == F.col("w")) & (F.col("newest") > F.col("event_time")),
        "left_anti",
    )


def scaled_up_now(events: DataFrame) -> DataFrame:
    """SCALED_UP events with no later stop, scale-down or smaller scale-up.

    Events are first reduced to the newest time per warehouse, kind and cluster count;
    what ends a scale-up to ``n`` clusters is then a running maximum over the counts
    below ``n``.
    """
    ends = F.col("event_type").isin("SCALED_DOWN", "STOPPED")
    per_count = (
        events.filter(ends | (F.col("event_type") == "SCALED_UP"))
        .groupBy("warehouse_id", F.when(~ends, F.col("cluster_count")).alias("count"), ends.alias("ends"))
        .agg(F.max("event_time").alias("newest"))
    )
    warehouse = Window.partitionBy("warehouse_id")
    smaller = warehouse.orderBy("count").rowsBetween(Window.unboundedPreceding, -1)
    scale_time = F.when(~F.col("ends"), F.col("newest"))
    blockers = (
        per_count.withColumn("ended", F.max(F.when(F.col("ends"), F.col("newest"))).over(warehouse))
        .withColumn("shrunk", F.max(F.when(F.col("count").isNotNull(), scale_time)).over(smaller))
        .filter(~F.col("ends") & F.col("count").isNotNull())
        .select(
            F.col("warehouse_id").alias("w"),
            F.col("count").alias("n"),
            F.greatest("ended", "shrunk").alias("blocked"),
        )
    )
    return events.filter(
        (F.col("event_type") == "SCALED_UP") & (F.col("cluster_count") >= UPSCALED_MIN_CLUSTERS)
    ).join(
        blockers,
        (F.col("warehouse_id") == F.col("w"))
        & (F.col("cluster_count") == F.col("n"))
        & (F.col("blocked") > F.col("event_time")),
        "left_anti",
    )


def with_config(events: DataFrame, configs: DataFrame) -> DataFrame:
    """Events with the name and size of their warehouse, where known."""
    return events.join(
        configs.select("warehouse_id", "warehouse_name", "warehouse_size", "max_clusters"),
        "warehouse_id",
        "left",
    )


def _clusters(name: str):
    """A cluster count; none and zero mean one."""
    return F.when(F.coalesce(name, F.lit(0)) == 0, F.lit(1)).otherwise(F.col(name)).cast("bigint")


def _name():
    return F.coalesce(F.nullif("warehouse_name", F.lit("")), F.lit("Unknown")).alias("warehouse_name")


def long_running(events: DataFrame, configs: DataFrame, as_of: datetime) -> DataFrame:
    hours = hours_running(F.col("event_time"), as_of)
    return (
        with_config(running_now(events), configs)
        .filter(hours > LONG_RUNNING_HOURS)
        .select(
            "warehouse_id",
            _name(),
            "warehouse_size",
            rounded(hours.cast("double"), 2).alias("running_hours"),
            _clusters("cluster_count").alias("cluster_count"),
            "event_time",
        )
    )


def upscaled(events: DataFrame, configs: DataFrame, as_of: datetime) -> DataFrame:
    hours = hours_running(F.col("event_time"), as_of)
    return (
        with_config(scaled_up_now(events), configs)
        .filter(hours > UPSCALED_HOURS)
        .select(
            "warehouse_id",
            _name(),
            "warehouse_size",
            _clusters("max_clusters").alias("max_clusters"),
            _clusters("cluster_count").alias("current_clusters"),
            rounded(hours.cast("double"), 2).alias("upscaled_hours"),
            "event_time",
        )
    )


def query_activity(history: DataFrame, as_of: datetime) -> DataFrame:
    """Queries per warehouse since the start of the day before ``as_of``."""
    yesterday = datetime.combine(as_of.date(), datetime.min.time()) - timedelta(days=1)
    return (
        history.filter(since(F.col("start_time"), yesterday))
        .groupBy(F.col("compute.warehouse_id").alias("warehouse_id"))
        .agg(F.count("*").alias("query_count"), F.max("end_time").alias("last_query_time"))
    )


def running_without_queries(running: DataFrame, activity: DataFrame, as_of: datetime) -> DataFrame:
    """Running warehouses without recent queries; ``running`` keeps its columns."""
    quiet_hours = whole_units("HOUR", F.col("last_query_time"), moment(as_of))
    return running.join(activity, "warehouse_id", "left").filter(
        (F.coalesce("query_count", F.lit(0)) == 0) | (quiet_hours > IDLE_QUERY_HOURS)
    )


def idle(events: DataFrame, configs: DataFrame, history: DataFrame, as_of: datetime) -> DataFrame:
    minutes = whole_units("MINUTE", F.col("event_time"), moment(as_of))
    running = (
        with_config(running_now(events), configs)
        .filter(minutes > IDLE_RUNNING_MINUTES)
        .select("warehouse_id", "warehouse_name", "warehouse_size", "event_time")
        .distinct()
    )
    hours = hours_running(F.col("event_time"), as_of)
    return running_without_queries(running, query_activity(history, as_of), as_of).select(
        "warehouse_id",
        _name(),
        "warehouse_size",
        rounded(hours.cast("double"), 2).alias("running_hours"),
        F.coalesce("query_count", F.lit(0)).alias("recent_query_count"),
        "last_query_time",
    )
