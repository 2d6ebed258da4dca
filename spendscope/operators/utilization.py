"""Rightsizing, idle, imbalance and autoscaling findings from node metrics."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import (
    availability,
    day_of,
    hour_of,
    is_classic,
    rounded,
    settled,
    since,
    total,
    total_if,
    uses_spot,
    worker_span,
)
from ..functions.percentiles import exact_percentiles, sketch
from ..functions.ranking import with_place
from ..session import cut_lineage
from ..sources.registry import AnalysisWindow
from .pricing import usage_in_period
from .versions import latest_clusters, latest_version


# ---- fixed values -------------------------------------------------------------
@dataclass(frozen=True)
class Thresholds:
    """Limits of the classification; shares are 0 to 1, ``*_pct`` are percent."""

    cpu_p90_high: float = 0.85
    mem_p95_high: float = 0.95
    hot_time_frac_hi: float = 0.20
    cpu_p50_low: float = 0.40
    mem_p50_low: float = 0.70
    hot_time_frac_lo: float = 0.05
    cpu_hot_pct: float = 80.0
    cpu_very_hot_pct: float = 90.0
    mem_hot_pct: float = 90.0
    mem_very_hot_pct: float = 95.0
    io_wait_p90_moderate: float = 0.15
    io_wait_p90_severe: float = 0.25
    io_wait_time_threshold: float = 0.20
    mem_stddev_moderate: float = 0.15
    mem_stddev_high: float = 0.25
    mem_volatility_moderate: float = 0.35
    mem_volatility_high: float = 0.50
    swap_max_threshold: float = 0.01
    swap_time_threshold: float = 0.05


TARGET_MIN_DBUS = 10
MIN_SAMPLES = 10
IO_WAIT_PCT = 20
PERCENTILES = {
    "cpu": (0.25, 0.50, 0.75, 0.90, 0.99),
    "mem": (0.25, 0.50, 0.75, 0.90, 0.95, 0.99),
    "io_wait": (0.50, 0.90),
}
UNDER, OVER, RIGHT = "under-provisioned", "over-provisioned", "right-sized"

ACTIONS = {
    "both_hot": "Increase memory first; reassess CPU",
    "mem_hot": "Increase memory or reduce concurrency",
    "cpu_hot": "Increase CPU (cores) or improve parallelism",
    "both_cold": "Consider downsizing (both CPU & memory)",
    "mem_cold": "Consider reducing memory (smaller node type)",
    "cpu_cold": "Consider reducing CPU (fewer/smaller nodes)",
    "keep": "Keep current configuration",
}
SWAP_PREFIX = "CRITICAL: Memory swapping detected! "
IO_SUFFIX = {
    "severe_io_bottleneck": " | SEVERE I/O BOTTLENECK: Consider storage-optimized instances, Photon acceleration, or optimize shuffle operations",
    "moderate_io_bottleneck": " | I/O bottleneck detected: Consider enabling elastic disk or storage-optimized node types",
}
SPIKE_SUFFIX = {
    "high": " | HIGH MEMORY VOLATILITY: Add 20-30% headroom to prevent OOM. Investigate memory leaks",
    "moderate": " | Moderate memory volatility: Add 10-15% headroom for safety",
}
ON_SPOT_SUFFIX = " (NOTE: Already using spot/preemptible - cost already optimized)"
TRY_SPOT_SUFFIX = " OR consider switching to spot/preemptible instances"

DOWNSIZE_SHARE = 0.25
IDLE_MIN_SAMPLES = 60
IDLE_CPU_PCT = 5
IDLE_TIME_SHARE = 0.5
IDLE_AVG_CPU_PCT = 10
IDLE_WASTE_SHARE = 0.8
SCALING_MIN_HOURS = 10
SCALING_WASTE_SHARE = 0.15
# -------------------------------------------------------------------------------


def cluster_usage(usage: DataFrame, window: AnalysisWindow) -> DataFrame:
    """DBUs per cluster, job and compute type over the days of the node metrics."""
    lines = usage_in_period(usage, window.metrics_window()).filter(F.col("cluster_id").isNotNull())
    return lines.groupBy("cluster_id", "job_id", is_classic(F.col("is_serverless")).alias("classic")).agg(
        total("usage_quantity").alias("dbus")
    )


def target_clusters(per_cluster: DataFrame, top_n: int | None = None) -> DataFrame:
    """Clusters that do not run serverless, or the ``top_n`` costliest of them by DBU."""
    found = (
        per_cluster.filter("classic")
        .groupBy("cluster_id")
        .agg(total("dbus").alias("dbus"), F.min("job_id").alias("job_id"))
        .filter(F.col("dbus") > TARGET_MIN_DBUS)
        .select("cluster_id", rounded(F.col("dbus"), 3).alias("total_dbus"), "job_id")
    )
    if top_n is None:
        return found
    return found.orderBy(F.col("total_dbus").desc(), "cluster_id").limit(top_n)


def cluster_dbus(per_cluster: DataFrame) -> DataFrame:
    return per_cluster.groupBy("cluster_id").agg(total("dbus").alias("total_dbus"))


def node_samples(node_timeline: DataFrame, targets: DataFrame, window: AnalysisWindow) -> DataFrame:
    """Node metrics of the target clusters; missing readings count as zero."""
    reading = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    return (
        node_timeline.filter(since(F.col("start_time"), window.metrics_start))
        .join(targets.select("cluster_id"), "cluster_id", "left_semi")
        .select(
            "cluster_id",
            F.when(F.col("driver"), "driver").otherwise("worker").alias("component"),
            (reading("cpu_system_percent") + reading("cpu_user_percent") + reading("cpu_wait_percent")).alias("cpu"),
            reading("cpu_wait_percent").alias("io_wait"),
            reading("mem_used_percent").alias("mem"),
            reading("mem_swap_percent").alias("swap"),
        )
    )


def utilization_profile(samples: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Percentiles, spread and time above limits per cluster and component.

    Reads the samples twice: once into the moments and a sketch per metric, which is stored with
    one row per component, and once for the values near the wanted ranks.
    """
    keys = ["cluster_id", "component"]

    def time_share(condition: Column) -> Column:
        return rounded(F.count_if(condition) / F.count("*"), 4)

    cpu, mem = F.col("cpu"), F.col("mem")
    moments = {
        "sample_count": F.count("*"),
        "mem_max": rounded(F.max("mem") / 100, 4),
        # Variances of parts are merged, not taken from sums of squares.
        "mem_stddev": rounded(F.stddev_samp("mem") / 100, 4),
        "io_wait_time_above_20pct": time_share(F.col("io_wait") >= IO_WAIT_PCT),
        "swap_max": rounded(F.max("swap") / 100, 4),
        "swap_time_fraction": time_share(F.col("swap") > 0),
        "cpu_time_above_80pct": time_share(cpu >= limits.cpu_hot_pct),
        "cpu_time_above_90pct": time_share(cpu >= limits.cpu_very_hot_pct),
        "mem_time_above_90pct": time_share(mem >= limits.mem_hot_pct),
        "mem_time_above_95pct": time_share(mem >= limits.mem_very_hot_pct),
    }
    profiled = cut_lineage(
        samples.groupBy(*keys)
        .agg(*[m.alias(name) for name, m in moments.items()], *map(sketch, PERCENTILES))
        .filter(F.col("sample_count") >= MIN_SAMPLES)
        .withColumn("n", F.col("sample_count"))
    )
    percentiles = exact_percentiles(samples, profiled, keys, PERCENTILES)
    scaled = [
        rounded(F.col(f"{m}_p{round(p * 100)}") / 100, 4).alias(f"{m}_p{round(p * 100)}")
        for m, points in PERCENTILES.items()
        for p in points
    ]
    return profiled.select(*keys, *moments).join(percentiles, keys).select(*keys, *moments, *scaled)


def cluster_metrics(
    node_timeline: DataFrame,
    targets: DataFrame,
    clusters: DataFrame,
    window: AnalysisWindow,
    limits: Thresholds = Thresholds(),
) -> DataFrame:
    """Profile of the target clusters with their configuration, ranked by DBU.

    The profile has a row or two per target; only versions of these clusters are compared. Targets
    and profile are stored: each is read several times.
    """
    keys = ["cluster_id", "component"]
    targets = cut_lineage(targets)
    profile = cut_lineage(utilization_profile(node_samples(node_timeline, targets, window), limits))
    known = clusters.join(profile, "cluster_id")
    capacity = latest_version(known, keys, "change_time", [F.col("cluster_name"), F.col("owned_by")])
    ranked = (
        capacity.join(targets, "cluster_id")
        .select(
            *profile.columns,
            F.coalesce("cluster_name", F.lit("Unknown")).alias("cluster_name"),
            "total_dbus",
            "job_id",
            F.when(F.col("component") == "driver", F.col("driver_node_type"))
            .otherwise(F.col("worker_node_type"))
            .alias("node_type"),
            "min_autoscale_workers",
            "max_autoscale_workers",
            "cluster_source",
            availability().alias("availability"),
            uses_spot().alias("uses_spot"),
        )
    )
    return with_place(ranked, "metric_rank", "total_dbus", *keys)


def cpu_flags(limits: Thresholds) -> tuple[Column, Column]:
    hot = (F.col("cpu_p90") >= limits.cpu_p90_high) | (F.col("cpu_time_above_80pct") >= limits.hot_time_frac_hi)
    cold = (F.col("cpu_p50") <= limits.cpu_p50_low) & (F.col("cpu_time_above_80pct") < limits.hot_time_frac_lo)
    return hot, cold


def mem_flags(limits: Thresholds) -> tuple[Column, Column]:
    hot = (F.col("mem_p95") >= limits.mem_p95_high) | (F.col("mem_time_above_90pct") >= limits.hot_time_frac_hi)
    cold = (F.col("mem_p50") <= limits.mem_p50_low) & (F.col("mem_time_above_90pct") < limits.hot_time_frac_lo)
    return hot, cold


def _status(hot: Column, cold: Column) -> Column:
    return F.when(hot, UNDER).when(cold, OVER).otherwise(RIGHT)


def io_issue(limits: Thresholds) -> Column:
    bound = (F.col("io_wait_p90") >= limits.io_wait_p90_moderate) | (
        F.col("io_wait_time_above_20pct") >= limits.io_wait_time_threshold
    )
    severe = F.col("io_wait_p90") >= limits.io_wait_p90_severe
    return F.when(bound & severe, "severe_io_bottleneck").when(bound, "moderate_io_bottleneck")


def spike_risk(limits: Thresholds) -> Column:
    gap = F.col("mem_p99") - F.col("mem_p50")
    high = (F.col("mem_stddev") >= limits.mem_stddev_high) | (gap >= limits.mem_volatility_high)
    moderate = (F.col("mem_stddev") >= limits.mem_stddev_moderate) | (gap >= limits.mem_volatility_moderate)
    return F.when(moderate & high, "high").when(moderate, "moderate").otherwise("none")


def swap_issue(limits: Thresholds) -> Column:
    return (F.col("swap_max") >= limits.swap_max_threshold) | (
        F.col("swap_time_fraction") >= limits.swap_time_threshold
    )


def _choice(col: Column, texts: Mapping[str, str]) -> Column:
    text = F.lit("")
    for value, suffix in texts.items():
        text = F.when(col == value, suffix).otherwise(text)
    return text


def suggested_action(limits: Thresholds) -> Column:
    (cpu_hot, cpu_cold), (mem_hot, mem_cold) = cpu_flags(limits), mem_flags(limits)
    main = (
        F.when(mem_hot & cpu_hot, ACTIONS["both_hot"])
        .when(mem_hot, ACTIONS["mem_hot"])
        .when(cpu_hot, ACTIONS["cpu_hot"])
        .when(mem_cold & cpu_cold, ACTIONS["both_cold"])
        .when(mem_cold, ACTIONS["mem_cold"])
        .when(cpu_cold, ACTIONS["cpu_cold"])
        .otherwise(ACTIONS["keep"])
    )
    cold = mem_cold | cpu_cold
    return F.concat(
        F.when(swap_issue(limits), SWAP_PREFIX).otherwise(""),
        main,
        _choice(F.coalesce(io_issue(limits), F.lit("")), IO_SUFFIX),
        _choice(spike_risk(limits), SPIKE_SUFFIX),
        F.when(cold & F.col("uses_spot"), ON_SPOT_SUFFIX).when(cold, TRY_SPOT_SUFFIX).otherwise(""),
    )


def classify(metrics: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Add status, bottleneck and action columns to the cluster metrics."""
    (cpu_hot, cpu_cold), (mem_hot, mem_cold) = cpu_flags(limits), mem_flags(limits)
    return metrics.select(
        "*",
        rounded(F.col("mem_p99") - F.col("mem_p50"), 3).alias("mem_volatility"),
        _status(cpu_hot, cpu_cold).alias("cpu_status"),
        _status(mem_hot, mem_cold).alias("mem_status"),
        _status(mem_hot | cpu_hot, mem_cold | cpu_cold).alias("overall_status"),
        io_issue(limits).isNotNull().alias("io_bound"),
        io_issue(limits).alias("io_issue"),
        spike_risk(limits).alias("mem_spike_risk"),
        swap_issue(limits).alias("swap_issue"),
        rounded(1 - F.col("cpu_p50"), 3).alias("cpu_headroom_p50"),
        rounded(1 - F.col("mem_p95"), 3).alias("mem_headroom_p95"),
        suggested_action(limits).alias("suggested_action"),
    )


def cluster_status(classified: DataFrame) -> DataFrame:
    """One status per cluster: that of the workers, or the driver's where there are none."""
    worker = F.col("component") == "worker"
    return classified.groupBy("cluster_id").agg(
        F.max("cluster_name").alias("cluster_name"),
        F.max("total_dbus").alias("total_dbus"),
        F.max_by("overall_status", "component").alias("overall_status"),
        F.max_by("suggested_action", "component").alias("suggested_action"),
        F.bool_or(worker & F.col("io_bound")).alias("workers_io_bound"),
        F.bool_or(worker & (F.col("mem_spike_risk") == "high")).alias("workers_spike"),
        F.bool_or(worker & F.col("swap_issue")).alias("workers_swap"),
    )


def utilization_summary(statuses: DataFrame) -> DataFrame:
    """One row of counts and DBUs by status."""
    status = F.col("overall_status")
    return statuses.agg(
        F.count("*").alias("total_clusters_analyzed"),
        F.count_if(status == OVER).alias("over_provisioned_count"),
        F.count_if(status == UNDER).alias("under_provisioned_count"),
        F.count_if(status == RIGHT).alias("right_sized_count"),
        rounded(total_if(status == OVER, "total_dbus"), 2).alias("over_provisioned_dbus"),
        rounded(total_if(status == UNDER, "total_dbus"), 2).alias("under_provisioned_dbus"),
        rounded(total_if(status == OVER, "total_dbus") * DOWNSIZE_SHARE, 2).alias("potential_savings_dbus"),
        F.count_if("workers_io_bound").alias("io_bound_clusters"),
        F.count_if("workers_spike").alias("high_memory_spike_clusters"),
        F.count_if("workers_swap").alias("swap_issue_clusters"),
    )


def driver_worker_pairs(metrics: DataFrame) -> DataFrame:
    """Driver and worker load side by side, for clusters that have both."""
    of = lambda part, c: F.max(F.when(F.col("component") == part, F.col(c)))
    return (
        metrics.groupBy("cluster_id")
        .agg(
            F.max("cluster_name").alias("cluster_name"),
            F.max("total_dbus").alias("total_dbus"),
            of("driver", "cpu_p90").alias("driver_cpu"),
            of("worker", "cpu_p90").alias("worker_cpu"),
            of("driver", "mem_p95").alias("driver_mem"),
            of("worker", "mem_p95").alias("worker_mem"),
        )
        .filter(F.col("driver_cpu").isNotNull() & F.col("worker_cpu").isNotNull())
    )


def driver_worker_imbalance(metrics: DataFrame) -> DataFrame:
    """Clusters whose driver and workers are loaded very differently."""
    issue = (
        F.when((F.col("driver_cpu") > 0.7) & (F.col("worker_cpu") < 0.3), "driver_cpu_bottleneck")
        .when((F.col("driver_mem") > 0.8) & (F.col("worker_mem") < 0.5), "driver_memory_bottleneck")
        .when((F.col("worker_cpu") > 0.8) & (F.col("driver_cpu") < 0.2), "workers_saturated_driver_idle")
    )
    return (
        driver_worker_pairs(metrics)
        .withColumn("issue", issue)
        .filter(F.col("issue").isNotNull())
        .select(
            "cluster_id",
            "cluster_name",
            "total_dbus",
            "issue",
            rounded(F.col("driver_cpu"), 2).alias("driver_cpu_p90"),
            rounded(F.col("worker_cpu"), 2).alias("worker_cpu_p90"),
            rounded(F.col("driver_mem"), 2).alias("driver_mem_p95"),
            rounded(F.col("worker_mem"), 2).alias("worker_mem_p95"),
        )
    )


def worker_hours(node_timeline: DataFrame, window: AnalysisWindow) -> DataFrame:
    """Workers and their load per cluster and hour."""
    cpu = F.coalesce("cpu_user_percent", F.lit(0.0)) + F.coalesce("cpu_system_percent", F.lit(0.0))
    return (
        node_timeline.filter(since(F.col("start_time"), window.metrics_start) & ~F.col("driver"))
        .groupBy(
            "cluster_id",
            day_of(F.col("start_time")).alias("usage_date"),
            hour_of(F.col("start_time")).alias("usage_hour"),
        )
        .agg(
            F.count_distinct("instance_id").alias("active_workers"),
            F.sum(cpu).alias("cpu_sum"),
            F.max(cpu).alias("cpu_max"),
            F.count_if(cpu < IDLE_CPU_PCT).alias("idle_samples"),
            F.count("*").alias("samples"),
        )
    )


def idle_clusters(
    hours: DataFrame, per_cluster: DataFrame, clusters: DataFrame, limit: int | None = None
) -> DataFrame:
    """Clusters whose workers do next to nothing for most of the time."""
    load = (
        hours.groupBy("cluster_id")
        .agg(
            (F.sum("cpu_sum") / F.sum("samples")).alias("avg_cpu"),
            F.max("cpu_max").alias("max_cpu"),
            (F.sum("idle_samples") / F.sum("samples")).alias("idle_share"),
            F.sum("samples").alias("sample_count"),
        )
        .filter(
            (F.col("sample_count") >= IDLE_MIN_SAMPLES)
            & (F.col("idle_share") > IDLE_TIME_SHARE)
            & (F.col("avg_cpu") < IDLE_AVG_CPU_PCT)
        )
    )
    names = latest_clusters(clusters).select("cluster_id", "cluster_name")
    idle = (
        load.join(cluster_dbus(per_cluster), "cluster_id", "left")
        .join(names, "cluster_id", "left")
    )
    if limit is not None:
        idle = idle.orderBy(F.col("total_dbus").desc_nulls_last(), "cluster_id").limit(limit)
    dbus = F.coalesce("total_dbus", F.lit(0.0))
    return idle.select(
        "cluster_id",
        F.coalesce("cluster_name", "cluster_id").alias("cluster_name"),
        rounded(F.col("avg_cpu"), 2).alias("avg_cpu_percent"),
        rounded(F.col("max_cpu"), 2).alias("max_cpu_percent"),
        rounded(F.col("idle_share") * 100, 1).alias("pct_time_idle"),
        dbus.alias("total_dbus"),
        "sample_count",
        settled(dbus * IDLE_WASTE_SHARE).alias("wasted_dbus_estimate"),
    )


def autoscaling_clusters(clusters: DataFrame) -> DataFrame:
    """Clusters whose latest configuration leaves room to scale."""
    return (
        latest_clusters(clusters)
        .filter(F.col("max_autoscale_workers") > F.col("min_autoscale_workers"))
        .select("cluster_id", "cluster_name", "min_autoscale_workers", "max_autoscale_workers")
    )


def autoscale_stats(
    hours: DataFrame, per_cluster: DataFrame, clusters: DataFrame, limit: int | None = None
) -> DataFrame:
    """Observed against configured workers of the autoscaling clusters.

    Hours are summed up per cluster before the configuration joins.
    """
    observed = (
        hours.groupBy("cluster_id")
        .agg(
            F.avg("active_workers").alias("avg_workers"),
            F.min("active_workers").alias("min_observed_workers"),
            F.max("active_workers").alias("max_observed_workers"),
            F.stddev("active_workers").alias("worker_stddev"),
            F.count("*").alias("sample_hours"),
        )
        .filter(F.col("sample_hours") >= SCALING_MIN_HOURS)
    )
    stats = (
        observed.join(autoscaling_clusters(clusters), "cluster_id")
        .join(cluster_dbus(per_cluster), "cluster_id", "left")
    )
    if limit is not None:
        stats = stats.orderBy(F.col("total_dbus").desc_nulls_last(), "cluster_id").limit(limit)
    used = (F.col("avg_workers") - F.col("min_autoscale_workers")) / worker_span() * 100
    return stats.select(
        "cluster_id",
        "cluster_name",
        "min_autoscale_workers",
        "max_autoscale_workers",
        settled(F.col("avg_workers")).alias("avg_workers"),
        "min_observed_workers",
        "max_observed_workers",
        settled(F.col("worker_stddev")).alias("worker_stddev"),
        "sample_hours",
        F.coalesce("total_dbus", F.lit(0.0)).alias("total_dbus"),
        rounded(used, 1).alias("scale_utilization_pct"),
    )


def autoscale_verdicts(stats: DataFrame) -> DataFrame:
    """Whether each autoscaling cluster really scales."""
    low, high = F.col("min_autoscale_workers"), F.col("max_autoscale_workers")
    never_down = (F.col("min_observed_workers") >= high * 0.9) | (F.col("avg_workers") >= high * 0.95)
    never_up = (F.col("max_observed_workers") <= low * 1.1) & (high > low * 1.5)
    steady = (F.coalesce("worker_stddev", F.lit(0.0)) < 0.5) & (high > low + 2)
    verdict = (
        F.when(never_down, "never_scales_down")
        .when(never_up, "never_scales_up")
        .when(steady, "low_variance")
        .otherwise("healthy")
    )
    waste = F.when(F.col("verdict") == "never_scales_down", F.col("total_dbus") * SCALING_WASTE_SHARE)
    return stats.withColumn("verdict", verdict).withColumn("wasted_dbus_estimate", settled(waste))


def utilization_coverage(targets: DataFrame, metrics: DataFrame) -> DataFrame:
    """Target clusters and whether node metrics exist for them."""
    sampled = metrics.groupBy("cluster_id").agg(F.sum("sample_count").alias("sample_count"))
    return targets.join(sampled, "cluster_id", "left").select(
        "cluster_id",
        "total_dbus",
        F.coalesce("sample_count", F.lit(0)).alias("sample_count"),
        F.col("sample_count").isNotNull().alias("available"),
    )
