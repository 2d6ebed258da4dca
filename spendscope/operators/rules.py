"""Savings rules: each builds recommendation rows from analysis results."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import (
    DEFAULT_DBU_PRICE,
    is_starter,
    ratio,
    rounded,
    row_id,
    total,
    total_if,
)
from .utilization import OVER

# ---- fixed values -------------------------------------------------------------
CONFIDENCE = 0.75
MIN_SAVINGS = 1.0
SEVERITY_ORDER = {"high": 0, "medium": 1, "low": 2}
# Dollars per cluster hour by warehouse size.
HOURLY_RATES = {"SMALL": 2, "MEDIUM": 4, "LARGE": 8, "X-LARGE": 16, "2X-LARGE": 32}
DEFAULT_HOURLY_RATE = 4
LARGE_SIZES = ("2X-LARGE", "3X-LARGE", "4X-LARGE")
# Rules in the order in which the first of several equal ids wins:
# rule, category, effort, advice.
RULES = (
    ("auto_term", "cluster", "2 minutes", "Set an idle limit of 30 to 60 minutes."),
    ("wh_auto_stop", "warehouse", "1 minute", "Let it stop after 10 to 15 idle minutes."),
    ("wh_reduce_stop", "warehouse", "1 minute", "Shorten the idle limit to 10 to 15 minutes."),
    ("wh_size", "warehouse", "5 minutes to test", "Try one size less and compare query times."),
    ("wh_min_clusters", "warehouse", "1 minute", "Start from one cluster and let load add more."),
    ("wh_long_run", "warehouse", "1 minute to stop", "Stop it if nobody queries it."),
    ("wh_upscaled", "warehouse", "5 minutes to review settings", "Look for queueing; lower the maximum if there is none."),
    ("wh_idle", "warehouse", "30 seconds to stop", "Stop it, then check its idle limit."),
    ("all_purpose_to_jobs", "compute", "15 minutes per workload", "Move scheduled work to job compute."),
    ("evaluate_photon", "compute", "30 minutes to benchmark", "Time the same queries with and without acceleration."),
    ("serverless_job", "jobs", "2 minutes to switch", "Run it once on serverless and compare the cost."),
    ("autoscale", "cluster", "2 minutes", "Use a worker range instead of a fixed number."),
    ("rightsize", "cluster", "10 minutes to analyze", "Check how many workers are busy at peak."),
    ("rightsize_overprovisioned", "cluster", "1-2 hours per cluster to analyze and adjust", "Take fewer or smaller nodes, costliest clusters first."),
    ("rightsize_underprovisioned", "cluster", "1-2 hours per cluster to analyze and adjust", "Add memory or nodes where the pressure is."),
    ("rightsize_cluster", "cluster", "30 minutes to implement, 1 week to validate", "Cut the workers by a quarter and watch the peaks."),
    ("idle_clusters", "cluster", "15 minutes to review and terminate", "Terminate what nobody needs."),
    ("autoscale_never_down", "cluster", "30 minutes per cluster to analyze and adjust", "Fix the size, or find out what keeps the workers."),
    ("autoscale_never_up", "cluster", "15 minutes per cluster to review", "Lower the maximum to what is used."),
    ("driver_cpu_bottleneck", "cluster", "2-4 hours to refactor code patterns", "Move work from the driver to the workers."),
    ("driver_memory_bottleneck", "cluster", "1-3 hours to identify and fix collect patterns", "Write results out instead of collecting them."),
    ("model_scale_to_zero", "ml", "2 minutes per endpoint", "Let endpoints without requests shut down."),
    ("job_failures", "jobs", "Varies - depends on root cause", "Find the cause in the run logs; add retries."),
    ("job_startup", "jobs", "15-30 minutes", "Batch short runs, or keep capacity ready."),
    ("weekend_waste", "governance", "30 minutes to audit, ongoing discipline", "Shut non-production work down over weekends."),
    ("use_spot_instances", "compute", "2 minutes per job", "Use spot workers where a run can be retried."),
    ("cluster_pools_startup", "cluster", "15 minutes to set up", "Keep a few instances in a pool for these jobs."),
    ("use_cluster_pools", "cluster", "15 minutes to set up", "A pool shortens the start of frequently used clusters."),
    ("job_freq", "jobs", "5 minutes to evaluate", "Run less often, or only when data arrives."),
    ("implement_tagging", "governance", "1-2 hours to implement policy, ongoing enforcement", "Require team, project and environment tags."),
    ("delta_optimization", "data", "15 min per table to analyze and optimize", "Cluster the most queried tables by their filters."),
    ("disk_spill", "warehouse", "2 minutes to change size, test queries", "Take the next size, or make the queries lighter."),
    ("shuffle_heavy_queries", "sql", "1-4 hours per query to optimize", "Filter and pre-aggregate before joining."),
    ("sql_partitioning", "sql", "30-60 minutes per table", "Partition large tables by a common filter."),
    ("cost_monitoring", "governance", "10 minutes", "Set a budget with alerts."),
)
# -------------------------------------------------------------------------------

FIELDS = (
    "id", "rule", "title", "severity", "category", "resource_id", "contact", "description",
    "advice", "estimated_savings", "effort",
)
_RULE = {rule: (i, category, effort, advice) for i, (rule, category, effort, advice) in enumerate(RULES)}


def recommend(
    df: DataFrame,
    rule: str,
    *,
    title: Column,
    severity: Column | str,
    savings: Column,
    description: Column,
    id: Column | None = None,
    resource_id: Column | None = None,
    contact: Column | None = None,
    seq: Column | None = None,
) -> DataFrame:
    """Recommendation rows of one rule; ``seq`` orders rows within it."""
    order, category, effort, advice = _RULE[rule]
    text = lambda c: F.lit(c) if isinstance(c, str) else c
    nothing = F.lit(None).cast("string")
    return df.select(
        (F.lit(rule) if id is None else id).alias("id"),
        F.lit(rule).alias("rule"),
        title.alias("title"),
        text(severity).alias("severity"),
        F.lit(category).alias("category"),
        (nothing if resource_id is None else resource_id.cast("string")).alias("resource_id"),
        (nothing if contact is None else contact).alias("contact"),
        description.alias("description"),
        F.lit(advice).alias("advice"),
        savings.cast("double").alias("estimated_savings"),
        F.lit(effort).alias("effort"),
        F.lit(order).alias("rule_order"),
        (F.lit(0.0) if seq is None else seq.cast("double")).alias("seq"),
    )


_confidence: ContextVar[float] = ContextVar("confidence", default=CONFIDENCE)


@contextmanager
def confidence_factor(factor: float) -> Iterator[None]:
    """Rules that are built inside count this part of their estimated savings."""
    token = _confidence.set(factor)
    try:
        yield
    finally:
        _confidence.reset(token)


def confident(savings: Column) -> Column:
    return rounded(savings * _confidence.get(), 2)


def product_cost(rollup: DataFrame, *products: str) -> DataFrame:
    """One row: cost, serverless and classic cost of some products, and of all."""
    every = F.col("dim") == "product"
    chosen = every & F.col("key").isin(*products)
    return rollup.agg(
        total_if(chosen, "cost").alias("cost"),
        total_if(chosen, "serverless_cost").alias("serverless_cost"),
        total_if(chosen, "classic_cost").alias("classic_cost"),
        total_if(every, "cost").alias("total_cost"),
    )


def average_dbu_price(totals: DataFrame) -> DataFrame:
    """One row: dollars per DBU."""
    price = F.col("total_cost") / F.col("total_dbus")
    return totals.select(
        F.when(F.col("total_dbus") > 0, price).otherwise(F.lit(DEFAULT_DBU_PRICE)).alias("dbu_price")
    )


# ---- clusters -----------------------------------------------------------------
def auto_termination(cluster_issues: DataFrame) -> DataFrame:
    return recommend(
        cluster_issues.filter(F.col("type") == "no_autotermination"),
        "auto_term",
        id=row_id("auto_term", F.col("resource_id")),
        resource_id=F.col("resource_id"),
        contact=F.coalesce(F.nullif("owner", F.lit("")), F.lit("Contact cluster owner")),
        title=F.concat(F.lit("Give an idle limit to cluster "), _label("resource_name", "resource_id")),
        severity="high",
        savings=confident(F.col("cost") * 0.4),
        description=F.format_string("Cost %.2f in the period and never ends by itself.", F.col("cost")),
        seq=-F.col("cost"),
    )


def cluster_sizing(cluster_issues: DataFrame) -> DataFrame:
    fixed = recommend(
        cluster_issues.filter(F.col("type") == "no_autoscaling"),
        "autoscale",
        id=row_id("autoscale", F.col("resource_id")),
        resource_id=F.col("resource_id"),
        title=F.concat(F.lit("Let cluster "), _label("resource_name", "resource_id"), F.lit(" scale")),
        severity="medium",
        savings=confident(F.col("cost") * 0.25),
        description=F.format_string("Always pays for %.0f workers.", F.col("metric")),
        seq=-F.col("cost"),
    )
    large = recommend(
        cluster_issues.filter(F.col("type") == "oversized"),
        "rightsize",
        id=row_id("rightsize", F.col("resource_id")),
        resource_id=F.col("resource_id"),
        title=F.concat(F.lit("Review the size of cluster "), _label("resource_name", "resource_id")),
        severity=F.when(F.col("metric") >= 20, "high").otherwise("medium"),
        savings=confident(F.col("cost") * 0.4),
        description=F.format_string("Configured for up to %.0f workers.", F.col("metric")),
        seq=-F.col("cost"),
    )
    return fixed.unionByName(large)


def cluster_rightsizing(summary: DataFrame, classified: DataFrame, totals: DataFrame) -> DataFrame:
    price = average_dbu_price(totals).scalar()
    over = recommend(
        summary.filter((F.col("over_provisioned_count") > 0) & (F.col("potential_savings_dbus") > 10)),
        "rightsize_overprovisioned",
        title=F.format_string("Shrink %d clusters with spare capacity", "over_provisioned_count"),
        severity="high",
        savings=confident(F.col("potential_savings_dbus") * price),
        description=F.format_string("They used %.0f DBUs at low load.", "over_provisioned_dbus"),
    )
    under = recommend(
        summary.filter(F.col("under_provisioned_count") > 0),
        "rightsize_underprovisioned",
        title=F.format_string("Enlarge %d clusters under pressure", "under_provisioned_count"),
        severity="medium",
        savings=F.lit(0.0),
        description=F.format_string("They used %.0f DBUs at high load.", "under_provisioned_dbus"),
    )
    spare = classified.filter(
        (F.col("overall_status") == OVER)
        & (F.col("component") == "worker")
        & (F.col("total_dbus") > 50)
        & (F.col("cpu_headroom_p50") > 0.5)
    )
    single = recommend(
        spare,
        "rightsize_cluster",
        id=row_id("rightsize", F.col("cluster_id")),
        resource_id=F.col("cluster_id"),
        title=F.concat(F.lit("Shrink cluster "), F.col("cluster_name")),
        severity="medium",
        savings=confident(F.col("total_dbus") * 0.25 * price),
        description=F.format_string("Median CPU share %.2f, memory share %.2f.", "cpu_p50", "mem_p50"),
        seq=F.col("metric_rank"),
    )
    return over.unionByName(under).unionByName(single)


def idle_cluster_waste(idle: DataFrame, totals: DataFrame) -> DataFrame:
    waste = idle.agg(F.count("*").alias("n"), total("wasted_dbus_estimate").alias("dbus")).withColumn(
        "cost", F.col("dbus") * average_dbu_price(totals).scalar()
    )
    return recommend(
        waste.filter(F.col("cost") > 5),
        "idle_clusters",
        title=F.format_string("Terminate %d idle clusters", "n"),
        severity="high",
        savings=confident(F.col("cost")),
        description=F.format_string("About %.0f DBUs went to waiting workers.", "dbus"),
    )


def autoscale_findings(verdicts: DataFrame, totals: DataFrame) -> DataFrame:
    price = average_dbu_price(totals).scalar()
    down = F.col("verdict") == "never_scales_down"
    sums = verdicts.agg(
        F.count_if(down).alias("down"),
        total_if(down, "wasted_dbus_estimate").alias("wasted"),
        F.count_if(F.col("verdict") == "never_scales_up").alias("up"),
    ).withColumn("cost", F.col("wasted") * price)
    never_down = recommend(
        sums.filter((F.col("down") > 0) & (F.col("cost") > 5)),
        "autoscale_never_down",
        title=F.format_string("Look at %d clusters that stay at their maximum", "down"),
        severity="medium",
        savings=confident(F.col("cost")),
        description=F.format_string("About %.0f DBUs paid for unneeded capacity.", "wasted"),
    )
    never_up = recommend(
        sums.filter(F.col("up") >= 2),
        "autoscale_never_up",
        title=F.format_string("Look at %d clusters that stay at their minimum", "up"),
        severity="low",
        savings=F.lit(0.0),
        description=F.lit("Their worker range is wider than the load needs."),
    )
    return never_down.unionByName(never_up)


def imbalance_findings(imbalance: DataFrame) -> DataFrame:
    of = lambda kind: F.col("issue") == kind
    sums = imbalance.agg(
        F.count_if(of("driver_cpu_bottleneck")).alias("cpu"),
        total_if(of("driver_cpu_bottleneck"), "total_dbus").alias("dbus"),
        F.count_if(of("driver_memory_bottleneck")).alias("mem"),
    )
    cpu = recommend(
        sums.filter(F.col("cpu") > 0),
        "driver_cpu_bottleneck",
        title=F.format_string("Relieve the driver CPU in %d clusters", "cpu"),
        severity="medium",
        savings=rounded(F.col("dbus") * 0.15 * 0.50, 2),
        description=F.lit("The driver is busy while the workers wait."),
    )
    mem = recommend(
        sums.filter(F.col("mem") > 0),
        "driver_memory_bottleneck",
        title=F.format_string("Relieve the driver memory in %d clusters", "mem"),
        severity="high",
        savings=F.lit(0.0),
        description=F.lit("The driver is full while the workers have room."),
    )
    return cpu.unionByName(mem)


def cluster_pools(job_issues: DataFrame, cluster_costs: DataFrame) -> DataFrame:
    """Pools for short runs; a weaker hint for clusters when there are no such jobs."""
    short = job_issues.filter(F.col("type") == "startup_overhead").agg(
        F.count("*").alias("n"), total("cost").alias("cost")
    )
    clusters = cluster_costs.agg(F.count("*").alias("n"), total("total_cost").alias("cost"))
    for_jobs = recommend(
        short.filter(F.col("n") >= 2),
        "cluster_pools_startup",
        title=F.format_string("Use pools for %d short jobs", "n"),
        severity="medium",
        savings=confident(F.col("cost") * 0.3),
        description=F.format_string("They cost %.2f, most of it for starting.", "cost"),
    )
    for_clusters = recommend(
        clusters.filter(
            (F.col("n") >= 2) & (F.col("cost") > 1) & (F.coalesce(short.select("n").scalar(), F.lit(0)) < 2)
        ),
        "use_cluster_pools",
        title=F.lit("Consider pools for faster starts"),
        severity="low",
        savings=confident(F.col("cost") * 0.05),
        description=F.format_string("%d interactive clusters are in use.", "n"),
    )
    return for_jobs.unionByName(for_clusters)


# ---- warehouses ---------------------------------------------------------------
def _label(name: str, fallback: str) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), fallback)


def _paid_warehouses(merged: DataFrame) -> DataFrame:
    """Warehouses with cost, but not the demo one while it is nearly free."""
    cost = F.col("total_cost")
    return merged.filter((cost > 0) & ~(is_starter(F.col("warehouse_name")) & (cost < 1.0))).withColumn(
        "label", _label("warehouse_name", "warehouse_id")
    )


def warehouse_auto_stop(merged: DataFrame) -> DataFrame:
    paid, limit = _paid_warehouses(merged), F.col("auto_stop_minutes")
    never = recommend(
        paid.filter(limit == 0),
        "wh_auto_stop",
        id=row_id("wh_auto_stop", F.col("warehouse_id")),
        resource_id=F.col("warehouse_id"),
        contact=F.lit("Contact SQL warehouse admin"),
        title=F.concat(F.lit("Give an idle limit to warehouse "), F.col("label")),
        severity="high",
        savings=confident(F.col("total_cost") * 0.3),
        description=F.format_string("Cost %.2f and stays up without queries.", "total_cost"),
        seq=-F.col("total_cost"),
    )
    late = recommend(
        paid.filter(limit > 60),
        "wh_reduce_stop",
        id=row_id("wh_reduce_stop", F.col("warehouse_id")),
        resource_id=F.col("warehouse_id"),
        title=F.concat(F.lit("Shorten the idle limit of warehouse "), F.col("label")),
        severity="medium",
        savings=confident(F.col("total_cost") * 0.1),
        description=F.format_string("Waits %d idle minutes before it stops.", limit),
        seq=-F.col("total_cost"),
    )
    return never.unionByName(late)


def warehouse_sizing(merged: DataFrame) -> DataFrame:
    paid = _paid_warehouses(merged)
    large = recommend(
        paid.filter(F.upper("warehouse_size").isin(*LARGE_SIZES)),
        "wh_size",
        id=row_id("wh_size", F.col("warehouse_id")),
        resource_id=F.col("warehouse_id"),
        title=F.concat(F.lit("Consider a smaller size for warehouse "), F.col("label")),
        severity="medium",
        savings=confident(F.col("total_cost") * 0.5),
        description=F.concat(F.lit("Its size is "), F.upper("warehouse_size"), F.lit(".")),
        seq=-F.col("total_cost"),
    )
    always = recommend(
        paid.filter(F.col("min_clusters") > 1),
        "wh_min_clusters",
        id=row_id("wh_min_clusters", F.col("warehouse_id")),
        resource_id=F.col("warehouse_id"),
        title=F.concat(F.lit("Start warehouse "), F.col("label"), F.lit(" from one cluster")),
        severity="medium",
        savings=confident(F.col("total_cost") * 0.2),
        description=F.format_string("Keeps %d clusters up at any load.", "min_clusters"),
        seq=-F.col("total_cost"),
    )
    return large.unionByName(always)


def hourly_rate(size: Column) -> Column:
    rate = F.lit(DEFAULT_HOURLY_RATE)
    for name, dollars in HOURLY_RATES.items():
        rate = F.when(F.upper(size) == name, dollars).otherwise(rate)
    return rate


def long_running_warehouses(long_running: DataFrame) -> DataFrame:
    hours = F.col("running_hours")
    cost = hours * hourly_rate(F.col("warehouse_size")) * F.col("cluster_count")
    return recommend(
        long_running.filter((hours > 4) & ~is_starter(F.col("warehouse_name"))),
        "wh_long_run",
        id=row_id("wh_long_run", F.col("warehouse_id")),
        resource_id=F.col("warehouse_id"),
        title=F.concat(F.lit("Check the long run of warehouse "), F.col("warehouse_name")),
        severity=F.when(hours > 8, "high").otherwise("medium"),
        savings=confident(cost * 0.5),
        description=F.format_string("Up for %.1f hours with %d clusters.", hours, F.col("cluster_count")),
        seq=-cost,
    )


def upscaled_warehouses(upscaled: DataFrame) -> DataFrame:
    hours = F.col("upscaled_hours")
    return recommend(
        upscaled.filter(hours > 1),
        "wh_upscaled",
        id=row_id("wh_upscaled", F.col("warehouse_id")),
        resource_id=F.col("warehouse_id"),
        title=F.concat(F.lit("Check the scale-up of warehouse "), F.col("warehouse_name")),
        severity="medium",
        savings=confident(hours * 4 * (F.col("current_clusters") - 1)),
        description=F.format_string("At %d clusters for %.1f hours.", F.col("current_clusters"), hours),
        # Several scale-ups may still hold; the longest one comes first.
        seq=-hours,
    )


def idle_warehouses(idle: DataFrame) -> DataFrame:
    hours = F.col("running_hours")
    return recommend(
        idle.filter(~is_starter(F.col("warehouse_name"))),
        "wh_idle",
        id=row_id("wh_idle", F.col("warehouse_id")),
        resource_id=F.col("warehouse_id"),
        title=F.concat(F.lit("Stop the idle warehouse "), F.col("warehouse_name")),
        severity=F.when(hours > 4, "high").otherwise("medium"),
        savings=confident(hours * hourly_rate(F.col("warehouse_size")) * 0.7),
        description=F.format_string("Up for %.1f hours without recent queries.", hours),
        seq=-hours,
    )


def spill_upsizing(spill: DataFrame) -> DataFrame:
    return recommend(
        spill.filter("needs_upsize"),
        "disk_spill",
        id=row_id("disk_spill", F.col("warehouse_id")),
        resource_id=F.col("warehouse_id"),
        title=F.concat(F.lit("Enlarge spilling warehouse "), F.col("warehouse_id")),
        severity="medium",
        savings=F.lit(0.0),
        description=F.format_string("%d queries spilled, up to %.1f GB.", "spill_frequency", "max_spilled_gb"),
        seq=-F.col("spill_frequency"),
    )


# ---- products -----------------------------------------------------------------
def all_purpose_to_jobs(rollup: DataFrame) -> DataFrame:
    share = ratio(F.col("cost"), F.col("total_cost")) * 100
    return recommend(
        product_cost(rollup, "INTERACTIVE", "ALL_PURPOSE").filter(
            (F.col("cost") > 0) & ((share > 10) | (F.col("cost") > 1))
        ),
        "all_purpose_to_jobs",
        title=F.lit("Move scheduled work from interactive to job compute"),
        severity=F.when(share > 25, "high").otherwise("medium"),
        savings=confident(F.col("cost") * 0.5),
        description=F.format_string("Interactive compute costs %.2f, %.0f %% of all.", F.col("cost"), share),
    )


def acceleration_check(rollup: DataFrame) -> DataFrame:
    serverless = ratio(F.col("serverless_cost"), F.col("cost")) * 100
    savings = confident(
        F.when(serverless < 80, F.col("classic_cost") * 0.3).otherwise(F.col("cost") * 0.05)
    )
    return recommend(
        product_cost(rollup, "SQL").filter((F.col("cost") > 5) & (savings >= 1.0)),
        "evaluate_photon",
        title=F.lit("Check whether query acceleration earns its price"),
        severity="low",
        savings=savings,
        description=F.format_string("SQL costs %.2f, %.0f %% of it serverless.", F.col("cost"), serverless),
    )


def model_scale_to_zero(rollup: DataFrame) -> DataFrame:
    return recommend(
        product_cost(rollup, "MODEL_SERVING").filter(F.col("cost") >= 5),
        "model_scale_to_zero",
        title=F.lit("Let model endpoints scale to zero"),
        severity="medium",
        savings=confident(F.col("cost") * 0.5),
        description=F.format_string("Model serving costs %.2f.", "cost"),
    )


# ---- jobs ---------------------------------------------------------------------
def serverless_job(jobs: DataFrame) -> DataFrame:
    classic = ~F.coalesce(F.col("is_serverless"), F.lit(False))
    return recommend(
        jobs.filter(classic & (F.col("run_count") >= 3) & (F.col("total_cost") > 0.1)),
        "serverless_job",
        id=row_id("serverless_job", F.col("job_id")),
        resource_id=F.col("job_id"),
        title=F.concat(F.lit("Try serverless for job "), _label("job_name", "job_id")),
        severity="low",
        savings=confident(F.col("total_cost") * 0.15),
        description=F.format_string("Starts classic compute for %d runs.", "run_count"),
        seq=F.col("job_rank"),
    )


def frequent_job(jobs: DataFrame) -> DataFrame:
    return recommend(
        jobs.filter((F.col("run_count") >= 20) & (F.col("total_cost") > 0.5)),
        "job_freq",
        id=row_id("job_freq", F.col("job_id")),
        resource_id=F.col("job_id"),
        title=F.concat(F.lit("Review the schedule of job "), _label("job_name", "job_id")),
        severity="low",
        savings=confident(F.col("total_cost") * 0.3),
        description=F.format_string("Ran %d times.", "run_count"),
        seq=F.col("job_rank"),
    )


def spot_instances(jobs: DataFrame) -> DataFrame:
    sums = jobs.agg(
        total("total_cost").alias("cost"),
        total("spot_cost").alias("spot"),
        total("on_demand_cost").alias("on_demand"),
    )
    share = ratio(F.col("spot"), F.col("cost")) * 100
    return recommend(
        sums.filter((F.col("on_demand") > 0.5) & (share <= 80)),
        "use_spot_instances",
        title=F.lit("Run job clusters on spot capacity"),
        severity="medium",
        savings=confident(F.col("on_demand") * 0.6),
        description=F.format_string("%.2f of the job cost is on demand, %.0f %% is on spot.", F.col("on_demand"), share),
    )


def job_efficiency(job_issues: DataFrame) -> DataFrame:
    failing = recommend(
        job_issues.filter((F.col("type") == "high_failure_rate") & (F.col("estimated_savings") >= 1)),
        "job_failures",
        id=row_id("job_failures", F.col("resource_id")),
        resource_id=F.col("resource_id"),
        title=F.concat(F.lit("Fix the failing job "), F.col("resource_name")),
        severity="high",
        savings=confident(F.col("estimated_savings")),
        description=F.format_string("%.0f %% of its runs fail.", "metric"),
        seq=F.col("job_rank"),
    )
    starting = recommend(
        job_issues.filter((F.col("type") == "startup_overhead") & (F.col("metric") >= 0.10)),
        "job_startup",
        id=row_id("job_startup", F.col("resource_id")),
        resource_id=F.col("resource_id"),
        title=F.concat(F.lit("Cut the starting cost of job "), F.col("resource_name")),
        severity="medium",
        savings=confident(F.col("metric") * 10 * 0.5),
        description=F.format_string("Runs %.0f s for %.2f each.", "avg_duration_seconds", "cost_per_run"),
        seq=F.col("job_rank"),
    )
    return failing.unionByName(starting)


# ---- queries ------------------------------------------------------------------
def shuffle_findings(heavy: DataFrame) -> DataFrame:
    few = heavy.orderBy(F.col("shuffle_read_bytes").desc(), "statement_id").limit(3)
    worst = few.agg(
        F.sort_array(F.collect_list(F.struct(-F.col("shuffle_read_bytes"), "statement_id", "shuffle_gb")))
    ).scalar()
    found = heavy.agg(F.count("*").alias("n")).withColumn("worst", worst)
    examples = F.array_join(
        F.transform("worst", lambda q: F.format_string("%s (%.1f GB)", q["statement_id"], q["shuffle_gb"])),
        ", ",
    )
    return recommend(
        found.filter(F.col("n") >= 5),
        "shuffle_heavy_queries",
        title=F.format_string("Rewrite %d queries that shuffle much", "n"),
        severity="low",
        savings=F.lit(0.0),
        description=F.concat(F.lit("Worst: "), examples),
    )


def unfiltered_queries(query_totals: DataFrame, rollup: DataFrame) -> DataFrame:
    sums = query_totals.withColumn("sql_cost", product_cost(rollup, "SQL").select("cost").scalar())
    share = ratio(F.col("no_where_clause").cast("double"), F.col("select_count")) * 100
    return recommend(
        sums.filter(
            (F.col("select_count") > 0) & (F.col("sql_cost") >= 1)
            & (share > 30) & (F.col("no_where_clause") > 20)
        ),
        "sql_partitioning",
        title=F.lit("Consider partitioning tables that are read unfiltered"),
        severity="low",
        savings=confident(F.col("sql_cost") * 0.1),
        description=F.format_string("%d of the SELECT statements have no filter.", "no_where_clause"),
    )


def table_layout(query_totals: DataFrame, rollup: DataFrame) -> DataFrame:
    sums = query_totals.withColumn("sql_cost", product_cost(rollup, "SQL").select("cost").scalar())
    return recommend(
        sums.filter(
            (F.col("sql_cost") > 10) & ((F.col("large_result_sets") > 5) | (F.col("query_count") > 100))
        ),
        "delta_optimization",
        title=F.lit("Improve the layout of the most queried tables"),
        severity="low",
        savings=confident(F.col("sql_cost") * 0.15),
        description=F.format_string("%d queries, SQL cost %.2f.", "query_count", "sql_cost"),
    )


# ---- governance ---------------------------------------------------------------
def tagging(coverage: DataFrame) -> DataFrame:
    share = F.col("untagged_percentage")
    return recommend(
        coverage.filter(F.col("has_tagging_gap") & (share > 20)),
        "implement_tagging",
        title=F.lit("Tag resources so that cost can be attributed"),
        severity=F.when(share > 50, "high").otherwise("medium"),
        savings=confident(F.col("untagged_dbus") * 0.50 * 0.1),
        description=F.format_string("%.0f %% of the DBUs carry no tag.", share),
    )


def weekend_waste(pattern: DataFrame, totals: DataFrame) -> DataFrame:
    waste = pattern.filter(F.col("has_weekend_waste") & (F.col("weekend_dbus") > 10)).withColumn(
        "wasted", totals.select("total_cost").scalar() * (F.col("weekend_percentage") / 100) * 0.7
    )
    return recommend(
        waste,
        "weekend_waste",
        title=F.lit("Reduce weekend usage"),
        severity=F.when(F.col("wasted") > 50, "high").otherwise("medium"),
        savings=confident(F.col("wasted")),
        description=F.format_string("%.1f %% of the DBUs fall on weekends.", "weekend_percentage"),
    )


def cost_monitoring(projection: DataFrame) -> DataFrame:
    return recommend(
        projection,
        "cost_monitoring",
        title=F.lit("Set cost alerts"),
        severity="low",
        savings=confident(F.col("estimated_monthly_cost") * 0.05),
        description=F.format_string("The projected monthly cost is %.2f.", "estimated_monthly_cost"),
    )


# ---- all together -------------------------------------------------------------
def union_rules(rules: list[DataFrame], totals: DataFrame) -> DataFrame:
    """All rule outputs; none when nothing was used or paid."""
    nothing = (totals.select("total_dbus").scalar() == 0) | (totals.select("total_cost").scalar() == 0)
    return reduce(DataFrame.unionByName, rules).filter(~nothing)


def keep_first(candidates: DataFrame, by_id: bool = False) -> DataFrame:
    """Drop repeated recommendations, keeping the first in rule order.

    Rows repeat when rule and resource are the same, or, with ``by_id``, when their ids are.
    """
    same = [F.col("id")] if by_id else [F.col("rule"), F.coalesce("resource_id", "id")]
    order = Window.partitionBy(*same).orderBy("rule_order", "seq", F.col("resource_id").asc_nulls_first())
    return candidates.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def worthwhile(candidates: DataFrame) -> DataFrame:
    return candidates.filter(F.col("estimated_savings") >= MIN_SAVINGS)


def severity_rank(severity: Column) -> Column:
    rank = F.lit(len(SEVERITY_ORDER))
    for name, place in SEVERITY_ORDER.items():
        rank = F.when(severity == name, place).otherwise(rank)
    return rank


def in_order(recommendations: DataFrame) -> DataFrame:
    """Severest first, then by savings."""
    return recommendations.orderBy(
        severity_rank(F.col("severity")), F.col("estimated_savings").desc(), "rule_order", "seq", "id",
        F.col("resource_id").asc_nulls_first(),
    )
