"""Registered queries: every operator over the sample tables, as flat rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, IntegralType

from spendscope.functions import expressions as ex
from spendscope.operators import clusters, costs, jobs, pricing, query_history, rules, usage, utilization, versions, warehouses
from spendscope.plans import report
from spendscope.plans.analysis import Analysis
from spendscope.session import configure
from spendscope.sources import profile, sinks
from spendscope.sources.registry import SourceTables
from spendscope.sources.sample_tables import SAMPLE_WINDOW, contracted_prices, sample_tables

# Windows that cut rows off on both sides, to exercise the bounds.
INNER_WINDOW = replace(SAMPLE_WINDOW, start=date(2024, 1, 2), end=date(2024, 1, 29))
HALF_LOOKBACK = replace(SAMPLE_WINDOW, lookback_days=15)
# Two days on, running warehouses have had no queries.
LATER_WINDOW = replace(SAMPLE_WINDOW, as_of=datetime(2024, 2, 2, 12, 0))

Build = Callable[[Analysis], DataFrame]
_REGISTRY: dict[str, tuple[Build, bool]] = {}


def query(name: str, shared: bool = False):
    """Register a query; ``shared`` ones read results that many others read too."""

    def register(build: Build) -> Build:
        _REGISTRY[name] = (build, shared)
        return build

    return register


def flat(df: DataFrame) -> DataFrame:
    """Integers as bigint and numbers as doubles of six digits."""

    def column(field):
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, IntegralType):
            col = col.cast("bigint")
        elif isinstance(field.dataType, (DoubleType, FloatType, DecimalType)):
            col = F.round(col.cast("double"), 6)
        return col.alias(field.name)

    return df.select(*[column(f) for f in df.schema.fields])


_tables: dict[tuple[str, str], SourceTables] = {}
_analyses: dict[tuple[str, str], Analysis] = {}


def run(name: str, spark: SparkSession, sf_dir: str, fresh: bool = False) -> DataFrame:
    """Run one query.

    Table definitions are kept per session. So are the results that shared queries
    read, unless ``fresh``, which computes everything for this query alone.
    """
    build, shared = _REGISTRY[name]
    session = (spark.sparkContext.applicationId, sf_dir)
    configure(spark)
    if session not in _tables:
        _tables[session] = sample_tables(spark, sf_dir)
    if not shared:
        analysis = Analysis(_tables[session], SAMPLE_WINDOW)
    elif fresh:
        analysis = Analysis(_tables[session], SAMPLE_WINDOW, reuse=True)
    else:
        if session not in _analyses:
            _analyses[session] = Analysis(_tables[session], SAMPLE_WINDOW, reuse=True)
        analysis = _analyses[session]
    return flat(build(analysis))


def names() -> list[str]:
    return list(_REGISTRY)


def _all_metrics(a: Analysis) -> DataFrame:
    return a.metrics


# ---- sources and sinks --------------------------------------------------------
@query("s1_read_source")
def _(a):
    return a.tables["query_history"].select(
        "statement_id", "executed_by", F.col("compute.warehouse_id").alias("warehouse_id"),
        "statement_type", "statement_text", "read_rows", "start_time", "end_time",
    )


@query("s2_contract_prices")
def _(a):
    contracted = contracted_prices(a.tables["list_prices"])
    return Analysis(a.tables.with_table("account_prices", contracted), a.window).totals


@query("s2_fallback_to_list_prices")
def _(a):
    other_skus = contracted_prices(a.tables["list_prices"]).withColumn(
        "sku_name", F.concat("sku_name", F.lit("_OLD"))
    )
    return Analysis(a.tables.with_table("account_prices", other_skus), a.window).totals


@query("s3_job_costs_without_jobs")
def _(a):
    return jobs.job_costs(a.list_priced, a.tables.without("jobs")).select(
        "job_id", "job_name", "owner", "sku_name", "is_serverless", "total_cost", "run_count"
    )


@query("s4_missing_node_timeline")
def _(a):
    less = Analysis(a.tables.without("node_timeline"), a.window)
    return utilization.utilization_coverage(less.targets, less.metrics)


@query("s5_source_profile")
def _(a):
    return profile.source_profile(a.tables)


@query("s5_distinct_skus")
def _(a):
    return profile.distinct_values(a.tables["usage"], "sku_name")


@query("s6_report_summary", shared=True)
def _(a):
    return sinks.report_summary(a.recommendations, a.projection)


# ---- filters ------------------------------------------------------------------
@query("f1_date_window")
def _(a):
    return pricing.usage_in_period(a.tables["usage"], INNER_WINDOW).groupBy("usage_date").agg(
        F.count("*").alias("lines"), F.sum("usage_quantity").alias("dbus")
    )


@query("f2_timestamp_window")
def _(a):
    return query_history.in_window(a.tables["query_history"], a.window).groupBy(
        F.to_date("start_time").alias("day")
    ).agg(F.count("*").alias("queries"), F.max("start_time").alias("last_start"))


@query("f3_metrics_lower_bound")
def _(a):
    since = ex.since(F.col("start_time"), HALF_LOOKBACK.metrics_start)
    return a.tables["node_timeline"].filter(since).groupBy("cluster_id").agg(
        F.count("*").alias("samples"), F.min("start_time").alias("first_sample")
    )


@query("f4_run_window")
def _(a):
    return jobs.job_runs(a.tables["job_run_timeline"], a.window).groupBy(
        F.to_date("period_start_time").alias("day")
    ).agg(F.count("*").alias("runs"), F.max("period_end_time").alias("last_end"))


@query("f5_nested_projection")
def _(a):
    return pricing.usage_lines(a.tables["usage"]).groupBy(
        "cluster_id", "job_id", "warehouse_id", "run_as_user", "is_serverless"
    ).agg(F.count("*").alias("lines"))


@query("f6_non_serverless")
def _(a):
    lines = pricing.usage_lines(a.tables["usage"])
    return lines.filter(ex.is_classic(F.col("is_serverless"))).groupBy("is_serverless").agg(
        F.count("*").alias("lines"), F.sum("usage_quantity").alias("dbus")
    )


@query("f7_job_cluster_names")
def _(a):
    name = F.col("cluster_name")
    return a.tables["clusters"].select(
        "cluster_id", "change_time", ex.is_job_cluster(name).alias("is_job_cluster"),
        ex.is_job_cluster(F.upper(name), ignore_case=True).alias("is_job_cluster_any_case"),
    )


@query("f8_presence")
def _(a):
    return pricing.usage_lines(a.tables["usage"]).filter(
        F.col("cluster_id").isNotNull() & F.col("job_id").isNotNull()
    ).groupBy("cluster_id", "job_id").agg(F.count("*").alias("lines"))


@query("f9_long_statements")
def _(a):
    return query_history.longest_queries(a.tables["query_history"], a.window, limit=None).select(
        "statement_id", "statement_type", "duration_seconds"
    )


@query("f10_starter_exclusion")
def _(a):
    return a.warehouses.filter(~ex.is_starter(F.col("warehouse_name"))).select("warehouse_id", "warehouse_name", "total_cost")


# ---- joins --------------------------------------------------------------------
@query("j1_temporal_price_join")
def _(a):
    return a.list_priced.select(
        "usage_date", "sku_name", "usage_end_time", "workspace_id", "usage_quantity",
        F.col("dollar_cost").cast("double").alias("dollar_cost"),
    )


@query("j2_usage_with_jobs")
def _(a):
    return jobs.with_job_names(jobs.job_usage(a.list_priced), a.tables).select(
        "workspace_id", "job_id", "job_run_id", "cluster_id", "sku_name", "is_serverless",
        "job_name", "owner", ex.amount("dbus").alias("dbus"), ex.amount("cost").alias("cost"), "first_run", "last_run",
    )


@query("j3_usage_with_clusters")
def _(a):
    return clusters.clusters_with_names(clusters.cluster_usage_cost(a.list_priced), a.tables["clusters"])


@query("j4_samples_of_top_clusters")
def _(a):
    return utilization.node_samples(a.tables["node_timeline"], a.targets, a.window)


@query("j5_idle_costs_and_names")
def _(a):
    return utilization.idle_clusters(a.worker_hours, a.cluster_usage, a.tables["clusters"], limit=None)


@query("j6_autoscale_costs")
def _(a):
    return utilization.autoscale_stats(a.worker_hours, a.cluster_usage, a.tables["clusters"], limit=None)


@query("j7_latest_state_anti_join")
def _(a):
    return warehouses.running_now(a.tables["warehouse_events"])


@query("j8_scale_up_anti_join")
def _(a):
    return warehouses.scaled_up_now(a.tables["warehouse_events"])


@query("j9_events_with_warehouse")
def _(a):
    return warehouses.with_config(a.tables["warehouse_events"], a.warehouse_configs)


@query("j10_running_without_queries")
def _(a):
    running = warehouses.running_now(a.tables["warehouse_events"]).select("warehouse_id", "event_time")
    activity = warehouses.query_activity(a.tables["query_history"], LATER_WINDOW.as_of)
    return warehouses.running_without_queries(running, activity, LATER_WINDOW.as_of)


@query("j11_merge_configs_and_costs")
def _(a):
    return a.warehouses


@query("j12_jobs_with_run_metrics")
def _(a):
    return a.jobs.select(
        "job_id", "sku_name", "is_serverless", "success_count", "failure_count", "avg_duration_seconds"
    )


@query("j13_named_top_items", shared=True)
def _(a):
    return a.named_top


@query("j14_driver_worker_pairs")
def _(a):
    return utilization.driver_worker_pairs(_all_metrics(a))


# ---- aggregations -------------------------------------------------------------
@query("a1_priced_usage")
def _(a):
    return a.priced.groupBy("usage_date", "billing_origin_product").agg(
        F.count("*").alias("lines"), ex.total("usage_quantity").alias("dbus"), ex.total("dollar_cost").alias("cost")
    )


@query("a2_totals")
def _(a):
    return a.totals


@query("a3_cost_by_dimension")
def _(a):
    return a.rollup.drop("serverless_dbus")


@query("a4_tag_usage")
def _(a):
    return usage.tag_usage(a.tables["usage"], a.window)


@query("a4_tag_coverage")
def _(a):
    return a.tag_coverage


@query("a5_weekday_usage")
def _(a):
    return a.by_day


@query("a5_weekend_pattern")
def _(a):
    return a.weekend


@query("a6_warehouse_costs")
def _(a):
    return warehouses.warehouse_costs(a.priced)


@query("a7_warehouse_rollup")
def _(a):
    return warehouses.warehouse_cost_rollup(warehouses.warehouse_costs(a.priced))


@query("a8_interactive_cluster_costs")
def _(a):
    return a.cluster_costs


@query("a9_job_costs")
def _(a):
    return a.job_costs


@query("a10_spot_classification")
def _(a):
    return a.tables["clusters"].select(
        "cluster_id", "change_time", ex.availability().alias("availability"), ex.uses_spot().alias("uses_spot")
    )


@query("a11_run_metrics")
def _(a):
    return a.run_metrics.select(
        "job_id", ex.rounded(F.col("avg_duration"), 1).alias("avg_duration"), "min_duration",
        "max_duration", "success_count", "failure_count", jobs.failure_percent().alias("failure_rate"),
    )


@query("a12_job_efficiency")
def _(a):
    return a.jobs.select(
        "job_rank", "job_id", "sku_name", "is_serverless", "avg_duration_seconds", "min_duration_seconds",
        "max_duration_seconds", "cost_per_run", "failure_rate", "duration_variance", "short_run",
    )


METRIC_COLUMNS = (
    "cluster_id", "component", "sample_count",
    "cpu_p25", "cpu_p50", "cpu_p75", "cpu_p90", "cpu_p99",
    "mem_p25", "mem_p50", "mem_p75", "mem_p90", "mem_p95", "mem_p99", "mem_max", "mem_stddev",
    "io_wait_p50", "io_wait_p90", "io_wait_time_above_20pct", "swap_max", "swap_time_fraction",
    "cpu_time_above_80pct", "cpu_time_above_90pct", "mem_time_above_90pct", "mem_time_above_95pct",
)


@query("a13_cluster_utilization")
def _(a):
    return _all_metrics(a).select(*METRIC_COLUMNS)


@query("a13_top_cluster_utilization")
def _(a):
    return a.metrics.select(
        *METRIC_COLUMNS, "cluster_name", "total_dbus", "job_id", "node_type", "min_autoscale_workers",
        "max_autoscale_workers", "availability", "uses_spot", "metric_rank",
    )


@query("a14_target_clusters")
def _(a):
    return a.targets


@query("a15_idle_clusters")
def _(a):
    return a.idle_clusters


@query("a16_hourly_workers")
def _(a):
    return a.worker_hours.select("cluster_id", "usage_date", "usage_hour", "active_workers")


@query("a17_autoscale_stats")
def _(a):
    return utilization.autoscale_stats(a.worker_hours, a.cluster_usage, a.tables["clusters"])


@query("a18_user_stats")
def _(a):
    return a.user_stats


@query("a19_disk_spill")
def _(a):
    return a.spill


@query("a19_spill_summary")
def _(a):
    return query_history.spill_summary(a.spill)


@query("a20_shuffle_by_warehouse")
def _(a):
    return query_history.shuffle_by_warehouse(a.shuffle_heavy)


@query("a21_pattern_counts")
def _(a):
    return a.pattern_counts


@query("a22_pattern_findings")
def _(a):
    return query_history.pattern_findings(a.pattern_counts)


@query("a23_utilization_summary")
def _(a):
    return a.utilization_summary


@query("a23_cluster_status")
def _(a):
    return utilization.cluster_status(_all_metrics(a)).select(
        "cluster_id", "cluster_name", "total_dbus", "overall_status", "suggested_action"
    )


@query("a24_query_activity")
def _(a):
    return warehouses.query_activity(a.tables["query_history"], a.window.as_of)


@query("a25_monthly_projection")
def _(a):
    return a.projection


@query("a26_job_totals")
def _(a):
    return a.job_totals


@query("a27_average_dbu_price")
def _(a):
    return rules.average_dbu_price(a.totals)


@query("a28_potential_savings")
def _(a):
    return costs.expected_savings(a.warehouse_issues)


# ---- windows ------------------------------------------------------------------
@query("d1_latest_clusters")
def _(a):
    return versions.latest_clusters(a.tables["clusters"]).select(
        "cluster_id", "change_time", "min_autoscale_workers", "max_autoscale_workers"
    )


@query("d2_latest_jobs")
def _(a):
    return versions.latest_jobs(a.tables["jobs"])


# ---- sort and limit -----------------------------------------------------------
@query("t1_top_items")
def _(a):
    return a.top


@query("t2_priced_newest_first")
def _(a):
    return pricing.listed_usage(a.priced).select(
        "usage_date", "dollar_cost", "sku_name", "billing_origin_product", "cluster_id", "warehouse_id",
        "run_as_user", "is_serverless", "usage_unit",
    )


@query("t3_longest_queries")
def _(a):
    return query_history.longest_queries(a.tables["query_history"], a.window)


@query("t4_top_shuffle_queries")
def _(a):
    return query_history.top_shuffle(a.shuffle_heavy)


@query("t5_recent_events")
def _(a):
    return warehouses.recent_events(a.tables["warehouse_events"], a.window)


@query("t6_warehouses_by_cost")
def _(a):
    return warehouses.by_cost(a.warehouses).select("warehouse_id", "total_cost")


@query("t7_runs_by_job")
def _(a):
    return jobs.job_runs(a.tables["job_run_timeline"], a.window).drop("compute_ids", "run_name")


@query("t8_idle_by_dbus")
def _(a):
    return a.idle_clusters.select("cluster_id", "total_dbus")


@query("t9_high_cost_jobs")
def _(a):
    return jobs.high_cost_jobs(a.jobs).drop("job_rank")


@query("t10_ranked_recommendations", shared=True)
def _(a):
    return rules.in_order(rules.keep_first(a.candidates)).select(
        rules.severity_rank(F.col("severity")).alias("severity_rank"), "estimated_savings", "id", "resource_id"
    )


@query("t11_cluster_listing")
def _(a):
    return versions.cluster_listing(a.tables["clusters"])


# ---- set operations -----------------------------------------------------------
REC_COLUMNS = ("id", "rule", "severity", "category", "resource_id", "contact", "estimated_savings", "effort")


@query("u1_union_of_rules", shared=True)
def _(a):
    return a.candidates.select(*REC_COLUMNS)


@query("u2_keep_first_by_id", shared=True)
def _(a):
    return rules.keep_first(a.candidates, by_id=True).select(*REC_COLUMNS)


@query("u2_keep_first_by_resource", shared=True)
def _(a):
    return rules.keep_first(a.candidates).select(*REC_COLUMNS)


@query("u3_worthwhile", shared=True)
def _(a):
    return rules.worthwhile(a.candidates).select(*REC_COLUMNS)


@query("u4_distinct_running_warehouses")
def _(a):
    return warehouses.running_now(a.tables["warehouse_events"]).select("warehouse_id").distinct()


# ---- scalar functions ---------------------------------------------------------
@query("sc1_rounding")
def _(a):
    cpu = F.col("cpu_user_percent") + F.col("cpu_system_percent")
    return a.tables["node_timeline"].groupBy("cluster_id", "instance_id").agg(
        ex.rounded(F.avg(cpu), 2).alias("avg_cpu"), ex.rounded(F.max(cpu) / 100, 4).alias("max_share")
    )


@query("sc2_null_handling")
def _(a):
    low, high = F.col("min_autoscale_workers"), F.col("max_autoscale_workers")
    return a.tables["clusters"].select(
        "cluster_id", "change_time",
        F.coalesce("worker_count", high, F.lit(0)).alias("workers"),
        ex.worker_span().alias("span"),
        F.when(low.isNull(), "fixed").when(high.between(3, 6), "small").otherwise("large").alias("kind"),
        F.col("auto_termination_minutes").isin(0, 15).alias("listed"),
    )


@query("sc3_date_parts")
def _(a):
    at = F.col("start_time")
    return a.tables["node_timeline"].groupBy(
        ex.day_of(at).alias("day"), ex.hour_of(at).alias("hour"), ex.weekday_of(at).alias("day_of_week")
    ).agg(F.count("*").alias("samples"))


@query("sc4_elapsed_units")
def _(a):
    start, end = F.col("period_start_time"), F.col("period_end_time")
    return a.tables["job_run_timeline"].select(
        "run_id",
        *[ex.whole_units(u, start, end).alias(u.lower() + "s") for u in ("SECOND", "MINUTE", "HOUR")],
        ex.hours_running(end, a.window.as_of).cast("double").alias("hours_ago"),
    )


@query("sc5_text_functions")
def _(a):
    text = F.col("statement_text")
    return a.tables["query_history"].select(
        "statement_id", ex.preview(text, 12).alias("preview"), F.upper(text).alias("upper_text"),
        text.rlike("^select").alias("lower_select"),
    )


@query("sc6_query_text_flags")
def _(a):
    text = F.col("statement_text")
    return query_history.text_flags(a.tables["query_history"]).select(
        "statement_id", "select_star", "no_where_clause", "excessive_joins", "large_result_sets",
        ex.join_count(text).alias("joins"),
    )


@query("sc7_map_and_struct")
def _(a):
    tags = F.col("custom_tags")
    return a.tables["usage"].groupBy(
        ex.tag_count(tags).isNull().alias("no_map"), ex.tag_count(tags).alias("tags"),
        F.col("product_features.is_serverless").alias("is_serverless"),
    ).agg(F.count("*").alias("lines"))


@query("sc8_unit_conversion")
def _(a):
    return a.tables["query_history"].select(
        "statement_id", ex.seconds(F.col("total_task_duration_ms")).alias("duration_seconds"),
        ex.gigabytes(F.col("spilled_local_bytes")).alias("spilled_gb"),
    )


@query("sc9_effort_minutes", shared=True)
def _(a):
    return a.candidates.groupBy("effort").agg(
        F.count("*").alias("recommendations"), F.max(ex.effort_minutes(F.col("effort"))).alias("minutes")
    )


@query("sc10_user_display")
def _(a):
    address = F.concat("executed_by", F.lit("@"), F.coalesce("compute.warehouse_id", F.lit("none")))
    return a.tables["query_history"].groupBy(ex.user_display(address).alias("user")).agg(
        F.count("*").alias("queries")
    )


# ---- classification -----------------------------------------------------------
def _classified(*columns: str) -> Build:
    return lambda a: _all_metrics(a).select("cluster_id", "component", *columns)


query("c1_cpu_status")(_classified("cpu_status"))
query("c2_memory_status")(_classified("mem_status"))
query("c3_overall_status")(_classified("overall_status"))
query("c4_io_bottleneck")(_classified("io_bound", "io_issue"))
query("c5_memory_spike_risk")(_classified("mem_volatility", "mem_spike_risk"))
query("c6_swap_issue")(_classified("swap_issue"))
query("c7_suggested_action")(_classified("suggested_action", "cpu_headroom_p50", "mem_headroom_p95"))


@query("c8_driver_worker_imbalance")
def _(a):
    return utilization.driver_worker_imbalance(_all_metrics(a))


@query("c9_autoscale_verdict")
def _(a):
    stats = utilization.autoscale_stats(a.worker_hours, a.cluster_usage, a.tables["clusters"], limit=None)
    return utilization.autoscale_verdicts(stats).select("cluster_id", "verdict", "total_dbus", "wasted_dbus_estimate")


ISSUE_COLUMNS = (
    "domain", "type", "resource_id", "resource_name", "owner", "severity", "cost", "estimated_savings", "metric",
)


@query("c10_cluster_issues")
def _(a):
    return a.cluster_issues.select(*ISSUE_COLUMNS)


@query("c11_warehouse_issues")
def _(a):
    return a.warehouse_issues.select(*ISSUE_COLUMNS)


@query("c12_long_running_warehouses")
def _(a):
    return a.long_running


@query("c13_upscaled_warehouses")
def _(a):
    return a.upscaled


@query("c14_idle_warehouses")
def _(a):
    return a.idle_warehouses


@query("c14_idle_warehouses_later")
def _(a):
    return Analysis(a.tables, LATER_WINDOW).idle_warehouses


@query("c15_job_issues")
def _(a):
    return a.job_issues.select("job_rank", *ISSUE_COLUMNS)


# ---- rules --------------------------------------------------------------------
def _rule(name: str, *builders: Callable[[Analysis], DataFrame]) -> None:
    def build(a: Analysis) -> DataFrame:
        result = builders[0](a)
        for more in builders[1:]:
            result = result.unionByName(more(a))
        return result.select(*REC_COLUMNS)

    query(name)(build)


_rule("r01_auto_termination", lambda a: rules.auto_termination(a.cluster_issues))
_rule("r02_warehouse_auto_stop", lambda a: rules.warehouse_auto_stop(a.warehouses))
_rule("r03_warehouse_sizing", lambda a: rules.warehouse_sizing(a.warehouses))
_rule("r04_long_running_warehouse", lambda a: rules.long_running_warehouses(Analysis(a.tables, LATER_WINDOW).long_running))
_rule("r05_upscaled_warehouse", lambda a: rules.upscaled_warehouses(a.upscaled))
_rule("r06_idle_warehouse", lambda a: rules.idle_warehouses(Analysis(a.tables, LATER_WINDOW).idle_warehouses))
_rule("r07_disk_spill", lambda a: rules.spill_upsizing(a.spill))
_rule("r08_shuffle_heavy_queries", lambda a: rules.shuffle_findings(a.shuffle_heavy))
_rule("r09_all_purpose_to_jobs", lambda a: rules.all_purpose_to_jobs(a.rollup))
_rule("r10_acceleration_check", lambda a: rules.acceleration_check(a.rollup))
_rule("r11_serverless_job", lambda a: rules.serverless_job(a.jobs))
_rule("r12_cluster_sizing", lambda a: rules.cluster_sizing(a.cluster_issues))
_rule("r13_model_scale_to_zero", lambda a: rules.model_scale_to_zero(a.rollup))
_rule("r14_spot_instances", lambda a: rules.spot_instances(a.jobs))
_rule("r15_job_efficiency", lambda a: rules.job_efficiency(a.job_issues))
_rule("r16_cluster_pools", lambda a: rules.cluster_pools(a.job_issues, a.cluster_costs))
_rule("r17_frequent_job", lambda a: rules.frequent_job(a.jobs))
_rule("r18_unfiltered_queries", lambda a: rules.unfiltered_queries(a.query_totals, a.rollup))
_rule("r19_cluster_rightsizing", lambda a: rules.cluster_rightsizing(a.utilization_summary, a.metrics, a.totals))
_rule("r20_idle_clusters", lambda a: rules.idle_cluster_waste(a.idle_clusters, a.totals))
_rule("r21_autoscale_findings", lambda a: rules.autoscale_findings(a.autoscale, a.totals))
_rule("r22_driver_imbalance", lambda a: rules.imbalance_findings(utilization.driver_worker_imbalance(_all_metrics(a))))
_rule(
    "r23_governance",
    lambda a: rules.tagging(a.tag_coverage),
    lambda a: rules.weekend_waste(a.weekend, a.totals),
)
_rule(
    "r24_layout_and_monitoring",
    lambda a: rules.table_layout(a.query_totals, a.rollup),
    lambda a: rules.cost_monitoring(a.projection),
)


@query("r25_recommendations", shared=True)
def _(a):
    return a.recommendations.select(*REC_COLUMNS)


# ---- report tables ------------------------------------------------------------
@query("p1_executive_summary", shared=True)
def _(a):
    return a.summary


@query("p2_assessment", shared=True)
def _(a):
    return report.assessment(a.summary)


@query("p3_twelve_months", shared=True)
def _(a):
    return report.twelve_months(a.summary)


@query("p4_product_breakdown")
def _(a):
    return report.product_breakdown(a.rollup, a.totals)


@query("p4_compute_breakdown")
def _(a):
    return report.compute_breakdown(a.projection)


@query("p4_weekday_breakdown")
def _(a):
    return report.weekday_breakdown(a.by_day)


@query("p5_user_breakdown")
def _(a):
    return report.user_breakdown(a.top, a.rollup, a.totals)


@query("p6_status_distribution")
def _(a):
    return report.status_distribution(a.cluster_status)


@query("p7_roadmap", shared=True)
def _(a):
    return report.roadmap(a.recommendations)


@query("p8_top_jobs", shared=True)
def _(a):
    return report.top_jobs(a.named_top, a.jobs)


@query("p8_top_interactive_clusters", shared=True)
def _(a):
    return a.top_interactive_clusters


@query("p9_governance")
def _(a):
    return a.governance
