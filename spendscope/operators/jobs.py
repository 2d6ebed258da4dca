"""Job cost, run efficiency and job findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import (
    amount_parts,
    moment,
    part_sums,
    ratio,
    rounded,
    total,
    total_parts,
    whole_units,
)
from ..functions.ranking import with_place
from ..sources.registry import AnalysisWindow, SourceTables
from .clusters import issue, raise_issues
from .versions import job_cluster_capacity, latest_jobs

# ---- fixed values -------------------------------------------------------------
FAILED_STATES = ("FAILED", "TIMEDOUT", "CANCELED")
SHORT_RUN_SECONDS = 60
SHORT_RUN_MIN_COST = 1
HIGH_COST = 10
FREQUENT_RUNS = 10
FAILURE_PERCENT = 10
SEVERE_FAILURE_PERCENT = 25
FAILURE_MIN_COST = 5
STARTUP_COST_PER_RUN = 0.10
VARIABLE_SECONDS = 300
VARIABLE_MIN_RUNS = 5
# The findings that count as inefficiency in the totals.
EFFICIENCY_ISSUES = ("high_failure_rate", "startup_overhead", "variable_duration")
# -------------------------------------------------------------------------------


def job_usage(priced: DataFrame) -> DataFrame:
    """Priced job usage per run, the grain at which names and capacity join; amounts as parts of sums."""
    return (
        priced.filter(F.col("job_id").isNotNull())
        .withColumns({"dbus": F.col("usage_quantity"), "cost": F.col("dollar_cost")})
        .select("*", *amount_parts("dbus", "cost"))
        .groupBy(
            "workspace_id", "job_id", "job_name", "job_run_id", "cluster_id", "sku_name", "is_serverless"
        )
        .agg(
            *part_sums("dbus", "cost"),
            F.min("usage_start_time").alias("first_run"),
            F.max("usage_end_time").alias("last_run"),
        )
    )


def with_job_names(per_run: DataFrame, tables: SourceTables) -> DataFrame:
    """Add job name and owner; without the jobs table the owner stays unknown."""
    if not tables.has("jobs"):
        return per_run.withColumn("owner", F.lit(None).cast("string"))
    jobs = latest_jobs(tables["jobs"]).select(
        "workspace_id",
        "job_id",
        F.col("name").alias("listed_name"),
        F.col("creator_user_name").alias("owner"),
    )
    return (
        per_run.join(jobs, ["workspace_id", "job_id"], "left")
        .withColumn("job_name", F.coalesce("job_name", "listed_name"))
        .drop("listed_name")
    )


def job_costs(priced: DataFrame, tables: SourceTables) -> DataFrame:
    """Cost of each (job, SKU, compute type), with spot share and run count."""
    capacity = job_cluster_capacity(tables["clusters"]).select(F.col("cluster_id").alias("_cluster"), "uses_spot")
    # Serverless runs have no cluster: as join keys, their nulls would all meet in one task, so
    # they are dealt by run and match nothing.
    spread = F.coalesce("cluster_id", F.xxhash64("job_id", "job_run_id", "sku_name").cast("string"))
    per_run = (
        job_usage(priced)
        .withColumn("_key", spread)
        .join(capacity, (F.col("_key") == F.col("_cluster")) & F.col("cluster_id").isNotNull(), "left")
        .drop("_key", "_cluster")
    )
    named = with_job_names(per_run, tables)
    spot = F.coalesce(F.col("uses_spot"), F.lit(False))
    return (
        named.groupBy("job_id", "job_name", "owner", "sku_name", "is_serverless")
        .agg(
            F.max("uses_spot").alias("uses_spot"),
            total_parts("dbus").alias("total_dbus"),
            total_parts("cost").alias("total_cost"),
            total_parts("cost", spot).alias("spot_cost"),
            total_parts("cost", ~spot).alias("on_demand_cost"),
            F.count_distinct("job_run_id").alias("run_count"),
            F.min("first_run").alias("first_run"),
            F.max("last_run").alias("last_run"),
        )
    )


def job_runs(runs: DataFrame, window: AnalysisWindow) -> DataFrame:
    """Finished runs that lie in the period; the last day ends at its midnight."""
    return runs.filter(
        (F.col("period_start_time") >= moment(window.start))
        & (F.col("period_end_time") <= moment(window.end))
        & F.col("result_state").isNotNull()
    ).select(
        "job_id",
        "run_id",
        "run_name",
        "result_state",
        whole_units("SECOND", F.col("period_start_time"), F.col("period_end_time")).alias(
            "duration_seconds"
        ),
        "compute_ids",
        "period_start_time",
        "period_end_time",
    )


# The order in which runs are listed, for ``write_results``.
RUNS_BY_JOB = ("job_id", "-period_start_time", "run_id")


def run_metrics(runs: DataFrame) -> DataFrame:
    """Durations and outcomes per job, not yet rounded."""
    timed = F.when(F.col("duration_seconds") > 0, F.col("duration_seconds"))
    state = F.upper("result_state")
    return runs.groupBy("job_id").agg(
        F.coalesce(F.avg(timed), F.lit(0.0)).alias("avg_duration"),
        F.coalesce(F.min(timed), F.lit(0)).cast("double").alias("min_duration"),
        F.coalesce(F.max(timed), F.lit(0)).cast("double").alias("max_duration"),
        F.count_if(state == "SUCCESS").alias("success_count"),
        F.count_if(state.isin(*FAILED_STATES)).alias("failure_count"),
    )


def failure_percent(success: str = "success_count", failure: str = "failure_count"):
    failed = F.col(failure).cast("double")
    return rounded(ratio(failed, F.col(success) + failed) * 100, 1)


def job_efficiency(costs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Job costs with run metrics; jobs without runs get zeros.

    ``job_rank`` is the place of the row by cost.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    last_ties = [c for c in ("is_serverless", "job_name", "owner") if c in costs.columns]
    first = [F.col(c).asc_nulls_first() for c in last_ties]
    ranked = with_place(costs, "job_rank", "total_cost", "job_id", "sku_name", *first)
    joined = ranked.join(metrics, "job_id", "left")
    average = zero("avg_duration")
    return joined.select(
        *ranked.columns,
        rounded(average, 1).alias("avg_duration_seconds"),
        rounded(zero("min_duration"), 1).alias("min_duration_seconds"),
        rounded(zero("max_duration"), 1).alias("max_duration_seconds"),
        rounded(ratio(F.col("total_cost"), F.col("run_count").cast("double")), 4).alias("cost_per_run"),
        zero("success_count").alias("success_count"),
        zero("failure_count").alias("failure_count"),
        F.coalesce(failure_percent(), F.lit(0.0)).alias("failure_rate"),
        rounded(zero("max_duration") - zero("min_duration"), 1).alias("duration_variance"),
        ((average < SHORT_RUN_SECONDS) & (F.col("total_cost") > SHORT_RUN_MIN_COST)).alias("short_run"),
    )


def job_issues(jobs: DataFrame) -> DataFrame:
    """Findings per job row, with the row's place in the list by cost."""
    jobs = jobs.withColumn("display_name", F.coalesce("job_name", F.col("job_id").cast("string")))
    wasted = rounded(F.col("total_cost") * (F.col("failure_rate") / 100), 2)
    classic = ~F.coalesce(F.col("is_serverless"), F.lit(False))

    def finding(kind, when, severity, text, savings, metric):
        return issue(
            "job", kind, when, F.col("job_id"), F.col("display_name"), F.col("owner"),
            severity, text, F.col("total_cost"), savings, metric,
        )

    none = F.lit(None)
    return raise_issues(
        jobs,
        [
            finding(
                "high_cost",
                F.col("total_cost") > HIGH_COST,
                "medium",
                F.format_string("Among the costly jobs, with %d runs", F.col("run_count")),
                none,
                F.col("cost_per_run"),
            ),
            finding(
                "serverless_candidate",
                classic & (F.col("run_count") > FREQUENT_RUNS),
                "low",
                F.format_string("Starts classic compute for each of %d runs", F.col("run_count")),
                none,
                F.col("run_count"),
            ),
            finding(
                "high_failure_rate",
                (F.col("failure_rate") > FAILURE_PERCENT) & (F.col("total_cost") > FAILURE_MIN_COST),
                F.when(F.col("failure_rate") > SEVERE_FAILURE_PERCENT, "high").otherwise("medium"),
                F.format_string("%.1f %% of the runs fail", F.col("failure_rate")),
                wasted,
                F.col("failure_rate"),
            ),
            finding(
                "startup_overhead",
                F.col("short_run") & (F.col("cost_per_run") > STARTUP_COST_PER_RUN),
                "medium",
                F.format_string("Runs %.0f s on average; starting costs more", F.col("avg_duration_seconds")),
                none,
                F.col("cost_per_run"),
            ),
            finding(
                "variable_duration",
                (F.col("duration_variance") > VARIABLE_SECONDS)
                & (F.col("run_count") > VARIABLE_MIN_RUNS),
                "low",
                F.format_string("Run times differ by %.0f s", F.col("duration_variance")),
                none,
                F.col("duration_variance"),
            ),
        ],
        "job_rank",
        "run_count",
        "cost_per_run",
        "avg_duration_seconds",
    )


def high_cost_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("total_cost") > HIGH_COST).select(
        "job_id",
        F.coalesce("job_name", "job_id").alias("job_name"),
        "total_cost",
        "total_dbus",
        "run_count",
        "avg_duration_seconds",
        "cost_per_run",
        "job_rank",
    )


def job_totals(jobs: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: cost, cost of failed runs, and jobs with inefficiencies."""
    inefficient = F.col("type").isin(*EFFICIENCY_ISSUES)
    found = issues.agg(
        F.struct(
            total("estimated_savings").alias("wasted"),
            F.count_distinct(F.when(inefficient, F.col("resource_id"))).alias("jobs"),
        )
    ).scalar()
    return jobs.agg(
        F.count("*").alias("job_count"), rounded(total("total_cost"), 2).alias("total_job_cost")
    ).select(
        "*",
        rounded(found["wasted"], 2).alias("total_wasted_on_failures"),
        found["jobs"].alias("jobs_with_issues"),
    )
