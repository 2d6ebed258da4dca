"""Report tables on top of the analysis results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import effort_minutes, ratio, rounded, settled, total
from ..operators.costs import cluster_names

# ---- fixed values -------------------------------------------------------------
MAX_SAVINGS_SHARE = 0.95
GRADES = ((40, "F"), (30, "D"), (20, "C"), (10, "B"))
BEST_GRADE = "A"
BENCHMARK_BANDS = ((35, "HIGH"), (20, "MEDIUM"), (10, "LOW"))
LOWEST_BAND = "VERY LOW"
IMPACT_TIERS = (
    (100_000, "1-2 headcount equivalents"),
    (50_000, "~1 mid-level engineer salary"),
    (20_000, "~3-4 months runway extension"),
)
SMALLEST_TIER = "meaningful cost reduction"
NO_TIMELINE = "N/A (no optimization opportunities found)"
TIMELINES = ((3, "2-3 weeks"), (1, "1-2 weeks"))
SLOWEST_TIMELINE = "2-4 weeks"
PHASES = {"high": 1, "medium": 2, "low": 3}
OTHER_USERS = "(Other users)"
UNATTRIBUTED = "(System/Unattributed)"
UNATTRIBUTED_MIN = 0.01
TOP_DRIVERS = 5
# -------------------------------------------------------------------------------


def _band(value: Column, steps, lowest: str) -> Column:
    band = F.lit(lowest)
    for limit, name in reversed(steps):
        band = F.when(value >= limit, name).otherwise(band)
    return band


def executive_summary(recommendations: DataFrame, projection: DataFrame) -> DataFrame:
    """One row: spend, capped savings and recommendations by severity."""
    severity = F.col("severity")
    monthly = projection.select("estimated_monthly_cost").scalar()
    sums = recommendations.agg(
        total("estimated_savings").alias("raw_savings"),
        F.count("*").alias("recommendations"),
        F.count_if(severity == "high").alias("high_count"),
        F.count_if(severity == "medium").alias("medium_count"),
        F.count_if(severity == "low").alias("low_count"),
    ).withColumn("monthly_cost", monthly)
    saved = sums.withColumn(
        "monthly_savings", settled(F.least("raw_savings", F.col("monthly_cost") * MAX_SAVINGS_SHARE))
    )
    return saved.select(
        "monthly_cost",
        settled(F.col("monthly_cost") * 12).alias("annual_spend"),
        "raw_savings",
        "monthly_savings",
        (F.col("raw_savings") > F.col("monthly_savings")).alias("savings_capped"),
        settled(F.col("monthly_savings") * 12).alias("annual_savings"),
        settled(ratio(F.col("monthly_savings"), F.col("monthly_cost")) * 100).alias("savings_percentage"),
        "recommendations",
        "high_count",
        "medium_count",
        "low_count",
    )


def assessment(summary: DataFrame) -> DataFrame:
    """One row: grade, benchmark band, impact tier and timeline."""
    share, high = F.col("savings_percentage"), F.col("high_count")
    timeline = F.when(F.col("recommendations") == 0, NO_TIMELINE).otherwise(
        _band(high, TIMELINES, SLOWEST_TIMELINE)
    )
    return summary.select(
        "savings_percentage",
        "annual_savings",
        _band(share, GRADES, BEST_GRADE).alias("grade"),
        _band(share, BENCHMARK_BANDS, LOWEST_BAND).alias("benchmark_band"),
        _band(F.col("annual_savings"), IMPACT_TIERS, SMALLEST_TIER).alias("impact_tier"),
        timeline.alias("timeline"),
    )


def twelve_months(summary: DataFrame) -> DataFrame:
    """Cumulative cost on the present and on the improved path."""
    left = F.col("monthly_cost") - F.col("monthly_savings")
    month = F.col("month")
    return summary.select("*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")).select(
        "month",
        settled(F.col("monthly_cost") * month).alias("current_path"),
        settled(F.greatest(left * month, F.lit(0.0))).alias("optimized_path"),
        settled(F.col("monthly_savings") * month).alias("cumulative_savings"),
    )


def product_breakdown(rollup: DataFrame, totals: DataFrame) -> DataFrame:
    whole = totals.select("total_cost").scalar()
    return rollup.filter(F.col("dim") == "product").select(
        F.col("key").alias("product"),
        "dbus",
        "cost",
        rounded(ratio(F.col("cost"), whole) * 100, 1).alias("percent_of_total"),
    )


def compute_breakdown(projection: DataFrame) -> DataFrame:
    """Serverless and classic compute; no rows when nothing was paid."""
    row = lambda name, share: F.struct(
        F.lit(name).alias("compute_type"),
        F.col(f"{name}_dbus").alias("dbus"),
        F.col(f"{name}_cost").alias("cost"),
        rounded(share, 1).alias("percent_of_total"),
    )
    share = F.col("serverless_percentage")
    return (
        projection.filter((F.col("serverless_cost") > 0) | (F.col("classic_cost") > 0))
        .select(F.inline(F.array(row("serverless", share), row("classic", 100 - share))))
    )


def weekday_breakdown(by_day: DataFrame) -> DataFrame:
    whole = by_day.agg(total("total_dbus")).scalar()
    return by_day.select(
        "day_of_week",
        "day_name",
        "total_dbus",
        rounded(ratio(F.col("total_dbus"), whole) * 100, 1).alias("percent_of_total"),
    )


def user_breakdown(top: DataFrame, rollup: DataFrame, totals: DataFrame) -> DataFrame:
    """Cost of the top users, of all others, and of what no user caused."""
    whole = totals.select("total_cost").scalar()
    users = top.filter(F.col("dim") == "user")
    share = lambda cost: rounded(ratio(cost, whole) * 100, 1).alias("percent_of_total")
    listed = users.select("rank", F.col("id").alias("user"), "dbus", "cost", share(F.col("cost")))
    shown = users.agg(total("cost").alias("shown"))
    sums = rollup.filter(F.col("dim") == "user").agg(total("cost").alias("attributed"))
    attributed = F.coalesce(sums.scalar(), F.lit(0.0))

    def remainder(label: str, cost: Column) -> DataFrame:
        row = shown.select(
            F.lit(None).cast("int").alias("rank"),
            F.lit(label).alias("user"),
            F.lit(None).cast("double").alias("dbus"),
            settled(cost).alias("cost"),
        )
        return row.filter(F.col("cost") > UNATTRIBUTED_MIN).select("*", share(F.col("cost")))

    others = remainder(OTHER_USERS, attributed - F.coalesce("shown", F.lit(0.0)))
    return listed.unionByName(others).unionByName(remainder(UNATTRIBUTED, whole - attributed))


def status_distribution(statuses: DataFrame) -> DataFrame:
    """Analysed clusters by status."""
    whole = statuses.agg(F.count("*").cast("double")).scalar()
    return statuses.groupBy("overall_status").agg(
        F.count("*").alias("clusters"), rounded(total("total_dbus"), 2).alias("dbus")
    ).select(
        "overall_status",
        "clusters",
        rounded(ratio(F.col("clusters").cast("double"), whole) * 100, 1).alias("percent"),
        "dbus",
    )


def roadmap(recommendations: DataFrame) -> DataFrame:
    """Savings per minute of effort, and the phase to act in."""
    minutes = effort_minutes(F.col("effort"))
    phase = F.lit(None).cast("int")
    for severity, number in PHASES.items():
        phase = F.when(F.col("severity") == severity, number).otherwise(phase)
    return recommendations.select(
        "id",
        "resource_id",
        "severity",
        "estimated_savings",
        settled(F.col("estimated_savings") * 12).alias("annual_savings"),
        "effort",
        settled(minutes).alias("effort_minutes"),
        settled(ratio(F.col("estimated_savings"), minutes)).alias("savings_per_minute"),
        phase.alias("phase"),
    )


def top_jobs(named_top: DataFrame, jobs: DataFrame, limit: int = TOP_DRIVERS) -> DataFrame:
    """Costliest jobs with runs and cost per run, from the job's last row by cost."""
    detail = jobs.groupBy(F.col("job_id").cast("string").alias("id")).agg(
        F.max_by("run_count", "job_rank").alias("run_count"),
        F.max_by("cost_per_run", "job_rank").alias("cost_per_run"),
    )
    with_runs = F.col("run_count") > 0
    return (
        named_top.filter((F.col("dim") == "job") & (F.col("rank") <= limit))
        .join(detail, "id", "left")
        .select(
            "rank",
            "id",
            "name",
            F.when(with_runs, F.col("run_count")).alias("run_count"),
            "dbus",
            F.when(with_runs, F.col("cost_per_run")).alias("cost_per_run"),
            "cost",
        )
    )


def top_interactive_clusters(
    rollup: DataFrame, clusters: DataFrame, cluster_costs: DataFrame, limit: int = TOP_DRIVERS
) -> DataFrame:
    """The costliest of all clusters that no job run started; ``rank`` is the place among these."""
    name = F.coalesce("name", F.lit(""))
    job_run = name.startswith("job-") & name.contains("-run-")
    listed = (
        rollup.filter(F.col("dim") == "cluster")
        .select(F.col("key").alias("id"), "dbus", "cost")
        .join(cluster_names(clusters, cluster_costs), "id", "left")
        .filter(~job_run)
        .orderBy(F.col("cost").desc(), "id")
        .limit(limit)
    )
    rank = F.row_number().over(Window.orderBy(F.col("cost").desc(), "id"))
    return listed.select(rank.alias("rank"), "id", "name", "dbus", "cost")


def governance(tag_coverage: DataFrame, weekend: DataFrame, projection: DataFrame) -> DataFrame:
    """One row: what untagged and weekend usage cost a month, by their parts of the DBUs."""
    monthly = projection.select("estimated_monthly_cost").scalar()
    days = weekend.select(F.struct("weekend_dbus", "weekend_percentage", "weekend_to_weekday_ratio").alias("w")).scalar()
    share = F.col("untagged_percentage")
    return tag_coverage.withColumns({"monthly_cost": monthly, "w": days}).select(
        "monthly_cost",
        "untagged_dbus",
        settled(F.col("tagged_dbus") + F.col("untagged_dbus")).alias("total_dbus"),
        settled(100 - share).alias("tagged_percentage"),
        share.alias("untagged_percentage"),
        rounded(F.col("monthly_cost") * share / 100, 2).alias("untagged_monthly_cost"),
        "w.weekend_dbus",
        "w.weekend_percentage",
        "w.weekend_to_weekday_ratio",
        rounded(F.col("monthly_cost") * F.col("w.weekend_percentage") / 100, 2).alias("weekend_monthly_cost"),
    )
