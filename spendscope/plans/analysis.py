"""All results of one analysis, each built on first use."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, partial

from pyspark.sql import DataFrame

from ..operators import clusters, costs, jobs, pricing, query_history, rules, usage, utilization, versions, warehouses
from ..session import cut_lineage
from ..sources import profile
from ..sources.registry import AnalysisWindow, SourceTables
from . import report
from .store import ResultStore

# Results that several others read, in waves: each depends on earlier waves only.
SHARED = (
    ("rollup", "cluster_usage", "worker_hours", "jobs", "user_stats", "select_totals", "daily"),
    ("metrics", "totals", "top", "cluster_costs", "warehouses", "job_issues", "idle_clusters", "autoscale"),
    ("cluster_issues", "utilization_summary"),
)


class Analysis:
    """Lazy results over the bound sources.

    With ``reuse`` the results that several others read are computed once and stored
    (see ``cut_lineage``): usage is then read four times, node metrics three times for
    the whole report. What is stored is sums per resource, per cluster and hour, or top
    lists; with a ``store`` it is kept there under its name. Without ``reuse`` every result is
    a plain plan over the sources, but for ranks over all rows and percentiles, which store
    what they read more than once. ``confidence`` is the part of estimated savings that counts.
    """

    def __init__(
        self,
        tables: SourceTables,
        window: AnalysisWindow,
        *,
        reuse: bool = False,
        store: ResultStore | None = None,
        top_n: int | None = None,
        limits: utilization.Thresholds = utilization.Thresholds(),
        confidence: float = rules.CONFIDENCE,
    ):
        self.tables = tables
        self.window = window
        self.reuse = reuse or store is not None
        self.store = store
        self.confidence = confidence
        self.top_n = top_n
        self.limits = limits

    def _keep(self, name: str, df: DataFrame) -> DataFrame:
        if self.store:
            return self.store.keep(name, df)
        return cut_lineage(df) if self.reuse else df

    def _stored(self, name: str) -> DataFrame | None:
        """A result of an earlier run, before anything of it is computed."""
        return self.store.get(name) if self.store else None

    def prepare(self, at_once: int = 4) -> None:
        """Compute the results that several others read, those that don't depend on each other together."""
        with ThreadPoolExecutor(at_once) as pool:
            for wave in SHARED:
                list(pool.map(partial(getattr, self), wave))

    # ---- usage ----------------------------------------------------------------
    @cached_property
    def priced(self) -> DataFrame:
        return pricing.priced_usage(self.tables, self.window)

    @cached_property
    def list_priced(self) -> DataFrame:
        """Cluster and job costs always use list prices."""
        return pricing.list_priced_usage(self.tables, self.window)

    @cached_property
    def totals(self) -> DataFrame:
        if self.reuse:
            return self._keep("totals", usage.totals_of(self.rollup))
        return pricing.cost_totals(pricing.cost_lines(self.priced))

    @cached_property
    def rollup(self) -> DataFrame:
        return self._keep("rollup", usage.cost_by_dimension(pricing.cost_lines(self.priced)))

    @cached_property
    def top(self) -> DataFrame:
        return self._keep("top", usage.top_items(self.rollup))

    @cached_property
    def projection(self) -> DataFrame:
        return costs.monthly_projection(self.totals, self.window)

    @cached_property
    def daily(self) -> DataFrame:
        return self._keep("daily", usage.daily_usage(self.tables["usage"], self.window))

    @cached_property
    def tag_coverage(self) -> DataFrame:
        return usage.tag_coverage(self.daily)

    @cached_property
    def by_day(self) -> DataFrame:
        return usage.weekday_usage(self.daily)

    @cached_property
    def weekend(self) -> DataFrame:
        return usage.weekend_pattern(self.by_day)

    # ---- clusters and jobs ----------------------------------------------------
    @cached_property
    def cluster_costs(self) -> DataFrame:
        if self.reuse and not self.tables.has("account_prices"):
            per_cluster = clusters.cluster_costs_of(self.rollup)
        else:
            per_cluster = clusters.cluster_usage_cost(self.list_priced)
        return self._keep("cluster_costs", clusters.interactive_cluster_costs(per_cluster, self.tables["clusters"]))

    @cached_property
    def cluster_issues(self) -> DataFrame:
        return self._keep("cluster_issues", clusters.cluster_issues(self.tables["clusters"], self.cluster_costs))

    @cached_property
    def job_costs(self) -> DataFrame:
        return jobs.job_costs(self.list_priced, self.tables)

    @cached_property
    def run_metrics(self) -> DataFrame:
        return jobs.run_metrics(jobs.job_runs(self.tables["job_run_timeline"], self.window))

    @cached_property
    def jobs(self) -> DataFrame:
        return self._stored("jobs") or self._keep("jobs", jobs.job_efficiency(self.job_costs, self.run_metrics))

    @cached_property
    def job_issues(self) -> DataFrame:
        return self._keep("job_issues", jobs.job_issues(self.jobs))

    @cached_property
    def job_totals(self) -> DataFrame:
        return jobs.job_totals(self.jobs, self.job_issues)

    # ---- utilization ----------------------------------------------------------
    @cached_property
    def utilization_available(self) -> bool:
        return self.tables.has("node_timeline")

    @cached_property
    def node_timeline(self) -> DataFrame:
        """Node metrics; without them the utilization results have no rows."""
        return self.tables.within("node_timeline", "start_time", self.window.metrics_start)

    @cached_property
    def cluster_usage(self) -> DataFrame:
        return self._keep("cluster_usage", utilization.cluster_usage(self.tables["usage"], self.window))

    @cached_property
    def targets(self) -> DataFrame:
        return self._keep("targets", utilization.target_clusters(self.cluster_usage, self.top_n))

    @cached_property
    def metrics(self) -> DataFrame:
        if stored := self._stored("metrics"):
            return stored
        profiled = utilization.cluster_metrics(
            self.node_timeline, self.targets, self.tables["clusters"], self.window, self.limits
        )
        return self._keep("metrics", utilization.classify(profiled, self.limits))

    @cached_property
    def cluster_status(self) -> DataFrame:
        return utilization.cluster_status(self.metrics)

    @cached_property
    def utilization_summary(self) -> DataFrame:
        return self._keep("utilization_summary", utilization.utilization_summary(self.cluster_status))

    @cached_property
    def imbalance(self) -> DataFrame:
        return utilization.driver_worker_imbalance(self.metrics)

    @cached_property
    def worker_hours(self) -> DataFrame:
        return self._keep("worker_hours", utilization.worker_hours(self.node_timeline, self.window))

    @cached_property
    def idle_clusters(self) -> DataFrame:
        return self._keep(
            "idle_clusters", utilization.idle_clusters(self.worker_hours, self.cluster_usage, self.tables["clusters"])
        )

    @cached_property
    def autoscale(self) -> DataFrame:
        stats = utilization.autoscale_stats(self.worker_hours, self.cluster_usage, self.tables["clusters"])
        return self._keep("autoscale", utilization.autoscale_verdicts(stats))

    # ---- warehouses -----------------------------------------------------------
    @cached_property
    def warehouse_configs(self) -> DataFrame:
        return warehouses.warehouse_configs(self.tables["warehouses"])

    @cached_property
    def warehouses(self) -> DataFrame:
        if self.reuse:
            rollup = warehouses.warehouse_costs_of(self.rollup)
        else:
            rollup = warehouses.warehouse_cost_rollup(warehouses.warehouse_costs(self.priced))
        return self._keep("warehouses", warehouses.merge_costs(self.warehouse_configs, rollup))

    @cached_property
    def warehouse_issues(self) -> DataFrame:
        return warehouses.warehouse_issues(self.warehouses)

    @cached_property
    def long_running(self) -> DataFrame:
        return warehouses.long_running(
            self.tables["warehouse_events"], self.warehouse_configs, self.window.as_of
        )

    @cached_property
    def upscaled(self) -> DataFrame:
        return warehouses.upscaled(
            self.tables["warehouse_events"], self.warehouse_configs, self.window.as_of
        )

    @cached_property
    def idle_warehouses(self) -> DataFrame:
        return warehouses.idle(
            self.tables["warehouse_events"], self.warehouse_configs,
            self.tables["query_history"], self.window.as_of,
        )

    # ---- queries --------------------------------------------------------------
    @cached_property
    def user_stats(self) -> DataFrame:
        return self._keep("user_stats", query_history.user_stats(self.tables["query_history"], self.window))

    @cached_property
    def select_totals(self) -> DataFrame:
        return self._keep("select_totals", query_history.select_totals(self.tables["query_history"], self.window))

    @cached_property
    def pattern_counts(self) -> DataFrame:
        return query_history.pattern_counts(self.select_totals)

    @cached_property
    def query_totals(self) -> DataFrame:
        return query_history.query_totals(self.user_stats, self.select_totals)

    @cached_property
    def spill(self) -> DataFrame:
        return query_history.disk_spill(self.tables["query_history"], self.window)

    @cached_property
    def shuffle_heavy(self) -> DataFrame:
        return query_history.shuffle_heavy(self.tables["query_history"], self.window)

    # ---- named top lists ------------------------------------------------------
    @cached_property
    def named_top(self) -> DataFrame:
        return costs.name_top_items(
            self.top, self.jobs, self.cluster_costs, self.tables["clusters"], self.warehouses
        )

    @cached_property
    def top_interactive_clusters(self) -> DataFrame:
        return report.top_interactive_clusters(self.rollup, self.tables["clusters"], self.cluster_costs)

    @cached_property
    def governance(self) -> DataFrame:
        return report.governance(self.tag_coverage, self.weekend, self.projection)

    # ---- recommendations ------------------------------------------------------
    @cached_property
    def candidates(self) -> DataFrame:
        """Rows of all rules, in rule order."""
        if self.reuse:
            self.prepare()
        with rules.confidence_factor(self.confidence):
            found = self._rule_rows()
        return self._keep("candidates", rules.union_rules(found, self.totals))

    def _rule_rows(self) -> list[DataFrame]:
        found = [
            rules.auto_termination(self.cluster_issues),
            rules.warehouse_auto_stop(self.warehouses),
            rules.warehouse_sizing(self.warehouses),
            rules.long_running_warehouses(self.long_running),
            rules.upscaled_warehouses(self.upscaled),
            rules.idle_warehouses(self.idle_warehouses),
            rules.all_purpose_to_jobs(self.rollup),
            rules.acceleration_check(self.rollup),
            rules.serverless_job(self.jobs),
            rules.cluster_sizing(self.cluster_issues),
        ]
        if self.utilization_available:
            found += [
                rules.cluster_rightsizing(self.utilization_summary, self.metrics, self.totals),
                rules.idle_cluster_waste(self.idle_clusters, self.totals),
                rules.autoscale_findings(self.autoscale, self.totals),
                rules.imbalance_findings(self.imbalance),
            ]
        found += [
            rules.model_scale_to_zero(self.rollup),
            rules.job_efficiency(self.job_issues),
            rules.weekend_waste(self.weekend, self.totals),
            rules.spot_instances(self.jobs),
            rules.cluster_pools(self.job_issues, self.cluster_costs),
            rules.frequent_job(self.jobs),
            rules.tagging(self.tag_coverage),
            rules.table_layout(self.query_totals, self.rollup),
            rules.spill_upsizing(self.spill),
            rules.shuffle_findings(self.shuffle_heavy),
            rules.unfiltered_queries(self.query_totals, self.rollup),
            rules.cost_monitoring(self.projection),
        ]
        return found

    @cached_property
    def recommendations(self) -> DataFrame:
        """Distinct worthwhile recommendations, the severest first."""
        found = self._keep("recommendations", rules.worthwhile(rules.keep_first(self.candidates)))
        return rules.in_order(found)

    # ---- report ---------------------------------------------------------------
    @cached_property
    def summary(self) -> DataFrame:
        return self._keep("summary", report.executive_summary(self.recommendations, self.projection))

    def report_tables(self) -> dict[str, DataFrame]:
        """Every table of the report, by name."""
        history = self.tables["query_history"]
        return {
            "executive_summary": self.summary,
            "assessment": report.assessment(self.summary),
            "twelve_months": report.twelve_months(self.summary),
            "cost_projection": self.projection,
            "cost_by_dimension": self.rollup,
            "top_items": self.named_top,
            "product_breakdown": report.product_breakdown(self.rollup, self.totals),
            "compute_breakdown": report.compute_breakdown(self.projection),
            "weekday_breakdown": report.weekday_breakdown(self.by_day),
            "user_breakdown": report.user_breakdown(self.top, self.rollup, self.totals),
            "tag_usage": usage.tag_usage(self.tables["usage"], self.window),
            "tag_coverage": self.tag_coverage,
            "weekend_pattern": self.weekend,
            "clusters": versions.cluster_listing(self.tables["clusters"]),
            "cluster_costs": self.cluster_costs,
            "cluster_issues": self.cluster_issues,
            "jobs": self.jobs,
            "job_issues": self.job_issues,
            "job_totals": self.job_totals,
            "high_cost_jobs": jobs.high_cost_jobs(self.jobs),
            "job_runs": jobs.job_runs(self.tables["job_run_timeline"], self.window),
            "top_jobs": report.top_jobs(self.named_top, self.jobs),
            "top_interactive_clusters": self.top_interactive_clusters,
            "governance": self.governance,
            "cluster_metrics": self.metrics,
            "utilization_summary": self.utilization_summary,
            "status_distribution": report.status_distribution(self.cluster_status),
            "driver_worker_imbalance": self.imbalance,
            "idle_clusters": self.idle_clusters,
            "autoscale": self.autoscale,
            "warehouses": self.warehouses,
            "warehouse_issues": self.warehouse_issues,
            "warehouse_events": warehouses.recent_events(self.tables["warehouse_events"], self.window),
            "expected_savings": costs.expected_savings(self.warehouse_issues),
            "long_running_warehouses": self.long_running,
            "upscaled_warehouses": self.upscaled,
            "idle_warehouses": self.idle_warehouses,
            "user_stats": self.user_stats,
            "longest_queries": query_history.longest_queries(history, self.window),
            "query_patterns": query_history.pattern_findings(self.pattern_counts),
            "query_totals": self.query_totals,
            "disk_spill": self.spill,
            "spill_summary": query_history.spill_summary(self.spill),
            "shuffle_queries": query_history.top_shuffle(self.shuffle_heavy),
            "shuffle_by_warehouse": query_history.shuffle_by_warehouse(self.shuffle_heavy),
            "recommendations": self.recommendations,
            "roadmap": report.roadmap(self.recommendations),
            "source_profile": profile.source_profile(self.tables),
        }
