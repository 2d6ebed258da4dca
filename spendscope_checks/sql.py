"""DuckDB statements for the registered queries, written apart from the Spark code.

``PARTS`` are named sub-queries, ``STATEMENTS`` the final ones; a statement gets just
the parts it mentions, in a WITH clause.
"""

from __future__ import annotations

import re

from spendscope.operators.rules import RULES
from spendscope.operators.utilization import (
    ACTIONS, IO_SUFFIX, ON_SPOT_SUFFIX, SPIKE_SUFFIX, SWAP_PREFIX, TRY_SPOT_SUFFIX,
)
from spendscope.sources.sample_tables import VIEWS, view_sql

START, END = "DATE '2024-01-01'", "DATE '2024-01-30'"
START_TS, END_TS = "TIMESTAMP '2024-01-01 00:00:00'", "TIMESTAMP '2024-01-30 00:00:00'"
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
LATER = "TIMESTAMP '2024-02-02 12:00:00'"
JOB_NAME = "'^job-[0-9]+-run-[0-9]+'"
GIB = "1073741824.0"


def r2(x: str, digits: int = 2) -> str:
    """Round half up; on doubles DuckDB would round the binary value instead."""
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38, 6)), {digits}) AS DOUBLE)"


def money(x: str) -> str:
    return f"ROUND(COALESCE(SUM({x}), 0), 6)"


PARTS: dict[str, str] = {
    name: view_sql(name, table=str, numbers=lambda times: f"unnest(range({times}))") for name in VIEWS
}

# ---- usage --------------------------------------------------------------------
PARTS["period_usage"] = f"SELECT * FROM usage WHERE usage_date BETWEEN {START} AND {END}"
PARTS["metric_usage"] = "SELECT * FROM usage WHERE usage_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'"
PARTS["priced"] = """
SELECT u.*, u.usage_quantity * p.price AS dollar_cost
FROM period_usage u JOIN list_prices p ON p.sku_name = u.sku_name
WHERE u.usage_end_time >= p.price_start_time
 AND (p.price_end_time IS NULL OR u.usage_end_time < p.price_end_time)"""
PARTS["cost_totals"] = f"""
SELECT {money('usage_quantity')} AS total_dbus, {money('dollar_cost')} AS total_cost,
 {money('CASE WHEN is_serverless THEN dollar_cost END')} AS serverless_cost,
 {money('CASE WHEN is_serverless IS NOT TRUE THEN dollar_cost END')} AS classic_cost,
 {money('CASE WHEN is_serverless THEN usage_quantity END')} AS serverless_dbus,
 {money('CASE WHEN is_serverless IS NOT TRUE THEN usage_quantity END')} AS classic_dbus
FROM priced"""
_DIMS = {
    "product": "COALESCE(billing_origin_product, 'UNKNOWN')",
    "sku": "sku_name",
    "workspace": "CAST(workspace_id AS VARCHAR)",
    "cluster": "cluster_id",
    "job": "job_id",
    "warehouse": "warehouse_id",
    "user": "run_as",
}
PARTS["cost_rollup"] = " UNION ALL ".join(
    f"""SELECT '{dim}' AS dim, {key} AS key, {money('usage_quantity')} AS dbus, {money('dollar_cost')} AS cost,
 {money('CASE WHEN is_serverless THEN dollar_cost END')} AS serverless_cost,
 {money('CASE WHEN is_serverless IS NOT TRUE THEN dollar_cost END')} AS classic_cost
FROM priced WHERE {key} IS NOT NULL GROUP BY {key}"""
    for dim, key in _DIMS.items()
)
PARTS["user_cost"] = "SELECT COALESCE(SUM(cost), 0) AS of_users FROM cost_rollup WHERE dim = 'user'"
PARTS["top_ten"] = """
SELECT dim, row_number() OVER (PARTITION BY dim ORDER BY cost DESC, key) AS rank, key AS id, dbus, cost
FROM cost_rollup WHERE dim <> 'workspace' QUALIFY rank <= 10"""
PARTS["tag_status_usage"] = f"""
SELECT CASE WHEN tag_count = 0 THEN 'untagged' ELSE 'tagged' END AS tag_status,
 {money('usage_quantity')} AS total_dbus, COUNT(DISTINCT cluster_id) AS cluster_count,
 COUNT(DISTINCT job_id) AS job_count FROM period_usage GROUP BY 1"""
PARTS["tag_row"] = f"""
SELECT tagged_dbus, untagged_dbus, {r2('share', 1)} AS untagged_percentage, share > 20 AS has_tagging_gap
FROM (SELECT *, untagged_dbus / (tagged_dbus + untagged_dbus) * 100 AS share FROM (
 SELECT {money("CASE WHEN tag_status = 'tagged' THEN total_dbus END")} AS tagged_dbus,
  {money("CASE WHEN tag_status = 'untagged' THEN total_dbus END")} AS untagged_dbus FROM tag_status_usage))"""
PARTS["dow_usage"] = f"""
SELECT dayofweek(usage_date) + 1 AS day_of_week, dayname(usage_date) AS day_name,
 {money('usage_quantity')} AS total_dbus FROM period_usage GROUP BY 1, 2"""
PARTS["weekend_row"] = f"""
SELECT weekend_dbus, weekday_dbus, {r2('weekend_dbus / (weekend_dbus + weekday_dbus) * 100', 1)} AS weekend_percentage,
 {r2('(weekend_dbus / 2) / (weekday_dbus / 5)', 2)} AS weekend_to_weekday_ratio,
 (weekend_dbus / 2) / (weekday_dbus / 5) > 0.15 AND weekend_dbus > 10 AS has_weekend_waste
FROM (SELECT {money('CASE WHEN day_of_week IN (1, 7) THEN total_dbus END')} AS weekend_dbus,
 {money('CASE WHEN day_of_week NOT IN (1, 7) THEN total_dbus END')} AS weekday_dbus FROM dow_usage)"""
PARTS["projection"] = f"""
SELECT *, 29 AS period_days, {r2('total_dbus * (30 / 29)')} AS estimated_monthly_dbus,
 {r2('total_cost * (30 / 29)')} AS estimated_monthly_cost,
 {r2('serverless_cost / total_cost * 100', 1)} AS serverless_percentage FROM cost_totals"""

# ---- clusters -----------------------------------------------------------------
PARTS["clusters_latest"] = """
SELECT * FROM clusters c WHERE NOT EXISTS (
 SELECT 1 FROM clusters d WHERE d.cluster_id = c.cluster_id AND d.change_time > c.change_time)"""
PARTS["spot_flags"] = """
SELECT *, COALESCE(aws_availability, azure_availability) AS availability,
 CASE WHEN aws_availability IN ('SPOT', 'SPOT_WITH_FALLBACK') THEN true
  WHEN azure_availability IN ('SPOT_AZURE', 'SPOT_WITH_FALLBACK_AZURE') THEN true ELSE false END AS uses_spot
FROM clusters"""
PARTS["spot_latest"] = """
SELECT * FROM spot_flags QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY change_time DESC) = 1"""
PARTS["cluster_cost_all"] = f"""
SELECT p.cluster_id, c.cluster_name, c.owned_by AS owner, {money('p.usage_quantity')} AS total_dbus,
 {money('p.dollar_cost')} AS total_cost
FROM priced p LEFT JOIN clusters_latest c ON p.cluster_id = c.cluster_id
WHERE p.cluster_id IS NOT NULL GROUP BY 1, 2, 3"""
PARTS["cluster_costs"] = f"""
SELECT * FROM cluster_cost_all WHERE cluster_name IS NULL OR NOT regexp_matches(cluster_name, {JOB_NAME})
"""
PARTS["configured"] = f"""
SELECT c.*, COALESCE(k.total_cost, 0) AS cost, COALESCE(k.owner, c.owned_by) AS owner,
 CASE WHEN COALESCE(c.worker_count, 0) <> 0 THEN c.worker_count ELSE COALESCE(c.max_autoscale_workers, 0) END AS workers
FROM clusters_latest c LEFT JOIN cluster_costs k ON k.cluster_id = c.cluster_id
WHERE NOT regexp_matches(c.cluster_name, {JOB_NAME}, 'i')"""


def _cluster_issue(kind: str, severity: str, metric: str, where: str) -> str:
    return f"""SELECT 'cluster' AS domain, '{kind}' AS type, cluster_id AS resource_id, cluster_name AS resource_name,
 owner, {severity} AS severity, cost, CAST(NULL AS DOUBLE) AS estimated_savings, CAST({metric} AS DOUBLE) AS metric
FROM configured WHERE {where}"""


PARTS["cluster_issues"] = " UNION ALL ".join([
    _cluster_issue("no_autotermination", "'high'", "auto_termination_minutes", "auto_termination_minutes = 0"),
    _cluster_issue(
        "no_autoscaling", "'medium'", "worker_count",
        "worker_count <> 0 AND COALESCE(min_autoscale_workers, 0) = 0 AND COALESCE(max_autoscale_workers, 0) = 0"),
    _cluster_issue("oversized", "CASE WHEN workers >= 20 THEN 'high' ELSE 'medium' END", "workers", "workers >= 10"),
    _cluster_issue("high_min_workers", "'low'", "min_autoscale_workers", "min_autoscale_workers > 2"),
])

# ---- jobs ---------------------------------------------------------------------
PARTS["jobs_latest"] = """
SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY workspace_id, job_id ORDER BY change_time DESC) = 1"""
PARTS["job_clusters"] = f"""
SELECT cluster_id, uses_spot FROM spot_flags WHERE regexp_matches(cluster_name, {JOB_NAME})
QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY change_time DESC) = 1"""


def _job_costs(name: str, owner: str, join: str) -> str:
    return f"""
SELECT p.job_id, {name} AS job_name, {owner} AS owner, p.sku_name, p.is_serverless,
 bool_or(jc.uses_spot) AS uses_spot, {money('p.usage_quantity')} AS total_dbus, {money('p.dollar_cost')} AS total_cost,
 {money('CASE WHEN jc.uses_spot THEN p.dollar_cost END')} AS spot_cost,
 {money('CASE WHEN jc.uses_spot IS NOT TRUE THEN p.dollar_cost END')} AS on_demand_cost,
 COUNT(DISTINCT p.job_run_id) AS run_count,
 MIN(p.usage_end_time) - INTERVAL '1' HOUR AS first_run, MAX(p.usage_end_time) AS last_run
FROM priced p {join} LEFT JOIN job_clusters jc ON jc.cluster_id = p.cluster_id
WHERE p.job_id IS NOT NULL GROUP BY 1, 2, 3, 4, 5"""


PARTS["job_costs"] = _job_costs(
    "j.name", "j.creator_user_name",
    "LEFT JOIN jobs_latest j ON j.workspace_id = p.workspace_id AND j.job_id = p.job_id",
)
PARTS["job_costs_reduced"] = _job_costs("CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "")
PARTS["period_runs"] = f"""
SELECT *, date_sub('second', period_start_time, period_end_time) AS duration_seconds FROM job_run_timeline
WHERE period_start_time >= {START_TS} AND period_end_time <= {END_TS} AND result_state IS NOT NULL"""
PARTS["run_stats"] = """
SELECT job_id, COALESCE(AVG(duration_seconds) FILTER (duration_seconds > 0), 0) AS avg_duration,
 CAST(COALESCE(MIN(duration_seconds) FILTER (duration_seconds > 0), 0) AS DOUBLE) AS min_duration,
 CAST(COALESCE(MAX(duration_seconds) FILTER (duration_seconds > 0), 0) AS DOUBLE) AS max_duration,
 COUNT(*) FILTER (result_state = 'SUCCESS') AS success_count,
 COUNT(*) FILTER (result_state IN ('FAILED', 'TIMEDOUT', 'CANCELED')) AS failure_count
FROM period_runs GROUP BY job_id"""
PARTS["job_rows"] = f"""
SELECT k.*, row_number() OVER (ORDER BY total_cost DESC, k.job_id, sku_name, is_serverless NULLS FIRST,
  job_name NULLS FIRST, owner NULLS FIRST) AS job_rank,
 {r2('COALESCE(avg_duration, 0)', 1)} AS avg_duration_seconds,
 {r2('COALESCE(min_duration, 0)', 1)} AS min_duration_seconds, {r2('COALESCE(max_duration, 0)', 1)} AS max_duration_seconds,
 CASE WHEN run_count > 0 THEN {r2('total_cost / run_count', 4)} ELSE 0 END AS cost_per_run,
 COALESCE(success_count, 0) AS success_count, COALESCE(failure_count, 0) AS failure_count,
 COALESCE({r2('failure_count / NULLIF(success_count + failure_count, 0) * 100', 1)}, 0) AS failure_rate,
 {r2('COALESCE(max_duration, 0) - COALESCE(min_duration, 0)', 1)} AS duration_variance,
 COALESCE(avg_duration, 0) < 60 AND total_cost > 1 AS short_run
FROM job_costs k LEFT JOIN run_stats m ON m.job_id = k.job_id"""


def _job_issue(kind: str, severity: str, savings: str, metric: str, where: str) -> str:
    return f"""SELECT job_rank, 'job' AS domain, '{kind}' AS type, job_id AS resource_id,
 COALESCE(job_name, job_id) AS resource_name, owner, {severity} AS severity, total_cost AS cost,
 CAST({savings} AS DOUBLE) AS estimated_savings, CAST({metric} AS DOUBLE) AS metric FROM job_rows WHERE {where}"""


PARTS["job_issues"] = " UNION ALL ".join([
    _job_issue("high_cost", "'medium'", "NULL", "cost_per_run", "total_cost > 10"),
    _job_issue("serverless_candidate", "'low'", "NULL", "run_count", "is_serverless IS NOT TRUE AND run_count > 10"),
    _job_issue(
        "high_failure_rate", "CASE WHEN failure_rate > 25 THEN 'high' ELSE 'medium' END",
        r2("total_cost * (failure_rate / 100)"), "failure_rate", "failure_rate > 10 AND total_cost > 5"),
    _job_issue("startup_overhead", "'medium'", "NULL", "cost_per_run", "short_run AND cost_per_run > 0.10"),
    _job_issue("variable_duration", "'low'", "NULL", "duration_variance", "duration_variance > 300 AND run_count > 5"),
])

# ---- utilization --------------------------------------------------------------
PARTS["all_targets"] = """
SELECT cluster_id, ROUND(SUM(usage_quantity), 3) AS total_dbus, MIN(job_id) AS job_id FROM metric_usage
WHERE cluster_id IS NOT NULL AND (is_serverless = false OR is_serverless IS NULL)
GROUP BY cluster_id HAVING SUM(usage_quantity) > 10"""
PARTS["top_targets"] = "SELECT * FROM all_targets"


def _samples(targets: str) -> str:
    return f"""
SELECT n.cluster_id, CASE WHEN driver THEN 'driver' ELSE 'worker' END AS component,
 COALESCE(cpu_system_percent, 0) + COALESCE(cpu_user_percent, 0) + COALESCE(cpu_wait_percent, 0) AS cpu,
 COALESCE(cpu_wait_percent, 0) AS io_wait, COALESCE(mem_used_percent, 0) AS mem, COALESCE(mem_swap_percent, 0) AS swap
FROM node_timeline n JOIN {targets} t ON t.cluster_id = n.cluster_id WHERE start_time >= {START_TS}"""


def _share(condition: str) -> str:
    return r2(f"AVG(CASE WHEN {condition} THEN 1.0 ELSE 0.0 END)", 4)


def _percentiles(metric: str, points: tuple[int, ...]) -> str:
    return ", ".join(
        f"{r2(f'quantile_cont({metric}, {p / 100}) / 100', 4)} AS {metric}_p{p}" for p in points
    )


def _metrics(samples: str, targets: str) -> str:
    return f"""
SELECT m.*, c.cluster_name, t.total_dbus, t.job_id, CAST(NULL AS VARCHAR) AS node_type,
 c.min_autoscale_workers, c.max_autoscale_workers, c.availability, c.uses_spot,
 row_number() OVER (ORDER BY t.total_dbus DESC, m.cluster_id, m.component) AS metric_rank
FROM (SELECT cluster_id, component, COUNT(*) AS sample_count,
 {_percentiles('cpu', (25, 50, 75, 90, 99))}, {_percentiles('mem', (25, 50, 75, 90, 95, 99))},
 {r2('MAX(mem) / 100', 4)} AS mem_max, {r2('STDDEV(mem) / 100', 4)} AS mem_stddev, {_percentiles('io_wait', (50, 90))},
 {_share('io_wait >= 20')} AS io_wait_time_above_20pct, {r2('MAX(swap) / 100', 4)} AS swap_max,
 {_share('swap > 0')} AS swap_time_fraction, {_share('cpu >= 80')} AS cpu_time_above_80pct,
 {_share('cpu >= 90')} AS cpu_time_above_90pct, {_share('mem >= 90')} AS mem_time_above_90pct,
 {_share('mem >= 95')} AS mem_time_above_95pct
 FROM {samples} GROUP BY 1, 2 HAVING COUNT(*) >= 10) m
JOIN spot_latest c ON c.cluster_id = m.cluster_id JOIN {targets} t ON t.cluster_id = m.cluster_id"""


def _classes(metrics: str) -> str:
    return f"""
SELECT *, cpu_p90 >= 0.85 OR cpu_time_above_80pct >= 0.20 AS cpu_hot,
 cpu_p50 <= 0.40 AND cpu_time_above_80pct < 0.05 AS cpu_cold,
 mem_p95 >= 0.95 OR mem_time_above_90pct >= 0.20 AS mem_hot,
 mem_p50 <= 0.70 AND mem_time_above_90pct < 0.05 AS mem_cold,
 io_wait_p90 >= 0.15 OR io_wait_time_above_20pct >= 0.20 AS io_bound,
 mem_stddev >= 0.15 OR mem_p99 - mem_p50 >= 0.35 AS spiky,
 mem_stddev >= 0.25 OR mem_p99 - mem_p50 >= 0.50 AS very_spiky,
 swap_max >= 0.01 OR swap_time_fraction >= 0.05 AS swap_issue
FROM {metrics}"""


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _statuses(classes: str) -> str:
    def status(hot: str, cold: str) -> str:
        return f"CASE WHEN {hot} THEN 'under-provisioned' WHEN {cold} THEN 'over-provisioned' ELSE 'right-sized' END"

    return f"""
SELECT * EXCLUDE (cpu_hot, cpu_cold, mem_hot, mem_cold, spiky, very_spiky),
 {status('cpu_hot', 'cpu_cold')} AS cpu_status, {status('mem_hot', 'mem_cold')} AS mem_status,
 {status('cpu_hot OR mem_hot', 'cpu_cold OR mem_cold')} AS overall_status,
 CASE WHEN io_bound AND io_wait_p90 >= 0.25 THEN 'severe_io_bottleneck' WHEN io_bound THEN 'moderate_io_bottleneck' END AS io_issue,
 {r2('mem_p99 - mem_p50', 3)} AS mem_volatility,
 CASE WHEN spiky AND very_spiky THEN 'high' WHEN spiky THEN 'moderate' ELSE 'none' END AS mem_spike_risk,
 {r2('1 - cpu_p50', 3)} AS cpu_headroom_p50, {r2('1 - mem_p95', 3)} AS mem_headroom_p95,
 CASE WHEN swap_issue THEN {_q(SWAP_PREFIX)} ELSE '' END ||
 CASE WHEN mem_hot AND cpu_hot THEN {_q(ACTIONS['both_hot'])} WHEN mem_hot THEN {_q(ACTIONS['mem_hot'])}
  WHEN cpu_hot THEN {_q(ACTIONS['cpu_hot'])} WHEN mem_cold AND cpu_cold THEN {_q(ACTIONS['both_cold'])}
  WHEN mem_cold THEN {_q(ACTIONS['mem_cold'])} WHEN cpu_cold THEN {_q(ACTIONS['cpu_cold'])} ELSE {_q(ACTIONS['keep'])} END ||
 CASE WHEN io_bound AND io_wait_p90 >= 0.25 THEN {_q(IO_SUFFIX['severe_io_bottleneck'])}
  WHEN io_bound THEN {_q(IO_SUFFIX['moderate_io_bottleneck'])} ELSE '' END ||
 CASE WHEN spiky AND very_spiky THEN {_q(SPIKE_SUFFIX['high'])} WHEN spiky THEN {_q(SPIKE_SUFFIX['moderate'])} ELSE '' END ||
 CASE WHEN (mem_cold OR cpu_cold) AND uses_spot THEN {_q(ON_SPOT_SUFFIX)}
  WHEN mem_cold OR cpu_cold THEN {_q(TRY_SPOT_SUFFIX)} ELSE '' END AS suggested_action
FROM {classes}"""


for _name, _targets in (("all", "all_targets"), ("top", "top_targets")):
    PARTS[f"{_name}_samples"] = _samples(_targets)
    PARTS[f"{_name}_metrics"] = _metrics(f"{_name}_samples", _targets)
    PARTS[f"{_name}_classes"] = _classes(f"{_name}_metrics")
    PARTS[f"{_name}_statuses"] = _statuses(f"{_name}_classes")
    PARTS[f"{_name}_cluster_status"] = f"""
SELECT cluster_id, MAX(cluster_name) AS cluster_name, MAX(total_dbus) AS total_dbus,
 COALESCE(MAX(CASE WHEN component = 'worker' THEN overall_status END), MAX(overall_status)) AS overall_status,
 COALESCE(MAX(CASE WHEN component = 'worker' THEN suggested_action END), MAX(suggested_action)) AS suggested_action
FROM {_name}_statuses GROUP BY cluster_id"""
    PARTS[f"{_name}_pairs"] = f"""
SELECT d.cluster_id, d.cluster_name, d.total_dbus, d.cpu_p90 AS driver_cpu, w.cpu_p90 AS worker_cpu,
 d.mem_p95 AS driver_mem, w.mem_p95 AS worker_mem
FROM {_name}_metrics d JOIN {_name}_metrics w ON w.cluster_id = d.cluster_id
WHERE d.component = 'driver' AND w.component = 'worker'"""
    PARTS[f"{_name}_imbalance"] = f"""
SELECT cluster_id, cluster_name, total_dbus, issue, {r2('driver_cpu')} AS driver_cpu_p90, {r2('worker_cpu')} AS worker_cpu_p90,
 {r2('driver_mem')} AS driver_mem_p95, {r2('worker_mem')} AS worker_mem_p95
FROM (SELECT *, CASE WHEN driver_cpu > 0.7 AND worker_cpu < 0.3 THEN 'driver_cpu_bottleneck'
  WHEN driver_mem > 0.8 AND worker_mem < 0.5 THEN 'driver_memory_bottleneck'
  WHEN worker_cpu > 0.8 AND driver_cpu < 0.2 THEN 'workers_saturated_driver_idle' END AS issue FROM {_name}_pairs)
WHERE issue IS NOT NULL"""

_STATUS_SUM = "CASE WHEN overall_status = '{0}' THEN total_dbus END"
PARTS["utilization_row"] = f"""
SELECT COUNT(*) AS total_clusters_analyzed,
 COUNT(*) FILTER (overall_status = 'over-provisioned') AS over_provisioned_count,
 COUNT(*) FILTER (overall_status = 'under-provisioned') AS under_provisioned_count,
 COUNT(*) FILTER (overall_status = 'right-sized') AS right_sized_count,
 ROUND({money(_STATUS_SUM.format('over-provisioned'))}, 2) AS over_provisioned_dbus,
 ROUND({money(_STATUS_SUM.format('under-provisioned'))}, 2) AS under_provisioned_dbus,
 {r2(f"{money(_STATUS_SUM.format('over-provisioned'))} * 0.25")} AS potential_savings_dbus,
 (SELECT COUNT(*) FROM top_statuses WHERE component = 'worker' AND io_bound) AS io_bound_clusters,
 (SELECT COUNT(*) FROM top_statuses WHERE component = 'worker' AND mem_spike_risk = 'high') AS high_memory_spike_clusters,
 (SELECT COUNT(*) FROM top_statuses WHERE component = 'worker' AND swap_issue) AS swap_issue_clusters
FROM top_cluster_status"""
PARTS["cluster_dbus"] = f"""
SELECT cluster_id, {money('usage_quantity')} AS dbus FROM metric_usage WHERE cluster_id IS NOT NULL GROUP BY 1"""
PARTS["idle_all"] = f"""
SELECT u.cluster_id, COALESCE(c.cluster_name, u.cluster_id) AS cluster_name, {r2('avg_cpu')} AS avg_cpu_percent,
 {r2('max_cpu')} AS max_cpu_percent, {r2('idle_share * 100', 1)} AS pct_time_idle, COALESCE(d.dbus, 0) AS total_dbus,
 sample_count, ROUND(COALESCE(d.dbus, 0) * 0.8, 6) AS wasted_dbus_estimate, d.dbus AS known_dbus
FROM (SELECT cluster_id, AVG(cpu) AS avg_cpu, MAX(cpu) AS max_cpu,
  AVG(CASE WHEN cpu < 5 THEN 1.0 ELSE 0.0 END) AS idle_share, COUNT(*) AS sample_count
 FROM (SELECT cluster_id, COALESCE(cpu_user_percent, 0) + COALESCE(cpu_system_percent, 0) AS cpu
  FROM node_timeline WHERE start_time >= {START_TS} AND driver = false)
 GROUP BY cluster_id HAVING COUNT(*) >= 60) u
LEFT JOIN cluster_dbus d ON d.cluster_id = u.cluster_id LEFT JOIN clusters_latest c ON c.cluster_id = u.cluster_id
WHERE idle_share > 0.5 AND avg_cpu < 10"""
PARTS["idle_top"] = """
SELECT * EXCLUDE (known_dbus) FROM idle_all"""
PARTS["hourly"] = f"""
SELECT cluster_id, CAST(start_time AS DATE) AS usage_date, hour(start_time) AS usage_hour,
 COUNT(DISTINCT instance_id) AS active_workers
FROM node_timeline WHERE start_time >= {START_TS} AND driver = false GROUP BY 1, 2, 3"""
PARTS["scaling_all"] = f"""
SELECT s.cluster_id, c.cluster_name, c.min_autoscale_workers, c.max_autoscale_workers, ROUND(avg_workers, 6) AS avg_workers,
 min_observed_workers, max_observed_workers, ROUND(worker_stddev, 6) AS worker_stddev, sample_hours,
 COALESCE(d.dbus, 0) AS total_dbus,
 {r2('(avg_workers - c.min_autoscale_workers) / NULLIF(c.max_autoscale_workers - c.min_autoscale_workers, 0) * 100', 1)} AS scale_utilization_pct,
 d.dbus AS known_dbus
FROM (SELECT cluster_id, AVG(active_workers) AS avg_workers, MIN(active_workers) AS min_observed_workers,
  MAX(active_workers) AS max_observed_workers, STDDEV(active_workers) AS worker_stddev, COUNT(*) AS sample_hours
 FROM hourly GROUP BY cluster_id HAVING COUNT(*) >= 10) s
JOIN clusters_latest c ON c.cluster_id = s.cluster_id AND c.max_autoscale_workers > c.min_autoscale_workers
LEFT JOIN cluster_dbus d ON d.cluster_id = s.cluster_id"""
PARTS["scaling_top"] = """
SELECT * EXCLUDE (known_dbus) FROM scaling_all"""


def _verdicts(stats: str) -> str:
    return f"""
SELECT cluster_id, verdict, total_dbus,
 CASE WHEN verdict = 'never_scales_down' THEN ROUND(total_dbus * 0.15, 6) END AS wasted_dbus_estimate
FROM (SELECT *, CASE
  WHEN min_observed_workers >= max_autoscale_workers * 0.9 OR avg_workers >= max_autoscale_workers * 0.95 THEN 'never_scales_down'
  WHEN max_observed_workers <= min_autoscale_workers * 1.1 AND max_autoscale_workers > min_autoscale_workers * 1.5 THEN 'never_scales_up'
  WHEN COALESCE(worker_stddev, 0) < 0.5 AND max_autoscale_workers > min_autoscale_workers + 2 THEN 'low_variance'
  ELSE 'healthy' END AS verdict FROM {stats})"""


PARTS["verdicts_all"] = _verdicts("scaling_all")
PARTS["verdicts_top"] = _verdicts("scaling_top")

# ---- warehouses ---------------------------------------------------------------
PARTS["warehouse_costs"] = f"""
SELECT warehouse_id, is_serverless, sku_name, {money('usage_quantity')} AS total_dbus, {money('dollar_cost')} AS total_cost
FROM priced WHERE warehouse_id IS NOT NULL GROUP BY 1, 2, 3"""
PARTS["warehouse_rollup"] = f"""
SELECT warehouse_id, {money('usage_quantity')} AS total_dbus, {money('dollar_cost')} AS total_cost,
 {money('CASE WHEN is_serverless THEN dollar_cost END')} AS serverless_cost,
 {money('CASE WHEN is_serverless IS NOT TRUE THEN dollar_cost END')} AS classic_cost
FROM priced WHERE warehouse_id IS NOT NULL GROUP BY 1"""
PARTS["merged"] = """
SELECT w.warehouse_id, w.warehouse_name, w.warehouse_type, w.warehouse_size, w.min_clusters, w.max_clusters, w.auto_stop_minutes,
 COALESCE(r.total_dbus, 0) AS total_dbus, COALESCE(r.total_cost, 0) AS total_cost,
 COALESCE(r.serverless_cost, 0) AS serverless_cost, COALESCE(r.classic_cost, 0) AS classic_cost
FROM warehouses w LEFT JOIN warehouse_rollup r ON r.warehouse_id = w.warehouse_id
UNION ALL
SELECT r.warehouse_id, 'Unknown (' || r.warehouse_id || ')', NULL, NULL, NULL, NULL, NULL,
 r.total_dbus, r.total_cost, r.serverless_cost, r.classic_cost
FROM warehouse_rollup r WHERE r.warehouse_id NOT IN (SELECT warehouse_id FROM warehouses)"""


def _warehouse_issue(kind: str, severity: str, share: float, metric: str, where: str) -> str:
    return f"""SELECT 'warehouse' AS domain, '{kind}' AS type, warehouse_id AS resource_id, warehouse_name AS resource_name,
 CAST(NULL AS VARCHAR) AS owner, '{severity}' AS severity, total_cost AS cost,
 ROUND(total_cost * {share}, 6) AS estimated_savings, CAST({metric} AS DOUBLE) AS metric FROM merged WHERE {where}"""


PARTS["warehouse_issues"] = " UNION ALL ".join([
    _warehouse_issue("no_auto_stop", "high", 0.2, "auto_stop_minutes", "auto_stop_minutes = 0"),
    _warehouse_issue("long_auto_stop", "medium", 0.1, "auto_stop_minutes", "auto_stop_minutes > 30"),
    _warehouse_issue("oversized", "medium", 0.25, "NULL",
                     "total_cost > 0 AND upper(warehouse_size) IN ('2X-LARGE', '3X-LARGE', '4X-LARGE')"),
    _warehouse_issue("serverless_candidate", "low", 0.15, "NULL", "warehouse_type = 'CLASSIC' AND total_cost > 5"),
])
PARTS["running"] = """
SELECT * FROM warehouse_events we WHERE event_type = 'RUNNING' AND NOT EXISTS (
 SELECT 1 FROM warehouse_events we2 WHERE we2.warehouse_id = we.warehouse_id AND we2.event_time > we.event_time)"""
PARTS["scaled_up"] = """
SELECT * FROM warehouse_events we WHERE event_type = 'SCALED_UP' AND cluster_count >= 2 AND NOT EXISTS (
 SELECT 1 FROM warehouse_events we2 WHERE we2.warehouse_id = we.warehouse_id AND we2.event_time > we.event_time
 AND (we2.event_type IN ('SCALED_DOWN', 'STOPPED')
  OR (we2.event_type = 'SCALED_UP' AND we2.cluster_count < we.cluster_count)))"""


def _long_running(as_of: str) -> str:
    hours = f"date_sub('minute', e.event_time, {as_of}) / 60.0"
    return f"""
SELECT e.warehouse_id, COALESCE(w.warehouse_name, 'Unknown') AS warehouse_name, w.warehouse_size,
 {r2(hours)} AS running_hours, e.cluster_count, e.event_time
FROM running e LEFT JOIN warehouses w ON w.warehouse_id = e.warehouse_id WHERE {hours} > 1"""


def _activity(as_of: str) -> str:
    return f"""
SELECT warehouse_id, COUNT(*) AS query_count, MAX(start_time) + INTERVAL '1' MINUTE AS last_query_time
FROM query_history WHERE start_time >= CAST(CAST({as_of} AS DATE) - INTERVAL '1' DAY AS TIMESTAMP) GROUP BY 1"""


def _quiet(as_of: str) -> str:
    return f"(COALESCE(q.query_count, 0) = 0 OR date_sub('hour', q.last_query_time, {as_of}) > 2)"


def _idle_warehouses(as_of: str, activity: str) -> str:
    minutes = f"date_sub('minute', e.event_time, {as_of})"
    return f"""
SELECT DISTINCT e.warehouse_id, COALESCE(w.warehouse_name, 'Unknown') AS warehouse_name, w.warehouse_size,
 {r2(f'{minutes} / 60.0')} AS running_hours, COALESCE(q.query_count, 0) AS recent_query_count, q.last_query_time
FROM running e LEFT JOIN warehouses w ON w.warehouse_id = e.warehouse_id LEFT JOIN {activity} q ON q.warehouse_id = e.warehouse_id
WHERE {minutes} > 30 AND {_quiet(as_of)}"""


PARTS["long_running"] = _long_running(AS_OF)
PARTS["long_running_later"] = _long_running(LATER)
_UP_HOURS = f"date_sub('minute', e.event_time, {AS_OF}) / 60.0"
PARTS["upscaled"] = f"""
SELECT e.warehouse_id, COALESCE(w.warehouse_name, 'Unknown') AS warehouse_name, w.warehouse_size,
 CAST(COALESCE(w.max_clusters, 1) AS BIGINT) AS max_clusters, e.cluster_count AS current_clusters, {r2(_UP_HOURS)} AS upscaled_hours, e.event_time
FROM scaled_up e LEFT JOIN warehouses w ON w.warehouse_id = e.warehouse_id WHERE {_UP_HOURS} > 0.5"""
PARTS["activity"] = _activity(AS_OF)
PARTS["activity_later"] = _activity(LATER)
PARTS["idle_wh"] = _idle_warehouses(AS_OF, "activity")
PARTS["idle_wh_later"] = _idle_warehouses(LATER, "activity_later")

# ---- queries ------------------------------------------------------------------
PARTS["history"] = f"SELECT * FROM query_history WHERE start_time >= {START_TS} AND start_time <= {END_TS}"
PARTS["user_stats"] = f"""
SELECT executed_by AS "user", COUNT(*) AS query_count, CAST(SUM(read_rows) AS BIGINT) AS total_rows_read,
 CAST(SUM(read_files) AS BIGINT) AS total_files_read, CAST(SUM(total_task_duration_ms) AS DOUBLE) / 1000 AS total_duration_seconds,
 {r2('AVG(total_task_duration_ms) / 1000', 3)} AS avg_duration_seconds
FROM history WHERE executed_by IS NOT NULL GROUP BY 1"""
PARTS["text_flags"] = r"""
SELECT statement_id, regexp_matches(upper(statement_text), 'SELECT\s+\*') AS select_star,
 position('WHERE' IN upper(statement_text)) = 0 AND position('JOIN' IN upper(statement_text)) = 0 AS no_where_clause,
 len(regexp_extract_all(upper(statement_text), '\bJOIN\b')) >= 5 AS excessive_joins,
 read_rows > 10000000 AS large_result_sets, len(regexp_extract_all(upper(statement_text), '\bJOIN\b')) AS joins
FROM query_history"""
PARTS["sampled_flags"] = """
SELECT f.* FROM text_flags f JOIN (SELECT statement_id FROM history WHERE statement_type = 'SELECT') s
 ON s.statement_id = f.statement_id"""
PARTS["pattern_counts"] = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{p}' AS pattern, COUNT(*) AS count FROM sampled_flags WHERE {p}"
    for p in ("select_star", "no_where_clause", "excessive_joins", "large_result_sets")
) + ") WHERE count > 0"
PARTS["spill"] = f"""
SELECT warehouse_id, COUNT(*) AS spill_frequency, {r2(f'MAX(spilled_local_bytes) / {GIB}')} AS max_spilled_gb,
 {r2(f'SUM(spilled_local_bytes) / {GIB}')} AS total_spilled_gb, MAX(spilled_local_bytes) / {GIB} > 1 AS needs_upsize
FROM history WHERE spilled_local_bytes > 0 AND warehouse_id IS NOT NULL GROUP BY 1"""
PARTS["heavy"] = f"""
SELECT warehouse_id, statement_id, executed_by AS "user", substring(statement_text, 1, 200) AS statement_preview, shuffle_read_bytes,
 {r2(f'shuffle_read_bytes / {GIB}')} AS shuffle_gb, total_task_duration_ms / 1000 AS duration_seconds, read_rows
FROM (SELECT * FROM history WHERE shuffle_read_bytes > 0)
WHERE shuffle_read_bytes / {GIB} > 0.1"""
PARTS["query_row"] = """
SELECT (SELECT COALESCE(SUM(query_count), 0) FROM user_stats) AS query_count, (SELECT COUNT(*) FROM sampled_flags) AS select_count,
 (SELECT COUNT(*) FROM sampled_flags WHERE no_where_clause) AS no_where_clause,
 (SELECT COUNT(*) FROM sampled_flags WHERE large_result_sets) AS large_result_sets"""

# ---- names --------------------------------------------------------------------
PARTS["named_top"] = """
SELECT t.dim, t.rank, t.id, CASE t.dim
  WHEN 'job' THEN (SELECT arg_max(job_name, job_rank) FROM job_rows j WHERE j.job_id = t.id AND j.job_name IS NOT NULL)
  WHEN 'cluster' THEN COALESCE((SELECT MAX(cluster_name) FROM clusters_latest c WHERE c.cluster_id = t.id),
   (SELECT MAX(cluster_name) FROM cluster_costs k WHERE k.cluster_id = t.id))
  WHEN 'warehouse' THEN (SELECT MAX(warehouse_name) FROM merged m WHERE m.warehouse_id = t.id) END AS name, t.dbus, t.cost
FROM top_ten t"""

# ---- rules --------------------------------------------------------------------
_ORDER = {rule: (i, category, effort) for i, (rule, category, effort, _) in enumerate(RULES)}


def rec(rule, source, where, savings, severity, id=None, resource="CAST(NULL AS VARCHAR)",
        contact="CAST(NULL AS VARCHAR)", seq="0", factor=" * 0.75"):
    order, category, effort = _ORDER[rule]
    return f"""SELECT {id or _q(rule)} AS id, '{rule}' AS rule, {severity} AS severity, '{category}' AS category,
 {resource} AS resource_id, {contact} AS contact, CAST({r2(f'({savings}){factor}')} AS DOUBLE) AS estimated_savings, {_q(effort)} AS effort,
 {order} AS rule_order, CAST({seq} AS DOUBLE) AS seq FROM {source} WHERE {where}"""


def _id(prefix: str, column: str) -> str:
    return f"'{prefix}_' || {column}"


def _product(*products: str) -> str:
    listed = ", ".join(_q(p) for p in products)
    return f"""(SELECT COALESCE(SUM(cost), 0) AS cost, COALESCE(SUM(serverless_cost), 0) AS serverless_cost,
 COALESCE(SUM(classic_cost), 0) AS classic_cost, (SELECT total_cost FROM cost_totals) AS total_cost
FROM cost_rollup WHERE dim = 'product' AND key IN ({listed}))"""


_PRICE = "(SELECT CASE WHEN total_dbus > 0 THEN total_cost / total_dbus ELSE 0.50 END FROM cost_totals)"
_SQL_COST = "(SELECT COALESCE(SUM(cost), 0) FROM cost_rollup WHERE dim = 'product' AND key = 'SQL')"
_PAID = "total_cost > 0 AND NOT (contains(lower(warehouse_name), 'starter') AND total_cost < 1)"
_RATE = """CASE upper(warehouse_size) WHEN 'SMALL' THEN 2 WHEN 'MEDIUM' THEN 4 WHEN 'LARGE' THEN 8
 WHEN 'X-LARGE' THEN 16 WHEN '2X-LARGE' THEN 32 ELSE 4 END"""
_NOT_STARTER = "NOT contains(lower(warehouse_name), 'starter')"

RULE_SQL = {
    "auto_term": rec(
        "auto_term", "cluster_issues", "type = 'no_autotermination'", "cost * 0.4", "'high'", _id("auto_term", "resource_id"),
        "resource_id", "COALESCE(owner, 'Contact cluster owner')", "-cost"),
    "wh_auto_stop": rec(
        "wh_auto_stop", "merged", f"{_PAID} AND auto_stop_minutes = 0", "total_cost * 0.3", "'high'",
        _id("wh_auto_stop", "warehouse_id"), "warehouse_id", "'Contact SQL warehouse admin'", "-total_cost"),
    "wh_reduce_stop": rec(
        "wh_reduce_stop", "merged", f"{_PAID} AND auto_stop_minutes > 60", "total_cost * 0.1", "'medium'",
        _id("wh_reduce_stop", "warehouse_id"), "warehouse_id", seq="-total_cost"),
    "wh_size": rec(
        "wh_size", "merged", f"{_PAID} AND upper(warehouse_size) IN ('2X-LARGE', '3X-LARGE', '4X-LARGE')", "total_cost * 0.5",
        "'medium'", _id("wh_size", "warehouse_id"), "warehouse_id", seq="-total_cost"),
    "wh_min_clusters": rec(
        "wh_min_clusters", "merged", f"{_PAID} AND min_clusters > 1", "total_cost * 0.2", "'medium'",
        _id("wh_min_clusters", "warehouse_id"), "warehouse_id", seq="-total_cost"),
    "wh_long_run": rec(
        "wh_long_run", "long_running", f"running_hours > 4 AND {_NOT_STARTER}", f"running_hours * {_RATE} * cluster_count * 0.5",
        "CASE WHEN running_hours > 8 THEN 'high' ELSE 'medium' END", _id("wh_long_run", "warehouse_id"), "warehouse_id",
        seq=f"-running_hours * {_RATE} * cluster_count"),
    "wh_upscaled": rec(
        "wh_upscaled", "upscaled", "upscaled_hours > 1", "upscaled_hours * 4 * (current_clusters - 1)", "'medium'",
        _id("wh_upscaled", "warehouse_id"), "warehouse_id", seq="-upscaled_hours"),
    "wh_idle": rec(
        "wh_idle", "idle_wh", _NOT_STARTER, f"running_hours * {_RATE} * 0.7",
        "CASE WHEN running_hours > 4 THEN 'high' ELSE 'medium' END", _id("wh_idle", "warehouse_id"), "warehouse_id",
        seq="-running_hours"),
    "all_purpose_to_jobs": rec(
        "all_purpose_to_jobs", _product("INTERACTIVE", "ALL_PURPOSE"),
        "cost > 0 AND (cost / total_cost * 100 > 10 OR cost > 1)", "cost * 0.5",
        "CASE WHEN cost / total_cost * 100 > 25 THEN 'high' ELSE 'medium' END"),
    "evaluate_photon": "SELECT * FROM (" + rec(
        "evaluate_photon", _product("SQL"), "cost > 5",
        "CASE WHEN serverless_cost / cost * 100 < 80 THEN classic_cost * 0.3 ELSE cost * 0.05 END", "'low'",
        ) + ") WHERE estimated_savings >= 1",
    "serverless_job": rec(
        "serverless_job", """(SELECT * FROM job_rows WHERE is_serverless IS NOT TRUE AND run_count >= 3
 AND total_cost > 0.1)""", "true", "total_cost * 0.15", "'low'", _id("serverless_job", "job_id"), "job_id", seq="job_rank"),
    "autoscale": rec(
        "autoscale", "cluster_issues", "type = 'no_autoscaling'", "cost * 0.25", "'medium'", _id("autoscale", "resource_id"),
        "resource_id", seq="-cost"),
    "rightsize": rec(
        "rightsize", "cluster_issues", "type = 'oversized'", "cost * 0.4", "CASE WHEN metric >= 20 THEN 'high' ELSE 'medium' END",
        _id("rightsize", "resource_id"), "resource_id", seq="-cost"),
    "rightsize_overprovisioned": rec(
        "rightsize_overprovisioned", "utilization_row", "over_provisioned_count > 0 AND potential_savings_dbus > 10",
        f"potential_savings_dbus * {_PRICE}", "'high'"),
    "rightsize_underprovisioned": rec(
        "rightsize_underprovisioned", "utilization_row", "under_provisioned_count > 0", "0", "'medium'"),
    "rightsize_cluster": rec(
        "rightsize_cluster", "top_statuses", """overall_status = 'over-provisioned' AND component = 'worker'
 AND total_dbus > 50 AND cpu_headroom_p50 > 0.5""", f"total_dbus * 0.25 * {_PRICE}", "'medium'", _id("rightsize", "cluster_id"),
        "cluster_id", seq="metric_rank"),
    "idle_clusters": rec(
        "idle_clusters", f"(SELECT SUM(wasted_dbus_estimate) * {_PRICE} AS cost FROM idle_top)", "cost > 5", "cost", "'high'"),
    "autoscale_never_down": rec(
        "autoscale_never_down", f"(SELECT SUM(wasted_dbus_estimate) * {_PRICE} AS cost FROM verdicts_top)", "cost > 5", "cost", "'medium'"),
    "autoscale_never_up": rec(
        "autoscale_never_up", "(SELECT COUNT(*) AS n FROM verdicts_top WHERE verdict = 'never_scales_up')", "n >= 2", "0", "'low'"),
    "driver_cpu_bottleneck": rec(
        "driver_cpu_bottleneck", "(SELECT SUM(total_dbus) AS dbus FROM top_imbalance WHERE issue = 'driver_cpu_bottleneck')",
        "dbus IS NOT NULL", "dbus * 0.15 * 0.50", "'medium'", factor=""),
    "driver_memory_bottleneck": rec(
        "driver_memory_bottleneck", "(SELECT COUNT(*) AS n FROM top_imbalance WHERE issue = 'driver_memory_bottleneck')", "n > 0",
        "0", "'high'"),
    "model_scale_to_zero": rec("model_scale_to_zero", _product("MODEL_SERVING"), "cost >= 5", "cost * 0.5", "'medium'"),
    "job_failures": rec(
        "job_failures", "job_issues", "type = 'high_failure_rate' AND estimated_savings >= 1", "estimated_savings", "'high'",
        _id("job_failures", "resource_id"), "resource_id", seq="job_rank"),
    "job_startup": rec(
        "job_startup", "job_issues", "type = 'startup_overhead' AND metric >= 0.10", "metric * 10 * 0.5", "'medium'",
        _id("job_startup", "resource_id"), "resource_id", seq="job_rank"),
    "weekend_waste": rec(
        "weekend_waste", """(SELECT (SELECT total_cost FROM cost_totals) * (weekend_percentage / 100) * 0.7 AS wasted FROM weekend_row
 WHERE has_weekend_waste AND weekend_dbus > 10)""", "true", "wasted", "CASE WHEN wasted > 50 THEN 'high' ELSE 'medium' END"),
    "use_spot_instances": rec(
        "use_spot_instances", f"""(SELECT {money('total_cost')} AS cost, {money('spot_cost')} AS spot, {money('on_demand_cost')} AS on_demand
 FROM job_rows)""", "on_demand > 0.5 AND spot / cost * 100 <= 80", "on_demand * 0.6", "'medium'"),
    "cluster_pools_startup": rec(
        "cluster_pools_startup", f"(SELECT COUNT(*) AS n, {money('cost')} AS cost FROM job_issues WHERE type = 'startup_overhead')",
        "n >= 2", "cost * 0.3", "'medium'"),
    "use_cluster_pools": rec(
        "use_cluster_pools", f"""(SELECT COUNT(*) AS n, {money('total_cost')} AS cost,
 (SELECT COUNT(*) FROM job_issues WHERE type = 'startup_overhead') AS short FROM cluster_costs)""",
        "n >= 2 AND cost > 1 AND short < 2", "cost * 0.05", "'low'"),
    "job_freq": rec(
        "job_freq", """(SELECT * FROM job_rows WHERE run_count >= 20 AND total_cost > 0.5)""", "true", "total_cost * 0.3", "'low'",
        _id("job_freq", "job_id"), "job_id", seq="job_rank"),
    "implement_tagging": rec(
        "implement_tagging", "tag_row", "has_tagging_gap AND untagged_percentage > 20", "untagged_dbus * 0.50 * 0.1",
        "CASE WHEN untagged_percentage > 50 THEN 'high' ELSE 'medium' END"),
    "delta_optimization": rec(
        "delta_optimization", f"(SELECT *, {_SQL_COST} AS sql_cost FROM query_row)",
        "sql_cost > 10 AND (large_result_sets > 5 OR query_count > 100)", "sql_cost * 0.15", "'low'"),
    "disk_spill": rec(
        "disk_spill", "spill", "needs_upsize", "0", "'medium'", _id("disk_spill", "warehouse_id"), "warehouse_id",
        seq="-spill_frequency"),
    "shuffle_heavy_queries": rec("shuffle_heavy_queries", "(SELECT COUNT(*) AS n FROM heavy)", "n >= 5", "0", "'low'"),
    "sql_partitioning": rec(
        "sql_partitioning", f"(SELECT *, {_SQL_COST} AS sql_cost FROM query_row)",
        """select_count > 0 AND sql_cost >= 1 AND no_where_clause / select_count * 100 > 30 AND no_where_clause > 20""",
        "sql_cost * 0.1", "'low'"),
    "cost_monitoring": rec("cost_monitoring", "projection", "true", "estimated_monthly_cost * 0.05", "'low'"),
}
for _rule, _sql in RULE_SQL.items():
    PARTS[f"rule_{_rule}"] = _sql
PARTS["candidates"] = " UNION ALL ".join(
    f"SELECT * FROM rule_{rule}" for rule, *_ in RULES
)
PARTS["guarded"] = """
SELECT * FROM candidates WHERE (SELECT total_dbus <> 0 AND total_cost <> 0 FROM cost_totals)"""
PARTS["first_by_id"] = """
SELECT * FROM guarded QUALIFY row_number() OVER (PARTITION BY id ORDER BY rule_order, seq, resource_id NULLS FIRST) = 1"""
PARTS["first_by_resource"] = """
SELECT * FROM guarded QUALIFY row_number() OVER (
 PARTITION BY rule, COALESCE(resource_id, id) ORDER BY rule_order, seq, resource_id NULLS FIRST) = 1"""
PARTS["final_recs"] = "SELECT * FROM first_by_resource WHERE estimated_savings >= 1.0"

# ---- report -------------------------------------------------------------------
PARTS["summary_row"] = """
SELECT monthly_cost, ROUND(monthly_cost * 12, 6) AS annual_spend, raw_savings, monthly_savings,
 raw_savings > monthly_savings AS savings_capped, ROUND(monthly_savings * 12, 6) AS annual_savings,
 ROUND(monthly_savings / monthly_cost * 100, 6) AS savings_percentage, recommendations, high_count, medium_count, low_count
FROM (SELECT *, ROUND(LEAST(raw_savings, monthly_cost * 0.95), 6) AS monthly_savings FROM (
 SELECT ROUND(COALESCE(SUM(estimated_savings), 0), 6) AS raw_savings, COUNT(*) AS recommendations,
  COUNT(*) FILTER (severity = 'high') AS high_count, COUNT(*) FILTER (severity = 'medium') AS medium_count,
  COUNT(*) FILTER (severity = 'low') AS low_count, (SELECT estimated_monthly_cost FROM projection) AS monthly_cost
 FROM final_recs))"""

REC = "id, rule, severity, category, resource_id, contact, estimated_savings, effort"
METRICS = (
    "cluster_id, component, sample_count, cpu_p25, cpu_p50, cpu_p75, cpu_p90, cpu_p99, mem_p25, mem_p50, mem_p75, mem_p90, mem_p95,"
    " mem_p99, mem_max, mem_stddev, io_wait_p50, io_wait_p90, io_wait_time_above_20pct, swap_max, swap_time_fraction,"
    " cpu_time_above_80pct, cpu_time_above_90pct, mem_time_above_90pct, mem_time_above_95pct"
)
ISSUES = "domain, type, resource_id, resource_name, owner, severity, cost, estimated_savings, metric"


def _rules(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT {REC} FROM rule_{name}" for name in names)


STATEMENTS: dict[str, str] = {
    "s1_read_source": """SELECT statement_id, executed_by, warehouse_id, statement_type, statement_text, read_rows, start_time,
 start_time + INTERVAL '1' MINUTE AS end_time FROM query_history""",
    "s2_contract_prices": """SELECT ROUND(SUM(usage_quantity), 6) AS total_dbus, ROUND(SUM(dollar_cost * 0.9), 6) AS total_cost,
 ROUND(SUM(dollar_cost * 0.9) FILTER (is_serverless), 6) AS serverless_cost,
 ROUND(SUM(dollar_cost * 0.9) FILTER (is_serverless IS NOT TRUE), 6) AS classic_cost,
 ROUND(SUM(usage_quantity) FILTER (is_serverless), 6) AS serverless_dbus,
 ROUND(SUM(usage_quantity) FILTER (is_serverless IS NOT TRUE), 6) AS classic_dbus FROM priced""",
    "s2_fallback_to_list_prices": "SELECT * FROM cost_totals",
    "s3_job_costs_without_jobs": """SELECT job_id, job_name, owner, sku_name, is_serverless, total_cost, run_count
FROM job_costs_reduced""",
    "s4_missing_node_timeline": "SELECT cluster_id, total_dbus, 0 AS sample_count, false AS available FROM top_targets",
    "s5_source_profile": " UNION ALL ".join(
        f"SELECT '{name}' AS source, COUNT(*) AS row_count, {f'CAST(MIN({at}) AS DATE)' if at else 'CAST(NULL AS DATE)'} AS min_date,"
        f" {f'CAST(MAX({at}) AS DATE)' if at else 'CAST(NULL AS DATE)'} AS max_date FROM {name}"
        for name, at in {
            "usage": "usage_date", "list_prices": None, "clusters": "change_time", "node_timeline": "start_time", "warehouses": None,
            "warehouse_events": None, "jobs": None, "job_run_timeline": None, "query_history": "start_time",
        }.items()
    ),
    "s5_distinct_skus": "SELECT DISTINCT sku_name FROM usage",
    "s6_report_summary": """SELECT COUNT(*) AS total_recommendations, ROUND(SUM(estimated_savings), 6) AS estimated_total_savings,
 (SELECT estimated_monthly_cost FROM projection) AS estimated_monthly_cost FROM final_recs""",
    "f1_date_window": """SELECT usage_date, COUNT(*) AS lines, SUM(usage_quantity) AS dbus FROM usage
WHERE usage_date BETWEEN DATE '2024-01-02' AND DATE '2024-01-29' GROUP BY 1""",
    "f2_timestamp_window": "SELECT CAST(start_time AS DATE) AS day, COUNT(*) AS queries, MAX(start_time) AS last_start FROM history GROUP BY 1",
    "f3_metrics_lower_bound": """SELECT cluster_id, COUNT(*) AS samples, MIN(start_time) AS first_sample FROM node_timeline
WHERE start_time >= TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1""",
    "f4_run_window": "SELECT CAST(period_start_time AS DATE) AS day, COUNT(*) AS runs, MAX(period_end_time) AS last_end FROM period_runs GROUP BY 1",
    "f5_nested_projection": """SELECT cluster_id, job_id, warehouse_id, run_as AS run_as_user, is_serverless, COUNT(*) AS lines FROM usage
GROUP BY 1, 2, 3, 4, 5""",
    "f6_non_serverless": """SELECT is_serverless, COUNT(*) AS lines, SUM(usage_quantity) AS dbus FROM usage
WHERE is_serverless = false OR is_serverless IS NULL GROUP BY 1""",
    "f7_job_cluster_names": f"""SELECT cluster_id, change_time, regexp_matches(cluster_name, {JOB_NAME}) AS is_job_cluster,
 regexp_matches(upper(cluster_name), {JOB_NAME}, 'i') AS is_job_cluster_any_case FROM clusters""",
    "f8_presence": "SELECT cluster_id, job_id, COUNT(*) AS lines FROM usage WHERE cluster_id IS NOT NULL AND job_id IS NOT NULL GROUP BY 1, 2",
    "f9_long_statements": """SELECT statement_id, statement_type, total_task_duration_ms / 1000 AS duration_seconds FROM history
WHERE total_task_duration_ms > 5000 AND statement_type IN ('SELECT', 'INSERT', 'MERGE', 'UPDATE', 'DELETE', 'CREATE', 'COPY')""",
    "f10_starter_exclusion": f"SELECT warehouse_id, warehouse_name, total_cost FROM merged WHERE {_NOT_STARTER}",
    "j1_temporal_price_join": """SELECT usage_date, sku_name, usage_end_time, workspace_id, usage_quantity,
 ROUND(dollar_cost, 6) AS dollar_cost FROM priced""",
    "j2_usage_with_jobs": f"""SELECT p.workspace_id, p.job_id, CAST(p.job_run_id AS VARCHAR) AS job_run_id, p.cluster_id, p.sku_name, p.is_serverless,
 j.name AS job_name, j.creator_user_name AS owner, {money('p.usage_quantity')} AS dbus, {money('p.dollar_cost')} AS cost,
 MIN(p.usage_end_time) - INTERVAL '1' HOUR AS first_run, MAX(p.usage_end_time) AS last_run
FROM priced p LEFT JOIN jobs_latest j ON j.workspace_id = p.workspace_id AND j.job_id = p.job_id
WHERE p.job_id IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6, 7, 8""",
    "j3_usage_with_clusters": "SELECT * FROM cluster_cost_all",
    "j4_samples_of_top_clusters": """SELECT cluster_id, component, ROUND(cpu, 6) AS cpu, ROUND(io_wait, 6) AS io_wait, ROUND(mem, 6) AS mem,
 ROUND(swap, 6) AS swap FROM top_samples""",
    "j5_idle_costs_and_names": "SELECT * EXCLUDE (known_dbus) FROM idle_all",
    "j6_autoscale_costs": "SELECT * EXCLUDE (known_dbus) FROM scaling_all",
    "j7_latest_state_anti_join": "SELECT * FROM running",
    "j8_scale_up_anti_join": "SELECT * FROM scaled_up",
    "j9_events_with_warehouse": """SELECT e.*, w.warehouse_name, w.warehouse_size, w.max_clusters
FROM warehouse_events e LEFT JOIN warehouses w ON w.warehouse_id = e.warehouse_id""",
    "j10_running_without_queries": f"""SELECT e.warehouse_id, e.event_time, q.query_count, q.last_query_time
FROM running e LEFT JOIN activity_later q ON q.warehouse_id = e.warehouse_id WHERE {_quiet(LATER)}""",
    "j11_merge_configs_and_costs": "SELECT * FROM merged",
    "j12_jobs_with_run_metrics": "SELECT job_id, sku_name, is_serverless, success_count, failure_count, avg_duration_seconds FROM job_rows",
    "j13_named_top_items": "SELECT * FROM named_top",
    "j14_driver_worker_pairs": "SELECT * FROM all_pairs",
    "a1_priced_usage": f"""SELECT usage_date, billing_origin_product, COUNT(*) AS lines, {money('usage_quantity')} AS dbus,
 {money('dollar_cost')} AS cost FROM priced GROUP BY 1, 2""",
    "a2_totals": "SELECT * FROM cost_totals",
    "a3_cost_by_dimension": "SELECT * FROM cost_rollup",
    "a4_tag_usage": "SELECT * FROM tag_status_usage",
    "a4_tag_coverage": "SELECT * FROM tag_row",
    "a5_weekday_usage": "SELECT * FROM dow_usage",
    "a5_weekend_pattern": "SELECT * FROM weekend_row",
    "a6_warehouse_costs": "SELECT * FROM warehouse_costs",
    "a7_warehouse_rollup": "SELECT * FROM warehouse_rollup",
    "a8_interactive_cluster_costs": "SELECT * FROM cluster_costs",
    "a9_job_costs": "SELECT * FROM job_costs",
    "a10_spot_classification": "SELECT cluster_id, change_time, availability, uses_spot FROM spot_flags",
    "a11_run_metrics": f"""SELECT job_id, {r2('avg_duration', 1)} AS avg_duration, min_duration, max_duration, success_count, failure_count,
 COALESCE({r2('failure_count / NULLIF(success_count + failure_count, 0) * 100', 1)}, 0) AS failure_rate FROM run_stats""",
    "a12_job_efficiency": """SELECT job_rank, job_id, sku_name, is_serverless, avg_duration_seconds, min_duration_seconds,
 max_duration_seconds, cost_per_run, failure_rate, duration_variance, short_run FROM job_rows""",
    "a13_cluster_utilization": f"SELECT {METRICS} FROM all_metrics",
    "a13_top_cluster_utilization": f"""SELECT {METRICS}, cluster_name, total_dbus, job_id, node_type, min_autoscale_workers,
 max_autoscale_workers, availability, uses_spot, metric_rank FROM top_metrics""",
    "a14_target_clusters": "SELECT * FROM top_targets",
    "a15_idle_clusters": "SELECT * FROM idle_top",
    "a16_hourly_workers": "SELECT * FROM hourly",
    "a17_autoscale_stats": "SELECT * FROM scaling_top",
    "a18_user_stats": "SELECT * FROM user_stats",
    "a19_disk_spill": "SELECT * FROM spill",
    "a19_spill_summary": """SELECT CAST(SUM(spill_frequency) AS BIGINT) AS total_spill_queries, bool_or(needs_upsize) AS has_significant_spill
FROM spill""",
    "a20_shuffle_by_warehouse": f"""SELECT COALESCE(warehouse_id, 'unknown') AS warehouse_id, COUNT(*) AS query_count,
 {money('shuffle_gb')} AS total_shuffle_gb FROM heavy GROUP BY 1""",
    "a21_pattern_counts": "SELECT * FROM pattern_counts",
    "a22_pattern_findings": """SELECT pattern AS type, CASE WHEN pattern = 'no_where_clause' THEN 'high' ELSE 'medium' END AS severity, count
FROM pattern_counts""",
    "a23_utilization_summary": "SELECT * FROM utilization_row",
    "a23_cluster_status": "SELECT * FROM all_cluster_status",
    "a24_query_activity": "SELECT * FROM activity",
    "a25_monthly_projection": "SELECT * FROM projection",
    "a26_job_totals": f"""SELECT COUNT(*) AS job_count, ROUND(SUM(total_cost), 2) AS total_job_cost,
 (SELECT {r2('SUM(estimated_savings)')} FROM job_issues) AS total_wasted_on_failures,
 (SELECT COUNT(DISTINCT resource_id) FROM job_issues WHERE type IN ('high_failure_rate', 'startup_overhead', 'variable_duration'))
 AS jobs_with_issues FROM job_rows""",
    "a27_average_dbu_price": f"SELECT ROUND({_PRICE}, 6) AS dbu_price",
    "a28_potential_savings": f"SELECT {money('estimated_savings')} AS potential_savings FROM warehouse_issues",
    "d1_latest_clusters": "SELECT cluster_id, change_time, min_autoscale_workers, max_autoscale_workers FROM clusters_latest",
    "d2_latest_jobs": "SELECT * FROM jobs_latest",
    "t1_top_items": "SELECT * FROM top_ten",
    "t2_priced_newest_first": """SELECT usage_date, ROUND(dollar_cost, 6) AS dollar_cost, sku_name, billing_origin_product, cluster_id,
 warehouse_id, run_as AS run_as_user, is_serverless, 'DBU' AS usage_unit FROM priced ORDER BY usage_date DESC, dollar_cost DESC""",
    "t3_longest_queries": """SELECT statement_id, executed_by AS "user", warehouse_id, statement_type, read_rows, read_files,
 total_task_duration_ms / 1000 AS duration_seconds, start_time FROM history
WHERE total_task_duration_ms > 5000 AND statement_type IN ('SELECT', 'INSERT', 'MERGE', 'UPDATE', 'DELETE', 'CREATE', 'COPY')
ORDER BY total_task_duration_ms DESC, statement_id LIMIT 10""",
    "t4_top_shuffle_queries": "SELECT * FROM heavy ORDER BY shuffle_read_bytes DESC, statement_id LIMIT 10",
    "t5_recent_events": f"""SELECT * FROM warehouse_events WHERE event_time BETWEEN {START_TS} AND {END_TS}
""",
    "t6_warehouses_by_cost": "SELECT warehouse_id, total_cost FROM merged ORDER BY total_cost DESC, warehouse_id",
    "t7_runs_by_job": """SELECT job_id, run_id, result_state, duration_seconds, period_start_time, period_end_time FROM period_runs
ORDER BY job_id, period_start_time DESC""",
    "t8_idle_by_dbus": "SELECT cluster_id, total_dbus FROM idle_top",
    "t9_high_cost_jobs": """SELECT job_id, COALESCE(job_name, job_id) AS job_name, total_cost, total_dbus, run_count, avg_duration_seconds,
 cost_per_run FROM job_rows WHERE total_cost > 10 ORDER BY total_cost DESC""",
    "t10_ranked_recommendations": """SELECT CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS severity_rank,
 estimated_savings, id, resource_id FROM first_by_resource
ORDER BY 1, estimated_savings DESC, rule_order, seq, id, resource_id NULLS FIRST""",
    "t11_cluster_listing": """SELECT cluster_id, cluster_name, owned_by, CAST(NULL AS TIMESTAMP) AS create_time,
 CAST(NULL AS TIMESTAMP) AS delete_time, CAST(NULL AS VARCHAR) AS driver_node_type, CAST(NULL AS VARCHAR) AS worker_node_type,
 worker_count, min_autoscale_workers, max_autoscale_workers, auto_termination_minutes, CAST(NULL AS BOOLEAN) AS enable_elastic_disk,
 CAST(NULL AS VARCHAR) AS cluster_source, CAST(NULL AS VARCHAR) AS dbr_version, change_time FROM clusters_latest""",
    "u1_union_of_rules": f"SELECT {REC} FROM guarded",
    "u2_keep_first_by_id": f"SELECT {REC} FROM first_by_id",
    "u2_keep_first_by_resource": f"SELECT {REC} FROM first_by_resource",
    "u3_worthwhile": f"SELECT {REC} FROM guarded WHERE estimated_savings >= 1.0",
    "u4_distinct_running_warehouses": "SELECT DISTINCT warehouse_id FROM running",
    "sc1_rounding": f"""SELECT cluster_id, instance_id, {r2('AVG(cpu_user_percent + cpu_system_percent)')} AS avg_cpu,
 {r2('MAX(cpu_user_percent + cpu_system_percent) / 100', 4)} AS max_share FROM node_timeline GROUP BY 1, 2""",
    "sc2_null_handling": """SELECT cluster_id, change_time, COALESCE(worker_count, max_autoscale_workers, 0) AS workers,
 NULLIF(max_autoscale_workers - min_autoscale_workers, 0) AS span, CASE WHEN min_autoscale_workers IS NULL THEN 'fixed'
 WHEN max_autoscale_workers BETWEEN 3 AND 6 THEN 'small' ELSE 'large' END AS kind, auto_termination_minutes IN (0, 15) AS listed FROM clusters""",
    "sc3_date_parts": """SELECT CAST(start_time AS DATE) AS day, hour(start_time) AS hour, dayofweek(start_time) + 1 AS day_of_week,
 COUNT(*) AS samples FROM node_timeline GROUP BY 1, 2, 3""",
    "sc4_elapsed_units": f"""SELECT run_id, date_sub('second', period_start_time, period_end_time) AS seconds,
 date_sub('minute', period_start_time, period_end_time) AS minutes, date_sub('hour', period_start_time, period_end_time) AS hours,
 ROUND(date_sub('minute', period_end_time, {AS_OF}) / 60.0, 6) AS hours_ago FROM job_run_timeline""",
    "sc5_text_functions": """SELECT statement_id, substring(statement_text, 1, 12) AS preview, upper(statement_text) AS upper_text,
 regexp_matches(statement_text, '^select') AS lower_select FROM query_history""",
    "sc6_query_text_flags": "SELECT * FROM text_flags",
    "sc7_map_and_struct": """SELECT tag_count = 0 AND workspace_id = 0 AS no_map, CASE WHEN tag_count = 0 AND workspace_id = 0 THEN NULL ELSE tag_count END AS tags,
 is_serverless, COUNT(*) AS lines FROM usage GROUP BY 1, 2, 3""",
    "sc8_unit_conversion": f"""SELECT statement_id, total_task_duration_ms / 1000 AS duration_seconds,
 ROUND(spilled_local_bytes / {GIB}, 6) AS spilled_gb FROM query_history""",
    "sc9_effort_minutes": r"""SELECT effort, COUNT(*) AS recommendations, CAST(MAX(CASE
 WHEN contains(effort, 'second') THEN COALESCE(TRY_CAST(regexp_extract(effort, '(\S+) second', 1) AS DOUBLE) / 60, 0.5)
 WHEN contains(effort, 'minute') THEN COALESCE(TRY_CAST(regexp_extract(effort, '(\S+) minute', 1) AS DOUBLE), 2)
 WHEN contains(effort, 'hour') THEN COALESCE(TRY_CAST(regexp_extract(effort, '(\S+) hour', 1) AS DOUBLE) * 60, 120)
 ELSE 30 END) AS DOUBLE) AS minutes FROM guarded GROUP BY effort""",
    "sc10_user_display": """SELECT split_part(executed_by || '@' || COALESCE(warehouse_id, 'none'), '@', 1) AS "user", COUNT(*) AS queries
FROM query_history GROUP BY 1""",
    "c1_cpu_status": "SELECT cluster_id, component, cpu_status FROM all_statuses",
    "c2_memory_status": "SELECT cluster_id, component, mem_status FROM all_statuses",
    "c3_overall_status": "SELECT cluster_id, component, overall_status FROM all_statuses",
    "c4_io_bottleneck": "SELECT cluster_id, component, io_bound, io_issue FROM all_statuses",
    "c5_memory_spike_risk": "SELECT cluster_id, component, mem_volatility, mem_spike_risk FROM all_statuses",
    "c6_swap_issue": "SELECT cluster_id, component, swap_issue FROM all_statuses",
    "c7_suggested_action": "SELECT cluster_id, component, suggested_action, cpu_headroom_p50, mem_headroom_p95 FROM all_statuses",
    "c8_driver_worker_imbalance": "SELECT * FROM all_imbalance",
    "c9_autoscale_verdict": "SELECT * FROM verdicts_all",
    "c10_cluster_issues": f"SELECT {ISSUES} FROM cluster_issues",
    "c11_warehouse_issues": f"SELECT {ISSUES} FROM warehouse_issues",
    "c12_long_running_warehouses": "SELECT * FROM long_running",
    "c13_upscaled_warehouses": "SELECT * FROM upscaled",
    "c14_idle_warehouses": "SELECT * FROM idle_wh",
    "c14_idle_warehouses_later": "SELECT * FROM idle_wh_later",
    "c15_job_issues": f"SELECT job_rank, {ISSUES} FROM job_issues",
    "r01_auto_termination": _rules("auto_term"),
    "r02_warehouse_auto_stop": _rules("wh_auto_stop", "wh_reduce_stop"),
    "r03_warehouse_sizing": _rules("wh_size", "wh_min_clusters"),
    "r04_long_running_warehouse": f"SELECT {REC} FROM ("
    + RULE_SQL["wh_long_run"].replace("FROM long_running", "FROM long_running_later") + ")",
    "r05_upscaled_warehouse": _rules("wh_upscaled"),
    "r06_idle_warehouse": f"SELECT {REC} FROM (" + RULE_SQL["wh_idle"].replace("FROM idle_wh", "FROM idle_wh_later") + ")",
    "r07_disk_spill": _rules("disk_spill"),
    "r08_shuffle_heavy_queries": _rules("shuffle_heavy_queries"),
    "r09_all_purpose_to_jobs": _rules("all_purpose_to_jobs"),
    "r10_acceleration_check": _rules("evaluate_photon"),
    "r11_serverless_job": _rules("serverless_job"),
    "r12_cluster_sizing": _rules("autoscale", "rightsize"),
    "r13_model_scale_to_zero": _rules("model_scale_to_zero"),
    "r14_spot_instances": _rules("use_spot_instances"),
    "r15_job_efficiency": _rules("job_failures", "job_startup"),
    "r16_cluster_pools": _rules("cluster_pools_startup", "use_cluster_pools"),
    "r17_frequent_job": _rules("job_freq"),
    "r18_unfiltered_queries": _rules("sql_partitioning"),
    "r19_cluster_rightsizing": _rules("rightsize_overprovisioned", "rightsize_underprovisioned", "rightsize_cluster"),
    "r20_idle_clusters": _rules("idle_clusters"),
    "r21_autoscale_findings": _rules("autoscale_never_down", "autoscale_never_up"),
    "r22_driver_imbalance": " UNION ALL ".join(
        f"SELECT {REC} FROM (" + RULE_SQL[r].replace("top_imbalance", "all_imbalance") + ")"
        for r in ("driver_cpu_bottleneck", "driver_memory_bottleneck")
    ),
    "r23_governance": _rules("implement_tagging", "weekend_waste"),
    "r24_layout_and_monitoring": _rules("delta_optimization", "cost_monitoring"),
    "r25_recommendations": f"SELECT {REC} FROM final_recs",
    "p1_executive_summary": "SELECT * FROM summary_row",
    "p2_assessment": """SELECT savings_percentage, annual_savings, CASE WHEN savings_percentage >= 40 THEN 'F'
 WHEN savings_percentage >= 30 THEN 'D' WHEN savings_percentage >= 20 THEN 'C' WHEN savings_percentage >= 10 THEN 'B' ELSE 'A' END AS grade,
 CASE WHEN savings_percentage >= 35 THEN 'HIGH' WHEN savings_percentage >= 20 THEN 'MEDIUM' WHEN savings_percentage >= 10 THEN 'LOW'
  ELSE 'VERY LOW' END AS benchmark_band,
 CASE WHEN annual_savings >= 100000 THEN '1-2 headcount equivalents' WHEN annual_savings >= 50000 THEN '~1 mid-level engineer salary'
  WHEN annual_savings >= 20000 THEN '~3-4 months runway extension' ELSE 'meaningful cost reduction' END AS impact_tier,
 CASE WHEN recommendations = 0 THEN 'N/A (no optimization opportunities found)' WHEN high_count >= 3 THEN '2-3 weeks'
  WHEN high_count >= 1 THEN '1-2 weeks' ELSE '2-4 weeks' END AS timeline FROM summary_row""",
    "p3_twelve_months": """SELECT m.month, ROUND(monthly_cost * m.month, 6) AS current_path,
 ROUND(GREATEST((monthly_cost - monthly_savings) * m.month, 0), 6) AS optimized_path, ROUND(monthly_savings * m.month, 6) AS cumulative_savings
FROM summary_row, range(1, 13) m(month)""",
    "p4_product_breakdown": f"""SELECT key AS product, dbus, cost, {r2('cost / (SELECT total_cost FROM cost_totals) * 100', 1)} AS percent_of_total
FROM cost_rollup WHERE dim = 'product'""",
    "p4_compute_breakdown": f"""SELECT 'serverless' AS compute_type, serverless_dbus AS dbus, serverless_cost AS cost,
 serverless_percentage AS percent_of_total FROM projection
UNION ALL SELECT 'classic', classic_dbus, classic_cost, {r2('100 - serverless_percentage', 1)} FROM projection""",
    "p4_weekday_breakdown": f"""SELECT day_of_week, day_name, total_dbus,
 {r2('total_dbus / (SELECT SUM(total_dbus) FROM dow_usage) * 100', 1)} AS percent_of_total FROM dow_usage""",
    "p5_user_breakdown": f"""SELECT rank, id AS "user", dbus, cost, {r2('cost / (SELECT total_cost FROM cost_totals) * 100', 1)} AS percent_of_total
FROM top_ten WHERE dim = 'user'
UNION ALL SELECT NULL, label, NULL, cost, {r2('cost / (SELECT total_cost FROM cost_totals) * 100', 1)}
FROM (SELECT '(Other users)' AS label, ROUND(of_users - (SELECT SUM(cost) FROM top_ten WHERE dim = 'user'), 6) AS cost FROM user_cost
 UNION ALL SELECT '(System/Unattributed)', ROUND((SELECT total_cost FROM cost_totals) - of_users, 6) FROM user_cost) WHERE cost > 0.01""",
    "p6_status_distribution": f"""SELECT overall_status, COUNT(*) AS clusters,
 {r2('COUNT(*) / (SELECT COUNT(*) FROM top_cluster_status) * 100', 1)} AS percent, ROUND(SUM(total_dbus), 2) AS dbus
FROM top_cluster_status GROUP BY 1""",
    "p7_roadmap": r"""SELECT id, resource_id, severity, estimated_savings, ROUND(estimated_savings * 12, 6) AS annual_savings, effort,
 ROUND(minutes, 6) AS effort_minutes, ROUND(estimated_savings / minutes, 6) AS savings_per_minute,
 CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 END AS phase
FROM (SELECT *, CASE
 WHEN contains(effort, 'second') THEN COALESCE(TRY_CAST(regexp_extract(effort, '(\S+) second', 1) AS DOUBLE) / 60, 0.5)
 WHEN contains(effort, 'minute') THEN COALESCE(TRY_CAST(regexp_extract(effort, '(\S+) minute', 1) AS DOUBLE), 2)
 WHEN contains(effort, 'hour') THEN COALESCE(TRY_CAST(regexp_extract(effort, '(\S+) hour', 1) AS DOUBLE) * 60, 120)
 ELSE 30 END AS minutes FROM final_recs)""",
    "p8_top_jobs": """SELECT t.rank, t.id, t.name, d.run_count, t.dbus, d.cost_per_run, t.cost
FROM named_top t LEFT JOIN (SELECT job_id, run_count, cost_per_run FROM job_rows
 QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY job_rank DESC) = 1) d ON d.job_id = t.id
WHERE t.dim = 'job' AND t.rank <= 5""",
    "p8_top_interactive_clusters": """SELECT row_number() OVER (ORDER BY cost DESC, id) AS rank, id, name, dbus, cost FROM (
 SELECT key AS id, dbus, cost, COALESCE((SELECT MAX(cluster_name) FROM clusters_latest c WHERE c.cluster_id = key),
  (SELECT MAX(cluster_name) FROM cluster_costs k WHERE k.cluster_id = key)) AS name FROM cost_rollup WHERE dim = 'cluster')
WHERE NOT (COALESCE(name, '') LIKE 'job-%' AND COALESCE(name, '') LIKE '%-run-%') QUALIFY rank <= 5""",
    "p9_governance": f"""SELECT monthly AS monthly_cost, untagged_dbus, ROUND(tagged_dbus + untagged_dbus, 6) AS total_dbus,
 ROUND(100 - untagged_percentage, 6) AS tagged_percentage, untagged_percentage,
 {r2('monthly * untagged_percentage / 100')} AS untagged_monthly_cost, weekend_dbus, weekend_percentage, weekend_to_weekday_ratio,
 {r2('monthly * weekend_percentage / 100')} AS weekend_monthly_cost
FROM tag_row, weekend_row, (SELECT estimated_monthly_cost AS monthly FROM projection)""",
}


def _needed(sql: str, found: list[str]) -> None:
    words = set(re.findall(r"\b[a-z_]+\b", sql))
    for name, part in PARTS.items():
        if name in words and name not in found:
            _needed(part, found)
            if name not in found:
                found.append(name)


def oracle(name: str) -> str:
    found: list[str] = []
    _needed(STATEMENTS[name], found)
    with_parts = ",\n".join(f"{part} AS ({PARTS[part]})" for part in found)
    return f"WITH {with_parts}\n{STATEMENTS[name]}" if found else STATEMENTS[name]
