"""Job efficiency, job findings and cluster configuration findings."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from spendscope.operators import clusters, jobs, versions
from spendscope.sources.sample_tables import SAMPLE_WINDOW

COSTS = "job_id string, sku_name string, is_serverless boolean, total_cost double, run_count bigint"


def runs(make, *rows):
    start = datetime(2024, 1, 5)
    return make("job_run_timeline", [
        {"job_id": j, "run_id": i, "result_state": state, "period_start_time": start,
         "period_end_time": start + timedelta(seconds=seconds)}
        for i, (j, state, seconds) in enumerate(rows)])


def test_run_metrics(frame, make):
    timeline = runs(make, ("a", "SUCCESS", 100), ("a", "FAILED", 0), ("a", "SKIPPED", 300), ("a", None, 900), ("b", "TIMEDOUT", 0))
    metrics = jobs.run_metrics(jobs.job_runs(timeline, SAMPLE_WINDOW))
    costs = frame(COSTS, [("a", "s", False, 12.0, 4), ("b", "s", False, 6.0, 0), ("c", "s", False, 2.0, 1)])
    found = {r.job_id: r for r in jobs.job_efficiency(costs, metrics).collect()}
    a = found["a"]
    assert (a.avg_duration_seconds, a.min_duration_seconds, a.max_duration_seconds) == (200.0, 100.0, 300.0)
    assert (a.success_count, a.failure_count, a.failure_rate, a.cost_per_run, a.duration_variance) == (1, 1, 50.0, 3.0, 200.0)
    assert (found["b"].failure_rate, found["b"].cost_per_run, found["b"].short_run) == (100.0, 0.0, True)
    # Without runs the average is zero, which counts as short.
    assert (found["c"].failure_rate, found["c"].short_run, found["c"].job_rank) == (0.0, True, 3)


def test_last_day_of_the_run_window_ends_at_midnight(make):
    end = datetime(2024, 1, 30)
    timeline = make("job_run_timeline", [
        {"job_id": "a", "run_id": i, "result_state": "SUCCESS", "period_start_time": end - timedelta(hours=1), "period_end_time": at}
        for i, at in enumerate((end, end + timedelta(seconds=1)))])
    assert [r.run_id for r in jobs.job_runs(timeline, SAMPLE_WINDOW).collect()] == [0]


@pytest.mark.parametrize(
    "changes, types",
    [
        ({}, set()),
        ({"total_cost": 10.0}, set()),
        ({"total_cost": 10.01}, {"high_cost"}),
        ({"run_count": 11}, {"serverless_candidate"}),
        ({"run_count": 11, "is_serverless": True}, set()),
        ({"run_count": 11, "is_serverless": None}, {"serverless_candidate"}),
        ({"failure_rate": 10.0, "total_cost": 6.0}, set()),
        ({"failure_rate": 10.1, "total_cost": 5.0}, set()),
        ({"failure_rate": 10.1, "total_cost": 6.0}, {"high_failure_rate"}),
        ({"short_run": True, "cost_per_run": 0.1}, set()),
        ({"short_run": True, "cost_per_run": 0.11}, {"startup_overhead"}),
        ({"duration_variance": 300.1, "run_count": 6}, {"variable_duration"}),
        ({"duration_variance": 300.0, "run_count": 6}, set()),
    ],
)
def test_job_finding_limits(spark, changes, types):
    row = {
        "job_id": "j", "job_name": None, "owner": None, "is_serverless": False, "total_cost": 3.0, "run_count": 3,
        "failure_rate": 0.0, "cost_per_run": 0.0, "avg_duration_seconds": 100.0, "duration_variance": 0.0, "short_run": False,
        "job_rank": 1, **changes,
    }
    ddl = (
        "job_id string, job_name string, owner string, is_serverless boolean, total_cost double, run_count bigint,"
        " failure_rate double, cost_per_run double, avg_duration_seconds double, duration_variance double,"
        " short_run boolean, job_rank int"
    )
    found = jobs.job_issues(spark.createDataFrame([tuple(row.values())], ddl)).collect()
    assert {i.type for i in found} == types
    assert {i.resource_name for i in found} <= {"j"}


@pytest.mark.parametrize("rate, severity", [(25.0, "medium"), (25.1, "high")])
def test_failure_severity(frame, rate, severity):
    ddl = (
        "job_id string, job_name string, owner string, is_serverless boolean, total_cost double, run_count bigint,"
        " failure_rate double, cost_per_run double, avg_duration_seconds double, duration_variance double,"
        " short_run boolean, job_rank int"
    )
    row = jobs.job_issues(frame(ddl, [("j", "n", "o", True, 8.0, 1, rate, 0.0, 1.0, 0.0, False, 1)])).first()
    assert (row.severity, row.estimated_savings) == (severity, round(8 * rate / 100, 2))


def config(**more):
    return {"cluster_id": "c", "cluster_name": "name", "owned_by": "owner", "change_time": datetime(2024, 1, 1),
            "auto_termination_minutes": 30, **more}


@pytest.mark.parametrize(
    "changes, found",
    [
        ({}, set()),
        ({"auto_termination_minutes": 0}, {("no_autotermination", "high")}),
        ({"auto_termination_minutes": None}, set()),
        ({"worker_count": 4}, {("no_autoscaling", "medium")}),
        ({"worker_count": 4, "max_autoscale_workers": 9}, set()),
        ({"worker_count": 10}, {("no_autoscaling", "medium"), ("oversized", "medium")}),
        ({"min_autoscale_workers": 1, "max_autoscale_workers": 20}, {("oversized", "high")}),
        ({"min_autoscale_workers": 3, "max_autoscale_workers": 9}, {("high_min_workers", "low")}),
        ({"auto_termination_minutes": 0, "cluster_name": "Job-1-RUN-2-x"}, set()),
        ({"auto_termination_minutes": 0, "cluster_name": None}, {("no_autotermination", "high")}),
    ],
)
def test_cluster_finding_limits(make, frame, changes, found):
    costs = frame("cluster_id string, owner string, total_cost double", [("c", "", 7.0)])
    issues = clusters.cluster_issues(make("clusters", [config(**changes)]), costs).collect()
    assert {(i.type, i.severity) for i in issues} == found
    assert {(i.owner, i.cost) for i in issues} <= {("owner", 7.0)}


def test_job_clusters_are_left_out_of_interactive_costs(frame, make):
    priced = frame("cluster_id string, usage_quantity double, dollar_cost double",
                   [("a", 1.0, 1.0), ("a", 1.0, 1.0), ("b", 9.0, 9.0), ("unknown", 1.0, 1.5), (None, 1.0, 5.0)])
    configs = make("clusters", [
        {"cluster_id": "a", "cluster_name": "job-1-run-2", "change_time": datetime(2024, 1, 1)},
        {"cluster_id": "a", "cluster_name": "renamed", "change_time": datetime(2024, 1, 2)},
        {"cluster_id": "b", "cluster_name": "job-1-run-2", "change_time": datetime(2024, 1, 1)}])
    rows = clusters.interactive_cluster_costs(clusters.cluster_usage_cost(priced), configs).collect()
    assert [(r.cluster_id, r.cluster_name, r.total_cost) for r in rows] == [("a", "renamed", 2.0), ("unknown", None, 1.5)]


def test_latest_version_takes_the_newest(make):
    rows = [{"cluster_id": "c", "cluster_name": n, "change_time": datetime(2024, 1, d)} for n, d in (("x", 1), ("z", 3), ("y", 3))]
    assert versions.latest_clusters(make("clusters", rows)).first().cluster_name == "y"


@pytest.mark.parametrize(
    "aws, azure, gcp, spot",
    [
        ("SPOT", None, None, True), ("ON_DEMAND", None, None, False), ("ON_DEMAND", "SPOT_AZURE", None, True),
        (None, "SPOT_WITH_FALLBACK_AZURE", None, True), (None, None, "PREEMPTIBLE_GCP", True), (None, None, None, False),
    ],
)
def test_spot_classification(make, aws, azure, gcp, spot):
    row = config(cluster_name="job-1-run-2", aws_attributes={"availability": aws}, azure_attributes={"availability": azure},
                 gcp_attributes={"availability": gcp})
    assert versions.job_cluster_capacity(make("clusters", [row])).first().uses_spot is spot
