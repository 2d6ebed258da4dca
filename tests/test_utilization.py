"""Rightsizing classes, imbalance, idle clusters and autoscaling."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from spendscope.operators import utilization as ut
from spendscope.plans.analysis import Analysis
from spendscope.sources.sample_tables import SAMPLE_WINDOW

CALM = {
    "cluster_id": "c", "cluster_name": "n", "component": "worker", "total_dbus": 10.0, "uses_spot": False, "metric_rank": 1,
    "cpu_p50": 0.6, "cpu_p90": 0.7, "cpu_time_above_80pct": 0.0, "mem_p50": 0.75, "mem_p95": 0.8, "mem_p99": 0.85,
    "mem_time_above_90pct": 0.0, "mem_stddev": 0.0, "io_wait_p90": 0.0, "io_wait_time_above_20pct": 0.0,
    "swap_max": 0.0, "swap_time_fraction": 0.0,
}


@pytest.fixture
def classify(spark):
    def run(**changes):
        return ut.classify(spark.createDataFrame([{**CALM, **changes}])).first()

    return run


@pytest.mark.parametrize(
    "changes, cpu, mem, overall",
    [
        ({}, ut.RIGHT, ut.RIGHT, ut.RIGHT),
        ({"cpu_p90": 0.85}, ut.UNDER, ut.RIGHT, ut.UNDER),
        ({"cpu_p90": 0.8499}, ut.RIGHT, ut.RIGHT, ut.RIGHT),
        ({"cpu_time_above_80pct": 0.20}, ut.UNDER, ut.RIGHT, ut.UNDER),
        ({"cpu_p50": 0.40, "cpu_time_above_80pct": 0.0499}, ut.OVER, ut.RIGHT, ut.OVER),
        ({"cpu_p50": 0.40, "cpu_time_above_80pct": 0.05}, ut.RIGHT, ut.RIGHT, ut.RIGHT),
        ({"mem_p95": 0.95}, ut.RIGHT, ut.UNDER, ut.UNDER),
        ({"mem_time_above_90pct": 0.20}, ut.RIGHT, ut.UNDER, ut.UNDER),
        ({"mem_p50": 0.70}, ut.RIGHT, ut.OVER, ut.OVER),
        # Either part under pressure outweighs the other one idling.
        ({"cpu_p50": 0.1, "mem_p95": 0.99}, ut.OVER, ut.UNDER, ut.UNDER),
    ],
)
def test_status_limits(classify, changes, cpu, mem, overall):
    row = classify(**changes)
    assert (row.cpu_status, row.mem_status, row.overall_status) == (cpu, mem, overall)


@pytest.mark.parametrize(
    "changes, issue",
    [
        ({"io_wait_p90": 0.1499}, None),
        ({"io_wait_p90": 0.15}, "moderate_io_bottleneck"),
        ({"io_wait_p90": 0.25}, "severe_io_bottleneck"),
        ({"io_wait_time_above_20pct": 0.20}, "moderate_io_bottleneck"),
    ],
)
def test_io_limits(classify, changes, issue):
    row = classify(**changes)
    assert (row.io_issue, row.io_bound) == (issue, issue is not None)


@pytest.mark.parametrize(
    "changes, risk",
    [
        ({"mem_stddev": 0.1499}, "none"),
        ({"mem_stddev": 0.15}, "moderate"),
        ({"mem_stddev": 0.25}, "high"),
        ({"mem_p50": 0.5, "mem_p99": 0.875}, "moderate"),
        ({"mem_p50": 0.25, "mem_p99": 0.75}, "high"),
    ],
)
def test_memory_spike_limits(classify, changes, risk):
    assert classify(**changes).mem_spike_risk == risk


@pytest.mark.parametrize(
    "changes, swapping", [({"swap_max": 0.0099}, False), ({"swap_max": 0.01}, True), ({"swap_time_fraction": 0.05}, True)]
)
def test_swap_limits(classify, changes, swapping):
    assert classify(**changes).swap_issue is swapping


def test_action_texts(classify):
    assert classify().suggested_action == ut.ACTIONS["keep"]
    assert classify(mem_p95=0.99, cpu_p90=0.9).suggested_action == ut.ACTIONS["both_hot"]
    cold = {"cpu_p50": 0.1, "mem_p50": 0.1, "mem_p99": 0.2}
    assert classify(**cold).suggested_action == ut.ACTIONS["both_cold"] + ut.TRY_SPOT_SUFFIX
    assert classify(**cold, uses_spot=True).suggested_action == ut.ACTIONS["both_cold"] + ut.ON_SPOT_SUFFIX
    everything = classify(mem_p95=0.99, swap_max=0.5, io_wait_p90=0.3, mem_stddev=0.3)
    assert everything.suggested_action == (
        ut.SWAP_PREFIX + ut.ACTIONS["mem_hot"] + ut.IO_SUFFIX["severe_io_bottleneck"] + ut.SPIKE_SUFFIX["high"]
    )


@pytest.mark.parametrize(
    "driver, worker, issue",
    [
        ((0.71, 0.5), (0.29, 0.6), "driver_cpu_bottleneck"),
        ((0.70, 0.5), (0.29, 0.6), None),
        ((0.5, 0.81), (0.5, 0.49), "driver_memory_bottleneck"),
        ((0.71, 0.81), (0.29, 0.49), "driver_cpu_bottleneck"),
        ((0.19, 0.5), (0.81, 0.6), "workers_saturated_driver_idle"),
    ],
)
def test_imbalance_limits(frame, driver, worker, issue):
    rows = [("c", "n", 1.0, "driver", *driver), ("c", "n", 1.0, "worker", *worker), ("d", "n", 1.0, "driver", 0.9, 0.9)]
    ddl = "cluster_id string, cluster_name string, total_dbus double, component string, cpu_p90 double, mem_p95 double"
    found = [r.issue for r in ut.driver_worker_imbalance(frame(ddl, rows)).collect()]
    assert found == ([issue] if issue else [])


@pytest.mark.parametrize(
    "low, high, least, most, average, spread, verdict",
    [
        (1, 10, 9, 10, 9.2, 0.4, "never_scales_down"),
        (1, 10, 5, 10, 9.5, 1.0, "never_scales_down"),
        (4, 10, 1, 4, 3.0, 1.0, "never_scales_up"),
        # The range must be wide enough for "never up" and for "low variance".
        (4, 6, 1, 4, 3.0, 1.0, "healthy"),
        (2, 10, 5, 6, 5.2, 0.49, "low_variance"),
        (2, 4, 3, 3, 3.0, 0.0, "healthy"),
        (2, 10, 2, 8, 5.0, 2.0, "healthy"),
    ],
)
def test_autoscale_verdicts(frame, low, high, least, most, average, spread, verdict):
    ddl = (
        "cluster_id string, min_autoscale_workers bigint, max_autoscale_workers bigint, min_observed_workers bigint,"
        " max_observed_workers bigint, avg_workers double, worker_stddev double, total_dbus double"
    )
    row = ut.autoscale_verdicts(frame(ddl, [("c", low, high, least, most, average, spread, 100.0)])).first()
    assert row.verdict == verdict
    assert row.wasted_dbus_estimate == (15.0 if verdict == "never_scales_down" else None)


def test_idle_needs_enough_samples(make):
    start = SAMPLE_WINDOW.as_of - timedelta(days=1)

    def samples(cluster, count, cpu, driver=False):
        return [
            {"cluster_id": cluster, "instance_id": "i", "driver": driver, "start_time": start + timedelta(minutes=i),
             "cpu_user_percent": cpu, "cpu_system_percent": None}
            for i in range(count)
        ]

    nodes = make("node_timeline", [
        *samples("idle", 60, 4.9), *samples("brief", 59, 0.0), *samples("busy", 60, 5.0), *samples("driver", 90, 0.0, True)])
    hours = ut.worker_hours(nodes, SAMPLE_WINDOW)
    none = ut.cluster_usage(make("usage", []), SAMPLE_WINDOW)
    found = ut.idle_clusters(hours, none, make("clusters", [])).collect()
    assert [(r.cluster_id, r.cluster_name, r.pct_time_idle, r.total_dbus) for r in found] == [("idle", "idle", 100.0, 0.0)]


def test_old_versions_do_not_repeat_clusters(make):
    """Hours count once, however many configurations a cluster had."""
    start = datetime(2024, 1, 20)
    nodes = [
        {"cluster_id": "c", "instance_id": f"i{w}", "driver": False, "start_time": start + timedelta(hours=h)}
        for h in range(12) for w in range(2)
    ]
    versions = [
        {"cluster_id": "c", "cluster_name": f"v{v}", "min_autoscale_workers": 1, "max_autoscale_workers": 4 + v,
         "change_time": datetime(2024, 1, 1 + v)}
        for v in range(3)
    ]
    hours = ut.worker_hours(make("node_timeline", nodes), SAMPLE_WINDOW)
    none = ut.cluster_usage(make("usage", []), SAMPLE_WINDOW)
    rows = ut.autoscale_stats(hours, none, make("clusters", versions)).collect()
    assert [(r.cluster_name, r.sample_hours, r.avg_workers, r.max_autoscale_workers) for r in rows] == [("v2", 12, 2.0, 6)]


def test_without_node_metrics_results_are_empty(sample):
    less = Analysis(sample.without("node_timeline"), SAMPLE_WINDOW)
    assert not less.utilization_available
    assert less.metrics.count() == 0
    assert less.utilization_summary.first().total_clusters_analyzed == 0


def test_top_list_and_full_list_agree(sample):
    """The broadcast path for few clusters gives what the shuffled path gives."""
    top = Analysis(sample, SAMPLE_WINDOW, top_n=3).metrics
    full = Analysis(sample, SAMPLE_WINDOW, top_n=1_000_000).metrics
    assert top.count() > 0
    columns = [c for c in top.columns if c != "metric_rank"]
    assert top.select(columns).exceptAll(full.select(columns)).count() == 0
