"""Query text patterns, rules and report tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spendscope.functions import expressions as ex
from spendscope.operators import query_history, rules
from spendscope.plans import report
from spendscope.plans.analysis import Analysis
from spendscope.sources.sample_tables import SAMPLE_WINDOW


@pytest.mark.parametrize(
    "text, star, no_filter, joins",
    [
        ("select\n  * from t", True, True, 0),
        ("SELECT a FROM t where x", False, False, 0),
        ("select a from t join u", False, False, 1),
        ("select count(*) from t", False, True, 0),
        ("select joined, nowhere from t", False, False, 0),
        ("a JOIN b join c Join d", False, False, 3),
        (None, False, True, 0),
    ],
)
def test_query_text(frame, text, star, no_filter, joins):
    row = frame("t string", [(text,)]).select(
        ex.selects_star(F.col("t")).alias("star"), ex.lacks_filter(F.col("t")).alias("bare"), ex.join_count(F.col("t")).alias("joins")
    ).first()
    assert (row.star, row.bare, row.joins) == (star, no_filter, joins)


@pytest.mark.parametrize(
    "effort, minutes",
    [
        ("30 seconds to stop", 0.5), ("90 seconds", 1.5), ("5 minutes to test", 5.0), ("15-30 minutes", 2.0),
        ("1-2 hours per cluster to analyze", 120.0), ("3 hours", 180.0), ("15 min per table", 30.0), ("Varies", 30.0),
        ("30 minutes to implement, 1 week to validate", 30.0), ("minutes", 2.0),
    ],
)
def test_effort_minutes(frame, effort, minutes):
    assert frame("e string", [(effort,)]).select(ex.effort_minutes(F.col("e"))).first()[0] == pytest.approx(minutes)


def test_user_display(frame):
    rows = frame("u string", [("ann@example.com",), ("bob",), (None,)]).select(ex.user_display(F.col("u"))).collect()
    assert [r[0] for r in rows] == ["ann", "bob", None]


def test_pattern_severity(frame):
    counts = frame("pattern string, count bigint", [("select_star", 2), ("no_where_clause", 1)])
    assert {(r.type, r.severity, r["count"]) for r in query_history.pattern_findings(counts).collect()} == {
        ("select_star", "medium", 2), ("no_where_clause", "high", 1)}


def test_spill_limit(make):
    gib = 1024**3
    history = make("query_history", [
        {"statement_id": i, "compute": {"warehouse_id": w}, "start_time": SAMPLE_WINDOW.as_of.replace(day=5), "spilled_local_bytes": b}
        for i, (w, b) in enumerate([("a", gib), ("b", gib + 1), ("b", 5), ("c", 0), (None, gib * 9)])])
    spill = query_history.disk_spill(history, SAMPLE_WINDOW)
    assert {r.warehouse_id: (r.spill_frequency, r.needs_upsize) for r in spill.collect()} == {"a": (1, False), "b": (2, True)}
    assert tuple(query_history.spill_summary(spill).first()) == (3, True)


CANDIDATE = "id string, rule string, resource_id string, severity string, estimated_savings double, rule_order int, seq double"


def test_keep_first_and_order(frame):
    rows = [
        ("rightsize_c", "rightsize", "c-1", "medium", 9.0, 12, 1.0),
        ("rightsize_c", "rightsize", "c-2", "medium", 8.0, 12, 2.0),
        ("job_x", "job_failures", "x", "high", 5.0, 22, 2.0),
        ("job_x", "job_failures", "x", "high", 7.0, 22, 1.0),
        ("cost_monitoring", "cost_monitoring", None, "low", 100.0, 34, 0.0),
        ("disk_spill_w", "disk_spill", "w", "medium", 0.0, 31, 0.0),
        ("tiny", "wh_size", "t", "high", 0.99, 3, 0.0),
    ]
    candidates = frame(CANDIDATE, rows)
    by_resource = rules.in_order(rules.worthwhile(rules.keep_first(candidates))).collect()
    assert [(r.id, r.resource_id, r.estimated_savings) for r in by_resource] == [
        ("job_x", "x", 7.0), ("rightsize_c", "c-1", 9.0), ("rightsize_c", "c-2", 8.0), ("cost_monitoring", None, 100.0)]
    by_id = rules.worthwhile(rules.keep_first(candidates, by_id=True))
    assert {r.resource_id for r in by_id.filter("rule = 'rightsize'").collect()} == {"c-1"}


def test_no_recommendations_without_cost(frame):
    totals = frame("total_dbus double, total_cost double", [(10.0, 0.0)])
    some = frame(CANDIDATE, [("a", "a", None, "low", 5.0, 1, 0.0)])
    assert rules.union_rules([some, some], totals).count() == 0
    paid = frame("total_dbus double, total_cost double", [(10.0, 1.0)])
    assert rules.union_rules([some, some], paid).count() == 2


def test_average_price_falls_back(frame):
    price = lambda *row: rules.average_dbu_price(frame("total_dbus double, total_cost double", [row])).first()[0]
    assert price(10.0, 4.0) == 0.4
    assert price(0.0, 0.0) == 0.5


def test_starter_warehouse_is_skipped_only_while_cheap(frame):
    ddl = "warehouse_id string, warehouse_name string, auto_stop_minutes int, total_cost double"
    rows = [("a", "My Starter", 0, 0.99), ("b", "My Starter", 0, 1.0), ("c", None, 61, 10.0), ("d", "x", 60, 10.0), ("e", "x", 0, 0.0)]
    found = rules.warehouse_auto_stop(frame(ddl, rows)).collect()
    assert {(r.id, r.estimated_savings) for r in found} == {("wh_auto_stop_b", 0.23), ("wh_reduce_stop_c", 0.75)}


@pytest.mark.parametrize(
    "hours, size, clusters, savings, severity",
    [(4.0, "Small", 1, None, None), (5.0, "Small", 2, 7.5, "medium"), (10.0, "odd", 1, 15.0, "high"), (8.0, "2x-large", 1, 96.0, "medium")],
)
def test_long_running_rule(frame, hours, size, clusters, savings, severity):
    ddl = "warehouse_id string, warehouse_name string, warehouse_size string, running_hours double, cluster_count bigint"
    found = rules.long_running_warehouses(frame(ddl, [("w", "n", size, hours, clusters)])).collect()
    assert [(r.estimated_savings, r.severity) for r in found] == ([(savings, severity)] if savings else [])


def test_pools_prefer_short_jobs(frame):
    jobs = lambda *costs: frame("type string, cost double", [("startup_overhead", c) for c in costs])
    clusters = frame("cluster_id string, total_cost double", [("a", 10.0), ("b", 10.0)])
    assert [(r.id, r.estimated_savings) for r in rules.cluster_pools(jobs(10.0, 20.0), clusters).collect()] == [
        ("cluster_pools_startup", 6.75)]
    assert [(r.id, r.estimated_savings) for r in rules.cluster_pools(jobs(10.0), clusters).collect()] == [
        ("use_cluster_pools", 0.75)]


def test_every_matching_job_is_named(frame):
    ddl = "job_id string, job_name string, is_serverless boolean, total_cost double, run_count bigint, job_rank int"
    rows = [("a", "A", True, 9.0, 50, 1), ("b", None, None, 8.0, 3, 2), ("c", "C", False, 7.0, 30, 3), ("d", "D", False, 6.0, 90, 4)]
    assert [r.id for r in rules.serverless_job(frame(ddl, rows)).collect()] == [
        "serverless_job_b", "serverless_job_c", "serverless_job_d"]
    assert [r.id for r in rules.frequent_job(frame(ddl, rows)).collect()] == ["job_freq_a", "job_freq_c", "job_freq_d"]
    assert rules.frequent_job(frame(ddl, rows[1:2])).count() == 0


def test_ids_hold_the_whole_resource(frame):
    ddl = "job_id string, job_name string, is_serverless boolean, total_cost double, run_count bigint, job_rank int"
    rows = [(f"same-first-12-characters-{k}", None, False, 9.0, 50, k) for k in (1, 2)]
    assert len({r.id for r in rules.frequent_job(frame(ddl, rows)).collect()}) == 2


@pytest.mark.parametrize("spot, on_demand, expected", [(0.0, 10.0, 4.5), (8.0, 2.0, 0.9), (8.1, 1.9, None), (0.0, 0.5, None)])
def test_spot_rule(frame, spot, on_demand, expected):
    jobs = frame("total_cost double, spot_cost double, on_demand_cost double", [(spot + on_demand, spot, on_demand)])
    assert [r.estimated_savings for r in rules.spot_instances(jobs).collect()] == ([expected] if expected else [])


def test_summary_caps_savings(frame):
    recommendations = frame("severity string, estimated_savings double", [("high", 90.0), ("low", 20.0)])
    projection = frame("estimated_monthly_cost double", [(100.0,)])
    row = report.executive_summary(recommendations, projection).first()
    assert (row.raw_savings, row.monthly_savings, row.savings_capped, row.savings_percentage) == (110.0, 95.0, True, 95.0)
    grades = report.assessment(report.executive_summary(recommendations, projection)).first()
    assert (grades.grade, grades.benchmark_band, grades.timeline) == ("F", "HIGH", "1-2 weeks")
    months = report.twelve_months(report.executive_summary(recommendations, projection)).collect()
    assert (len(months), months[11].current_path, months[11].optimized_path) == (12, 1200.0, 60.0)


@pytest.mark.parametrize(
    "share, annual, grade, band",
    [(40.0, 100_000.0, "F", "HIGH"), (30.0, 50_000.0, "D", "MEDIUM"), (20.0, 20_000.0, "C", "MEDIUM"), (10.0, 1.0, "B", "LOW"),
     (9.9, 1.0, "A", "VERY LOW")],
)
def test_bands(frame, share, annual, grade, band):
    row = report.assessment(
        frame("savings_percentage double, annual_savings double, high_count int, recommendations int", [(share, annual, 0, 1)])
    ).first()
    assert (row.grade, row.benchmark_band, row.timeline) == (grade, band, "2-4 weeks")


def test_reuse_gives_the_same_recommendations(sample):
    """Stored intermediate results change nothing but the work."""
    stored = Analysis(sample, SAMPLE_WINDOW, reuse=True)
    plain = Analysis(sample, SAMPLE_WINDOW)
    columns = ["id", "resource_id", "severity", "estimated_savings"]
    for name in ("cluster_issues", "warehouses", "totals", "rollup", "weekend"):
        a, b = getattr(stored, name), getattr(plain, name)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())), name
    ordered = stored.recommendations.select(columns).collect()
    place = {"high": 0, "medium": 1, "low": 2}
    assert ordered and ordered == sorted(ordered, key=lambda r: (place[r.severity], -r.estimated_savings))
