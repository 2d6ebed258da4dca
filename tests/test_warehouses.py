"""Warehouse state against a brute-force reading of the rules, and findings."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from spendscope.operators import warehouses as wh

START = datetime(2024, 1, 1)


def random_events(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    kinds = ["RUNNING", "SCALED_UP", "SCALED_UP", "SCALED_DOWN", "STOPPED", "STARTING"]
    # Few minutes, so that times tie often; warehouse 0 holds a third of the events.
    return [
        (f"wh-{rng.choice([0, 0, 0, *range(1, 7)])}", rng.choice(kinds), rng.choice([1, 2, 3, 4, None]),
         START + timedelta(minutes=rng.randrange(15)))
        for _ in range(60)
    ]


def brute_running(events):
    return [e for e in events if e[1] == "RUNNING" and not any(o[0] == e[0] and o[3] > e[3] for o in events)]


def brute_scaled_up(events):
    def ends(o, e):
        smaller = o[1] == "SCALED_UP" and o[2] is not None and o[2] < e[2]
        return o[0] == e[0] and o[3] > e[3] and (o[1] in ("SCALED_DOWN", "STOPPED") or smaller)

    return [
        e for e in events
        if e[1] == "SCALED_UP" and e[2] is not None and e[2] >= 2 and not any(ends(o, e) for o in events)
    ]


@pytest.mark.parametrize("seed", range(6))
def test_state_equals_brute_force(frame, seed):
    events = random_events(seed)
    df = frame("warehouse_id string, event_type string, cluster_count bigint, event_time timestamp_ntz", events)
    plain = lambda found: sorted(tuple(r) for r in found.select(df.columns).collect())
    assert plain(wh.running_now(df)) == sorted(brute_running(events))
    assert plain(wh.scaled_up_now(df)) == sorted(brute_scaled_up(events))


def test_recent_events_equal_a_plain_sort(frame):
    rng = random.Random(3)
    from spendscope.sources.sample_tables import SAMPLE_WINDOW

    events = [(f"wh-{rng.randrange(5)}", "RUNNING", i, START + timedelta(minutes=rng.randrange(40_000))) for i in range(2_000)]
    df = frame("warehouse_id string, event_type string, cluster_count bigint, event_time timestamp_ntz", events)
    inside = [e for e in events if START <= e[3] <= datetime(2024, 1, 30)]
    for limit in (1, 100, 5_000):
        expected = sorted(inside, key=lambda e: (-e[3].timestamp(), e[0], e[1], e[2]))[:limit]
        assert [tuple(r) for r in wh.recent_events(df, SAMPLE_WINDOW, limit).collect()] == expected


@pytest.mark.parametrize(
    "stop, size, kind, cost, found",
    [
        (0, "Small", "PRO", 10.0, {("no_auto_stop", "high", 2.0)}),
        (30, "Small", "PRO", 10.0, set()),
        (31, "Small", "PRO", 10.0, {("long_auto_stop", "medium", 1.0)}),
        (10, "2x-Large", "PRO", 10.0, {("oversized", "medium", 2.5)}),
        (10, "2X-Large", "PRO", 0.0, set()),
        (10, "Small", "classic", 5.0, set()),
        (0, "4X-LARGE", "CLASSIC", 10.0, {
            ("no_auto_stop", "high", 2.0), ("oversized", "medium", 2.5), ("serverless_candidate", "low", 1.5)}),
        (None, None, None, 10.0, set()),
    ],
)
def test_configuration_findings(frame, stop, size, kind, cost, found):
    ddl = (
        "warehouse_id string, warehouse_name string, warehouse_type string, warehouse_size string,"
        " auto_stop_minutes int, total_cost double"
    )
    issues = wh.warehouse_issues(frame(ddl, [("w", "name", kind, size, stop, cost)])).collect()
    assert {(i.type, i.severity, i.estimated_savings) for i in issues} == found


def test_merge_keeps_both_sides(frame):
    configs = frame(
        "warehouse_id string, warehouse_name string, warehouse_type string, warehouse_size string, min_clusters int,"
        " max_clusters int, auto_stop_minutes int", [("a", None, "PRO", "Small", 1, 2, 10), ("b", "B", "PRO", "Small", 1, 2, 10)])
    costs = frame(
        "warehouse_id string, total_dbus double, total_cost double, serverless_cost double, classic_cost double",
        [("b", 1.0, 2.0, 2.0, 0.0), ("gone", 3.0, 4.0, 0.0, 4.0)])
    merged = {r.warehouse_id: (r.warehouse_name, r.total_cost) for r in wh.merge_costs(configs, costs).collect()}
    assert merged == {"a": (None, 0.0), "b": ("B", 2.0), "gone": ("Unknown (gone)", 4.0)}


def test_idle_needs_quiet_hours(frame, make):
    as_of = datetime(2024, 1, 31, 12)
    events = frame(
        "warehouse_id string, event_type string, cluster_count bigint, event_time timestamp_ntz",
        [(w, "RUNNING", 1, as_of - timedelta(minutes=m)) for w, m in
         (("none", 31), ("young", 30), ("busy", 90), ("quiet", 240), ("old", 240))])
    history = make("query_history", [
        {"statement_id": i, "compute": {"warehouse_id": w}, "start_time": as_of - age, "end_time": as_of - age}
        for i, (w, age) in enumerate([
            ("busy", timedelta(hours=2, minutes=59)), ("quiet", timedelta(hours=3)), ("old", timedelta(days=3))])])
    configs = wh.warehouse_configs(make("warehouses", []))
    found = {r.warehouse_id: (r.warehouse_name, r.running_hours, r.recent_query_count)
             for r in wh.idle(events, configs, history, as_of).collect()}
    assert found == {"none": ("Unknown", 0.52, 0), "quiet": ("Unknown", 4.0, 1), "old": ("Unknown", 4.0, 0)}


def test_long_running_limit(frame, make):
    as_of = datetime(2024, 1, 31)
    events = frame(
        "warehouse_id string, event_type string, cluster_count bigint, event_time timestamp_ntz",
        [("a", "RUNNING", None, as_of - timedelta(minutes=61)), ("b", "RUNNING", 2, as_of - timedelta(minutes=60, seconds=59))])
    rows = wh.long_running(events, wh.warehouse_configs(make("warehouses", [])), as_of).collect()
    assert [(r.warehouse_id, r.running_hours, r.cluster_count) for r in rows] == [("a", 1.02, 1)]
