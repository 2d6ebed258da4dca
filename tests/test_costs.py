"""Pricing, cost roll-ups, tags and weekdays."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from spendscope.functions.expressions import amount_parts, part_sums, total, total_parts
from spendscope.operators import costs, pricing, usage
from spendscope.plans.analysis import Analysis
from spendscope.sources.registry import SourceTables
from spendscope.sources.sample_tables import SAMPLE_WINDOW, contracted_prices

OPEN = datetime(2025, 1, 1)


def line(day, sku, product, qty, end_hour=12, **more):
    metadata = {k: more.pop(k) for k in ("cluster_id", "job_id", "warehouse_id") if k in more}
    return {
        "usage_date": day,
        "usage_start_time": datetime(day.year, day.month, day.day, end_hour - 1),
        "usage_end_time": datetime(day.year, day.month, day.day, end_hour),
        "sku_name": sku,
        "billing_origin_product": product,
        "workspace_id": 123456,
        "usage_quantity": float(qty),
        "usage_metadata": metadata,
        "identity_metadata": {"run_as": more.pop("run_as", None)},
        "product_features": {"is_serverless": more.pop("serverless", None)},
        **more,
    }


def price(sku, amount, start=OPEN, end=None):
    return {
        "sku_name": sku,
        "price_start_time": start,
        "price_end_time": end,
        "pricing": {"effective_list": {"default": Decimal(str(amount))}},
    }


@pytest.fixture(scope="module")
def known(spark, make):
    """The three priced lines whose totals are known."""
    day1, day2 = date(2025, 12, 1), date(2025, 12, 2)
    lines = [
        line(day1, "PREMIUM_ALL_PURPOSE_DBU", "ALL_PURPOSE", 50, cluster_id="cluster-1", run_as="user@example.com", serverless=False),
        line(day1, "PREMIUM_SQL_SERVER_DBU", "SQL", 30, warehouse_id="wh-1", run_as="analyst@example.com", serverless=True),
        line(day2, "PREMIUM_JOBS_DBU", "JOBS", 20, cluster_id="cluster-2", job_id="job-1", run_as="etl@example.com", serverless=False),
    ]
    prices = [price("PREMIUM_ALL_PURPOSE_DBU", 0.51), price("PREMIUM_SQL_SERVER_DBU", 0.6), price("PREMIUM_JOBS_DBU", 0.4)]
    return SourceTables(spark, {"usage": make("usage", lines), "list_prices": make("list_prices", prices)})


def test_known_answer(known, window):
    assert window.period_days == 90
    row = Analysis(known, window).projection.first()
    assert (row.total_dbus, row.total_cost) == (100.0, 51.5)
    assert (row.serverless_cost, row.classic_cost, row.serverless_percentage) == (18.0, 33.5, 35.0)
    assert (row.estimated_monthly_dbus, row.estimated_monthly_cost) == (33.33, 17.17)


def test_known_answer_by_dimension(known, window):
    rollup = {(r.dim, r.key): (r.dbus, r.cost) for r in Analysis(known, window).rollup.collect()}
    assert rollup[("product", "SQL")] == (30.0, 18.0)
    assert rollup[("cluster", "cluster-1")] == (50.0, 25.5)
    assert rollup[("job", "job-1")] == (20.0, 8.0)
    assert rollup[("user", "analyst@example.com")] == (30.0, 18.0)
    assert rollup[("workspace", "123456")] == (100.0, 51.5)
    assert not [k for k in rollup if k[1] is None]


def test_price_holds_from_start_up_to_end(spark, make, window):
    day = date(2025, 12, 1)
    change = datetime(2025, 12, 1, 12)
    lines = [line(day, "A", "SQL", 1, end_hour=h) for h in (11, 12, 13)] + [line(day, "B", "SQL", 1)]
    prices = [price("A", 1, OPEN, change), price("A", 2, change)]
    tables = SourceTables(spark, {"usage": make("usage", lines), "list_prices": make("list_prices", prices)})
    priced = pricing.priced_usage(tables, window).collect()
    assert sorted((r.usage_end_time.hour, r.dollar_cost) for r in priced) == [(11, 1.0), (12, 2.0), (13, 2.0)]


def test_overlapping_prices_multiply_and_period_includes_both_ends(spark, make, window):
    days = [date(2025, 11, 17), date(2025, 11, 18), date(2026, 2, 16), date(2026, 2, 17)]
    lines = [line(d, "A", "SQL", 1) for d in days]
    tables = SourceTables(
        spark, {"usage": make("usage", lines), "list_prices": make("list_prices", [price("A", 1), price("A", 2)])}
    )
    priced = pricing.priced_usage(tables, window).collect()
    assert sorted((r.usage_date, r.dollar_cost) for r in priced) == [
        (days[1], 1.0), (days[1], 2.0), (days[2], 1.0), (days[2], 2.0)
    ]


def test_contract_prices_win_only_if_they_price_something(known, window):
    contracted = contracted_prices(known["list_prices"])
    assert Analysis(known.with_table("account_prices", contracted), window).totals.first().total_cost == 46.35
    none = known.with_table("account_prices", contracted.filter("false"))
    assert Analysis(none, window).totals.first().total_cost == 51.5


def test_dimensions_add_up_to_the_total(sample):
    analysis = Analysis(sample, SAMPLE_WINDOW)
    total = analysis.totals.first()
    sums = {
        r.dim: r for r in analysis.rollup.groupBy("dim").agg(
            {"cost": "sum", "serverless_cost": "sum", "classic_cost": "sum"}
        ).collect()
    }
    for dim in usage.ALWAYS_KNOWN:
        assert sums[dim]["sum(cost)"] == pytest.approx(total.total_cost)
        assert sums[dim]["sum(serverless_cost)"] + sums[dim]["sum(classic_cost)"] == pytest.approx(total.total_cost)
    assert total.serverless_cost + total.classic_cost == pytest.approx(total.total_cost)


def test_totals_from_dimensions_equal_direct_totals(sample):
    analysis = Analysis(sample, SAMPLE_WINDOW)
    direct, derived = analysis.totals.first(), usage.totals_of(analysis.rollup).first()
    assert derived.asDict() == pytest.approx(direct.asDict())


def test_price_join_keeps_line_count_without_overlap(sample):
    lines = pricing.usage_in_period(sample["usage"], SAMPLE_WINDOW)
    priced = pricing.priced_usage(sample, SAMPLE_WINDOW).count()
    assert priced == lines.filter("sku_name NOT LIKE 'SKU_NEW%'").count()


@pytest.mark.parametrize(
    "tagged, untagged, percentage, gap", [(80.0, 20.0, 20.0, False), (79.0, 21.0, 21.0, True), (0.0, 0.0, 0.0, False)]
)
def test_tag_gap_starts_above_twenty_percent(frame, tagged, untagged, percentage, gap):
    by_status = frame("tag_status string, total_dbus double", [("tagged", tagged), ("untagged", untagged)])
    row = usage.tag_coverage(by_status).first()
    assert (row.untagged_percentage, row.has_tagging_gap) == (percentage, gap)


def test_empty_and_missing_tags_are_untagged(make, window):
    day = date(2025, 12, 1)
    lines = [line(day, "A", "SQL", q, custom_tags=t) for q, t in ((1, None), (2, {}), (4, {"team": "x"}))]
    found = {r.tag_status: r.total_dbus for r in usage.tag_usage(make("usage", lines), window).collect()}
    assert found == {"untagged": 3.0, "tagged": 4.0}


@pytest.mark.parametrize(
    "weekend, weekday, waste", [(12.0, 200.0, False), (12.01, 200.0, True), (10.0, 25.0, False), (0.0, 0.0, False)]
)
def test_weekend_waste_limits(frame, weekend, weekday, waste):
    by_day = frame("day_of_week int, total_dbus double", [(1, weekend), (4, weekday)])
    assert usage.weekend_pattern(by_day).first().has_weekend_waste is waste


def test_weekdays_are_named_from_sunday(make, window):
    daily = usage.daily_usage(make("usage", [line(date(2025, 12, 7), "A", "SQL", 1)]), window)
    by_day = usage.weekday_usage(daily).first()
    assert (by_day.day_of_week, by_day.day_name) == (1, "Sunday")


def test_configured_cluster_name_wins(frame):
    top = frame("dim string, rank int, id string, dbus double, cost double", [
        ("cluster", 1, "c1", 1.0, 1.0), ("cluster", 2, "c2", 1.0, 1.0), ("job", 1, "j1", 1.0, 1.0), ("sku", 1, "c1", 1.0, 1.0)])
    jobs = frame("job_id string, job_name string, job_rank int", [("j1", "first", 1), ("j1", "last", 2), ("j1", None, 3)])
    cost_names = frame("cluster_id string, cluster_name string", [("c1", "old"), ("c2", "from cost")])
    configs = frame(
        "cluster_id string, cluster_name string, owned_by string, change_time timestamp_ntz",
        [("c1", "older", "o", datetime(2025, 1, 1)), ("c1", "new", "o", datetime(2025, 2, 1))],
    )
    houses = frame("warehouse_id string, warehouse_name string", [("w", "x")])
    found = {(r.dim, r.id): r.name for r in costs.name_top_items(top, jobs, cost_names, configs, houses).collect()}
    assert found == {("cluster", "c1"): "new", ("cluster", "c2"): "from cost", ("job", "j1"): "last", ("sku", "c1"): None}


def test_sums_of_millions_do_not_depend_on_partitions(spark):
    n = 2_000_000
    amounts = spark.range(n).select("id", (((F.col("id") * 7919) % 1_000_003) / 997.0).alias("amount"))
    found = {
        parts: amounts.repartition(parts, F.xxhash64("id", F.lit(parts))).agg(total("amount").alias("sum")).first()[0]
        for parts in (1, 3, 37)
    }
    assert len(set(found.values())) == 1
    exact = sum((Decimal(repr(k * 7919 % 1_000_003 / 997.0)).quantize(Decimal("1e-12"), ROUND_HALF_UP) for k in range(n)), Decimal(0))
    assert found[1] == float(exact.quantize(Decimal("1e-6"), ROUND_HALF_UP))


def test_many_prices_of_one_sku_meet_lines_by_day(frame, window):
    """A thousand prices of a SKU, some of them overlapping, open or ending before they begin."""
    begin, hours = datetime(2025, 11, 10), 110 * 24
    moments = [begin + timedelta(hours=h * 2.64) for h in range(1000)]
    book = [("S", a, b, Decimal(k % 97 + 1)) for k, (a, b) in enumerate(zip(moments, moments[1:]))]
    book += [("S", moments[500], None, Decimal(1000)), ("S", moments[9], moments[3], Decimal(2000)), ("S", None, None, Decimal(3000)),
             ("T", moments[0], moments[-1], Decimal(5)), (None, moments[0], None, Decimal(6))]
    lines = [(sku, 1.0, begin + timedelta(hours=h, minutes=30 * (h % 2))) for h in range(-50, hours + 50, 7) for sku in ("S", "T")]
    lines += [("S", 1.0, m) for m in moments[::13]] + [("S", 1.0, None), (None, 1.0, moments[0]), ("U", 1.0, moments[0])]
    usage = frame("sku_name string, usage_quantity double, usage_end_time timestamp_ntz", lines)
    prices = frame("sku_name string, price_start_time timestamp_ntz, price_end_time timestamp_ntz, unit_price decimal(18,6)", book)
    expected = sorted(
        (sku, end, price) for sku, _, end in lines for of, a, b, price in book
        if sku is not None and sku == of and end and a and a <= end and (b is None or end < b)
    )
    found = pricing.price_usage(usage, prices, window)
    assert found.columns == [*usage.columns, "dollar_cost"]
    assert sorted((r.sku_name, r.usage_end_time, r.dollar_cost) for r in found.collect()) == expected
    joins = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
    assert any("_day" in x.partition("Inner")[0] for x in joins)  # a key of the join, not a filter after it


def test_only_long_histories_are_cut(frame, window):
    schema = "sku_name string, price_start_time timestamp_ntz, price_end_time timestamp_ntz, unit_price decimal(18,6)"
    days = [OPEN + timedelta(days=330 + k) for k in range(31)]  # from November 27 on
    often = [("often", a, b, Decimal(1)) for a, b in zip(days, days[1:])]
    seldom = [("seldom", OPEN, None, Decimal(k)) for k in range(pricing.FEW_PRICES)]
    book = frame(schema, often + seldom + [("often", OPEN, None, Decimal(2)), ("often", None, None, Decimal(2)), (None, OPEN, None, Decimal(2))])
    daily = pricing._daily_skus(book)
    assert [r.sku_name for r in daily.collect()] == ["often"]
    found = [(r.sku_name, r._day) for r in pricing._by_day(book, daily, window).collect()]
    assert sorted(d for sku, d in found if sku == "seldom") == [pricing.UNCUT] * len(seldom)
    reached = sorted(d for sku, d in found if sku == "often")
    # Each day's price reaches into the next day's midnight; the open one is in all days, before and after too.
    # One without a start has a row that no line can match.
    expected = [d for k in range(30) for d in (9 + k, 10 + k)] + [*range(-1, window.period_days + 2), window.period_days + 1]
    assert reached == sorted(expected)
    usage = frame("sku_name string, usage_quantity double, usage_end_time timestamp_ntz", [("seldom", 1.0, days[0])])
    assert pricing.price_usage(usage, book, window).count() == len(seldom)
    assert pricing.price_usage(usage, frame(schema, []), window).count() == 0


def test_amounts_are_priced_as_decimals(frame, window):
    usage = frame("sku_name string, usage_quantity double, usage_end_time timestamp_ntz",
                  [("S", 0.1, datetime(2024, 1, 2))] * 3 + [("S", None, datetime(2024, 1, 2))])
    prices = frame("sku_name string, price_start_time timestamp_ntz, price_end_time timestamp_ntz, unit_price decimal(18,6)",
                   [("S", datetime(2024, 1, 1), None, Decimal("0.7"))])
    priced = pricing.price_usage(usage, prices, window)
    assert priced.schema["dollar_cost"].dataType.simpleString().startswith("decimal")
    assert sorted(str(r.dollar_cost.normalize()) for r in priced.filter("dollar_cost is not null").collect()) == ["0.07"] * 3
    assert priced.agg(total("dollar_cost")).first()[0] == 0.21


def test_parts_add_up_to_the_exact_sum(frame):
    values = [0.1, 1e9 + 0.123456789012, -0.000000000001, 12345.678901234567, -7.5, 1 / 3, None, 1e11] * 50
    exact = sum((Decimal(repr(v)).quantize(Decimal("1e-12"), ROUND_HALF_UP) for v in values if v is not None), Decimal(0))
    expected = float(exact.quantize(Decimal("1e-6"), ROUND_HALF_UP))
    for parts in (1, 3, 37):
        table = frame("k int, v double", [(n % 7, v) for n, v in enumerate(values)]).repartition(parts)
        assert table.agg(total("v").alias("t")).first().t == expected
        per_key = table.select("k", *amount_parts("v")).groupBy("k").agg(*part_sums("v"))
        assert per_key.agg(total_parts("v").alias("t")).first().t == expected
    assert frame("v double", []).agg(total("v").alias("t")).first().t == 0.0


@pytest.mark.parametrize("values", [[1e13], [9e12, 9e12]])
def test_sums_past_the_limit_are_errors(frame, values):
    with pytest.raises(ArithmeticException):
        frame("v double", [(v,) for v in values]).agg(total("v")).collect()


def _scans(df, table):
    """How often the plan reads a sample table."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(f"{table}.parquet" in line for line in plan.splitlines() if "FileScan" in line)


def test_dimensions_come_from_one_pass_without_expand(sample, spark):
    rollup = Analysis(sample, SAMPLE_WINDOW).rollup
    plan = rollup._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    rollup.collect()
    final = rollup._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert "ReusedExchange" in final


def test_combinations_of_catalogs_and_resources_are_not_kept(frame):
    """Every line is a combination of its own, but SKUs and clusters are few."""
    n = 40
    ddl = "product string, sku string, workspace string, cluster string, job string, warehouse string, user string, serverless boolean"
    rows = [("P", f"s{i}", "1", f"c{j}", None, None, None, False, 1, 0, 2, 0) for i in range(n) for j in range(n)]
    lines = frame(ddl + ", dbus_high long, dbus_low long, cost_high long, cost_low long", rows)
    resources = [d for d in usage.DIMENSIONS if d not in usage.ALWAYS_KNOWN]
    found = usage._two_cuboids(lines, list(usage.ALWAYS_KNOWN), resources).collect()
    assert len(found) == 2 * n
    assert {(r.sku, r.cluster, r.dbus_high, r.cost_high) for r in found} == {
        *((f"s{i}", None, n, 2 * n) for i in range(n)), *((None, f"c{i}", n, 2 * n) for i in range(n))
    }


def test_short_doubles_are_added_without_decimals(frame):
    values = [0.1, 0.7, 12.5, -3.000001, 1e8 + 0.25, 999999999.999999, 0.0000005, 1 / 3, -0.0, 0.0, None, 5e11, 123456.1234567]
    table = frame("k int, v double", list(enumerate(values)))
    found = table.select("v", *amount_parts("v")).collect()
    for r in found:
        if r.v is None:
            assert (r.v_high, r.v_low) == (None, None)
        else:
            exact = Decimal(repr(r.v)).quantize(Decimal("1e-12"), ROUND_HALF_UP).scaleb(12)
            assert r.v_high * 10**6 + r.v_low == exact
    plan = table.select(*amount_parts("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "rint" in plan.lower()
    decimals = table.select(F.col("v").cast("decimal(28,12)").alias("v")).select(*amount_parts("v"))
    assert "rint" not in decimals._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [tuple(r) for r in decimals.collect()] == [(r.v_high, r.v_low) for r in found]


def test_what_a_task_reads_is_bounded(spark):
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "16MB"


def test_job_costs_read_usage_once(sample):
    assert _scans(Analysis(sample, SAMPLE_WINDOW).job_costs, "lineitem") == 1


def test_runs_without_cluster_match_no_capacity(sample):
    """Their spread keys name no cluster, even one whose id looks like a key."""
    found = Analysis(sample, SAMPLE_WINDOW).job_costs
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan and "isnotnull(cluster_id" in plan
