"""Schema checks, missing sources, profile and files."""

from __future__ import annotations

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from spendscope.operators import jobs, pricing
from spendscope.plans.analysis import Analysis
from spendscope.plans.store import ResultStore
from spendscope.sources import profile, sinks
from spendscope.sources.registry import MissingSource, SchemaMismatch, SourceTables
from spendscope.sources.sample_tables import SAMPLE_WINDOW, contracted_prices


def test_schema_is_checked(spark, sample):
    with pytest.raises(SchemaMismatch, match="list_prices.pricing is missing"):
        SourceTables(spark, {"list_prices": sample["list_prices"].drop("pricing")})
    with pytest.raises(SchemaMismatch, match="usage.usage_quantity is string"):
        SourceTables(spark, {"usage": sample["usage"].withColumn("usage_quantity", sample["usage"].sku_name)})
    with pytest.raises(SchemaMismatch, match="query_history.compute.warehouse_id is missing"):
        SourceTables(spark, {"query_history": sample["query_history"].selectExpr("* except (compute)", "struct(1 as x) as compute")})
    with pytest.raises(KeyError):
        SourceTables(spark, {"surprise": sample["usage"]})


def test_wider_and_decimal_tables_are_fine(spark, sample):
    usage = sample["usage"].selectExpr("* except (usage_quantity)", "cast(usage_quantity as decimal(38,18)) as usage_quantity", "1 as more")
    tables = sample.with_table("usage", usage)
    assert Analysis(tables, SAMPLE_WINDOW).totals.first() == Analysis(sample, SAMPLE_WINDOW).totals.first()


def test_zoned_time_stamps_are_fine(sample):
    """Sources may hold time stamps with a zone; the session zone is UTC."""
    zoned = lambda df: df.select(*[
        F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else f.name
        for f in df.schema.fields])
    tables = sample
    for name in ("usage", "list_prices", "warehouse_events", "query_history", "job_run_timeline"):
        tables = tables.with_table(name, zoned(tables[name]))
    a, b = Analysis(tables, SAMPLE_WINDOW), Analysis(sample, SAMPLE_WINDOW)
    for name in ("totals", "run_metrics", "user_stats"):
        assert sorted(map(str, getattr(a, name).collect())) == sorted(map(str, getattr(b, name).collect())), name
    for name in ("long_running", "upscaled"):
        assert getattr(a, name).drop("event_time").collect() == getattr(b, name).drop("event_time").collect(), name


def test_missing_sources(sample):
    less = sample.without("jobs", "node_timeline")
    assert not less.has("jobs")
    assert less.get_or_empty("jobs").count() == 0
    with pytest.raises(MissingSource):
        less["jobs"]
    owners = Analysis(less, SAMPLE_WINDOW).jobs.select("owner").distinct().collect()
    assert [r.owner for r in owners] == [None]


def test_recommendations_without_optional_sources(sample):
    less = Analysis(sample.without("jobs", "node_timeline"), SAMPLE_WINDOW, reuse=True)
    found = {r.rule for r in less.recommendations.select("rule").distinct().collect()}
    assert "cost_monitoring" in found
    assert not found & {"rightsize_cluster", "idle_clusters", "autoscale_never_down"}


def test_catalog_and_parquet(spark, sample, tmp_path):
    path = str(tmp_path / "warehouses")
    sample["warehouses"].write.parquet(path)
    assert SourceTables.from_parquet(spark, {"warehouses": path})["warehouses"].count() == 25
    spark.read.parquet(path).createOrReplaceTempView("wh_view")
    bound = SourceTables.from_catalog(spark, {"warehouses": "wh_view", "jobs": "no_such_table"})
    assert bound.names() == ["warehouses"]


def test_profile(sample):
    rows = {r.source: r for r in profile.source_profile(sample).collect()}
    assert rows["usage"].row_count == sample["usage"].count()
    assert str(rows["usage"].min_date) == "2024-01-01"
    assert profile.sample_rows(sample["usage"]).count() == 5
    assert profile.distinct_values(sample["usage"], "sku_name", 20).count() == 20
    assert profile.distinct_values(sample["usage"], "sku_name").count() == sample["usage"].select("sku_name").distinct().count()


def test_results_are_written(sample, tmp_path):
    analysis = Analysis(sample, SAMPLE_WINDOW, reuse=True)
    tables = analysis.report_tables()
    summary = sinks.report_summary(analysis.recommendations, analysis.projection)
    sinks.write_results({"summary": summary, **tables}, str(tmp_path / "out"))
    written = {p.name for p in (tmp_path / "out").iterdir()}
    assert written == {"summary", *tables}
    [line] = [l for p in (tmp_path / "out" / "summary").glob("*.json") for l in p.read_text().splitlines()]
    assert json.loads(line)["total_recommendations"] == analysis.recommendations.count()
    sinks.write_results({"top": tables["top_items"]}, str(tmp_path / "out"), fmt="parquet")
    assert sample.spark.read.parquet(str(tmp_path / "out" / "top")).count() == tables["top_items"].count()


def test_files_in_order_give_the_order(spark, sample, tmp_path):
    priced = pricing.listed_usage(Analysis(sample, SAMPLE_WINDOW).priced)
    runs = jobs.job_runs(sample["job_run_timeline"], SAMPLE_WINDOW)
    assert "rangepartitioning" not in priced._jdf.queryExecution().executedPlan().toString()
    orders = {"priced": pricing.NEWEST_FIRST, "runs": jobs.RUNS_BY_JOB}
    sinks.write_results({"priced": priced, "runs": runs}, str(tmp_path), fmt="parquet", orders=orders)
    for name, df in (("priced", priced), ("runs", runs)):
        files = sorted((tmp_path / name).glob("part-*.parquet"))
        assert len(files) > 1
        rows = [r for f in files for r in spark.read.parquet(str(f)).select(*[c.lstrip("-") for c in orders[name]]).collect()]
        expected = df.orderBy(*map(sinks.sort_key, orders[name])).select(*[c.lstrip("-") for c in orders[name]]).collect()
        assert rows == expected
    bounds = {r.file: r for r in sinks.file_bounds(spark, str(tmp_path / "priced"), "usage_date").collect()}
    in_order = [bounds[f.name] for f in sorted((tmp_path / "priced").glob("part-*.parquet"))]
    assert all(a.least >= b.greatest for a, b in zip(in_order, in_order[1:])) and sum(r.rows for r in in_order) == priced.count()


def test_results_are_taken_up_again_and_removed(spark, sample, tmp_path):
    store = ResultStore(spark, str(tmp_path / "results"))
    first = Analysis(sample, SAMPLE_WINDOW, store=store)
    expected = [tuple(r) for r in first.recommendations.collect()]
    names = set(store.names())
    assert {"rollup", "metrics", "jobs", "candidates", "recommendations"} <= names and expected
    # A result that broke off is computed again, the others are read.
    (tmp_path / "results" / "user_stats" / "_SUCCESS").unlink()
    kept = {n: (tmp_path / "results" / n / "_SUCCESS").stat().st_mtime_ns for n in names - {"user_stats"}}
    again = Analysis(sample, SAMPLE_WINDOW, store=store)
    assert [tuple(r) for r in again.recommendations.collect()] == expected and set(store.names()) == names
    assert kept == {n: (tmp_path / "results" / n / "_SUCCESS").stat().st_mtime_ns for n in kept}
    plain = Analysis(sample, SAMPLE_WINDOW, reuse=True)
    assert [tuple(r) for r in plain.recommendations.collect()] == expected
    store.remove()
    assert store.names() == [] and not (tmp_path / "results").exists()


def test_confidence_scales_the_savings(sample):
    half = Analysis(sample, SAMPLE_WINDOW, reuse=True, confidence=0.375)
    whole = Analysis(sample, SAMPLE_WINDOW, reuse=True)
    of = lambda a: {r.id: r.estimated_savings for r in a.candidates.where("rule = 'cost_monitoring'").collect()}
    found, usual = of(half), of(whole)
    assert found.keys() == usual.keys() and all(abs(2 * found[k] - usual[k]) <= 0.01 for k in usual) and any(usual.values())


def test_contract_prices_are_chosen_without_a_job(spark, sample):
    tables = sample.with_table("account_prices", contracted_prices(sample["list_prices"]))
    tracker, before = spark.sparkContext.statusTracker(), spark.sparkContext.statusTracker().getJobIdsForGroup("built")
    spark.sparkContext.setJobGroup("built", "definition")
    try:
        totals = Analysis(tables, SAMPLE_WINDOW).totals
        assert list(tracker.getJobIdsForGroup("built")) == list(before)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plain = Analysis(sample, SAMPLE_WINDOW).totals.first()
    assert totals.first().total_cost == pytest.approx(0.9 * plain.total_cost)


def test_days_without_samples_of_the_period_are_not_read(spark, sample, tmp_path):
    path = str(tmp_path / "nodes")
    sample["node_timeline"].withColumn("day", F.to_date("start_time")).write.partitionBy("day").parquet(path)
    layout = {"node_timeline": {"day": "start_time"}}
    bound = SourceTables.from_parquet(spark, {"node_timeline": path}, layout)
    late = replace(SAMPLE_WINDOW, lookback_days=10)
    less = Analysis(bound, late).worker_hours
    plan = less._jdf.queryExecution().executedPlan().toString()
    [filters] = {line.partition("PartitionFilters: [")[2].partition("]")[0] for line in plan.splitlines() if "FileScan" in line}
    assert "day" in filters and "2024-01-21" in filters
    plain = Analysis(SourceTables(spark, {"node_timeline": sample["node_timeline"]}), late).worker_hours
    key = ["cluster_id", "usage_date", "usage_hour", "active_workers", "samples"]
    assert less.select(key).exceptAll(plain.select(key)).count() == 0 == plain.select(key).exceptAll(less.select(key)).count()
    assert less.count() > 0 and "node_timeline" in bound.layout and not bound.without("node_timeline").layout
    with pytest.raises(SchemaMismatch, match="node_timeline has no month"):
        SourceTables(spark, {"node_timeline": sample["node_timeline"]}, {"node_timeline": {"month": "start_time"}})
