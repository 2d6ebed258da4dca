"""Exact percentiles against numpy and Spark's own."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendscope.functions import percentiles
from spendscope.functions.percentiles import exact_percentiles, sketch

POINTS = (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)


def data() -> pd.DataFrame:
    rng = np.random.default_rng(7)
    groups = {
        # One group holds most rows, and most of its values are equal.
        "hot": np.concatenate([np.zeros(30_000), rng.uniform(0, 100, 5_000)]),
        "spread": rng.normal(50, 20, 4_001),
        "narrow": rng.uniform(10.0, 10.05, 999),
        "pair": np.array([1.0, 2.0]),
        "single": np.array([42.5]),
        "negative": rng.uniform(-3, 3, 500),
        "equal": np.full(2_000, 7.0),
    }
    return pd.DataFrame([(g, float(v)) for g, values in groups.items() for v in values], columns=["grp", "m"])


def found_by(rows, fractions, **options):
    rows = rows.withColumn("k", F.col("m") * -2)
    profile = rows.groupBy("grp").agg(F.count("*").alias("n"), sketch("m"), sketch("k"))
    return exact_percentiles(rows, profile, ["grp"], fractions, **options)


@pytest.mark.parametrize("error", [percentiles.RANK_ERROR, 0.2, -0.008])
def test_equal_to_numpy(spark, monkeypatch, error):
    """With a negative error bounds are too narrow for most sketches, and are widened."""
    widened = []
    widen = percentiles._widened
    monkeypatch.setattr(percentiles, "_widened", lambda *a: widened.append(a[4].count()) or widen(*a))
    rows = data()
    table = spark.createDataFrame(rows).repartition(7)
    found = found_by(table, {"m": POINTS, "k": (0.5,)}, error=error).collect()
    assert len(found) == rows.grp.nunique()
    for row in found:
        values = rows.m[rows.grp == row.grp]
        expected = np.percentile(values, [p * 100 for p in POINTS])
        assert [row[f"m_p{round(p * 100)}"] for p in POINTS] == pytest.approx(expected)
        assert row.k_p50 == pytest.approx(np.percentile(values * -2, 50))
    assert error > 0 or widened and 0 < widened[0] < 7 * len(found)


def test_equal_to_spark_percentile(sample):
    cpu = F.col("cpu_user_percent") + F.col("cpu_system_percent")
    rows = sample["node_timeline"].select(F.col("cluster_id").alias("grp"), cpu.alias("m"))
    found = found_by(rows, {"m": (0.5, 0.9)})
    builtin = rows.groupBy("grp").agg(F.percentile("m", F.array(F.lit(0.5), F.lit(0.9))).alias("p"))
    for row in found.join(builtin, "grp").collect():
        assert [row.m_p50, row.m_p90] == pytest.approx(row.p)


def test_no_groups(spark):
    assert found_by(spark.createDataFrame([], "grp string, m double"), {"m": POINTS}).count() == 0
