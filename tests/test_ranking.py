from __future__ import annotations

import random

from pyspark.sql import functions as F

from spendscope.functions.ranking import in_ranges, with_place


def test_places_are_those_of_a_sort(frame):
    rng = random.Random(1)
    values = [None, 0.0, 0.0, -0.0, 1e-300, 1e300, -1e-300, -5.0, float("inf")] + [round(rng.expovariate(0.01), 1) for _ in range(300)]
    values += [-round(rng.expovariate(0.1), 1) for _ in range(100)]
    rows = [(k, v) for k, v in enumerate(values)]
    found = with_place(frame("id int, v double", rows).repartition(5), "place", "v", "id").collect()
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0]))
    assert {r.id: r.place for r in found} == {k: n for n, (k, _) in enumerate(order, 1)}


def test_places_of_no_rows(frame):
    assert with_place(frame("id int, v double", []), "place", "v", "id").collect() == []


def test_equal_values_spread_over_partitions(spark, frame):
    rows = [(k % 700, None if k % 40 == 0 else 5.0 if k % 10 else float(k)) for k in range(9000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        table = frame("id int, v double", rows).repartition(5)
        dealt = in_ranges(table, F.col("v").desc_nulls_last(), "id")
        sizes = [r["count"] for r in dealt.groupBy(F.shiftright("_at", 33)).count().collect()]
        places = sorted((r.place, r.id, r.v) for r in with_place(table, "place", "v", "id").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(sizes) == len(rows) and len(sizes) > 150 and max(sizes) < 0.04 * len(rows)
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0]))
    assert [(p, i, v) for p, i, v in places] == [(n, i, v) for n, (i, v) in enumerate(order, 1)]
