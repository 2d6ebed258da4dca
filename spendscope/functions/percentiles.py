"""Exact percentiles of groups of any size, found between the bounds that a sketch gives.

Spark's ``percentile`` keeps every distinct value of a group in one buffer, which a
group holding a large share of continuous measurements outgrows. Here a mergeable sketch
per group, made beside other aggregates, tells between which values a rank lies, give or take
its error. One more pass over the rows counts what is smaller and keeps the few values in
between; where the counts show that a rank lies outside, its bounds are widened to the smallest
and largest value. The results are those of ``percentile``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# The sketch's size, and how far a rank may be off, as a part of all rows; a sketch of this size
# is off by 0.4 % in one of a hundred cases.
SKETCH_SIZE = 800
RANK_ERROR = 0.006
# Bounds are the wider, the smaller a group is, and the smallest and largest value below these sizes.
# A sketch keeps all values of a group that is smaller than itself.
GROUP_SIZES = (25, 100, 400, SKETCH_SIZE)
# Parts of the range between two bounds; the values of one of them are ranked in one task.
STEPS = 1024
_SMALLER = -1


def sketch(metric: str) -> Column:
    """The aggregate that ``exact_percentiles`` needs for a metric."""
    return F.kll_sketch_agg_double(metric, SKETCH_SIZE).alias(f"{metric}_sketch")


def _points(fractions: Mapping[str, Sequence[float]]) -> list[tuple[str, float]]:
    return [(metric, p) for metric, points in fractions.items() for p in points]


def _bounds(profile: DataFrame, keys: Sequence[str], points: Sequence[tuple[str, float]], error: float) -> DataFrame:
    """(keys, lows, highs): for each point, the values between which its ranks should lie."""
    by_metric: dict[str, list[float]] = {}
    for metric, p in points:
        by_metric.setdefault(metric, []).append(p)

    def near(slack: float) -> Column:
        """The values at ranks that are so far off; a sketch takes ranks as constants only."""
        ranks = {m: F.array(*[F.lit(min(max(p + slack, 0.0), 1.0)) for p in ps]) for m, ps in by_metric.items()}
        return F.flatten(F.array(*[F.kll_sketch_get_quantile_double(f"{m}_sketch", r) for m, r in ranks.items()]))

    def bounds(side: int) -> Column:
        # Ranks count rows, and interpolation looks at two neighbours.
        found = near(float(side))
        for size in GROUP_SIZES:
            slack = 2 / size + (error if size >= SKETCH_SIZE else 0.0)
            found = F.when(F.col("n") >= size, near(side * slack)).otherwise(found)
        return found

    return profile.select(*keys, bounds(-1).alias("lows"), bounds(1).alias("highs"))


def _counted(rows: DataFrame, bounds: DataFrame, keys: Sequence[str], points: Sequence[tuple[str, float]]) -> DataFrame:
    """(keys, point, step, value, n, below), in one pass: the values within bounds and how often each occurs.

    Point -1 has a row for each group, whose ``below`` holds how many values are smaller than
    each lower bound. Points without bounds are left out.
    """
    entry = "struct<point:int,step:int,value:double>"
    found = []
    for i, (metric, _) in enumerate(points):
        value, low, high = F.col(metric), F.col("lows")[i], F.col("highs")[i]
        step = F.when(high > low, F.floor((value - low) / (high - low) * STEPS)).otherwise(0).cast("int")
        inside = F.struct(F.lit(i).alias("point"), step.alias("step"), value.alias("value")).cast(entry)
        found.append(F.when((value >= low) & (value <= high), inside))
    counter = F.struct(F.lit(_SMALLER), F.lit(0), F.lit(None).cast("double")).cast(entry)
    each = rows.join(bounds, list(keys)).select(
        *keys, "lows", *dict.fromkeys(m for m, _ in points), F.explode(F.array_compact(F.array(*found, counter))).alias("e")
    )
    counting = F.col("e.point") == _SMALLER
    below = [F.count_if(counting & (F.col(m) < F.col("lows")[i])) for i, (m, _) in enumerate(points)]
    sums = each.groupBy(*keys, "e.point", "e.step", "e.value").agg(
        F.count("*").alias("n"), *[b.alias(f"below_{i}") for i, b in enumerate(below)]
    )
    counts = F.when(F.col("point") == _SMALLER, F.array(*[f"below_{i}" for i in range(len(points))]))
    return cut_lineage(sums.select(*keys, "point", "step", "value", "n", counts.alias("below")))


def _ranks(
    counted: DataFrame, profile: DataFrame, keys: Sequence[str], points: Sequence[tuple[str, float]]
) -> DataFrame:
    """(keys, point, below, position, low, high): the wanted ranks, from 0, and the values below the bounds."""
    fraction = F.element_at(F.array(*[F.lit(float(p)) for _, p in points]), F.col("point") + 1)
    return (
        counted.where(F.col("point") == _SMALLER)
        .select(*keys, F.posexplode("below").alias("point", "below"))
        .join(profile.select(*keys, F.col("n").alias("size")), list(keys))
        .withColumn("position", (F.col("size") - 1) * fraction)
        .select(*keys, "point", "below", "position", F.floor("position").alias("low"), F.ceil("position").alias("high"))
    )


def _outside(counted: DataFrame, ranks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The points of which a wanted rank is not among the values between the bounds."""
    inside = counted.where(F.col("point") != _SMALLER).groupBy(*keys, "point").agg(F.sum("n").alias("inside"))
    end = F.col("below") + F.coalesce("inside", F.lit(0))
    found = ranks.join(inside, [*keys, "point"], "left").where((F.col("low") < F.col("below")) | (F.col("high") >= end))
    return found.select(*keys, "point")


def exact_percentiles(
    rows: DataFrame,
    profile: DataFrame,
    keys: Sequence[str],
    fractions: Mapping[str, Sequence[float]],
    error: float = RANK_ERROR,
) -> DataFrame:
    """Percentiles with linear interpolation, one column ``<metric>_p<percent>`` each.

    ``rows`` has the keys and a column per metric; ``profile`` has the keys, the number of rows
    ``n`` and a ``sketch`` of each metric, and says which groups are wanted. Keys and metrics are
    never null. The rows are read once, and once more for groups whose sketch was off by more
    than ``error``; what lies between the bounds is stored on the way.
    """
    points = _points(fractions)
    # Stored, so that sketches are read once for a group and not where it meets its rows.
    bounds = cut_lineage(_bounds(profile, keys, points, error))
    counted = _counted(rows, bounds, keys, points)
    ranks = _ranks(counted, profile, keys, points)
    outside = cut_lineage(_outside(counted, ranks, keys))
    if not outside.isEmpty():
        counted, ranks = _widened(rows, profile, counted, ranks, outside, keys, points)
    key = [*keys, "point"]
    values = counted.where(F.col("point") != _SMALLER).drop("below")
    steps = values.groupBy(*key, "step").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy(*key).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    holding = (
        steps.withColumn("_earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(ranks, key)
        .withColumn("before", F.col("below") + F.col("_earlier"))
        .where(_covers("before", "n", "low") | _covers("before", "n", "high"))
        .select(*key, "step", "before", "position", "low", "high")
    )
    smaller = Window.partitionBy(*key, "step").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = values.join(holding, [*key, "step"]).withColumn(
        "first_rank", F.col("before") + F.coalesce(F.sum("n").over(smaller), F.lit(0))
    )

    def at(point: int) -> Column:
        here = F.col("point") == point
        low = F.max(F.when(here & _covers("first_rank", "n", "low"), F.col("value")))
        high = F.max(F.when(here & _covers("first_rank", "n", "high"), F.col("value")))
        return low + (high - low) * F.max(F.when(here, F.col("position") - F.col("low")))

    names = [f"{metric}_p{round(p * 100)}" for metric, p in points]
    return placed.groupBy(*keys).agg(*[at(i).alias(name) for i, name in enumerate(names)])


def _widened(
    rows: DataFrame,
    profile: DataFrame,
    counted: DataFrame,
    ranks: DataFrame,
    outside: DataFrame,
    keys: Sequence[str],
    points: Sequence[tuple[str, float]],
) -> tuple[DataFrame, DataFrame]:
    """Counts and ranks in which the points outside their bounds have all values instead."""
    key = [*keys, "point"]
    lost = outside.groupBy(*keys).agg(F.collect_set("point").alias("lost"))
    whole = _bounds(profile, keys, points, 1.0).join(lost, list(keys))

    def only_lost(column: str) -> Column:
        return F.transform(column, lambda x, i: F.when(F.array_contains("lost", i), x)).alias(column)

    again = _counted(rows, whole.select(*keys, only_lost("lows"), only_lost("highs")), keys, points)
    values = again.where(F.col("point") != _SMALLER)
    kept = counted.where(F.col("point") != _SMALLER).join(outside, key, "left_anti")
    new = _ranks(again, profile, keys, points).join(outside, key, "left_semi")
    return kept.unionByName(values), ranks.join(outside, key, "left_anti").unionByName(new)


def _covers(first: str, count: str, rank: str) -> Column:
    return (F.col(rank) >= F.col(first)) & (F.col(rank) < F.col(first) + F.col(count))
