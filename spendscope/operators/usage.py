"""Cost by dimension, tag coverage and weekday pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import (
    amount_parts,
    in_period,
    known,
    part_sums,
    ratio,
    rounded,
    tag_count,
    total,
    total_if,
    total_parts,
    weekday_of,
)
from ..sources.registry import AnalysisWindow

# ---- fixed values -------------------------------------------------------------
TAG_GAP_PERCENT = 20
WEEKEND_RATIO = 0.15
WEEKEND_MIN_DBUS = 10
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
WEEKEND_DAYS = (1, 7)
TOP_ITEMS = 10
# -------------------------------------------------------------------------------

# Dimension name -> column of the cost lines. Rows without a value count as UNKNOWN
# in the first three and are left out of the others.
DIMENSIONS = {
    "product": "billing_origin_product",
    "sku": "sku_name",
    "workspace": "workspace_id",
    "cluster": "cluster_id",
    "job": "job_id",
    "warehouse": "warehouse_id",
    "user": "run_as_user",
}
ALWAYS_KNOWN = ("product", "sku", "workspace")


def _cuboid(lines: DataFrame, dims: list[str]) -> DataFrame:
    """Sums by some dimensions and compute type, which are parts of sums again."""
    return lines.groupBy(*dims, "serverless").agg(*part_sums("dbus", "cost"))


def _two_cuboids(lines: DataFrame, *groups: list[str]) -> DataFrame:
    """The sums by each group of dimensions in one table, in which the other dimensions are NULL."""

    def filled(group: list[str]) -> Column:
        return F.struct(*[(F.col(d) if d in group else F.lit(None).cast("string")).alias(d) for d in DIMENSIONS])

    rest = [c for c in lines.columns if c not in DIMENSIONS]
    each = lines.select(F.explode(F.array(*map(filled, groups))).alias("of"), *rest).select("of.*", *rest)
    return _cuboid(each, list(DIMENSIONS))


def _edges(cuboid: DataFrame, dims: list[str]) -> DataFrame:
    """A cuboid's sums once for each of its dimensions that has a value."""

    def entry(dim: str) -> Column:
        named = F.col(dim) != ""
        if dim == "user":
            named &= F.col(dim) != "UNKNOWN"
        return F.when(named, F.struct(F.lit(dim).alias("dim"), F.col(dim).alias("key")))

    named = F.array_compact(F.array(*map(entry, dims)))
    parts = [f"{name}_{side}" for name in ("dbus", "cost") for side in ("high", "low")]
    return cuboid.select(F.explode(named).alias("entry"), "serverless", *parts).select("entry.*", "serverless", *parts)


def cost_by_dimension(lines: DataFrame) -> DataFrame:
    """Cost by each dimension, as (dim, key, dbus, cost, serverless_cost, classic_cost,
    serverless_dbus).

    A lattice of sums, each from the smallest parent: the lines give two cuboids in one pass, that
    of the dimensions that come from catalogs and that of the resources. A line counts once in each,
    so their rows are combinations that occur, not lines, as they would be by all dimensions
    together. Single dimensions come from one of the two. Every task first sums up its own rows per
    key, so only sums are shuffled, and a key with very many lines is no different from others.
    """
    keyed = lines.select(
        *[
            (known(F.col(c)) if d in ALWAYS_KNOWN else F.col(c).cast("string")).alias(d)
            for d, c in DIMENSIONS.items()
        ],
        "serverless",
        *amount_parts("dbus", "cost"),
    )
    resources = [d for d in DIMENSIONS if d not in ALWAYS_KNOWN]
    both = _two_cuboids(keyed, list(ALWAYS_KNOWN), resources)
    small = _cuboid(both, list(ALWAYS_KNOWN))
    serverless = F.col("serverless")
    return (
        _edges(small, list(ALWAYS_KNOWN))
        .unionAll(_edges(both, resources))
        .groupBy("dim", "key")
        .agg(
            total_parts("dbus").alias("dbus"),
            total_parts("cost").alias("cost"),
            total_parts("cost", serverless).alias("serverless_cost"),
            total_parts("cost", ~serverless).alias("classic_cost"),
            total_parts("dbus", serverless).alias("serverless_dbus"),
        )
    )


def totals_of(rollup: DataFrame) -> DataFrame:
    """The totals, from the products: every line belongs to one."""
    return rollup.filter(F.col("dim") == "product").agg(
        total("dbus").alias("total_dbus"),
        total("cost").alias("total_cost"),
        total("serverless_cost").alias("serverless_cost"),
        total("classic_cost").alias("classic_cost"),
        total("serverless_dbus").alias("serverless_dbus"),
        total(F.col("dbus") - F.col("serverless_dbus")).alias("classic_dbus"),
    )


def top_items(rollup: DataFrame, limit: int = TOP_ITEMS) -> DataFrame:
    """The costliest keys of each dimension but the workspace."""
    by_cost = Window.partitionBy("dim").orderBy(F.col("cost").desc(), "key")
    return (
        rollup.filter(F.col("dim") != "workspace")
        .withColumn("rank", F.row_number().over(by_cost))
        .filter(F.col("rank") <= limit)
        .select("dim", "rank", F.col("key").alias("id"), "dbus", "cost")
    )


def _tag_status() -> Column:
    untagged = F.coalesce(tag_count(F.col("custom_tags")), F.lit(0)) == 0
    return F.when(untagged, "untagged").otherwise("tagged").alias("tag_status")


def tag_usage(usage: DataFrame, window: AnalysisWindow) -> DataFrame:
    """DBUs, clusters and jobs of tagged and of untagged usage, priced or not."""
    per_resource = (
        usage.filter(in_period(F.col("usage_date"), window))
        .groupBy(
            _tag_status(),
            F.col("usage_metadata.cluster_id").alias("cluster_id"),
            F.col("usage_metadata.job_id").alias("job_id"),
        )
        .agg(total("usage_quantity").alias("dbus"))
    )
    return per_resource.groupBy("tag_status").agg(
        total("dbus").alias("total_dbus"),
        F.count_distinct("cluster_id").alias("cluster_count"),
        F.count_distinct("job_id").alias("job_count"),
    )


def daily_usage(usage: DataFrame, window: AnalysisWindow) -> DataFrame:
    """DBUs per day and tag status, priced or not."""
    return (
        usage.filter(in_period(F.col("usage_date"), window))
        .groupBy("usage_date", _tag_status())
        .agg(total("usage_quantity").alias("total_dbus"))
    )


def tag_coverage(tagged_usage: DataFrame) -> DataFrame:
    """One row: tagged and untagged DBUs, and whether the gap is worth closing."""
    tagged = F.col("tag_status") == "tagged"
    sums = tagged_usage.agg(
        total_if(tagged, "total_dbus").alias("tagged_dbus"),
        total_if(~tagged, "total_dbus").alias("untagged_dbus"),
    )
    share = ratio(F.col("untagged_dbus"), F.col("tagged_dbus") + F.col("untagged_dbus")) * 100
    return sums.select(
        "*",
        rounded(share, 1).alias("untagged_percentage"),
        (share > TAG_GAP_PERCENT).alias("has_tagging_gap"),
    )


def weekday_usage(daily: DataFrame) -> DataFrame:
    """DBUs by day of the week (1 is Sunday)."""
    day_name = F.element_at(F.array(*[F.lit(n) for n in DAY_NAMES]), F.col("day_of_week"))
    return (
        daily.groupBy(weekday_of(F.col("usage_date")).alias("day_of_week"))
        .agg(total("total_dbus").alias("total_dbus"))
        .select("day_of_week", day_name.alias("day_name"), "total_dbus")
    )


def weekend_pattern(by_day: DataFrame) -> DataFrame:
    """One row: weekend usage against weekdays."""
    weekend = F.col("day_of_week").isin(*WEEKEND_DAYS)
    sums = by_day.agg(
        total_if(weekend, "total_dbus").alias("weekend_dbus"),
        total_if(~weekend, "total_dbus").alias("weekday_dbus"),
    )
    share = ratio(F.col("weekend_dbus"), F.col("weekend_dbus") + F.col("weekday_dbus")) * 100
    per_day = ratio(F.col("weekend_dbus") / 2, F.col("weekday_dbus") / 5)
    return sums.select(
        "*",
        rounded(share, 1).alias("weekend_percentage"),
        rounded(per_day, 2).alias("weekend_to_weekday_ratio"),
        ((per_day > WEEKEND_RATIO) & (F.col("weekend_dbus") > WEEKEND_MIN_DBUS)).alias(
            "has_weekend_waste"
        ),
    )
