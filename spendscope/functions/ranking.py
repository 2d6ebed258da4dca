"""Ranks over a whole table, without a window that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Spark numbers the rows of a partition in the low bits, the partitions in those above.
_ROW_BITS = 33


def in_ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` stored once, in partitions that hold one range of the order after the other, with ``_at``.

    ``_at`` has the number of the partition above the number of the row in it. Splitters are
    sampled over all columns of the order and a row number behind them, so neither equal
    values nor equal rows fill one partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Sampling reads the rows once more than dealing does: they are computed only once before.
    kept = cut_lineage(df).withColumn("_number", F.monotonically_increasing_id())
    dealt = kept.repartitionByRange(parts, *order, "_number").sortWithinPartitions(*order, "_number")
    return cut_lineage(dealt.drop("_number").withColumn("_at", F.monotonically_increasing_id()))


def with_place(df: DataFrame, name: str, value: str, *ties: Column | str) -> DataFrame:
    """Add the 1-based place by ``value``, largest first and null last; equal values go by ``ties``.

    Rows are dealt by ranges; a place is that within the range and the number of rows in the
    ranges before. Only one count per partition meets in one task.
    """
    dealt = in_ranges(df, F.col(value).desc_nulls_last(), *ties).withColumn("_part", F.shiftright("_at", _ROW_BITS))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    # One row per partition.
    placed = dealt.join(F.broadcast(before), "_part")
    return placed.select(*df.columns, (F.col("_before") + within).cast("int").alias(name))
