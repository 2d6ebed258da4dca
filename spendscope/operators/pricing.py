"""Usage priced by the price that was valid when it ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import day_of, in_period, total, total_if
from ..sources.registry import AnalysisWindow, SourceTables

# Billed quantities; times a price of 18 digits they leave 25 before and 13 after the point.
QUANTITY = "decimal(24,12)"
# A SKU with more prices than these is priced by the day, if it is among the DAILY_SKUS with the most.
FEW_PRICES = 16
DAILY_SKUS = 4096
UNCUT = -2


def usage_lines(usage: DataFrame) -> DataFrame:
    """Usage with the nested attribution fields as plain columns."""
    return usage.select(
        "usage_date",
        "usage_start_time",
        "usage_end_time",
        "sku_name",
        "billing_origin_product",
        "workspace_id",
        "usage_quantity",
        "usage_unit",
        F.col("usage_metadata.cluster_id").alias("cluster_id"),
        F.col("usage_metadata.job_id").alias("job_id"),
        F.col("usage_metadata.job_name").alias("job_name"),
        F.col("usage_metadata.job_run_id").alias("job_run_id"),
        F.col("usage_metadata.warehouse_id").alias("warehouse_id"),
        F.col("usage_metadata.dlt_pipeline_id").alias("pipeline_id"),
        F.col("usage_metadata.endpoint_name").alias("endpoint_name"),
        F.col("identity_metadata.run_as").alias("run_as_user"),
        F.col("product_features.is_serverless").alias("is_serverless"),
        F.col("product_features.is_photon").alias("is_photon"),
        "custom_tags",
    )


def usage_in_period(usage: DataFrame, window: AnalysisWindow) -> DataFrame:
    return usage_lines(usage).filter(in_period(F.col("usage_date"), window))


def list_price_book(list_prices: DataFrame) -> DataFrame:
    return list_prices.select(
        "sku_name",
        "price_start_time",
        "price_end_time",
        F.col("pricing.effective_list.default").alias("unit_price"),
    )


def account_price_book(account_prices: DataFrame) -> DataFrame:
    return account_prices.select(
        "sku_name", "price_start_time", "price_end_time", F.col("pricing.default").alias("unit_price")
    )


def _daily_skus(prices: DataFrame) -> DataFrame:
    """SKUs that change their price often, a bounded number of them."""
    counts = prices.groupBy("sku_name").agg(F.count("*").alias("versions")).filter(F.col("versions") > FEW_PRICES)
    return counts.orderBy(F.col("versions").desc(), "sku_name").limit(DAILY_SKUS).select("sku_name")


def _day(at: Column, window: AnalysisWindow) -> Column:
    """Day of the period, from 0; -1 is all time before it, and one day more all time after it, or no time at all."""
    return F.greatest(F.lit(-1), F.least(F.lit(window.period_days + 1), F.datediff(day_of(at), F.lit(window.start))))


def _by_day(prices: DataFrame, daily: DataFrame, window: AnalysisWindow) -> DataFrame:
    """The price book, in which SKUs that change their price often have a row for each day of a price."""
    first = _day(F.col("price_start_time"), window)
    last = F.greatest(first, _day(F.col("price_end_time"), window))
    cut = prices.join(F.broadcast(daily), "sku_name", "left_semi")
    whole = prices.join(F.broadcast(daily), "sku_name", "left_anti")
    return cut.withColumn("_day", F.explode(F.sequence(first, last, F.lit(1)))).unionByName(
        whole.withColumn("_day", F.lit(UNCUT))
    )


def price_usage(usage: DataFrame, prices: DataFrame, window: AnalysisWindow) -> DataFrame:
    """Join usage lines with the price valid at their end; ``dollar_cost`` is a decimal.

    Usage without a valid price drops out. Lines of a SKU with a long history of prices meet its
    prices by day, so they are not all compared with all of it and the SKU is not one join key; a
    line lies in one day and a price in all that it reaches, so no pair is found twice. Other SKUs
    are joined whole. The broadcast hint is for ``DAILY_SKUS`` names at most. There is none for prices:
    Spark broadcasts the price
    book while its measured size is below ``spark.sql.autoBroadcastJoinThreshold``;
    past that it sorts and merges, and splits the partition of a very frequent SKU.
    """
    daily = _daily_skus(prices)
    flag = F.broadcast(daily.select(F.col("sku_name").alias("_daily")))
    day = F.when(F.col("_daily").isNotNull(), _day(F.col("usage_end_time"), window)).otherwise(F.lit(UNCUT))
    u = usage.join(flag, usage["sku_name"] == F.col("_daily"), "left").withColumn("_day", day).alias("u")
    p = _by_day(prices, daily, window).alias("p")
    valid = (
        (F.col("u.sku_name") == F.col("p.sku_name"))
        & (F.col("u._day") == F.col("p._day"))
        & (F.col("u.usage_end_time") >= F.col("p.price_start_time"))
        & (
            F.col("p.price_end_time").isNull()
            | (F.col("u.usage_end_time") < F.col("p.price_end_time"))
        )
    )
    cost = F.col("u.usage_quantity").cast(QUANTITY) * F.col("p.unit_price")
    return u.join(p, valid, "inner").select(*[F.col(f"u.{c}") for c in usage.columns], cost.alias("dollar_cost"))


def list_priced_usage(tables: SourceTables, window: AnalysisWindow) -> DataFrame:
    return price_usage(
        usage_in_period(tables["usage"], window), list_price_book(tables["list_prices"]), window
    )


def priced_usage(tables: SourceTables, window: AnalysisWindow) -> DataFrame:
    """Usage at contract prices if there are any for it, else at list prices.

    One plan: whether a line has a contract price decides, as a scalar subquery that stops at
    the first such line, which of the two price books joins.
    """
    listed = list_price_book(tables["list_prices"])
    usage = usage_in_period(tables["usage"], window)
    if not tables.has("account_prices"):
        return price_usage(usage, listed, window)
    contracted = account_price_book(tables["account_prices"])
    found = price_usage(usage, contracted, window).limit(1).agg((F.count("*") > 0).alias("found")).scalar()
    book = contracted.withColumn("of_contract", F.lit(True)).unionByName(listed.withColumn("of_contract", F.lit(False)))
    return price_usage(usage, book.filter(F.col("of_contract") == found).drop("of_contract"), window)


# The order in which priced usage is listed, for ``write_results``.
NEWEST_FIRST = ("-usage_date", "-dollar_cost", "sku_name", "usage_end_time", "workspace_id", "usage_quantity")


def listed_usage(priced: DataFrame) -> DataFrame:
    """Priced usage as it is listed; the order is that of the files it is written to."""
    return priced.withColumn("dollar_cost", F.col("dollar_cost").cast("double"))


def cost_lines(priced: DataFrame) -> DataFrame:
    """Priced usage reduced to what the cost results need."""
    return priced.select(
        "billing_origin_product",
        "sku_name",
        "workspace_id",
        "cluster_id",
        "job_id",
        "warehouse_id",
        "run_as_user",
        F.coalesce("is_serverless", F.lit(False)).alias("serverless"),
        F.col("usage_quantity").alias("dbus"),
        F.col("dollar_cost").alias("cost"),
    )


def cost_totals(lines: DataFrame) -> DataFrame:
    """One row: DBUs and cost, in all and for serverless and classic compute."""
    serverless = F.col("serverless")
    return lines.agg(
        total("dbus").alias("total_dbus"),
        total("cost").alias("total_cost"),
        total_if(serverless, "cost").alias("serverless_cost"),
        total_if(~serverless, "cost").alias("classic_cost"),
        total_if(serverless, "dbus").alias("serverless_dbus"),
        total_if(~serverless, "dbus").alias("classic_dbus"),
    )
