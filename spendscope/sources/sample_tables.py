"""The source tables, derived from the TPC-H-like test data.

``VIEWS`` is flat SQL that Spark and DuckDB both accept, so that the correctness check
and the engine start from the same rows. ``sample_tables`` wraps
the flat views into the nested shapes of the real sources.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from .registry import AnalysisWindow, SourceTables
from .schemas import schema_of

SAMPLE_WINDOW = AnalysisWindow(
    start=date(2024, 1, 1), end=date(2024, 1, 30), as_of=datetime(2024, 1, 31), lookback_days=30
)

VIEWS = {
    "usage": """
SELECT DATE '2024-01-01' + CAST(l_orderkey % 30 AS INT) AS usage_date,
 CAST(DATE '2024-01-01' + CAST(l_orderkey % 30 AS INT) AS TIMESTAMP) + INTERVAL '1' HOUR * (l_linenumber+1) AS usage_end_time,
 CASE WHEN l_partkey % 25 = 24 THEN 'SKU_NEW_' || CAST(l_partkey % 7 AS VARCHAR(9)) WHEN l_partkey % 6 = 1 THEN 'SKU_' || CAST(l_partkey % 25 AS VARCHAR(9)) ELSE 'SKU_' || CAST(l_partkey AS VARCHAR(9)) END AS sku_name,
 CASE l_partkey % 6 WHEN 0 THEN 'ALL_PURPOSE' WHEN 1 THEN 'JOBS' WHEN 2 THEN 'SQL' WHEN 3 THEN 'INTERACTIVE' WHEN 4 THEN 'MODEL_SERVING' END AS billing_origin_product,
 l_suppkey % 3 AS workspace_id, l_quantity AS usage_quantity,
 CASE WHEN l_partkey % 6 IN (0,1,3) AND NOT (l_partkey % 6 = 1 AND l_orderkey % 4 = 1) THEN 'cluster-' || CAST(l_suppkey AS VARCHAR(9)) END AS cluster_id,
 CASE WHEN l_partkey % 6 = 1 THEN 'job-' || CAST(CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_suppkey END AS VARCHAR(9)) END AS job_id,
 CASE WHEN l_partkey % 6 = 1 THEN l_orderkey END AS job_run_id,
 CASE WHEN l_partkey % 6 = 2 THEN 'wh-' || CAST(l_suppkey % 27 AS VARCHAR(9)) END AS warehouse_id,
 CASE l_suppkey % 4 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS is_serverless,
 CASE WHEN l_returnflag <> 'N' THEN 'user-' || CAST(l_suppkey % 70 AS VARCHAR(9)) END AS run_as,
 CASE WHEN l_linestatus = 'O' OR l_returnflag = 'A' THEN 0 ELSE 1 END AS tag_count FROM {lineitem}
""",
    "list_prices": """
SELECT 'SKU_' || CAST(p_partkey AS VARCHAR(9)) AS sku_name, CASE n WHEN 0 THEN TIMESTAMP '2023-01-01 00:00:00' ELSE TIMESTAMP '2024-01-16 00:00:00' END AS price_start_time, CASE n WHEN 0 THEN TIMESTAMP '2024-01-16 00:00:00' END AS price_end_time, (p_size + 5*n)/100.0 AS price FROM {part_versions}
""",
    "clusters": """
SELECT 'cluster-' || CAST(s_suppkey AS VARCHAR(9)) AS cluster_id, CASE WHEN s_suppkey % 5 = 0 THEN 'job-' || CAST(s_suppkey AS VARCHAR(9)) || '-run-1' ELSE s_name END AS cluster_name, s_name AS owned_by, TIMESTAMP '2023-12-01 00:00:00' + INTERVAL '1' DAY * n AS change_time,
 CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey % 25 END AS worker_count, CASE WHEN s_suppkey % 4 <> 0 THEN 1 + s_suppkey % 4 - n*(s_suppkey % 2) END AS min_autoscale_workers, CASE WHEN s_suppkey % 4 <> 0 THEN CASE WHEN s_suppkey % 12 = 5 OR s_suppkey % 24 = 1 THEN 3 ELSE 3 + s_suppkey % 12 END END AS max_autoscale_workers,
 CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 30 END AS auto_termination_minutes, CASE s_suppkey % 3 WHEN 0 THEN 'SPOT' WHEN 1 THEN 'ON_DEMAND' END AS aws_availability, CASE WHEN s_suppkey % 6 = 2 THEN 'SPOT_AZURE' END AS azure_availability FROM {supplier_versions}
""",
    "node_timeline": """
SELECT 'cluster-' || CAST(user_id AS VARCHAR(9)) AS cluster_id, 'i-' || CAST(n AS VARCHAR(9)) AS instance_id, n = 0 AS driver, ts AS start_time,
 CASE WHEN n = 0 THEN (CASE WHEN value > 75 THEN 75 ELSE value END) * ((user_id + 1) % 3) / 1.7 WHEN user_id % 10 = 7 THEN 45 + value % 20 ELSE (CASE WHEN value > 60 THEN 60 ELSE value END) * (user_id % 4) / 2.5 END AS cpu_user_percent, value % 3 AS cpu_system_percent, value % (CASE WHEN user_id % 6 = 0 THEN 40 ELSE 10 END) AS cpu_wait_percent,
 CASE WHEN n = 0 THEN 60 + value % 40 WHEN user_id % 10 = 7 THEN 72 + value % 10 ELSE LEAST(100.0, (user_id % 5) * 12 + value % (10 + 14 * (user_id % 5))) END AS mem_used_percent, CASE WHEN user_id % 11 = 0 THEN value % 3 ELSE 0 END AS mem_swap_percent
 FROM {event_nodes} WHERE n <= 1 + user_id % 3
""",
    "warehouses": """
SELECT 'wh-' || CAST(n_nationkey AS VARCHAR(9)) AS warehouse_id, CASE WHEN n_nationkey = 3 THEN 'Starter Warehouse' ELSE n_name END AS warehouse_name, CASE n_nationkey % 3 WHEN 0 THEN 'CLASSIC' WHEN 1 THEN 'PRO' ELSE 'SERVERLESS' END AS warehouse_type, CASE n_nationkey % 5 WHEN 0 THEN 'Small' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Large' WHEN 3 THEN '2X-Large' ELSE '3X-Large' END AS warehouse_size, 1 + n_nationkey % 3 AS min_clusters, 3 + n_nationkey % 3 AS max_clusters, CASE n_nationkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 45 ELSE 120 END AS auto_stop_minutes FROM {nation}
""",
    "warehouse_events": """
SELECT 'wh-' || CAST(user_id % 25 AS VARCHAR(9)) AS warehouse_id, CASE event_type WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'SCALED_UP' WHEN 'signup' THEN 'SCALED_DOWN' WHEN 'purchase' THEN 'STOPPED' ELSE 'STARTING' END AS event_type, 1 + event_id % 4 AS cluster_count, ts AS event_time FROM {events}
""",
    "query_history": """
SELECT o_orderkey AS statement_id, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN 'user-' || CAST(o_custkey % 60 AS VARCHAR(9)) END AS executed_by, CASE WHEN o_custkey % 10 <> 0 THEN 'wh-' || CAST(o_custkey % 13 * 2 AS VARCHAR(9)) END AS warehouse_id, CASE WHEN o_orderkey % 8 < 5 THEN 'SELECT' WHEN o_orderkey % 8 = 5 THEN 'INSERT' WHEN o_orderkey % 8 = 6 THEN 'MERGE' ELSE 'SHOW' END AS statement_type,
 CASE o_orderkey % 4 WHEN 0 THEN 'select  * from t' WHEN 1 THEN 'SELECT a FROM t WHERE b = 1' WHEN 2 THEN 'SELECT a FROM t JOIN b JOIN c JOIN d JOIN e JOIN f WHERE x = 1' ELSE 'SELECT a FROM t' END AS statement_text, CAST(FLOOR(o_totalprice * 100) AS BIGINT) AS read_rows, o_orderkey % 1000 AS read_files, CAST(FLOOR(o_totalprice) AS BIGINT) AS total_task_duration_ms, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * (o_orderkey * 7 % 43200) AS start_time,
 CASE WHEN o_orderkey % 9 = 0 THEN CAST(FLOOR(o_totalprice * 100) AS BIGINT) * (o_custkey % 13) * 10 ELSE 0 END AS spilled_local_bytes, CASE WHEN o_orderkey % 5 = 0 THEN CAST(FLOOR(o_totalprice * 2000) AS BIGINT) ELSE 0 END AS shuffle_read_bytes FROM {orders}
""",
    "jobs": """
SELECT 'job-' || CAST(c_custkey AS VARCHAR(9)) AS job_id, c_custkey % 3 AS workspace_id, c_name AS name, c_name AS creator_user_name, TIMESTAMP '2023-12-01 00:00:00' + INTERVAL '1' DAY * n AS change_time FROM {customer_versions}
""",
    "job_run_timeline": """
SELECT 'job-' || CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS VARCHAR(9)) AS job_id, o_orderkey AS run_id, CASE WHEN o_orderkey % 17 = 3 THEN NULL WHEN o_orderkey % (4 + o_custkey % 40) = 0 THEN 'FAILED' WHEN o_orderkey % 53 = 5 THEN 'TIMEDOUT' WHEN o_orderkey % 59 = 5 THEN 'CANCELED' WHEN o_orderkey % 61 = 5 THEN 'SKIPPED' ELSE 'SUCCESS' END AS result_state, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * (o_orderkey * 7 % 43200) AS period_start_time, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * (o_orderkey * 7 % 43200) + INTERVAL '1' SECOND * (CASE WHEN o_custkey % 4 = 0 THEN 30 + o_orderkey % 20 ELSE o_orderkey % 2000 END) AS period_end_time FROM {orders}
""",
}

PLAIN_TABLES = ("nation", "orders", "lineitem", "events")
# Tables whose rows appear several times, numbered ``n`` from 0.
NUMBERED_TABLES = {
    "part_versions": ("part", 2),
    "supplier_versions": ("supplier", 2),
    "customer_versions": ("customer", 2),
    "event_nodes": ("events", 4),
}


def view_sql(name: str, table: Callable[[str], str], numbers: Callable[[int], str]) -> str:
    """The text of a view, given how an engine names a table and unnests 0 to n - 1."""
    sources = {t: table(t) for t in PLAIN_TABLES}
    for numbered, (t, times) in NUMBERED_TABLES.items():
        sources[numbered] = f"(SELECT *, {numbers(times)} AS n FROM {table(t)})"
    return VIEWS[name].format(**sources).strip()


def sample_tables(spark: SparkSession, sf_dir: str) -> SourceTables:
    """All sources but ``account_prices``, over the parquet files in ``sf_dir``."""
    configure(spark)
    flat = {
        name: spark.sql(
            view_sql(
                name,
                table=lambda t: f"parquet.`{sf_dir}/{t}.parquet`",
                numbers=lambda times: f"explode(sequence(0, {times - 1}))",
            )
        )
        for name in VIEWS
    }
    return SourceTables(spark, {name: _conform(name, nest(flat[name])) for name, nest in _NEST.items()})


def contracted_prices(list_prices: DataFrame) -> DataFrame:
    """Contract prices at nine tenths of the list price."""
    return list_prices.withColumn(
        "pricing",
        F.struct(
            (F.col("pricing.effective_list.default") * F.lit("0.9").cast("decimal(2,1)"))
            .cast("decimal(18,6)")
            .alias("default")
        ),
    )


def _conform(name: str, df: DataFrame) -> DataFrame:
    """Cast to the declared schema; columns the view does not have are NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema_of(name).fields
        ]
    )


def _text(value=None):
    return F.lit(value).cast("string")


def _usage(df: DataFrame) -> DataFrame:
    no_tags = F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))")
    return df.select(
        "*",
        F.lit("DBU").alias("usage_unit"),
        (F.col("usage_end_time") - F.expr("INTERVAL '1' HOUR")).alias("usage_start_time"),
        F.struct(
            "cluster_id",
            "job_id",
            _text().alias("job_name"),
            F.col("job_run_id").cast("string").alias("job_run_id"),
            "warehouse_id",
            _text().alias("dlt_pipeline_id"),
            _text().alias("endpoint_name"),
        ).alias("usage_metadata"),
        F.struct("run_as").alias("identity_metadata"),
        F.struct("is_serverless", F.lit(None).cast("boolean").alias("is_photon")).alias("product_features"),
        # An untagged row has either no map or an empty one.
        F.when(F.col("tag_count") > 0, F.create_map(F.lit("team"), F.col("sku_name")))
        .when(F.col("workspace_id") > 0, no_tags)
        .alias("custom_tags"),
    )


def _list_prices(df: DataFrame) -> DataFrame:
    price = F.col("price").cast("decimal(18,6)").alias("default")
    return df.withColumn("pricing", F.struct(F.struct(price).alias("effective_list")))


def _clusters(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.struct(F.col("aws_availability").alias("availability")).alias("aws_attributes"),
        F.struct(F.col("azure_availability").alias("availability")).alias("azure_attributes"),
        F.struct(_text().alias("availability")).alias("gcp_attributes"),
    )


def _query_history(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.struct("warehouse_id").alias("compute"),
        (F.col("start_time") + F.expr("INTERVAL '1' MINUTE")).alias("end_time"),
    )


def _as_is(df: DataFrame) -> DataFrame:
    return df


_NEST = {
    "usage": _usage,
    "list_prices": _list_prices,
    "clusters": _clusters,
    "node_timeline": _as_is,
    "warehouses": _as_is,
    "warehouse_events": _as_is,
    "jobs": _as_is,
    "job_run_timeline": _as_is,
    "query_history": _query_history,
}
