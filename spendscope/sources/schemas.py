"""Schemas of the source tables, as Spark DDL.

Only the columns that some operator reads are listed; wider tables are fine.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql.types import StructType

SOURCE_DDL = {
    "usage": """
        usage_date date, usage_start_time timestamp_ntz, usage_end_time timestamp_ntz,
        sku_name string, billing_origin_product string, workspace_id bigint,
        usage_quantity double, usage_unit string,
        usage_metadata struct<cluster_id:string,job_id:string,job_name:string,job_run_id:string,
                              warehouse_id:string,dlt_pipeline_id:string,endpoint_name:string>,
        identity_metadata struct<run_as:string>,
        product_features struct<is_serverless:boolean,is_photon:boolean>,
        custom_tags map<string,string>
    """,
    "list_prices": """
        sku_name string, price_start_time timestamp_ntz, price_end_time timestamp_ntz,
        pricing struct<effective_list:struct<default:decimal(18,6)>>
    """,
    "account_prices": """
        sku_name string, price_start_time timestamp_ntz, price_end_time timestamp_ntz,
        pricing struct<default:decimal(18,6)>
    """,
    "clusters": """
        cluster_id string, cluster_name string, owned_by string,
        create_time timestamp_ntz, delete_time timestamp_ntz,
        driver_node_type string, worker_node_type string, worker_count bigint,
        min_autoscale_workers bigint, max_autoscale_workers bigint,
        auto_termination_minutes bigint, enable_elastic_disk boolean,
        cluster_source string, dbr_version string, change_time timestamp_ntz,
        aws_attributes struct<availability:string>, azure_attributes struct<availability:string>,
        gcp_attributes struct<availability:string>
    """,
    "node_timeline": """
        cluster_id string, instance_id string, driver boolean, start_time timestamp_ntz,
        cpu_user_percent double, cpu_system_percent double, cpu_wait_percent double,
        mem_used_percent double, mem_swap_percent double
    """,
    "warehouses": """
        warehouse_id string, warehouse_name string, warehouse_type string, warehouse_size string,
        min_clusters int, max_clusters int, auto_stop_minutes int, created_by string,
        tags map<string,string>
    """,
    "warehouse_events": """
        warehouse_id string, event_type string, cluster_count bigint, event_time timestamp_ntz
    """,
    "jobs": """
        workspace_id bigint, job_id string, name string, creator_user_name string,
        change_time timestamp_ntz
    """,
    "job_run_timeline": """
        job_id string, run_id bigint, run_name string, result_state string,
        period_start_time timestamp_ntz, period_end_time timestamp_ntz, compute_ids array<string>
    """,
    "query_history": """
        statement_id bigint, executed_by string, compute struct<warehouse_id:string>,
        statement_type string, statement_text string, read_rows bigint, read_files bigint,
        total_task_duration_ms bigint, start_time timestamp_ntz, end_time timestamp_ntz,
        spilled_local_bytes bigint, shuffle_read_bytes bigint
    """,
}


@cache
def schema_of(name: str) -> StructType:
    """The declared schema; parsing DDL needs a running session."""
    return StructType.fromDDL(SOURCE_DDL[name])
