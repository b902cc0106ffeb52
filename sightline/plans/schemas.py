"""Column lists of the driver tables and derived views, for the SQL checks (fixed values)."""

TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
VIEWS = {
    "assets": "hostname string, fqdn string, ip_address string, region string, country string, infra_type string, os string, platform string, class string, a_host string, a_log_type string, a_count bigint, b_host string, b_agent_health string, b_agent_status string, c_host string, c_sourcetype string, c_count bigint, log_count bigint",
    "job_refs": "job_id bigint, creation_time timestamp_ntz, user_email string, job_type string, total_bytes bigint, total_cost_ms bigint, dst_dataset string, dst_table string, ref_dataset string, ref_table string",
    "operations": "operation_id bigint, operation_type string, start_time timestamp_ntz, duration_s double, rows_scanned bigint, error_count int, success boolean, error_message string, resource_id string",
    "scan_jobs": "id bigint, user_id bigint, status string, started_at timestamp_ntz, total_tables int, processed_tables int, mappings_found int",
}


def columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.strip().split(" ", 1)) for part in spec.split(",")]
