"""SQL text of the derived views, for the independent check in another engine."""

from sightline.sources import views

ASSETS = """
a AS (SELECT o_custkey AS k, o_orderpriority AS log_type, count(*) AS cnt FROM orders
  WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT','2-HIGH') GROUP BY o_custkey, o_orderpriority),
b AS (SELECT user_id AS k, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errs, count(*) AS n, max(value) AS mx
  FROM events GROUP BY user_id),
c AS (SELECT o_custkey AS k, concat('ship_', lower(l_linestatus)) AS sourcetype, count(*) AS cnt
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  WHERE l_returnflag = 'R' AND l_shipdate < TIMESTAMP '1995-07-01' GROUP BY o_custkey, concat('ship_', lower(l_linestatus))),
assets AS (SELECT CASE WHEN c_acctbal < -900 THEN NULL ELSE c_name END AS hostname,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat(lower(replace(c_name,'#','-')), '.', lower(n_name), '.example.com') END AS fqdn,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat('10.', CAST(c_nationkey AS VARCHAR), '.',
    CAST(CAST(floor(c_custkey / 256) AS BIGINT) % 256 AS VARCHAR), '.', CAST(c_custkey % 256 AS VARCHAR)) END AS ip_address,
  nullif(r_name, 'MIDDLE EAST') AS region, n_name AS country,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'On-Prem' WHEN 'BUILDING' THEN 'Cloud' WHEN 'FURNITURE' THEN 'SaaS' WHEN 'HOUSEHOLD' THEN 'API' END AS infra_type,
  CASE c_custkey % 4 WHEN 0 THEN 'linux' WHEN 1 THEN 'windows' WHEN 2 THEN 'macos' END AS os,
  CASE c_custkey % 3 WHEN 0 THEN 'vm' WHEN 1 THEN 'physical' END AS platform,
  c_mktsegment AS class,
  CASE WHEN a.k IS NOT NULL THEN c_name END AS a_host, a.log_type AS a_log_type, a.cnt AS a_count,
  CASE WHEN b.k IS NOT NULL THEN c_name END AS b_host,
  CASE WHEN b.k IS NULL THEN NULL WHEN errs * 5 > n THEN 'Degraded' ELSE 'Healthy' END AS b_agent_health,
  CASE WHEN mx > 200 THEN 'Active' END AS b_agent_status,
  CASE WHEN c.k IS NOT NULL THEN c_name END AS c_host, c.sourcetype AS c_sourcetype, c.cnt AS c_count,
  coalesce(a.cnt, 0) + coalesce(c.cnt, 0) AS log_count
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN a ON a.k = c_custkey LEFT JOIN b ON b.k = c_custkey LEFT JOIN c ON c.k = c_custkey)"""

JOB_REFS = """
job_refs AS (SELECT o_orderkey AS job_id, o_orderdate AS creation_time, concat('user', CAST(o_custkey % 40 AS VARCHAR), '@example.com') AS user_email,
  CASE o_orderstatus WHEN 'F' THEN 'QUERY' WHEN 'O' THEN 'LOAD' ELSE 'COPY' END AS job_type,
  CAST(floor(o_totalprice) AS BIGINT) AS total_bytes, CAST(floor(o_totalprice / 10) AS BIGINT) AS total_cost_ms,
  CASE o_custkey % 3 WHEN 0 THEN 'marts' WHEN 1 THEN 'reports' ELSE 'core' END AS dst_dataset,
  concat(CASE o_custkey % 3 WHEN 0 THEN 'mart_' WHEN 1 THEN 'rpt_' ELSE 'int_' END, CAST(o_custkey % 8 AS VARCHAR)) AS dst_table,
  CASE l_suppkey % 3 WHEN 0 THEN 'landing' WHEN 1 THEN 'core' ELSE 'marts' END AS ref_dataset,
  concat(CASE l_suppkey % 3 WHEN 0 THEN 'raw_' WHEN 1 THEN 'int_' ELSE 'mart_' END, CAST(l_partkey % 8 AS VARCHAR)) AS ref_table
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""

BATCH_REFS = """
job_refs AS (SELECT DISTINCT o_orderkey AS job_id, o_orderdate AS creation_time, concat('user', CAST(o_custkey % 40 AS VARCHAR), '@example.com') AS user_email,
  CASE o_orderstatus WHEN 'F' THEN 'QUERY' WHEN 'O' THEN 'LOAD' ELSE 'COPY' END AS job_type,
  CAST(floor(o_totalprice) AS BIGINT) AS total_bytes, CAST(floor(o_totalprice / 10) AS BIGINT) AS total_cost_ms,
  CASE o_custkey % 3 WHEN 0 THEN 'marts' WHEN 1 THEN 'reports' ELSE 'core' END AS dst_dataset,
  concat(CASE o_custkey % 3 WHEN 0 THEN 'mart_' WHEN 1 THEN 'rpt_' ELSE 'int_' END, CAST(CASE WHEN o_custkey % 5 = 0 THEN o_custkey % 40 ELSE 0 END AS VARCHAR)) AS dst_table,
  CASE l_suppkey % 3 WHEN 0 THEN 'landing' WHEN 1 THEN 'core' ELSE 'marts' END AS ref_dataset,
  concat(CASE l_suppkey % 3 WHEN 0 THEN 'raw_' WHEN 1 THEN 'int_' ELSE 'mart_' END, CAST(CASE WHEN l_partkey % 5 = 0 THEN l_partkey % 40 ELSE 0 END AS VARCHAR)) AS ref_table
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""

OPERATIONS = """
operations AS (SELECT event_id AS operation_id, event_type AS operation_type, ts AS start_time, value AS duration_s,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 100 AS rows_scanned,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS error_count, event_type <> 'error' AS success,
  CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN '403 forbidden' WHEN 1 THEN '429 rate limit reached' WHEN 2 THEN 'connection timeout' WHEN 3 THEN '404 not found' ELSE 'unexpected end of input' END END AS error_message,
  concat('res_', CAST(user_id % 25 AS VARCHAR)) AS resource_id FROM events)"""

SCAN_RESULTS = """
scan_results AS (SELECT l_orderkey AS job_id, concat('proj_', CAST(l_suppkey % 12 AS VARCHAR)) AS project_id, concat('ds_', CAST(l_partkey % 4 AS VARCHAR)) AS dataset_id,
  concat('table_', CAST(l_partkey % 50 AS VARCHAR)) AS table_id, concat('col_', CAST(l_linenumber AS VARCHAR)) AS column_name,
  CASE l_suppkey % 6 WHEN 0 THEN 'network_presence' WHEN 1 THEN 'endpoint_identity' WHEN 2 THEN 'identity_context' WHEN 3 THEN 'application_telemetry' WHEN 4 THEN 'cloud_infrastructure' ELSE 'other' END AS metric_type,
  l_quantity / 50.0 AS confidence FROM lineitem)"""

SCAN_JOBS = """
scan_jobs AS (SELECT o_orderkey AS id, o_custkey % 20 AS user_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  o_orderdate AS started_at, CAST(o_orderkey % 9 AS INT) AS total_tables,
  CAST(CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 9 ELSE o_orderkey % 4 END AS INT) AS processed_tables,
  CAST(floor(o_totalprice / 10000) AS INT) AS mappings_found FROM orders)"""

PROJECT_ACCESS = """
project_access AS (SELECT DISTINCT o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'purchase' WHEN 'O' THEN 'signup' ELSE 'error' END AS project_id FROM orders)"""

TELEMETRY = "telemetry AS (SELECT " + ", ".join(
    f"{sql.replace('AS BINARY', 'AS BLOB')} AS {name}" for name, sql in views.TELEMETRY.items()
) + " FROM events)"


def with_views(*parts: str, body: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts) + "\n" + body.strip()
