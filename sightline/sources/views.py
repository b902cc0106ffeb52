"""Derived inputs: the driver tables in the shape the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.columns import cases
from sightline.sources.tables import Loader


def assets(load: Loader) -> DataFrame:
    """Wide asset table: one row per asset x source-A log type x source-C type."""
    orders, c = load("orders"), F.col
    a = (
        orders.filter((c("o_orderstatus") == "F") & c("o_orderpriority").isin("1-URGENT", "2-HIGH"))
        .groupBy(c("o_custkey").alias("a_k"), c("o_orderpriority").alias("a_log_type"))
        .agg(F.count(F.lit(1)).alias("a_count"))
    )
    b = load("events").groupBy(c("user_id").alias("b_k")).agg(
        F.count_if(c("event_type") == "error").alias("errs"),
        F.count(F.lit(1)).alias("n"),
        F.max("value").alias("mx"),
    )
    returned = load("lineitem").filter(
        (c("l_returnflag") == "R") & (c("l_shipdate") < F.lit("1995-07-01").cast("timestamp_ntz"))
    )
    s = (
        returned.join(orders, c("l_orderkey") == c("o_orderkey"))
        .groupBy(c("o_custkey").alias("c_k"), F.concat(F.lit("ship_"), F.lower("l_linestatus")).alias("c_sourcetype"))
        .agg(F.count(F.lit(1)).alias("c_count"))
    )
    key, text = c("c_custkey"), lambda x: x.cast("string")
    fqdn = F.concat(F.lower(F.replace(c("c_name"), F.lit("#"), F.lit("-"))), F.lit("."), F.lower("n_name"), F.lit(".example.com"))
    address = F.concat(
        F.lit("10."), text(c("c_nationkey")), F.lit("."),
        text(F.floor(key / 256) % 256), F.lit("."), text(key % 256),
    )
    infra = [("AUTOMOBILE", "On-Prem"), ("BUILDING", "Cloud"), ("FURNITURE", "SaaS"), ("HOUSEHOLD", "API")]
    return (
        load("customer")
        .join(load("nation"), c("n_nationkey") == c("c_nationkey"), "left")
        .join(load("region"), c("r_regionkey") == c("n_regionkey"), "left")
        .join(a, c("a_k") == key, "left")
        .join(b, c("b_k") == key, "left")
        .join(s, c("c_k") == key, "left")
        .select(
            F.when(~(c("c_acctbal") < -900) | c("c_acctbal").isNull(), c("c_name")).alias("hostname"),
            F.when(key % 7 != 0, fqdn).alias("fqdn"),
            F.when(key % 11 != 0, address).alias("ip_address"),
            F.nullif(c("r_name"), F.lit("MIDDLE EAST")).alias("region"),
            c("n_name").alias("country"),
            cases([(c("c_mktsegment") == k, v) for k, v in infra], None).alias("infra_type"),
            cases([(key % 4 == i, v) for i, v in enumerate(["linux", "windows", "macos"])], None).alias("os"),
            cases([(key % 3 == i, v) for i, v in enumerate(["vm", "physical"])], None).alias("platform"),
            c("c_mktsegment").alias("class"),
            F.when(c("a_k").isNotNull(), c("c_name")).alias("a_host"),
            "a_log_type",
            "a_count",
            F.when(c("b_k").isNotNull(), c("c_name")).alias("b_host"),
            cases([(c("b_k").isNull(), F.lit(None).cast("string")), (c("errs") * 5 > c("n"), "Degraded")], "Healthy").alias("b_agent_health"),
            F.when(c("mx") > 200, "Active").alias("b_agent_status"),
            F.when(c("c_k").isNotNull(), c("c_name")).alias("c_host"),
            "c_sourcetype",
            "c_count",
            (F.coalesce(c("a_count"), F.lit(0)) + F.coalesce(c("c_count"), F.lit(0))).alias("log_count"),
        )
    )


def job_refs(load: Loader) -> DataFrame:
    """Warehouse job history, one row per referenced table."""
    c, text = F.col, lambda x: x.cast("string")
    third = lambda k, names: cases([(k % 3 == i, n) for i, n in enumerate(names[:2])], names[2])
    cust, supp = c("o_custkey"), c("l_suppkey")
    return load("orders").join(load("lineitem"), c("l_orderkey") == c("o_orderkey")).select(
        c("o_orderkey").alias("job_id"),
        c("o_orderdate").alias("creation_time"),
        F.concat(F.lit("user"), text(cust % 40), F.lit("@example.com")).alias("user_email"),
        cases([(c("o_orderstatus") == "F", "QUERY"), (c("o_orderstatus") == "O", "LOAD")], "COPY").alias("job_type"),
        F.floor("o_totalprice").alias("total_bytes"),
        F.floor(c("o_totalprice") / 10).alias("total_cost_ms"),
        third(cust, ["marts", "reports", "core"]).alias("dst_dataset"),
        F.concat(third(cust, ["mart_", "rpt_", "int_"]), text(cust % 8)).alias("dst_table"),
        third(supp, ["landing", "core", "marts"]).alias("ref_dataset"),
        F.concat(third(supp, ["raw_", "int_", "mart_"]), text(c("l_partkey") % 8)).alias("ref_table"),
    )


def nested_jobs(load: Loader) -> DataFrame:
    """Job history in nested form: a destination struct and an array of referenced tables."""
    ref = F.struct(F.col("ref_dataset").alias("dataset"), F.col("ref_table").alias("table"))
    return job_refs(load).select(
        "job_id", "creation_time", "user_email", "job_type", "total_bytes", "total_cost_ms",
        F.struct(F.col("dst_dataset").alias("dataset"), F.col("dst_table").alias("table")).alias("destination"),
        F.array(ref).alias("referenced"),
    )


def batch_jobs(load: Loader) -> DataFrame:
    """Job history in nested form, one row per job with all the tables it reads. One table of each
    layer is busy, the others are not."""
    c, text = F.col, lambda x: x.cast("string")
    third = lambda k, names: cases([(k % 3 == i, n) for i, n in enumerate(names[:2])], names[2])
    few = lambda k: F.when(k % 5 == 0, k % 40).otherwise(0)
    cust, supp = c("o_custkey"), c("l_suppkey")
    ref = F.struct(third(supp, ["landing", "core", "marts"]).alias("dataset"), F.concat(third(supp, ["raw_", "int_", "mart_"]), text(few(c("l_partkey")))).alias("table"))
    reads = load("lineitem").groupBy(c("l_orderkey").alias("job_id")).agg(F.sort_array(F.collect_set(ref)).alias("referenced"))
    return load("orders").join(reads, c("o_orderkey") == c("job_id")).select(
        "job_id", c("o_orderdate").alias("creation_time"), F.concat(F.lit("user"), text(cust % 40), F.lit("@example.com")).alias("user_email"),
        cases([(c("o_orderstatus") == "F", "QUERY"), (c("o_orderstatus") == "O", "LOAD")], "COPY").alias("job_type"),
        F.floor("o_totalprice").alias("total_bytes"), F.floor(c("o_totalprice") / 10).alias("total_cost_ms"),
        F.struct(third(cust, ["marts", "reports", "core"]).alias("dataset"), F.concat(third(cust, ["mart_", "rpt_", "int_"]), text(few(cust))).alias("table")).alias("destination"),
        "referenced",
    )


def operations(load: Loader) -> DataFrame:
    """Operation records; the end of an operation is its start plus `duration_s`."""
    c = F.col
    failed = c("event_type") == "error"
    messages = ["403 forbidden", "429 rate limit reached", "connection timeout", "404 not found"]
    return load("events").select(
        c("event_id").alias("operation_id"),
        c("event_type").alias("operation_type"),
        c("ts").alias("start_time"),
        c("value").alias("duration_s"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("bigint") * 100).alias("rows_scanned"),
        failed.cast("int").alias("error_count"),
        (~failed).alias("success"),
        F.when(failed, cases([(c("event_id") % 5 == i, m) for i, m in enumerate(messages)], "unexpected end of input")).alias("error_message"),
        F.concat(F.lit("res_"), (c("user_id") % 25).cast("string")).alias("resource_id"),
    )


def scan_results(load: Loader) -> DataFrame:
    """Stored scan findings, one row per finding."""
    c, tag = F.col, lambda p, k: F.concat(F.lit(p), k.cast("string"))
    metrics = ["network_presence", "endpoint_identity", "identity_context", "application_telemetry", "cloud_infrastructure"]
    return load("lineitem").select(
        c("l_orderkey").alias("job_id"),
        tag("proj_", c("l_suppkey") % 12).alias("project_id"),
        tag("ds_", c("l_partkey") % 4).alias("dataset_id"),
        tag("table_", c("l_partkey") % 50).alias("table_id"),
        tag("col_", c("l_linenumber")).alias("column_name"),
        cases([(c("l_suppkey") % 6 == i, m) for i, m in enumerate(metrics)], "other").alias("metric_type"),
        (c("l_quantity") / 50.0).alias("confidence"),
    )


def scan_jobs(load: Loader) -> DataFrame:
    c = F.col
    done = c("o_orderstatus") == "F"
    return load("orders").select(
        c("o_orderkey").alias("id"),
        (c("o_custkey") % 20).alias("user_id"),
        cases([(done, "completed"), (c("o_orderstatus") == "O", "running")], "failed").alias("status"),
        c("o_orderdate").alias("started_at"),
        (c("o_orderkey") % 9).cast("int").alias("total_tables"),
        F.when(done, c("o_orderkey") % 9).otherwise(c("o_orderkey") % 4).cast("int").alias("processed_tables"),
        F.floor(c("o_totalprice") / 10000).cast("int").alias("mappings_found"),
    )


def project_access(load: Loader) -> DataFrame:
    """Customers are granted what their orders point to, so that users of events have some grants."""
    c = F.col
    project = F.when(c("o_orderstatus") == "F", "purchase").when(c("o_orderstatus") == "O", "signup").otherwise("error")
    return load("orders").select(c("o_custkey").alias("user_id"), project.alias("project_id")).distinct()


_ID, _USER = "CAST(event_id AS STRING)", "CAST(user_id AS STRING)"
_HEX = f"md5({_ID})"


def _of(number: str, width: int) -> str:
    return f"lpad({number}, {width}, '0')"


def _guid(hex_: str = _HEX) -> str:
    return f"concat(substr({hex_}, 1, 8), '-', substr({hex_}, 9, 4), '-', substr({hex_}, 13, 4), '-', substr({hex_}, 17, 4), '-', substr({hex_}, 21, 12))"


_MESSAGES = [
    f"concat('login user', {_USER}, '@corp.example.com from 10.', CAST(event_id % 200 AS STRING), '.0.', CAST(user_id % 250 AS STRING), ':', CAST(1024 + event_id % 5000 AS STRING))",
    f"concat('CORP', chr(92), 'user', {_USER}, ' event 4624 on WS-FIN-', {_ID})",
    f"concat('SRV-DB-', {_ID}, ' guid ', {_guid()})",
    f"concat('instance i-', substr({_HEX}, 1, 8), ' volume vol-', substr({_HEX}, 9, 17), ' in us-east-1')",
    f"concat('GET https://shop.example.com/api/v1/orders/', {_ID}, ' 200')",
    f"concat('addr fe80:0:0:0:0:0:', substr({_HEX}, 1, 4), ':', substr({_HEX}, 5, 4), ' up')",
    f"concat('PT', {_of(_ID, 6)}, ' MRN', {_of(_ID, 8)}, ' PHI npi ', {_of(_USER, 10)})",
    f"concat('card 4', {_of(_ID, 12)}, ' iban DE12ABCD', {_of(_ID, 7)}, ' swift DEUTDEFF NYSE:IBM')",
    f"concat('CUST', {_of(_ID, 6)}, ' ORD', upper(substr({_HEX}, 1, 8)), ' sku AB', {_of(_ID, 6)}, ' code ', {_of(_ID, 9)})",
    f"concat('AT', {_of(_ID, 7)}, ' SN', upper(substr({_HEX}, 1, 10)), ' LOT', upper(substr({_HEX}, 11, 6)), ' MTR', {_of(_ID, 7)}, ' XY_', {_of(_USER, 5)}, ' GN', {_of(_USER, 5)})",
    f"concat('CHD', {_of(_ID, 8)}, ' FC', {_of(_USER, 5)}, ' CON', upper(substr({_HEX}, 1, 9)), ' DE', {_of(_ID, 9)})",
    f"concat('ubuntu 20.04 vmware mailsvr eth0:10.1.2.3 windows server 2019 rhel 8 aix macos ABC-DEF-', {_of(_ID, 5)}, ' 10.0.0.', CAST(user_id % 250 AS STRING), ':443 win2019')",
]
_PAYLOADS = [
    f"concat('{{\"user\": {{\"id\": ', {_USER}, ', \"mail\": \"u', {_USER}, '@example.com\"}}, \"tags\": [\"red\", \"blue\"]}}')",
    f"concat('<!-- note --><event><host>SRV-X-', {_ID}, '</host><code>4625</code></event>')",
    f"base64(CAST(concat('host ws', {_ID}, '.corp.example.com') AS BINARY))",
    "'idle'",
]


def _dealt(texts: list[str], by: str = "event_id") -> str:
    return f"CASE {by} % {len(texts)} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + " END"


#: Log lines with every kind of identifier, payloads in every form, and columns in every format; some null.
#: The same SQL text makes the view in the engine that checks.
TELEMETRY = {
    "event_id": "event_id",
    "message": f"CASE WHEN event_id % 13 = 0 THEN NULL ELSE {_dealt(_MESSAGES)} END",
    "payload": _dealt(_PAYLOADS),
    "contact": f"CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('user', {_USER}, '@example.com') END",
    "address": "concat('10.0.', CAST(user_id % 250 AS STRING), '.', CAST(event_id % 250 AS STRING))",
    "token": _guid(),
    "seen_at": "concat('2024-01-', lpad(CAST(1 + event_id % 28 AS STRING), 2, '0'), ' 10:00:00')",
    "link": f"CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('https://example.com/', {_USER}) END",
    "phone": f"concat('555-010-', {_of('CAST(user_id % 10000 AS STRING)', 4)})",
}


def telemetry(load: Loader) -> DataFrame:
    """Events as the log lines of many systems."""
    return load("events").selectExpr(*[f"{sql} AS {name}" for name, sql in TELEMETRY.items()])
