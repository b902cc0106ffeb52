import json

import pytest
from pyspark.sql import functions as F

from sightline.functions.rules import METRICS
from sightline.operators import lineage as lin
from sightline.operators import ops
from sightline.operators import readiness as rd
from sightline.sources import tables, views
from sightline.sources.tables import loader

RESULT = "project_id string, dataset_id string, table_id string, column_name string, metric_type string, confidence double"


def results(spark, counts, confidence=0.9, extra=()):
    rows = [(f"p{i}", "d", f"t{i}", "c", m, confidence) for m, n in counts.items() for i in range(n)]
    return spark.createDataFrame([*rows, *extra], RESULT)


def test_readiness_bounds(spark):
    found = results(spark, dict(zip(METRICS, [5, 4, 2, 1, 12])))
    got = {r["metric"]: (r["n_sources"], r["status"], r["coverage_score"]) for r in rd.readiness(found).collect()}
    assert list(got.values()) == [(5, "READY", 50.0), (4, "PARTIAL", 40.0), (2, "PARTIAL", 20.0), (1, "NOT_READY", 10.0), (12, "READY", 100.0)]
    total = rd.overall(rd.readiness(found)).first()
    assert (total["ready_areas"], total["percentage"], total["areas_ready"], total["status"]) == (2, 40.0, "2/5", "PARTIAL")


def test_readiness_counts_the_threshold_itself(spark):
    found = results(spark, {METRICS[0]: 5}, 0.7)
    assert rd.readiness(found).filter("status = 'READY'").count() == 1
    assert rd.value_summary(found).filter("ready").count() == 0
    assert results(spark, {METRICS[0]: 5}, 0.3).transform(rd.confident, 0.3).count() == 0


def test_no_findings_at_all(spark):
    empty = results(spark, {})
    assert [r["status"] for r in rd.readiness(empty).collect()] == ["NOT_READY"] * 5
    assert [r["total_findings"] for r in rd.value_summary(empty).collect()] == [0] * 5
    assert rd.technical_summary(empty).first()["data_quality_assessment"] == "insufficient_data"
    assert rd.budget_estimate(empty).first()["initial_setup"] == "$0"


def test_readiness_rises_with_the_count(spark):
    rank = {"NOT_READY": 0, "PARTIAL": 1, "READY": 2}
    found = spark.range(13).select(F.col("id").alias("job_id"), F.explode(F.sequence(F.lit(1), F.col("id"))).alias("_i"), F.lit(METRICS[0]).alias("metric_type"), F.lit(0.8).alias("confidence")).filter("job_id > 0")
    rows = rd.readiness(found, ["job_id"]).filter(F.col("metric") == METRICS[0]).orderBy("job_id").collect()
    assert [rank[r["status"]] for r in rows] == sorted(rank[r["status"]] for r in rows)
    assert [r["coverage_score"] for r in rows] == sorted(r["coverage_score"] for r in rows)


@pytest.mark.parametrize("ready, status, risk, confidence", [(5, "READY", "LOW", "high"), (4, "READY", "LOW", "high"), (3, "NEARLY_READY", "MEDIUM", "medium"), (2, "PARTIAL", "HIGH", "low"), (0, "NOT_READY", "HIGH", "low")])
def test_report_bands(spark, ready, status, risk, confidence):
    found = results(spark, {m: 5 for m in METRICS[:ready]})
    row = rd.report_score(rd.overall(rd.readiness(found))).first()
    assert (row["readiness_status"], row["overall_risk_level"], row["confidence_level"]) == (status, risk, confidence)


def test_impact_is_clamped(spark):
    full = rd.report_score(rd.overall(rd.readiness(results(spark, {m: 5 for m in METRICS}))))
    assert list(rd.impact_estimates(full).first()) == ["95%", "80%", "90%", "70%", "6-12 months"]


def test_frameworks_and_risks(spark):
    ready = rd.readiness(results(spark, {"network_presence": 5, "endpoint_identity": 2}))
    got = {r["framework"]: (r["met_requirements"], r["status"], r["gaps"]) for r in rd.compliance_frameworks(ready).collect()}
    assert got["SOC2"] == (2, "PARTIAL", ["access_logging", "change_management"])
    assert got["NIST_CSF"] == (1, "PARTIAL", ["protect", "detect", "respond", "recover"])
    risks = [(r["area"], r["risk_level"]) for r in rd.risk_list(ready).collect()]
    assert risks == [("identity_coverage", "HIGH"), ("application_coverage", "MEDIUM"), ("cloud_coverage", "MEDIUM")]
    assert [r["dependency"] for r in rd.coverage_dependencies(ready).collect()] == ["Identity and access management integration"]
    assert rd.risk_list(ready).filter("area = 'cloud_coverage'").first()["action"] == "Enhance cloud data collection and monitoring"


def test_report_is_one_json_row(spark):
    found = results(spark, {m: 12 for m in METRICS})
    body = json.loads(rd.report_json(found).first()["report"])
    assert body["summary"]["readiness_status"] == "READY" and len(body["compliance"]) == 4
    assert len(body["key_findings"]) == 2 and body["budget"][0]["initial_setup"] == "$60,000"


def test_enterprise_summary_and_failures(spark):
    messages = ["Permission denied", "quota exceeded", "Connection reset", "strange", None]
    attempts = spark.createDataFrame([(i, f"r{i}", m is None, m, 2.0) for i, m in enumerate(messages)], "operation_id int, resource_id string, success boolean, error_message string, duration_s double")
    row = rd.enterprise_summary(results(spark, {METRICS[0]: 3}), attempts).first()
    assert (row["data_rich_projects"], row["total_unique_sources"], row["tables_processed"], row["success_rate"], row["permission_failures"], row["quota_failures"], row["network_failures"], row["tables_per_second"]) == (3, 3, 5, 80.0, 1, 1, 1, 0.5)
    assert [r["error_category"] for r in rd.failed_resources(attempts).collect()] == ["permission_denied", "quota_exceeded", "unknown", "unknown"]


# ----------------------------------------------------------------------------- lineage
JOBS = "job_id int, creation_time timestamp_ntz, user_email string, job_type string, total_bytes bigint, total_cost_ms bigint, destination struct<dataset:string,table:string>, referenced array<struct<dataset:string,table:string>>"


def jobs(spark, rows):
    base = spark.createDataFrame([(i, day, user, kind, 10, 4, dst, refs) for i, (day, user, kind, dst, refs) in enumerate(rows)], JOBS.replace("timestamp_ntz", "string"))
    return base.withColumn("creation_time", F.col("creation_time").cast("timestamp_ntz"))


def test_lineage_of_a_small_history(spark):
    history = jobs(spark, [
        ("2024-01-31 00:00:00", "u1", "QUERY", ("marts", "mart_a"), [("core", "int_a"), ("landing", "raw_a"), ("marts", "mart_b")]),
        ("2024-01-30 00:00:00", "u2", "QUERY", ("core", "int_a"), [("landing", "raw_a")]),
        ("2024-01-01 00:00:00", "u2", "LOAD", ("core", "int_a"), [("landing", "raw_b")]),
        ("2023-12-31 23:59:59", "u2", "LOAD", ("core", "int_a"), [("landing", "raw_old")]),
    ])
    refs = lin.unnest_references(history)
    as_of = lin.newest(refs)
    edges = lin.table_edges(refs, as_of)
    pairs = {(r["source"], r["target"]) for r in edges.collect()}
    # The same dataset is left out, 30 days ago exactly is still in.
    assert pairs == {("core.int_a", "marts.mart_a"), ("landing.raw_a", "marts.mart_a"), ("landing.raw_a", "core.int_a"), ("landing.raw_b", "core.int_a")}

    ingestion = lin.ingestion_pattern(refs, as_of)
    got = {r["table_key"]: (r["avg_daily_jobs"], r["total_bytes"], r["pattern_rows"], r["ingestion_frequency"]) for r in ingestion.collect()}
    assert got == {"marts.mart_a": (1.0, 10, 1, "irregular"), "core.int_a": (1.0, 20, 2, "irregular")}

    access = lin.access_pattern(lin.access_days(refs, as_of))
    got = {r["table_key"]: (r["avg_daily_queries"], r["unique_users_count"], r["access_frequency"]) for r in access.collect()}
    assert got["landing.raw_a"] == (1.0, 2, "low") and "landing.raw_b" not in got

    known = spark.createDataFrame([("core.int_a",), ("marts.mart_a",)], "table_key string")
    flows = {(r["source"], r["target"]): (r["flow_type"], r["frequency"]) for r in lin.data_flows(edges, known, ingestion, access).collect()}
    assert flows[("core.int_a", "marts.mart_a")] == ("transformation", "low")
    assert flows[("landing.raw_a", "core.int_a")] == ("ingestion", "irregular")

    points = {r["table_key"]: (r["input_count"], r["output_count"], r["transformation_type"], r["complexity"]) for r in lin.transformation_points(edges, known).collect()}
    assert points == {"core.int_a": (2, 1, "intermediate", "moderate"), "marts.mart_a": (2, 0, "mart", "simple")}

    counts = spark.createDataFrame([("landing.raw_a", 0), ("core.int_a", 5)], "table_key string, row_count bigint")
    health = {r["table_key"]: (r["dependency_count"], r["critical_dependencies"], r["dependency_health"]) for r in lin.dependency_health(edges, known, counts).collect()}
    assert health == {"core.int_a": (2, ["landing.raw_a"], "critical"), "marts.mart_a": (2, ["landing.raw_a"], "critical")}
    assert lin.lineage_report(edges, known, ingestion, access, counts).count() == 2


def test_daily_needs_more_than_twenty_rows(spark):
    day = lambda i: f"2024-01-{i:02d} 00:00:00"
    make = lambda n: lin.unnest_references(jobs(spark, [(day(i), "u", "LOAD", ("core", "int_a"), [("l", "raw_a"), ("l", "raw_b")]) for i in range(1, n + 1)]))
    freq = lambda n: lin.ingestion_pattern(make(n), F.lit("2024-01-28").cast("timestamp_ntz")).first()
    assert freq(20)["ingestion_frequency"] == "irregular" and freq(21)["ingestion_frequency"] == "daily"
    assert freq(21)["avg_daily_jobs"] == 1.0


def test_layers(spark):
    names = ["d.stg_x", "d.raw_x", "d.temp_x", "d.dim_x", "raw_d.x", "d.rpt_x"]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    assert [r[0] for r in df.select(lin.layer_of("t")).collect()] == ["staging", "staging", "intermediate", "mart", "unknown", "reporting"]


# --------------------------------------------------------------------- jobs and sinks
def test_error_categories_follow_declared_order(spark):
    df = spark.createDataFrame([("429 forbidden",), ("Access Denied",), ("Read Timeout",), ("500 oops",), ("hm",), (None,)], "error_message string")
    assert [r[0] for r in df.select(ops.error_category()).collect()] == ["quota_exceeded", "permission_denied", "network_timeout", "internal_error", "unknown_error", "unknown_error"]


def test_job_progress_is_clamped(spark):
    df = spark.createDataFrame([(1, "running", 9, 4, 0), (2, "running", 0, 0, 0), (3, "running", 1, 4, 0)], "id int, status string, processed_tables int, total_tables int, mappings_found int")
    got = {r["id"]: (r["progress_percentage"], r["seconds_left"]) for r in ops.job_progress(df).collect()}
    assert got == {1: (100.0, -10), 2: (0.0, 0), 3: (25.0, 6)}


def test_folded_operations(spark):
    rows = [(1, "o", "start", 1, 0, 0, "a", "r1", None), (2, "o", "update", 2, 5, 1, "b", "r2", None), (3, "o", "end", 3, 7, 0, "b", "r2", "boom"), (4, "p", "start", 4, 0, 0, "a", "r1", None)]
    df = spark.createDataFrame(rows, "event_id int, operation_id string, kind string, at_micros bigint, rows_scanned bigint, error_count int, operation_type string, resource_id string, error_message string")
    got = {r["operation_id"]: tuple(r)[1:] for r in ops.fold_operation_events(df).collect()}
    assert got["o"] == (1, 3, 12, 2, "b", "r2", False, False)
    assert got["p"] == (4, None, 0, 0, "a", "r1", True, True)


def test_recommendations_when_all_is_well(spark):
    summary = spark.createDataFrame([(1.0, 100.0, 500.0)], "average_duration double, success_rate double, average_throughput double")
    resources = spark.createDataFrame([], "resource_id string, error_rate double")
    alerts = spark.createDataFrame([], "type string")
    assert [r["recommendation"] for r in ops.recommendations(summary, resources, alerts).collect()] == ["No specific recommendation"]
    assert ops.recommendations(summary.withColumn("success_rate", F.lit(50.0)), resources, alerts, 21).count() == 2


def test_sinks_and_stages(spark, tmp_path):
    df = results(spark, {METRICS[0]: 3})
    for fmt in ("json", "parquet"):
        tables.write_results(df, f"{tmp_path}/{fmt}", fmt)
        assert tables.load_stage(spark, f"{tmp_path}/{fmt}", df.schema, fmt).exceptAll(df).count() == 0
    path = f"{tmp_path}/store"
    tables.append_scan_results(df, path, "job-1", "2024-01-01 00:00:00")
    tables.append_scan_results(df, path, "job-2", "2024-01-02 00:00:00")
    tables.append_scan_results(df, path, "job-2", "2024-01-03 00:00:00")  # run again: one set of rows
    assert {(r["job_id"], str(r["created_at"])[:10]) for r in spark.read.parquet(path).collect()} == {("job-1", "2024-01-01"), ("job-2", "2024-01-03")}
    stored = spark.read.parquet(path)
    assert stored.count() == 6 and stored.filter("job_id = 'job-2'").count() == 3
    catalog = spark.createDataFrame([("d", "t", "c", "string")], "dataset string, table string, column string, data_type string")
    spark.sql("DROP TABLE IF EXISTS column_snapshot")
    tables.snapshot_columns(catalog, "column_snapshot")
    tables.snapshot_columns(catalog, "column_snapshot")
    try:
        assert [r["sample_note"] for r in spark.table("column_snapshot").collect()] == ["Metadata collected"]
    finally:
        spark.sql("DROP TABLE column_snapshot")


def test_runs_added_to_a_rollup_equal_the_whole_history(spark, small, tmp_path):
    refs = lin.unnest_references(views.batch_jobs(loader(spark, small)))
    early = F.col("creation_time") < "1996-03-01"
    for run, part in (("a", refs.filter(early)), ("b", refs.filter(~early)), ("a", refs.filter(early))):
        lin.store_run(lin.rolled_up(part), str(tmp_path), run)
    added = lin.report_from_rollup(lin.load_rollup(spark, str(tmp_path)))
    whole = lin.report_from_rollup(lin.rolled_up(refs))
    rounded = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
    assert rounded(added) == rounded(whole) and added.count() > 10
    estimate = [(r["users_estimate"], r["unique_users_count"]) for r in added.filter("users_estimate IS NOT NULL").collect()]
    assert all(e <= n for e, n in estimate)


def test_risks_are_sorted_by_job_before_they_are_rows(spark, capsys):
    rows = [(j, m, 0.9) for j in (5, 3, None, 40, 5, 5) for m in METRICS[:2]]
    results = spark.createDataFrame(rows, "job_id int, metric_type string, confidence double")
    risks = rd.risk_list(rd.readiness(results, ["job_id"], in_order=True), ["job_id"], in_order=True)
    risks.explain()
    plan = capsys.readouterr().out
    assert plan.index("Generate") < plan.index("Sort [")
    assert risks.collect() == rd.risk_list(rd.readiness(results, ["job_id"]), ["job_id"]).collect()
    assert rd.risk_list(rd.readiness(results, in_order=True), in_order=True).collect() == rd.risk_list(rd.readiness(results)).collect()
