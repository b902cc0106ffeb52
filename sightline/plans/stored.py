"""Registered queries over what was stored before and over the session catalog, and their SQL checks."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from sightline.operators import catalog as cat
from sightline.operators import readiness as rd
from sightline.plans.oracle_views import SCAN_RESULTS, with_views
from sightline.plans.registry import rounded
from sightline.plans.schemas import TABLES, columns
from sightline.sources import tables as tb
from sightline.sources import views
from sightline.sources.tables import loader

JOBS, LOADED = 3, "2024-06-01 00:00:00"


def _results(spark, base):
    """Three jobs store their findings in one table, one of them twice; what the table holds then."""
    found = views.scan_results(loader(spark, base))
    path = tb.staged(spark, "results")
    for job in (*range(JOBS), 1):
        tb.append_scan_results(found.filter(F.col("job_id") % JOBS == job).drop("job_id"), path, f"job_{job}", LOADED)
    schema = "project_id string, dataset_id string, table_id string, column_name string, metric_type string, confidence double, created_at timestamp, job_id string"
    stored = tb.load_stage(spark, path, schema, "parquet")
    total = F.sum("confidence").alias("confidence")
    return rounded(stored.groupBy("job_id", "metric_type").agg(F.count(F.lit(1)).alias("n"), total, F.countDistinct("created_at").alias("loads")))


def _stage(spark, base):
    """The mappings written as JSON by one stage and read by the next with a schema of its own."""
    path = tb.staged(spark, "mappings")
    tb.write_results(rd.mappings(rd.confident(views.scan_results(loader(spark, base)), 0.9)), path)
    stored = tb.load_stage(spark, path, "source string, metric string, confidence double, no_such_field string")
    return rounded(stored.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"), F.count("no_such_field").alias("n_missing")))


def _snapshot(spark, base):
    """The column list stored twice as a table of the session catalog."""
    load = loader(spark, base)
    catalog = cat.measured_columns("lake", {t: load(t) for t in TABLES})
    name, path = f"snapshot_{uuid4().hex}", tb.staged(spark, "snapshot")
    for note in ("first", "second"):
        tb.snapshot_columns(catalog, name, note, path)
    spark.sql(f"DROP TABLE {name}")  # the files of a table with a path stay
    return spark.read.parquet(path).select("dataset", "table", "column", "data_type", "sample_note", F.col("scan_timestamp").isNotNull().alias("has_time"))


#: Partition and bucketing columns of the tables that are registered.
REGISTERED = {"orders": ("o_orderstatus", "o_custkey"), "customer": (None, "c_custkey"), "nation": ("n_regionkey", None), "part": (None, None), "temp_part": (None, None)}


def _discovered(spark, base):
    """Registered tables, partitioned and bucketed, as the session catalog lists them; views, scratch tables
    and the names of datasets that are for the system do not count."""
    load, dataset = loader(spark, base), f"lake_{uuid4().hex}"
    spark.sql(f"CREATE DATABASE {dataset} LOCATION '{tb.staged(spark, 'lake')}'")
    try:
        for name, (partition, bucket) in REGISTERED.items():
            writer = load(name.removeprefix("temp_")).write
            writer = writer.partitionBy(partition) if partition else writer
            writer = writer.bucketBy(4, bucket).sortBy(bucket) if bucket else writer
            writer.saveAsTable(f"{dataset}.{name}")
        spark.sql(f"CREATE VIEW {dataset}.a_view AS SELECT * FROM {dataset}.nation")
        listed = cat.list_datasets(spark).filter(F.col("dataset") == dataset).count()
        tables = [r["table"] for r in cat.list_tables(spark, dataset).collect()]
        found = cat.without_system_tables(cat.list_columns(spark, dataset, tables))
        rows = cat.table_stats({t: spark.table(f"{dataset}.{t}") for t in tables}).select("table", "row_count")
        # One row per column: metadata, kept when the tables are gone.
        joined = found.join(rows, "table").select(F.lit(listed).alias("datasets"), "table", "column", "data_type", "is_partition", "is_clustering", "row_count")
        return joined.checkpoint()
    finally:
        spark.sql(f"DROP DATABASE {dataset} CASCADE")


QUERIES = {"stored_results": _results, "stored_stage": _stage, "stored_snapshot": _snapshot, "discovered_columns": _discovered}

ORACLES = {
    "stored_results": with_views(SCAN_RESULTS, body=f"SELECT concat('job_', job_id % {JOBS}) AS job_id, metric_type, count(*) AS n, round(sum(confidence), 6) AS confidence, 1 AS loads FROM scan_results GROUP BY 1, 2"),
    "stored_stage": with_views(SCAN_RESULTS, body="""SELECT CASE metric_type WHEN 'network_presence' THEN 'network_coverage' WHEN 'endpoint_identity' THEN 'endpoint_coverage' WHEN 'identity_context' THEN 'identity_coverage'
      WHEN 'cloud_infrastructure' THEN 'cloud_coverage' ELSE 'application_coverage' END AS metric, count(*) AS n, round(max(confidence), 6) AS confidence, 0 AS n_missing FROM scan_results WHERE confidence > 0.9 GROUP BY 1"""),
    "stored_snapshot": "SELECT * FROM (VALUES " + ", ".join(f"('lake', '{t}', '{c}', '{k}', 'second', true)" for t, spec in TABLES.items() for c, k in columns(spec)) + ") v(dataset, \"table\", \"column\", data_type, sample_note, has_time)",
    "discovered_columns": "SELECT 1 AS datasets, v.* , n AS row_count FROM (VALUES " + ", ".join(
        f"('{t}', '{c}', '{k}', {str(c == REGISTERED[t][0]).lower()}, {str(c == REGISTERED[t][1]).lower()})" for t in REGISTERED if t in TABLES for c, k in columns(TABLES[t])
    ) + ") v(\"table\", \"column\", data_type, is_partition, is_clustering) JOIN (" + " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in REGISTERED if t in TABLES) + ") s ON s.t = v.\"table\"",
}
