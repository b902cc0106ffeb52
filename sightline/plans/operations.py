"""Registered operations, limits and job history queries and their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import rules
from sightline.functions.columns import cases, epoch_micros
from sightline.operators import ops
from sightline.plans.oracle_views import OPERATIONS, PROJECT_ACCESS, SCAN_JOBS, SCAN_RESULTS, with_views
from sightline.plans.registry import rounded
from sightline.sources import views
from sightline.sources.tables import loader


def _metrics(spark, base):
    return ops.operation_metrics(views.operations(loader(spark, base)))


def _on_metrics(fn):
    return lambda spark, base: rounded(fn(_metrics(spark, base)))


def _on_events(fn):
    return lambda spark, base: rounded(fn(loader(spark, base)("events")))


def _jobs(spark, base):
    return views.scan_jobs(loader(spark, base))


def _latest_results(spark, base):
    load = loader(spark, base)
    return ops.latest_results(views.scan_jobs(load), views.scan_results(load))


def _recent_alerts(spark, base):
    metrics = _metrics(spark, base)
    as_of = metrics.agg(F.max(ops.END)).scalar()
    return rounded(ops.recent_alerts(ops.threshold_alerts(metrics), as_of))


def _advice(spark, base):
    metrics = _metrics(spark, base)
    as_of = metrics.agg(F.max(ops.END)).scalar()
    alerts = ops.recent_alerts(ops.threshold_alerts(metrics), as_of)
    return ops.recommendations(ops.performance_summary(metrics), ops.resource_performance(metrics), alerts)


def operation_events(load):
    """Four events make one operation: start, two updates, end."""
    e, c = load("events"), F.col
    kind = cases([(c("event_id") % 4 == 0, "start"), (c("event_id") % 4 == 3, "end")], "update")
    failed = c("event_type") == "error"
    return e.select(
        "event_id", F.floor(c("event_id") / 4).alias("operation_id"), kind.alias("kind"), epoch_micros("ts").alias("at_micros"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("bigint") * 100).alias("rows_scanned"),
        (failed & (kind == "update")).cast("int").alias("error_count"), c("event_type").alias("operation_type"),
        F.concat(F.lit("res_"), (c("user_id") % 25).cast("string")).alias("resource_id"), F.when(failed & (kind == "end"), "failed at the end").alias("error_message"),
    )


def _dashboard(spark, base):
    out = ops.dashboard_stats(_jobs(spark, base))
    text = F.transform("recent_activity", lambda r: F.concat_ws(":", r["job_id"].cast("string"), r["status"]))
    return out.withColumn("recent_activity", F.array_join(text, "|"))


def _grants(spark, base):
    load = loader(spark, base)
    rows = load("events").select("event_id", "user_id", F.col("event_type").alias("project_id"))
    return ops.granted_rows(rows, views.project_access(load), ["user_id", "project_id"])


def _double_grants(spark, base):
    grants = loader(spark, base)("events").filter(F.col("event_type").isin("signup", "purchase")).select("user_id", F.col("event_type").alias("project_id"))
    return ops.duplicate_grants(grants, ["user_id", "project_id"])


def _audit(spark, base):
    return ops.audit_trail(loader(spark, base)("events")).withColumn("first_at", epoch_micros("first_at")).withColumn("last_at", epoch_micros("last_at"))


QUERIES = {
    "operation_metrics": _on_metrics(lambda m: m.select("operation_id", "end_micros", "rows_per_second", "duration_s")),
    "latest_operations": _on_metrics(lambda m: ops.latest_operations(m).select("operation_id", "end_micros")),
    "performance_summary": _on_metrics(ops.performance_summary),
    "duration_percentile": _on_metrics(ops.duration_percentile),
    "operation_breakdown": _on_metrics(ops.operation_breakdown),
    "resource_performance": _on_metrics(lambda m: ops.resource_performance(m, None)),
    "worst_resources": _on_metrics(ops.resource_performance),
    "rolling_error_rate": _on_metrics(ops.rolling_error_rate),
    "rolling_error_rate_by_resource": _on_metrics(lambda m: ops.rolling_error_rate(m, keys=["resource_id"])),
    "concurrent_operations": _on_metrics(ops.concurrency),
    "threshold_alerts": _on_metrics(ops.threshold_alerts),
    "recent_alerts": _recent_alerts,
    "recommendations": _advice,
    "request_counts": _on_events(ops.request_counts),
    "over_limit": _on_events(lambda e: ops.over_limit(e, 1)),
    "failures": _on_metrics(ops.failures),
    "failure_matrix": _on_metrics(lambda m: ops.failure_matrix(ops.failures(m))),
    "failure_pivot": _on_metrics(lambda m: ops.failure_pivot(ops.failures(m))),
    "failure_streaks": _on_metrics(ops.failure_streaks),
    "jobs_of_user": lambda spark, base: ops.keyed_lookup(_jobs(spark, base), user_id=7, status="completed").select("id", "total_tables", "mappings_found"),
    "job_progress": lambda spark, base: rounded(ops.job_progress(_jobs(spark, base))),
    "latest_jobs": lambda spark, base: ops.latest_jobs(_jobs(spark, base), 50).select("user_id", "recency", "id", "status"),
    "latest_results": lambda spark, base: rounded(_latest_results(spark, base).select("user_id", "job_id", "table_id", "column_name", "metric_type", "confidence")),
    "area_means": lambda spark, base: rounded(ops.area_means(_latest_results(spark, base))),
    "dashboard_stats": _dashboard,
    "granted_rows": _grants,
    "duplicate_grants": _double_grants,
    "audit_trail": _audit,
    "rate_windows": _on_events(lambda e: ops.rate_windows(e).withColumn("window_start", epoch_micros("window_start"))),
    "folded_operations": lambda spark, base: ops.fold_operation_events(operation_events(loader(spark, base))),
}

# ------------------------------------------------------------------------------ SQL
METRICS = """m AS (SELECT *, epoch_us(start_time) AS s0, epoch_us(start_time) + CAST(round(duration_s * 1000000) AS BIGINT) AS end_micros,
  rows_scanned / greatest(duration_s, 0.001) AS rows_per_second FROM operations)"""
ROLLED = """SELECT operation_id, end_micros{keys}, in_frame, round(100.0 * errs / in_frame, 6) AS error_rate FROM (
  SELECT *, count(*) OVER w AS in_frame, sum(CASE WHEN success THEN 0 ELSE 1 END) OVER w AS errs FROM m
  WINDOW w AS ({part} ORDER BY end_micros, operation_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE in_frame >= 10"""
ALERTS = f"""r AS ({ROLLED.format(keys='', part='')}),
b AS (SELECT operation_id, t0, sum(step) OVER (ORDER BY t0, step, operation_id) - 1 AS busy, step FROM (SELECT operation_id, s0 AS t0, 1 AS step FROM m UNION ALL SELECT operation_id, end_micros, -1 FROM m)),
al AS (SELECT 'slow_operation' AS type, 'medium' AS severity, operation_id, end_micros AS at_micros, duration_s AS value FROM m WHERE duration_s > 30
  UNION ALL SELECT 'low_throughput', 'medium', operation_id, end_micros, rows_per_second FROM m WHERE rows_per_second < 100
  UNION ALL SELECT 'high_error_rate', 'high', operation_id, end_micros, error_rate FROM r WHERE error_rate > 10
  UNION ALL SELECT 'high_concurrency', 'high', operation_id, t0, CAST(busy AS DOUBLE) FROM b WHERE step = 1 AND busy >= 50)"""
LAST50 = "z AS (SELECT * FROM m ORDER BY end_micros DESC, operation_id DESC LIMIT 50)"
SUMMARY = """s AS (SELECT count(*) AS n_operations, avg(duration_s) AS average_duration, median(duration_s) AS median_duration,
  (SELECT duration_s FROM (SELECT duration_s, row_number() OVER (ORDER BY duration_s, operation_id) AS rn, count(*) OVER () AS n FROM z) WHERE rn = CAST(floor((n - 1) * 95 / 100) AS BIGINT) + 1) AS p95_duration,
  coalesce(avg(CASE WHEN rows_scanned > 0 THEN rows_per_second END), 0.0) AS average_throughput, 100.0 * sum(CASE WHEN success THEN 1 ELSE 0 END) / count(*) AS success_rate FROM z)"""
RESOURCES = """rp AS (SELECT resource_id, count(*) AS operation_count, CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) AS BIGINT) AS error_count, CAST(sum(rows_scanned) AS BIGINT) AS total_rows,
  avg(duration_s) AS average_duration, 100.0 * sum(CASE WHEN success THEN 0 ELSE 1 END) / count(*) AS error_rate, sum(rows_scanned) / sum(duration_s) AS throughput FROM m GROUP BY resource_id)"""
RESOURCE_COLUMNS = "resource_id, operation_count, error_count, total_rows, round(average_duration, 6) AS average_duration, round(error_rate, 6) AS error_rate, round(throughput, 6) AS throughput"


def _m(body, *ctes):
    return with_views(OPERATIONS, METRICS, *ctes, body=body)


def _category(words, default):
    any_word = lambda ws: " OR ".join(f"contains(lower(error_message), '{w}')" for w in ws)
    return "CASE " + " ".join(f"WHEN {any_word(ws)} THEN '{c}'" for c, ws in words.items()) + f" ELSE '{default}' END"


CALL = _category(rules.CALL_ERROR_WORDS, "unknown_error")
REQUESTS = """q AS (SELECT a.user_id, a.event_type, a.event_id, epoch_us(a.ts) AS at_micros, count(*) AS requests FROM events a JOIN events b
  ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.ts > a.ts - INTERVAL 1 HOUR AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id <= a.event_id)) GROUP BY ALL)"""
RECENT = "lj AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, id DESC) AS recency FROM scan_jobs QUALIFY recency <= {k})"
RESULTS = "lr AS (SELECT user_id, sr.* FROM scan_results sr JOIN lj ON lj.id = sr.job_id WHERE status = 'completed')"
FOLD_EVENTS = """oe AS (SELECT event_id, CAST(floor(event_id / 4) AS BIGINT) AS operation_id, CASE event_id % 4 WHEN 0 THEN 'start' WHEN 3 THEN 'end' ELSE 'update' END AS kind, epoch_us(ts) AS at_micros,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 100 AS rows_scanned, CASE WHEN event_type = 'error' AND event_id % 4 IN (1, 2) THEN 1 ELSE 0 END AS errs, event_type,
  concat('res_', CAST(user_id % 25 AS VARCHAR)) AS resource_id, event_type = 'error' AND event_id % 4 = 3 AS bad_end FROM events)"""

ORACLES = {
    "operation_metrics": _m("SELECT operation_id, end_micros, round(rows_per_second, 6) AS rows_per_second, round(duration_s, 6) AS duration_s FROM m"),
    "latest_operations": _m("SELECT operation_id, end_micros FROM z", LAST50),
    "performance_summary": _m("""SELECT n_operations, round(average_duration, 6) AS average_duration, round(median_duration, 6) AS median_duration, round(p95_duration, 6) AS p95_duration,
      round(average_throughput, 6) AS average_throughput, round(success_rate, 6) AS success_rate FROM s""", LAST50, SUMMARY),
    "duration_percentile": _m("""SELECT operation_type, n, round(duration_s, 6) AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY operation_type ORDER BY duration_s, operation_id) AS rn,
      count(*) OVER (PARTITION BY operation_type) AS n FROM m) WHERE rn = CAST(floor((n - 1) * 95 / 100) AS BIGINT) + 1"""),
    "operation_breakdown": _m("""SELECT operation_type, count(*) AS operation_count, round(sum(duration_s), 6) AS total_duration, CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS success_count,
      CAST(sum(rows_scanned) AS BIGINT) AS total_rows, round(avg(duration_s), 6) AS average_duration, round(100.0 * sum(CASE WHEN success THEN 1 ELSE 0 END) / count(*), 6) AS success_rate,
      round(avg(rows_scanned), 6) AS average_rows FROM m GROUP BY operation_type"""),
    "resource_performance": _m(f"SELECT {RESOURCE_COLUMNS} FROM rp", RESOURCES),
    "worst_resources": _m(f"SELECT {RESOURCE_COLUMNS} FROM rp ORDER BY rp.error_rate DESC, resource_id LIMIT 10", RESOURCES),
    "rolling_error_rate": _m(ROLLED.format(keys="", part="")),
    "rolling_error_rate_by_resource": _m(ROLLED.format(keys=", resource_id", part="PARTITION BY resource_id")),
    "concurrent_operations": _m("SELECT operation_id, t0 AS start_micros, CAST(busy AS BIGINT) AS already_running FROM b WHERE step = 1", ALERTS),
    "threshold_alerts": _m("SELECT type, severity, operation_id, at_micros, round(value, 6) AS value FROM al", ALERTS),
    "recent_alerts": _m("""SELECT type, severity, operation_id, at_micros, round(value, 6) AS value FROM al, (SELECT max(end_micros) AS now FROM m)
      WHERE at_micros <= now AND now - at_micros < 3600000000""", ALERTS),
    "recommendations": _m("""SELECT CAST(row_number() OVER (ORDER BY n) - 1 AS INT) AS position, recommendation FROM (
      SELECT 1 AS n, 'Tune the queries or add capacity: operations are slow' AS recommendation FROM s WHERE average_duration > 60
      UNION ALL SELECT 2, 'Look into recurring operation failures' FROM s WHERE success_rate < 90
      UNION ALL SELECT 3, 'Review sampling rates and queries: throughput is low' FROM s WHERE average_throughput < 50
      UNION ALL SELECT 5, concat('Check the connection to: ', string_agg(resource_id, ', ' ORDER BY resource_id)) FROM (SELECT * FROM rp WHERE error_rate > 20 ORDER BY error_rate DESC, resource_id LIMIT 3) HAVING count(*) > 0
      UNION ALL SELECT 6, 'Review the recent alerts' FROM al, (SELECT max(end_micros) AS now FROM m) WHERE at_micros <= now AND now - at_micros < 3600000000 HAVING count(*) > 5)""", ALERTS, LAST50, SUMMARY, RESOURCES),
    "request_counts": f"WITH {REQUESTS} SELECT * FROM q",
    "over_limit": f"WITH {REQUESTS} SELECT * FROM q WHERE requests > 1",
    "failures": _m(f"""SELECT operation_id, resource_id, {_category(rules.SCAN_ERROR_WORDS, 'unknown')} AS scan_category, {CALL} AS call_category, substr(error_message, 1, 100) AS error_message FROM m WHERE NOT success"""),
    "failure_matrix": _m(f"SELECT resource_id, {CALL} AS error_type, count(*) AS n FROM m WHERE NOT success GROUP BY 1, 2"),
    "failure_pivot": _m("SELECT resource_id, " + ", ".join(f"CAST(sum(CASE WHEN k = '{k}' THEN 1 ELSE 0 END) AS BIGINT) AS {k}" for k in [*rules.CALL_ERROR_WORDS, "unknown_error"]) + f" FROM (SELECT resource_id, {CALL} AS k FROM m WHERE NOT success) GROUP BY resource_id"),
    "failure_streaks": _m("""SELECT resource_id, count(*) AS n_operations, CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) AS BIGINT) AS n_failures, CAST(max(k) AS BIGINT) AS max_streak,
      CAST(arg_max(k, rn) AS BIGINT) AS last_streak, max(k) >= 5 AS opened, min(CASE WHEN k >= 5 THEN end_micros END) AS first_open_micros FROM (
      SELECT *, c - least(0, min(c) OVER (PARTITION BY resource_id ORDER BY end_micros, operation_id)) AS k, row_number() OVER (PARTITION BY resource_id ORDER BY end_micros, operation_id) AS rn FROM (
      SELECT *, sum(CASE WHEN success THEN -1 ELSE 1 END) OVER (PARTITION BY resource_id ORDER BY end_micros, operation_id) AS c FROM m)) GROUP BY resource_id"""),
    "jobs_of_user": with_views(SCAN_JOBS, body="SELECT id, total_tables, mappings_found FROM scan_jobs WHERE user_id = 7 AND status = 'completed'"),
    "job_progress": with_views(SCAN_JOBS, body="""SELECT id, status, processed_tables, total_tables, mappings_found, round(least(100.0 * processed_tables / greatest(total_tables, 1), 100.0), 6) AS progress_percentage,
      (total_tables - processed_tables) * 2 AS seconds_left FROM scan_jobs"""),
    "latest_jobs": with_views(SCAN_JOBS, RECENT.format(k=50), body="SELECT user_id, CAST(recency AS INT) AS recency, id, status FROM lj"),
    "latest_results": with_views(SCAN_JOBS, SCAN_RESULTS, RECENT.format(k=10), RESULTS, body="SELECT user_id, job_id, table_id, column_name, metric_type, round(confidence, 6) AS confidence FROM lr"),
    "area_means": with_views(SCAN_JOBS, SCAN_RESULTS, RECENT.format(k=10), RESULTS, body="SELECT user_id, metric_type, round(avg(confidence), 6) AS mean_confidence, count(*) AS n FROM lr GROUP BY 1, 2"),
    "dashboard_stats": with_views(SCAN_JOBS, RECENT.format(k=10), body="""SELECT user_id, count(*) AS total_scans, CAST(sum(CASE WHEN status = 'running' THEN 1 ELSE 0 END) AS BIGINT) AS active_scans,
      CAST(sum(mappings_found) AS BIGINT) AS total_detections, string_agg(concat(id, ':', status), '|' ORDER BY recency) FILTER (WHERE recency <= 5) AS recent_activity FROM lj GROUP BY user_id"""),
    "granted_rows": with_views(PROJECT_ACCESS, body="SELECT event_id, user_id, event_type AS project_id FROM events e WHERE EXISTS (SELECT 1 FROM project_access p WHERE p.user_id = e.user_id AND p.project_id = e.event_type)"),
    "duplicate_grants": "SELECT user_id, event_type AS project_id, count(*) AS n_grants FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1, 2 HAVING count(*) > 1",
    "audit_trail": "SELECT user_id, event_type, count(*) AS n_actions, epoch_us(min(ts)) AS first_at, epoch_us(max(ts)) AS last_at FROM events GROUP BY 1, 2",
    "rate_windows": """SELECT epoch_us(w) AS window_start, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, round(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / 300.0, 6) AS errors_per_second,
      round(avg(value), 6) AS mean_duration, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / 300.0 > 0.1 AS failing, avg(value) > 300 AS slow
      FROM (SELECT *, date_trunc('minute', ts) - i * INTERVAL 1 MINUTE AS w FROM events, range(5) t(i)) GROUP BY w""",
    "folded_operations": f"""WITH {FOLD_EVENTS} SELECT operation_id, min(CASE WHEN kind = 'start' THEN at_micros END) AS start_micros, max(CASE WHEN kind = 'end' THEN at_micros END) AS end_micros,
      CAST(sum(rows_scanned) AS BIGINT) AS rows_scanned, CAST(sum(errs) + sum(CASE WHEN bad_end THEN 1 ELSE 0 END) AS BIGINT) AS error_count, arg_max(event_type, (at_micros, event_id)) AS operation_type,
      arg_max(resource_id, (at_micros, event_id)) AS resource_id, NOT bool_or(bad_end) AS success, NOT bool_or(kind = 'end') AS active FROM oe GROUP BY operation_id""",
}
