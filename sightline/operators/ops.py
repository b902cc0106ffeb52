"""Operational metrics, alerts, limits and job history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import rules
from sightline.functions.columns import epoch_micros, first_label, percent, stacked
from sightline.operators.ordering import element_at_fraction, with_last_n, with_running

SECOND = 1_000_000
END = "end_micros"


def operation_metrics(ops: DataFrame) -> DataFrame:
    """End time and throughput; a duration counts as at least a millisecond."""
    start = epoch_micros("start_time")
    return ops.withColumn(END, start + F.round(F.col("duration_s") * SECOND).cast("bigint")).withColumn(
        "rows_per_second", per_second("rows_scanned")
    )


def per_second(amount: str) -> Column:
    """Any counter of an operation per second, for bytes as well as for rows."""
    return F.col(amount) / F.greatest(F.col("duration_s"), F.lit(0.001))


def latest_operations(metrics: DataFrame, n: int = 50) -> DataFrame:
    return metrics.orderBy(F.desc(END), F.desc("operation_id")).limit(n)


def performance_summary(metrics: DataFrame, n: int = 50) -> DataFrame:
    """One row over the latest n operations."""
    recent = latest_operations(metrics, n)
    # The window spans the latest n rows only.
    ranked = recent.withColumn("_rn", F.row_number().over(Window.orderBy("duration_s", "operation_id"))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    p95 = F.max(F.when(F.col("_rn") == F.floor((F.col("_n") - 1) * 95 / 100) + 1, F.col("duration_s")))
    return ranked.agg(
        F.count(F.lit(1)).alias("n_operations"), F.avg("duration_s").alias("average_duration"), F.median("duration_s").alias("median_duration"), p95.alias("p95_duration"),
        F.coalesce(F.avg(F.when(F.col("rows_scanned") > 0, F.col("rows_per_second"))), F.lit(0.0)).alias("average_throughput"),
        percent(F.count_if("success"), F.count(F.lit(1))).alias("success_rate"),
    )


def duration_percentile(ops: DataFrame, keys: Sequence[str] = ("operation_type",), percentile: int = 95) -> DataFrame:
    return element_at_fraction(ops, list(keys), "duration_s", "operation_id", percentile)


def operation_breakdown(ops: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return ops.groupBy("operation_type").agg(
        n.alias("operation_count"), F.sum("duration_s").alias("total_duration"), F.count_if("success").alias("success_count"), F.sum("rows_scanned").alias("total_rows"),
        F.avg("duration_s").alias("average_duration"), percent(F.count_if("success"), n).alias("success_rate"), F.avg("rows_scanned").alias("average_rows"),
    )


def resource_performance(ops: DataFrame, worst: int | None = 10) -> DataFrame:
    """Per resource counts, error rate and throughput; the worst by error rate."""
    stats = ops.filter(F.col("resource_id") != "").groupBy("resource_id").agg(
        F.count(F.lit(1)).alias("operation_count"), F.count_if(~F.col("success")).alias("error_count"), F.sum("rows_scanned").alias("total_rows"),
        F.avg("duration_s").alias("average_duration"), F.sum("duration_s").alias("_d"),
    )
    stats = stats.withColumn("error_rate", percent("error_count", "operation_count")).withColumn("throughput", F.when(F.col("_d") > 0, F.col("total_rows") / F.col("_d")).otherwise(0.0)).drop("_d")
    ordered = stats.orderBy(F.desc("error_rate"), "resource_id")
    return ordered.limit(worst) if worst else ordered


def rolling_error_rate(metrics: DataFrame, last: int = 20, at_least: int = 10, keys: Sequence[str] = (), **options) -> DataFrame:
    """Error rate over each operation and those finished just before it."""
    rolled = with_last_n(
        metrics.select("operation_id", END, "success", *keys), list(keys), [END, "operation_id"], last,
        {"_errors": F.count_if(~F.col("success")), "in_frame": F.count(F.lit(1))}, **options,
    )
    return rolled.filter(F.col("in_frame") >= at_least).withColumn("error_rate", percent("_errors", "in_frame")).drop("_errors", "success", "rank")


def concurrency(metrics: DataFrame) -> DataFrame:
    """For every operation the number of others still running when it starts."""
    start = epoch_micros("start_time")
    edges = metrics.select("operation_id", stacked(["at", "step"], (start, F.lit(1)), (F.col(END), F.lit(-1))))
    running = with_running(edges, [], ["at", "step", "operation_id"], "step")
    return running.filter(F.col("step") == 1).select("operation_id", F.col("at").alias("start_micros"), (F.col("running") - 1).alias("already_running"))


def threshold_alerts(metrics: DataFrame, last: int = 20) -> DataFrame:
    """One row per broken bound: slow, low throughput, high error rate, high concurrency."""
    alert = lambda kind, severity, at, value: [F.lit(kind).alias("type"), F.lit(severity).alias("severity"), "operation_id", at.alias("at_micros"), value.cast("double").alias("value")]
    end = F.col(END)
    slow = metrics.filter(F.col("duration_s") > rules.SLOW_SECONDS).select(*alert("slow_operation", "medium", end, F.col("duration_s")))
    low = metrics.filter(F.col("rows_per_second") < rules.LOW_ROWS_PER_SECOND).select(*alert("low_throughput", "medium", end, F.col("rows_per_second")))
    errors = rolling_error_rate(metrics, last).filter(F.col("error_rate") > rules.HIGH_ERROR_PERCENT).select(*alert("high_error_rate", "high", end, F.col("error_rate")))
    busy = concurrency(metrics).filter(F.col("already_running") >= rules.MAX_CONCURRENT).select(*alert("high_concurrency", "high", F.col("start_micros"), F.col("already_running")))
    return slow.unionByName(low).unionByName(errors).unionByName(busy)


def alert_message() -> Column:
    value = F.format_string("%.1f", "value")
    return (
        F.when(F.col("type") == "slow_operation", F.concat(F.lit("Operation "), F.col("operation_id").cast("string"), F.lit(" took "), value, F.lit(" seconds")))
        .when(F.col("type") == "low_throughput", F.concat(F.lit("Low throughput: "), value, F.lit(" rows/sec")))
        .when(F.col("type") == "high_error_rate", F.concat(F.lit("Error rate: "), value, F.lit("%")))
        .otherwise(F.concat(F.lit("Too many concurrent operations: "), F.col("value").cast("int").cast("string")))
    )


def recent_alerts(alerts: DataFrame, as_of: Column, seconds: int = 3600) -> DataFrame:
    return alerts.filter((F.col("at_micros") <= as_of) & (as_of - F.col("at_micros") < seconds * SECOND))


def recommendations(summary: DataFrame, resources: DataFrame, alerts: DataFrame, active: Column | int = 0, worst: int = 3) -> DataFrame:
    """Advice rows for the broken rules, or one row when all is well. The `worst` resources are named."""
    bad = resources.filter(F.col("error_rate") > 20).orderBy(F.desc("error_rate"), "resource_id").limit(worst)
    names = bad.agg(F.array_join(F.sort_array(F.collect_list("resource_id")), ", ")).scalar()
    n_alerts = alerts.agg(F.count(F.lit(1))).scalar()
    active = F.lit(active) if isinstance(active, int) else active
    found = [
        (F.col("average_duration") > 60, F.lit("Tune the queries or add capacity: operations are slow")),
        (F.col("success_rate") < 90, F.lit("Look into recurring operation failures")),
        (F.col("average_throughput") < 50, F.lit("Review sampling rates and queries: throughput is low")),
        (active > 20, F.lit("Queue operations to limit concurrency")),
        (F.length("_names") > 0, F.concat(F.lit("Check the connection to: "), F.col("_names"))),
        (F.col("_alerts") > 5, F.lit("Review the recent alerts")),
    ]
    wide = summary.withColumn("_names", names).withColumn("_alerts", n_alerts)
    rows = F.array_compact(F.array(*[F.when(test, text) for test, text in found]))
    fine = F.array(F.lit("No specific recommendation"))
    return wide.select(F.posexplode(F.when(F.size(rows) > 0, rows).otherwise(fine)).alias("position", "recommendation"))


# ------------------------------------------------------------------------------ limits
def request_counts(events: DataFrame, user: str = "user_id", action: str = "event_type", at: str = "ts", key: str = "event_id", seconds: int = 3600) -> DataFrame:
    """For every request the requests of its user and action in the window that ends with it.

    A request enters the count at its time and leaves it when the window has passed.
    """
    t = epoch_micros(at)
    steps = events.select(user, action, key, stacked(["at", "step"], (t, F.lit(1)), (t + F.lit(seconds * SECOND), F.lit(-1))))
    running = with_running(steps, [user, action], ["at", "step", key], "step")
    return running.filter(F.col("step") == 1).select(user, action, key, F.col("at").alias("at_micros"), F.col("running").alias("requests"))


def over_limit(events: DataFrame, limit: int = 3, **options) -> DataFrame:
    return request_counts(events, **options).filter(F.col("requests") > limit)


# ------------------------------------------------------------------------------ errors
def error_category(message: Column | str = "error_message", words: Mapping[str, Sequence[str]] = rules.CALL_ERROR_WORDS, default: str = "unknown_error") -> Column:
    """Category by the first list with a word inside the message."""
    message = F.col(message) if isinstance(message, str) else message
    return first_label(F.lower(message), words, default)


def failures(ops: DataFrame) -> DataFrame:
    """Failed operations with both categories and a message cut to 100 characters."""
    return ops.filter(~F.col("success")).select(
        "operation_id", "resource_id",
        error_category(words=rules.SCAN_ERROR_WORDS, default="unknown").alias("scan_category"), error_category().alias("call_category"),
        F.substring("error_message", 1, 100).alias("error_message"),
    )


def failure_matrix(failed: DataFrame) -> DataFrame:
    return failed.groupBy("resource_id", F.col("call_category").alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


def failure_pivot(failed: DataFrame) -> DataFrame:
    """One row per resource, one column per error category."""
    kinds = [*rules.CALL_ERROR_WORDS, "unknown_error"]
    return failed.groupBy("resource_id").agg(*[F.count_if(F.col("call_category") == k).alias(k) for k in kinds])


def failure_streaks(metrics: DataFrame, threshold: int = 5) -> DataFrame:
    """Per resource the failure count that rises by one per failure and falls by one, not
    below zero, per success: its highest and last value, and whether it reached the threshold.

    The floored count is the running sum less its lowest value so far, if that is negative.
    """
    step = F.when(F.col("success"), F.lit(-1)).otherwise(F.lit(1))
    run = with_running(metrics.select("resource_id", "operation_id", END, "success"), ["resource_id"], [END, "operation_id"], step)
    streak = F.col("running") - F.least(F.col("lowest"), F.lit(0))
    run = run.withColumn("streak", streak)
    order = F.struct(END, "operation_id")
    return run.groupBy("resource_id").agg(
        F.count(F.lit(1)).alias("n_operations"), F.count_if(~F.col("success")).alias("n_failures"), F.max("streak").alias("max_streak"),
        F.max_by("streak", order).alias("last_streak"), (F.max("streak") >= threshold).alias("opened"),
        F.min(F.when(F.col("streak") >= threshold, F.col(END))).alias("first_open_micros"),
    )


# -------------------------------------------------------------------------------- jobs
def keyed_lookup(df: DataFrame, **equals) -> DataFrame:
    for name, value in equals.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def job_progress(jobs: DataFrame) -> DataFrame:
    """Percent done, at most 100, and the seconds left at two per table."""
    done = percent("processed_tables", F.greatest(F.col("total_tables"), F.lit(1)))
    return jobs.select(
        "id", "status", "processed_tables", "total_tables", "mappings_found", F.least(done, F.lit(100.0)).alias("progress_percentage"),
        ((F.col("total_tables") - F.col("processed_tables")) * 2).alias("seconds_left"),
    )


def latest_jobs(jobs: DataFrame, k: int = 10) -> DataFrame:
    """The k latest jobs of every user; the rank limit cuts each task's rows first."""
    order = Window.partitionBy("user_id").orderBy(F.desc("started_at"), F.desc("id"))
    return jobs.withColumn("recency", F.row_number().over(order)).filter(F.col("recency") <= k)


def latest_results(jobs: DataFrame, results: DataFrame, k: int = 10) -> DataFrame:
    """Results of the completed jobs among each user's latest ones."""
    done = latest_jobs(jobs, k).filter(F.col("status") == "completed").select(F.col("id").alias("job_id"), "user_id")
    return results.join(done, "job_id")


def area_means(results: DataFrame, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    return results.groupBy(*keys, "metric_type").agg(F.avg("confidence").alias("mean_confidence"), F.count(F.lit(1)).alias("n"))


def dashboard_stats(jobs: DataFrame, recent: int = 5) -> DataFrame:
    """Per user over the latest ten jobs: totals, running jobs, findings, and the last five."""
    last = latest_jobs(jobs)
    activity = F.sort_array(F.collect_list(F.when(F.col("recency") <= recent, F.struct("recency", F.col("id").alias("job_id"), "status"))))
    return last.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_scans"), F.count_if(F.col("status") == "running").alias("active_scans"),
        F.sum("mappings_found").alias("total_detections"), activity.alias("recent_activity"),
    )


def granted_rows(rows: DataFrame, grants: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose user and project have a grant."""
    return rows.join(grants.select(*keys).distinct(), list(keys), "left_semi")


def duplicate_grants(grants: DataFrame, keys: Sequence[str]) -> DataFrame:
    return grants.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_grants")).filter(F.col("n_grants") > 1)


def audit_trail(log: DataFrame, user: str = "user_id", action: str = "event_type") -> DataFrame:
    return log.groupBy(user, action).agg(F.count(F.lit(1)).alias("n_actions"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def rate_windows(events: DataFrame, at: str = "ts", length: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Errors per second and mean duration in sliding windows, with the two alert bounds."""
    seconds = 300.0
    counted = events.groupBy(F.window(F.col(at), length, slide)).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.avg("value").alias("mean_duration"))
    return counted.select(
        F.col("window.start").alias("window_start"), "errors", (F.col("errors") / seconds).alias("errors_per_second"), "mean_duration",
        (F.col("errors") / seconds > 0.1).alias("failing"), (F.col("mean_duration") > 300).alias("slow"),
    )


def fold_operation_events(events: DataFrame) -> DataFrame:
    """Start, update and end events to one record per operation.

    Counters add up, other fields take their last value, an end with an error adds one error
    and marks the operation failed, and an operation without an end is still active.
    """
    is_end = F.col("kind") == "end"
    order = F.struct("at_micros", "event_id")
    failed_end = is_end & F.col("error_message").isNotNull()
    return events.groupBy("operation_id").agg(
        F.min(F.when(F.col("kind") == "start", F.col("at_micros"))).alias("start_micros"),
        F.max(F.when(is_end, F.col("at_micros"))).alias("end_micros"),
        F.sum("rows_scanned").alias("rows_scanned"),
        (F.sum("error_count") + F.count_if(failed_end)).alias("error_count"),
        F.max_by("operation_type", order).alias("operation_type"),
        F.max_by(F.col("resource_id"), order).alias("resource_id"),
        (~F.coalesce(F.max(failed_end), F.lit(False))).alias("success"),
        (F.count_if(is_end) == 0).alias("active"),
    )
