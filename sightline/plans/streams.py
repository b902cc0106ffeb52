"""Registered streaming queries, each run over all available files, and their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions.columns import epoch_micros
from sightline.functions.rules import DETECTORS
from sightline.operators import ops
from sightline.plans import operations as batch
from sightline.plans.registry import rounded
from sightline.sources.tables import loader
from sightline.streaming import operations as so
from sightline.streaming import streams as st

LIVE = [d for d in DETECTORS if d.name in ("ipv4", "api_endpoint", "http_status")]
# Files of a stored table come in any order of time, so no row of it counts as late.
STORED = "36500 days"


def _events(spark, base):
    return st.read_stream(spark, base, "events", loader(spark, base)("events").schema)


def log_lines(events):
    """Events as lines of a web log."""
    c, text = F.col, lambda e: e.cast("string")
    line = F.concat(F.lit("GET /api/"), c("event_type"), F.lit("/"), text(c("user_id")), F.lit(" "), text(200 + c("event_id") % 4 * 100), F.lit(" from 10.0."), text(c("user_id") % 256), F.lit("."), text(c("event_id") % 256))
    return events.select("event_id", "ts", line.alias("text"))


def _micros(df):
    return df.withColumn("window_start", epoch_micros("window_start"))


def _request_windows(spark, base):
    return _micros(st.latest(st.run_available(st.request_windows(_events(spark, base), watermark=STORED), "update"), ["window_start", "user_id", "event_type"]))


def _rate_windows(spark, base):
    return rounded(_micros(st.latest(st.run_available(st.rate_windows(_events(spark, base), watermark=STORED), "update"), ["window_start"])))


def _live(spark, base):
    return _micros(st.latest(st.run_available(st.live_detections(log_lines(_events(spark, base)), LIVE, watermark=STORED), "update"), ["window_start", "detector"]))


def _folded(spark, base):
    stream = ops.fold_operation_events(batch.operation_events(lambda _: _events(spark, base)))
    return st.latest(st.run_available(stream, "update"), ["operation_id"])


def _closed(spark, base):
    stream = batch.operation_events(lambda _: _events(spark, base)).withColumn("ts", F.timestamp_micros("at_micros"))
    emitted, _ = so.run_operations(so.closed_operations(stream))
    return emitted.drop("batch")


def _audit(spark, base):
    log = st.run_available(st.audit_log(_events(spark, base)), "append")
    return log.groupBy("user_id", "action").agg(F.count(F.lit(1)).alias("n_actions"), F.min(epoch_micros("ts")).alias("first_at"), F.max(epoch_micros("ts")).alias("last_at"))


QUERIES = {
    "stream_request_windows": _request_windows,
    "stream_rate_windows": _rate_windows,
    "stream_live_detections": _live,
    "stream_folded_operations": _folded,
    "stream_closed_operations": _closed,
    "stream_audit_trail": _audit,
}

ORACLES = {
    "stream_request_windows": """SELECT epoch_us(w) AS window_start, user_id, event_type, count(*) AS requests FROM (
      SELECT *, time_bucket(INTERVAL 10 MINUTE, ts) - i * INTERVAL 10 MINUTE AS w FROM events, range(6) t(i)) GROUP BY 1, 2, 3""",
    "stream_rate_windows": batch.ORACLES["rate_windows"],
    "stream_live_detections": "SELECT epoch_us(w) AS window_start, detector, CAST(sum(n) AS BIGINT) AS n_matches FROM (" + " UNION ALL ".join(
        f"SELECT date_trunc('day', ts)::TIMESTAMP AS w, '{d.name}' AS detector, len(regexp_extract_all(line, '(?i){d.pattern}')) AS n FROM l" for d in LIVE) + """) WHERE n > 0 GROUP BY 1, 2""",
    "stream_folded_operations": batch.ORACLES["folded_operations"],
    # An operation leaves the state a minute after its last event, or a day if it has no end, when the watermark gets there.
    "stream_closed_operations": f"""WITH f AS ({batch.ORACLES["folded_operations"]}), l AS (SELECT event_id // 4 AS operation_id, max(epoch_us(ts)) // 1000 AS newest FROM events GROUP BY 1)
      SELECT f.* FROM f JOIN l USING (operation_id) WHERE newest + CASE WHEN active THEN 86400000 ELSE 60000 END <= (SELECT max(epoch_us(ts)) // 1000 FROM events) - 600000""",
    "stream_audit_trail": "SELECT user_id, event_type AS action, count(*) AS n_actions, epoch_us(min(ts)) AS first_at, epoch_us(max(ts)) AS last_at FROM events GROUP BY 1, 2",
}
ORACLES["stream_live_detections"] = """WITH l AS (SELECT ts, concat('GET /api/', event_type, '/', user_id, ' ', 200 + event_id % 4 * 100, ' from 10.0.', user_id % 256, '.', event_id % 256) AS line FROM events) """ + ORACLES["stream_live_detections"]
