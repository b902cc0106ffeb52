"""Registered queries from a list of tables to readiness, and their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions.rules import COMPLIANCE_DETECTORS, DETECTORS, INDUSTRY_DETECTORS, VARIANT_DETECTORS
from sightline.operators import detect as det
from sightline.operators import longform as lf
from sightline.operators import profile as prof
from sightline.operators import readiness as rd
from sightline.operators import scan as sc
from sightline.plans import reports
from sightline.plans.oracle_views import TELEMETRY, with_views
from sightline.plans.registry import rounded
from sightline.plans.scanning import FLAT_SQL, MESSAGE_SQL, _counts_sql, _matches_sql, flat, on_telemetry
from sightline.sources import views
from sightline.sources.tables import loader

#: Project, dataset, table, columns of a scan; `telemetry` is a view.
LAKE = [
    ("content", "text", "documents", ["text"]),
    ("content", "text", "conversations", ["role", "text"]),
    ("web", "crawl", "pages", ["url"]),
    ("sales", "core", "customer", ["c_name", "c_mktsegment"]),
    ("security", "logs", "telemetry", ["message", "payload", "contact", "address", "token"]),
    ("security", "logs", "gone", ["text"]),
]


def _sources(spark, base):
    load = loader(spark, base)
    return [
        sc.Source(p, d, t, None, lambda: views.telemetry(load), c) if t == "telemetry" else sc.Source(p, d, t, f"{base}/{t}.parquet", None, c)
        for p, d, t, c in LAKE
    ]


def _scanned(fn):
    return lambda spark, base: rounded(fn(sc.scan(spark, _sources(spark, base))))


def _telemetry(spark, base):
    return views.telemetry(loader(spark, base))


def _long(spark, base, columns):
    return lf.to_long(_telemetry(spark, base), "telemetry", "event_id", columns)


def _matches(detectors):
    return lambda spark, base: det.match_counts(lf.raw_fragments(_long(spark, base, ["message"])), detectors).filter(F.col("detector") != "")


def _profile(spark, base):
    long = lf.to_long(_telemetry(spark, base), "telemetry", "event_id", PROFILED, keep_nulls=True)
    profile = prof.profile_columns(prof.column_stats(prof.value_groups(long)))
    return rounded(profile.withColumn("formats", F.array_join("formats", "|")))


PROFILED = ["message", "contact", "address", "token", "seen_at", "link", "phone"]

QUERIES = {
    "scan_results": _scanned(lambda s: sc.results(s).drop("evidence")),
    "scan_to_readiness": _scanned(sc.readiness_by_project),
    "scan_mappings": _scanned(lambda s: rd.mappings(sc.results(s))),
    "scan_attempts": _scanned(lambda s: sc.attempts(s).select(*sc.TABLE, "rows_read", "success")),
    "scan_failures": _scanned(lambda s: sc.failures(s).select(*sc.TABLE, "file", "error_category", "rows_lost")),
    "scan_report": lambda spark, base: sc.report(sc.scan(spark, _sources(spark, base))).selectExpr("to_json(struct(*)) AS report"),
    "telemetry_detections": lambda spark, base: flat(det.score(det.match_counts(lf.raw_fragments(_long(spark, base, ["message"]))))),
    "telemetry_industry": _matches(INDUSTRY_DETECTORS),
    "telemetry_compliance": _matches(COMPLIANCE_DETECTORS),
    "telemetry_variants": _matches(VARIANT_DETECTORS),
    "telemetry_fragments": lambda spark, base: lf.expand_fragments(_long(spark, base, ["payload"])).select("row_id", "origin", "fragment"),
    "telemetry_profile": _profile,
}


# ------------------------------------------------------------------------------ SQL
_PRESENT = [x for x in LAKE if x[2] != "gone"]
LONG_SQL = " UNION ALL ".join(
    f"SELECT '{p}|{d}|{t}' AS tbl, '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM {t} WHERE {c} IS NOT NULL" for p, d, t, cols in _PRESENT for c in cols
)
FOUND_SQL = on_telemetry(_matches_sql(DETECTORS, LONG_SQL)) + """,
  d AS (SELECT tbl, col, area, detector, count(DISTINCT m) AS n_distinct FROM h GROUP BY tbl, col, area, detector),
  f AS (SELECT tbl, col, count(*) AS n_fragments FROM l GROUP BY tbl, col),
  scan_results AS (SELECT split_part(tbl, '|', 1) AS project_id, split_part(tbl, '|', 2) AS dataset_id, split_part(tbl, '|', 3) AS table_id, col AS column_name, area AS metric_type, detector,
    n_fragments, n_distinct, least(n_distinct / greatest(0.01 * n_fragments, 1.0), 1.0) AS confidence FROM d JOIN f USING (tbl, col)
    WHERE least(n_distinct / greatest(0.01 * n_fragments, 1.0), 1.0) > 0.3)"""
COUNTS = ", ".join(f"('{p}', '{d}', '{t}', (SELECT count(*) FROM {'events' if t == 'telemetry' else t}))" for p, d, t, _ in _PRESENT)

_FORMAT_OF = {"contact": "email", "address": "ip_address", "token": "uuid", "seen_at": "timestamp", "link": "url", "phone": "phone"}
_PROFILE_ONE = """SELECT 'telemetry' AS "table", '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, round(count({c}) / count(*), 6) AS completeness,
  round(count(DISTINCT {c}) / count(*), 6) AS unique_ratio, CASE WHEN count(DISTINCT {c}) / count(*) > 0.95 THEN 'highly_unique' WHEN count(DISTINCT {c}) / count(*) > 0.5 THEN 'moderately_unique' ELSE 'repetitive' END AS distribution,
  CASE WHEN stddev_samp(length({c})) < 0.1 * avg(length({c})) THEN 'consistent' ELSE 'variable' END AS consistency, '{f}' AS formats FROM telemetry"""

ORACLES = {
    "scan_results": FOUND_SQL + " SELECT * REPLACE (round(confidence, 6) AS confidence) FROM scan_results",
    "scan_to_readiness": FOUND_SQL + f""", {reports._ready(['project_id'])}, {reports._overall(['project_id'])}
      SELECT rd.*, ov.ready_areas, round(ov.percentage, 6) AS percentage, ov.status AS overall_status FROM rd JOIN ov ON ov.project_id = rd.project_id""",
    "scan_mappings": FOUND_SQL + f""" SELECT concat_ws('.', project_id, dataset_id, table_id, column_name) AS source, concat_ws('.', project_id, dataset_id, table_id) AS full_table_name, {reports.AREA} AS metric,
      round(confidence, 6) AS confidence, metric_type AS pattern_type, 'value_content_analysis' AS detection_method FROM scan_results""",
    "scan_attempts": f"SELECT * FROM (SELECT *, true AS success FROM (VALUES {COUNTS}) t(project_id, dataset_id, table_id, rows_read)) UNION ALL SELECT 'security', 'logs', 'gone', 0, false",
    "scan_failures": "SELECT 'security' AS project_id, 'logs' AS dataset_id, 'gone' AS table_id, CAST(NULL AS VARCHAR) AS file, 'not_found' AS error_category, CAST(NULL AS BIGINT) AS rows_lost",
    "telemetry_detections": on_telemetry(_matches_sql(DETECTORS, MESSAGE_SQL)) + """,
      d AS (SELECT tbl, col, area, detector, count(DISTINCT m) AS n_distinct, list_sort(list(DISTINCT m))[1:5] AS ev FROM h GROUP BY tbl, col, area, detector),
      f AS (SELECT tbl, col, count(*) AS n_fragments FROM l GROUP BY tbl, col),
      k AS (SELECT d.*, n_fragments, least(n_distinct / greatest(0.01 * n_fragments, 1.0), 1.0) AS confidence FROM d JOIN f USING (tbl, col))""" + FLAT_SQL,
    "telemetry_industry": on_telemetry(_counts_sql(INDUSTRY_DETECTORS, MESSAGE_SQL)),
    "telemetry_compliance": on_telemetry(_counts_sql(COMPLIANCE_DETECTORS, MESSAGE_SQL)),
    "telemetry_variants": on_telemetry(_counts_sql(VARIANT_DETECTORS, MESSAGE_SQL)),
    # What the payloads are made of, without parsing them.
    "telemetry_fragments": with_views(TELEMETRY, body="""SELECT CAST(event_id AS VARCHAR) AS row_id, 'raw' AS origin, payload AS fragment FROM telemetry
      UNION ALL SELECT CAST(event_id AS VARCHAR), 'json', unnest(['user', 'id', CAST(user_id AS VARCHAR), 'mail', concat('u', user_id, '@example.com'), 'tags', 'red', 'blue']) FROM events WHERE event_id % 4 = 0
      UNION ALL SELECT CAST(event_id AS VARCHAR), 'xml', unnest(['event', concat('SRV-X-', event_id), 'host', '4625', 'code']) FROM events WHERE event_id % 4 = 1
      UNION ALL SELECT CAST(event_id AS VARCHAR), 'base64', concat('host ws', event_id, '.corp.example.com') FROM events WHERE event_id % 4 = 2"""),
    "telemetry_profile": f"WITH {TELEMETRY} " + " UNION ALL ".join(_PROFILE_ONE.format(c=c, f=_FORMAT_OF.get(c, "")) for c in PROFILED),
}
