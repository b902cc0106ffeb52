"""Registered readiness, compliance and risk queries and their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import rules
from sightline.functions.columns import redact
from sightline.operators import readiness as rd
from sightline.operators.ops import operation_metrics
from sightline.plans.oracle_views import OPERATIONS, SCAN_RESULTS, with_views
from sightline.plans.registry import rounded
from sightline.sources import views
from sightline.sources.tables import loader

JOB = ["job_id"]


def _results(spark, base):
    return views.scan_results(loader(spark, base))


def _on_results(fn):
    return lambda spark, base: rounded(fn(_results(spark, base)))


def _per_job(fn):
    return _on_results(lambda r: fn(rd.readiness(r, JOB)))


def _attempts(spark, base):
    return operation_metrics(views.operations(loader(spark, base)))


def _frameworks(ready, by=()):
    return rd.compliance_frameworks(ready, by).withColumn("gaps", F.array_join("gaps", "|"))


def _redacted(results):
    evidence = F.array("table_id", "column_name", "metric_type", "project_id")
    return results.select("job_id", F.array_join(redact(evidence), "|").alias("evidence"))


QUERIES = {
    "confident_reached": _on_results(lambda r: rd.confident(r, 0.7, inclusive=True).groupBy("metric_type").agg(F.count(F.lit(1)).alias("n"))),
    "confident_exceeded": _on_results(lambda r: rd.confident(r, 0.7).groupBy("metric_type").agg(F.count(F.lit(1)).alias("n"))),
    "confident_kept": _on_results(lambda r: rd.confident(r, 0.3).groupBy("metric_type").agg(F.count(F.lit(1)).alias("n"))),
    "finding_mappings": _on_results(rd.mappings),
    "finding_areas": _on_results(lambda r: r.groupBy(rd.area_of().alias("area")).agg(F.count(F.lit(1)).alias("n"))),
    "evidence_redaction": _on_results(_redacted),
    "value_summary": _on_results(rd.value_summary),
    "value_summary_overall": _on_results(lambda r: rd.overall_from_summary(rd.value_summary(r))),
    "metric_distribution": _on_results(rd.metric_distribution),
    "readiness_by_metric": _on_results(rd.readiness),
    "readiness_per_job": _on_results(lambda r: rd.readiness(r, JOB)),
    "overall_readiness": _on_results(lambda r: rd.overall(rd.readiness(r))),
    "overall_readiness_per_project": _on_results(lambda r: rd.overall(rd.readiness(r, ["project_id", "table_id"]), ["project_id", "table_id"])),
    "enterprise_summary": lambda spark, base: rounded(rd.enterprise_summary(_results(spark, base), _attempts(spark, base))),
    "failed_resources": lambda spark, base: rd.failed_resources(_attempts(spark, base)),
    "report_score": _on_results(lambda r: rd.report_score(rd.overall(rd.readiness(r)))),
    "report_score_per_table": _on_results(lambda r: rd.report_score(rd.overall(rd.readiness(r, ["project_id", "table_id"]), ["project_id", "table_id"]), ["project_id", "table_id"])),
    "impact_estimates": _on_results(lambda r: rd.impact_estimates(rd.report_score(rd.overall(rd.readiness(r, ["table_id"]), ["table_id"]), ["table_id"]), ["table_id"])),
    "key_findings": _on_results(lambda r: rd.key_findings(r, rd.readiness(r))),
    "compliance_frameworks": _on_results(lambda r: _frameworks(rd.readiness(r))),
    "compliance_frameworks_per_job": _per_job(lambda ready: _frameworks(ready, JOB)),
    "risk_list_per_job": _on_results(lambda r: rd.risk_list(rd.readiness(r, JOB, in_order=True), JOB, in_order=True)),
    "coverage_dependencies_per_job": _per_job(lambda ready: rd.coverage_dependencies(ready, JOB)),
    "technical_summary": _on_results(rd.technical_summary),
    "budget_estimate": _on_results(rd.budget_estimate),
    "report": _on_results(rd.report_json),
}


# ------------------------------------------------------------------------------ SQL
def _sql(body, *ctes):
    return with_views(SCAN_RESULTS, *ctes, body=body)


def _case(key, mapping, default):
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {default} END"


def _category(words, default):
    any_word = lambda ws: " OR ".join(f"contains(lower(error_message), '{w}')" for w in ws)
    return "CASE " + " ".join(f"WHEN {any_word(ws)} THEN '{c}'" for c, ws in words.items()) + f" ELSE '{default}' END"


AREA = _case("metric_type", rules.METRIC_TO_AREA, f"'{rules.DEFAULT_AREA}'")
METRIC_ROWS = ", ".join(f"('{m}', '{a}')" for m, a in rules.METRIC_TO_AREA.items())


def _ready(by=()):
    keys = "".join(f"g.{k}, " for k in by)
    groups = f"(SELECT DISTINCT {', '.join(by)} FROM scan_results)" if by else "(SELECT 1 AS one)"
    match = " AND ".join([*(f"r.{k} = g.{k}" for k in by), "r.metric_type = m.metric", "r.confidence >= 0.7"])
    return f"""rd AS (SELECT *, CASE WHEN n_sources >= 5 THEN 'READY' WHEN n_sources >= 2 THEN 'PARTIAL' ELSE 'NOT_READY' END AS status, round(least(n_sources / 10, 1.0) * 100, 6) AS coverage_score FROM (
      SELECT {keys}m.metric, m.area, count(r.metric_type) AS n_sources FROM {groups} g CROSS JOIN (VALUES {METRIC_ROWS}) m(metric, area) LEFT JOIN scan_results r ON {match} GROUP BY {keys}m.metric, m.area))"""


def _overall(by=(), source="rd", flag="status = 'READY'"):
    keys = "".join(f"{k}, " for k in by)
    group = f" GROUP BY {', '.join(by)}" if by else ""
    return f"""ov AS (SELECT *, 100.0 * ready_areas / 5 AS percentage, concat(ready_areas, '/5') AS areas_ready, CASE WHEN ready_areas >= 4 THEN 'READY' WHEN ready_areas >= 2 THEN 'PARTIAL' ELSE 'NOT_READY' END AS status,
      CASE WHEN ready_areas >= 4 THEN 'ready: coverage is sufficient' WHEN ready_areas >= 2 THEN 'partly ready: collect more in the weak areas' ELSE 'not ready: coverage is insufficient' END AS recommendation
      FROM (SELECT {keys}CAST(sum(CASE WHEN {flag} THEN 1 ELSE 0 END) AS BIGINT) AS ready_areas FROM {source}{group}))"""


def _score(by=()):
    keys = "".join(f"{k}, " for k in by)
    lines = {s: i for i, s in enumerate(rules.TIMELINES)}
    pick = lambda j: _case("readiness_status", {s: rules.TIMELINES[s][j] for s in lines}, "NULL")
    return f"""sc AS (SELECT *, {_case('readiness_status', rules.ADVICE, 'NULL')} AS investment_recommendation, {pick(0)} AS phase1, {pick(1)} AS full_implementation, {pick(2)} AS total_time,
      CASE WHEN score > 0.7 THEN 'LOW' WHEN score > 0.4 THEN 'MEDIUM' ELSE 'HIGH' END AS overall_risk_level, CASE WHEN score > 0.7 THEN 'high' WHEN score > 0.4 THEN 'medium' ELSE 'low' END AS confidence_level
      FROM (SELECT {keys}percentage / 100 AS score, CASE WHEN percentage / 100 >= 0.8 THEN 'READY' WHEN percentage / 100 >= 0.6 THEN 'NEARLY_READY' WHEN percentage / 100 >= 0.4 THEN 'PARTIAL' ELSE 'NOT_READY' END AS readiness_status FROM ov))"""


VALUE_SUMMARY = f"""vs AS (SELECT m.area, count(r.area) AS total_findings, CAST(coalesce(sum(CASE WHEN r.confidence > 0.7 THEN 1 ELSE 0 END), 0) AS BIGINT) AS high_confidence,
  count(DISTINCT concat(project_id, '.', dataset_id, '.', table_id)) AS unique_tables, coalesce(sum(CASE WHEN r.confidence > 0.7 THEN 1 ELSE 0 END), 0) >= 3 AS ready
  FROM (VALUES {METRIC_ROWS}) m(metric, area) LEFT JOIN (SELECT *, {AREA} AS area FROM scan_results) r ON r.area = m.area GROUP BY m.area)"""
FRAMEWORK_ROWS = ", ".join(f"('{f}', '{r}', {i}, '{rules.REQUIREMENT_TO_AREA[r]}')" for f, rs in rules.FRAMEWORKS.items() for i, r in enumerate(rs))


def _framework_sql(by=()):
    keys = "".join(f"{k}, " for k in by)
    return _sql(f"""SELECT {keys}framework, round(100.0 * sum(met) / count(*), 6) AS score, CASE WHEN sum(met) = count(*) THEN 'COMPLIANT' WHEN sum(met) > 0 THEN 'PARTIAL' ELSE 'NON_COMPLIANT' END AS status,
      CAST(sum(met) AS BIGINT) AS met_requirements, count(*) AS total_requirements, coalesce(string_agg(CASE WHEN met = 0 THEN requirement END, '|' ORDER BY position), '') AS gaps FROM (
      SELECT {keys}framework, requirement, position, CASE WHEN status IN ('READY', 'PARTIAL') THEN 1 ELSE 0 END AS met FROM rd JOIN (VALUES {FRAMEWORK_ROWS}) f(framework, requirement, position, a) ON f.a = rd.area) GROUP BY {keys}framework""", _ready(by))


SOURCE_TOTALS = """tt AS (SELECT count(*) AS total_data_sources, CAST(sum(CASE WHEN confidence > 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS high_confidence_sources, count(DISTINCT project_id) AS projects_analyzed,
  count(DISTINCT CASE WHEN confidence > 0.8 THEN project_id END) AS high_projects, avg(confidence) AS mean_confidence FROM scan_results)"""
PT = ("project_id", "table_id")
SCORE_COLUMNS = "round(score, 6) AS score, readiness_status, investment_recommendation, phase1, full_implementation, total_time, overall_risk_level, confidence_level"

ORACLES = {
    "confident_reached": _sql("SELECT metric_type, count(*) AS n FROM scan_results WHERE confidence >= 0.7 GROUP BY 1"),
    "confident_exceeded": _sql("SELECT metric_type, count(*) AS n FROM scan_results WHERE confidence > 0.7 GROUP BY 1"),
    "confident_kept": _sql("SELECT metric_type, count(*) AS n FROM scan_results WHERE confidence > 0.3 GROUP BY 1"),
    "finding_mappings": _sql(f"""SELECT concat_ws('.', project_id, dataset_id, table_id, column_name) AS source, concat_ws('.', project_id, dataset_id, table_id) AS full_table_name, {AREA} AS metric,
      round(confidence, 6) AS confidence, metric_type AS pattern_type, 'value_content_analysis' AS detection_method FROM scan_results"""),
    "finding_areas": _sql(f"SELECT {AREA} AS area, count(*) AS n FROM scan_results GROUP BY 1"),
    "evidence_redaction": _sql("SELECT job_id, concat_ws('|', concat('<redacted:', length(table_id), '>'), concat('<redacted:', length(column_name), '>'), concat('<redacted:', length(metric_type), '>')) AS evidence FROM scan_results"),
    "value_summary": _sql("SELECT * FROM vs", VALUE_SUMMARY),
    "value_summary_overall": _sql("SELECT ready_areas, round(percentage, 6) AS percentage, areas_ready, status, recommendation FROM ov", VALUE_SUMMARY, _overall(source="vs", flag="ready")),
    "metric_distribution": _sql("SELECT coalesce(metric_type, 'unknown') AS metric_type, count(*) AS n FROM scan_results GROUP BY 1"),
    "readiness_by_metric": _sql("SELECT * FROM rd", _ready()),
    "readiness_per_job": _sql("SELECT * FROM rd", _ready(JOB)),
    "overall_readiness": _sql("SELECT ready_areas, round(percentage, 6) AS percentage, areas_ready, status, recommendation FROM ov", _ready(), _overall()),
    "overall_readiness_per_project": _sql("SELECT project_id, table_id, ready_areas, round(percentage, 6) AS percentage, areas_ready, status, recommendation FROM ov", _ready(PT), _overall(PT)),
    "enterprise_summary": with_views(SCAN_RESULTS, OPERATIONS, body=f"""SELECT (SELECT count(DISTINCT project_id) FROM scan_results) AS data_rich_projects,
      (SELECT count(DISTINCT concat(project_id, '.', dataset_id, '.', table_id)) FROM scan_results) AS total_unique_sources, count(*) AS tables_processed,
      round(100.0 * (count(*) - sum(CASE WHEN NOT success AND k = 'other' THEN 1 ELSE 0 END)) / count(*), 6) AS success_rate,
      """ + ", ".join(f"CAST(sum(CASE WHEN NOT success AND k = '{c}' THEN 1 ELSE 0 END) AS BIGINT) AS {c}_failures" for c in rules.SCAN_RETRY_WORDS) + f""",
      round(count(*) / sum(duration_s), 6) AS tables_per_second FROM (SELECT *, {_category(rules.SCAN_RETRY_WORDS, 'other')} AS k FROM operations)"""),
    "failed_resources": with_views(OPERATIONS, body=f"SELECT operation_id, resource_id, {_category(rules.SCAN_ERROR_WORDS, 'unknown')} AS error_category, substr(error_message, 1, 100) AS error_message FROM operations WHERE NOT success ORDER BY operation_id LIMIT 10"),
    "report_score": _sql(f"SELECT {SCORE_COLUMNS} FROM sc", _ready(), _overall(), _score()),
    "report_score_per_table": _sql(f"SELECT project_id, table_id, {SCORE_COLUMNS} FROM sc", _ready(PT), _overall(PT), _score(PT)),
    "impact_estimates": _sql("""SELECT table_id, concat(CAST(round(least(score * 100, 95.0)) AS INT), '%') AS threat_detection_improvement, concat(CAST(round(least(score * 80, 90.0)) AS INT), '%') AS incident_response_time_reduction,
      concat(CAST(round(least(score * 90, 92.0)) AS INT), '%') AS compliance_readiness, concat(CAST(round(score * 70) AS INT), '%') AS estimated_risk_reduction,
      CASE WHEN score > 0.6 THEN '6-12 months' ELSE '12-18 months' END AS roi_timeframe FROM sc""", _ready(["table_id"]), _overall(["table_id"]), _score(["table_id"])),
    "key_findings": _sql("""SELECT concat('Found ', high_confidence_sources, ' high-confidence sources') AS finding, 'positive' AS impact, concat('Across ', high_projects, ' projects') AS detail FROM tt
      UNION ALL SELECT concat('Gaps in ', count(*), ' areas'), 'negative', concat('Weak: ', string_agg(area, ', ' ORDER BY area)) FROM rd WHERE status = 'NOT_READY' HAVING count(*) > 0
      UNION ALL SELECT concat('Data from ', projects_analyzed, ' projects'), 'positive', 'Visibility across the enterprise' FROM tt WHERE projects_analyzed > 10""", _ready(), SOURCE_TOTALS),
    "compliance_frameworks": _framework_sql(),
    "compliance_frameworks_per_job": _framework_sql(JOB),
    "risk_list_per_job": _sql("""SELECT job_id, area, CASE WHEN area IN ('network_coverage', 'identity_coverage') THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level, concat('Limited visibility in ', replace(area, '_', ' ')) AS description,
      concat('Enhance ', replace(replace(area, '_coverage', ''), '_', ' '), ' data collection and monitoring') AS action FROM rd WHERE status = 'NOT_READY'""", _ready(JOB)),
    "coverage_dependencies_per_job": _sql(f"SELECT job_id, area, {_case('area', rules.AREA_DEPENDENCIES, 'NULL')} AS dependency FROM rd WHERE status = 'NOT_READY' AND area IN (" + ", ".join(f"'{a}'" for a in rules.AREA_DEPENDENCIES) + ")", _ready(JOB)),
    "technical_summary": _sql("""SELECT total_data_sources, high_confidence_sources, projects_analyzed, CASE WHEN mean_confidence > 0.8 THEN 'excellent' WHEN mean_confidence > 0.6 THEN 'good' WHEN mean_confidence > 0.4 THEN 'fair' ELSE 'poor' END AS data_quality_assessment FROM tt""", SOURCE_TOTALS),
    "budget_estimate": _sql("""SELECT format('${:,}', CAST(b AS BIGINT)) AS initial_setup, format('${:,}', CAST(round(b * 0.3) AS BIGINT)) AS annual_operational, format('${:,}', CAST(round(b * 1.3) AS BIGINT)) AS total_first_year
      FROM (SELECT least(count(DISTINCT project_id) * 5000, 200000) AS b FROM scan_results)"""),
}
