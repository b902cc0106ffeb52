"""Readiness, compliance and risk rollups over detections.

Detections have `metric_type` and `confidence` and name their project, dataset and table.
`by` splits every rollup, for example per scan job; without it there is one result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import rules
from sightline.functions.columns import band, lookup, percent, qualified, stacked
from sightline.operators.ops import error_category

READINESS_HIGH = 0.7  # reached counts
SUMMARY_HIGH = 0.7  # has to be exceeded
REPORT_HIGH = 0.8  # has to be exceeded


def area_of(metric: Column | str = "metric_type") -> Column:
    return lookup(metric, rules.METRIC_TO_AREA, rules.DEFAULT_AREA)


def confident(df: DataFrame, threshold: float, inclusive: bool = False) -> DataFrame:
    value = F.col("confidence")
    return df.filter(value >= threshold if inclusive else value > threshold)


def mappings(results: DataFrame, method: str = "value_content_analysis") -> DataFrame:
    """Findings in mapping form: qualified names, a constant tag, most confident first."""
    table = ("project_id", "dataset_id", "table_id")
    return results.select(
        qualified(*table, "column_name").alias("source"), qualified(*table).alias("full_table_name"), area_of().alias("metric"),
        "confidence", F.col("metric_type").alias("pattern_type"), F.lit(method).alias("detection_method"),
    ).orderBy(F.desc("confidence"), "source", "pattern_type")


def value_summary(results: DataFrame, ready_at: int = 3) -> DataFrame:
    """Per area: findings, findings of high confidence, tables, and whether it is ready.

    Tables are counted as rows of a first grouping, and the five areas come from the final
    aggregate itself, so areas without findings show up as zeros.
    """
    per_table = results.groupBy(area_of().alias("area"), "project_id", "dataset_id", "table_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") > SUMMARY_HIGH).alias("h")
    )
    at = lambda area, value: F.coalesce(F.sum(F.when(F.col("area") == area, value)), F.lit(0))
    wide = per_table.agg(*[
        e for i, a in enumerate(rules.AREAS) for e in (at(a, F.col("n")).alias(f"n{i}"), at(a, F.col("h")).alias(f"h{i}"), at(a, F.lit(1)).alias(f"t{i}"))
    ])
    rows = [(a, F.col(f"n{i}"), F.col(f"h{i}"), F.col(f"t{i}"), F.col(f"h{i}") >= ready_at) for i, a in enumerate(rules.AREAS)]
    return wide.select(stacked(["area", "total_findings", "high_confidence", "unique_tables", "ready"], *rows))


def metric_distribution(results: DataFrame) -> DataFrame:
    return results.groupBy(F.coalesce("metric_type", F.lit("unknown")).alias("metric_type")).agg(F.count(F.lit(1)).alias("n"))


def readiness(results: DataFrame, by: Sequence[str] = (), in_order: bool = False) -> DataFrame:
    """Five rows per group: confident sources of each metric, status and score. With `in_order` in the order of
    `risk_list`: the groups are sorted while they are one row each, and their areas follow in order."""
    high = F.col("confidence") >= READINESS_HIGH
    wide = results.groupBy(*by).agg(*[F.count_if(high & (F.col("metric_type") == m)).alias(f"_{m}") for m in rules.METRICS])
    metrics = list(rules.METRICS)
    if in_order:
        metrics.sort(key=lambda m: (rules.METRIC_TO_AREA[m] not in rules.HIGH_RISK_AREAS, rules.METRIC_TO_AREA[m]))
        wide = wide.orderBy(*by) if by else wide
    rows = [(m, rules.METRIC_TO_AREA[m], F.col(f"_{m}")) for m in metrics]
    n = F.col("n_sources")
    return wide.select(*by, stacked(["metric", "area", "n_sources"], *rows)).withColumns({
        "status": F.when(n >= 5, "READY").when(n >= 2, "PARTIAL").otherwise("NOT_READY"),
        "coverage_score": F.least(n / 10, F.lit(1.0)) * 100,
    })


def overall(ready: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ready areas of five, percentage, status and advice."""
    areas = ready.groupBy(*by).agg(F.count_if(F.col("status") == "READY").alias("ready_areas"))
    pick = lambda a, b, c: band("ready_areas", [(4, a), (2, b)], c)
    return areas.select(
        *by, "ready_areas", percent("ready_areas", F.lit(5)).alias("percentage"), F.concat(F.col("ready_areas").cast("string"), F.lit("/5")).alias("areas_ready"),
        pick("READY", "PARTIAL", "NOT_READY").alias("status"),
        pick("ready: coverage is sufficient", "partly ready: collect more in the weak areas", "not ready: coverage is insufficient").alias("recommendation"),
    )


def overall_from_summary(summary: DataFrame) -> DataFrame:
    """The same rollup over the value summary."""
    return overall(summary.withColumn("status", F.when(F.col("ready"), "READY")))


def enterprise_summary(results: DataFrame, attempts: DataFrame) -> DataFrame:
    """Projects and tables with findings, and how reliable the scan was."""
    tables = results.groupBy("project_id", "dataset_id", "table_id").agg(F.count(F.lit(1)).alias("_n"))
    projects = tables.groupBy("project_id").agg(F.count(F.lit(1)).alias("_t")).agg(F.count("project_id").alias("data_rich_projects"), F.sum("_t").alias("total_unique_sources"))
    category = error_category(words=rules.SCAN_RETRY_WORDS, default="other")
    failed = ~F.col("success")
    n, errors = F.count(F.lit(1)), F.count_if(failed & (category == "other"))
    scan = attempts.agg(
        n.alias("tables_processed"), (F.try_divide((n - errors) * 100.0, F.greatest(n, F.lit(1)))).alias("success_rate"),
        *[F.count_if(failed & (category == c)).alias(f"{c}_failures") for c in rules.SCAN_RETRY_WORDS],
        F.try_divide(n, F.sum("duration_s")).alias("tables_per_second"),
    )
    rates = [F.col(c) for c in scan.columns]
    return projects.withColumn("_one", F.lit(1)).join(scan.withColumn("_one", F.lit(1)), "_one").select("data_rich_projects", "total_unique_sources", *rates)


def failed_resources(attempts: DataFrame, k: int = 10) -> DataFrame:
    return attempts.filter(~F.col("success")).select(
        "operation_id", "resource_id", error_category(words=rules.SCAN_ERROR_WORDS, default="unknown").alias("error_category"), F.substring("error_message", 1, 100).alias("error_message")
    ).orderBy("operation_id").limit(k)


# ----------------------------------------------------------------------------- reports
def report_score(total: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Score between 0 and 1 with its status, advice, timeline, risk and confidence level."""
    status = band("score", rules.STATUS_BANDS, "NOT_READY")
    timeline = F.try_element_at(F.create_map(*[x for k, v in rules.TIMELINES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("readiness_status"))
    return (
        total.select(*by, (F.col("percentage") / 100).alias("score"))
        .withColumn("readiness_status", status)
        .withColumns({
            "investment_recommendation": lookup("readiness_status", rules.ADVICE, None),
            "phase1": timeline[0], "full_implementation": timeline[1], "total_time": timeline[2],
            "overall_risk_level": band("score", [(0.7, "LOW"), (0.4, "MEDIUM")], "HIGH", inclusive=False),
            "confidence_level": band("score", [(0.7, "high"), (0.4, "medium")], "low", inclusive=False),
        })
    )


def impact_estimates(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Clamped linear estimates, as percentages."""
    score = F.col("score")
    shown = lambda e: F.concat(F.round(e).cast("int").cast("string"), F.lit("%"))
    return scored.select(
        *by, shown(F.least(score * 100, F.lit(95.0))).alias("threat_detection_improvement"), shown(F.least(score * 80, F.lit(90.0))).alias("incident_response_time_reduction"),
        shown(F.least(score * 90, F.lit(92.0))).alias("compliance_readiness"), shown(score * 70).alias("estimated_risk_reduction"),
        F.when(score > 0.6, "6-12 months").otherwise("12-18 months").alias("roi_timeframe"),
    )


def _source_totals(results: DataFrame) -> DataFrame:
    per_project = results.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") > REPORT_HIGH).alias("h"), F.sum("confidence").alias("c"))
    return per_project.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_data_sources"), F.coalesce(F.sum("h"), F.lit(0)).alias("high_confidence_sources"), F.count("project_id").alias("projects_analyzed"),
        F.count_if(F.col("h") > 0).alias("high_projects"), F.try_divide(F.sum("c"), F.sum("n")).alias("mean_confidence"),
    )


def key_findings(results: DataFrame, ready: DataFrame, most: int = 5) -> DataFrame:
    """At most `most` findings: confident sources, weak areas, breadth."""
    weak = ready.filter(F.col("status") == "NOT_READY").agg(F.sort_array(F.collect_list("area"))).scalar()
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    wide = _source_totals(results).withColumn("_weak", weak)
    n_weak = F.size("_weak")
    rows = F.array_compact(F.array(
        F.struct(text("Found ", F.col("high_confidence_sources"), " high-confidence sources").alias("finding"), F.lit("positive").alias("impact"), text("Across ", F.col("high_projects"), " projects").alias("detail")),
        F.when(n_weak > 0, F.struct(text("Gaps in ", n_weak, " areas").alias("finding"), F.lit("negative").alias("impact"), F.concat(F.lit("Weak: "), F.array_join("_weak", ", ")).alias("detail"))),
        F.when(F.col("projects_analyzed") > 10, F.struct(text("Data from ", F.col("projects_analyzed"), " projects").alias("finding"), F.lit("positive").alias("impact"), F.lit("Visibility across the enterprise").alias("detail"))),
    ))
    return wide.select(F.inline(F.slice(rows, 1, most)))


def compliance_frameworks(ready: DataFrame, by: Sequence[str] = (), frameworks: Mapping[str, Sequence[str]] = rules.FRAMEWORKS, to_area: Mapping[str, str] = rules.REQUIREMENT_TO_AREA) -> DataFrame:
    """Per framework: requirements met by a ready or partly ready area, score, status, gaps."""
    areas = sorted({to_area[r] for rs in frameworks.values() for r in rs if r in to_area})
    usable = F.col("status").isin("READY", "PARTIAL")
    wide = ready.groupBy(*by).agg(*[F.coalesce(F.max(F.when(F.col("area") == a, usable)), F.lit(False)).alias(f"_{a}") for a in areas])
    met = lambda r: F.col(f"_{to_area[r]}") if r in to_area else F.lit(False)
    rows = [
        (f, sum((met(r).cast("int") for r in rs), F.lit(0)).cast("bigint"), F.lit(len(rs)).cast("bigint"), F.array_compact(F.array(*[F.when(~met(r), F.lit(r)) for r in rs])))
        for f, rs in frameworks.items()
    ]
    n_met = F.col("met_requirements")
    listed = wide.select(*by, stacked(["framework", "met_requirements", "total_requirements", "gaps"], *rows))
    return listed.select(
        *by, "framework", percent(n_met, "total_requirements").alias("score"),
        F.when(n_met == F.col("total_requirements"), "COMPLIANT").when(n_met > 0, "PARTIAL").otherwise("NON_COMPLIANT").alias("status"),
        "met_requirements", "total_requirements", "gaps",
    )


def risk_list(ready: DataFrame, by: Sequence[str] = (), in_order: bool = False) -> DataFrame:
    """Areas that are not ready, high risks first, with the action for each. Rows that `readiness` gave
    `in_order` are not sorted again."""
    high = F.col("area").isin(rules.HIGH_RISK_AREAS)
    short = F.replace(F.replace(F.col("area"), F.lit("_coverage")), F.lit("_"), F.lit(" "))
    risks = ready.filter(F.col("status") == "NOT_READY").select(
        *by, "area", F.when(high, "HIGH").otherwise("MEDIUM").alias("risk_level"),
        F.concat(F.lit("Limited visibility in "), F.replace(F.col("area"), F.lit("_"), F.lit(" "))).alias("description"),
        F.concat(F.lit("Enhance "), short, F.lit(" data collection and monitoring")).alias("action"),
    )
    return risks if in_order else risks.orderBy(*by, "risk_level", "area")


def coverage_dependencies(ready: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Capability each weak area needs, where one is known."""
    needed = lookup("area", rules.AREA_DEPENDENCIES, None)
    return ready.filter(F.col("status") == "NOT_READY").select(*by, "area", needed.alias("dependency")).filter(F.col("dependency").isNotNull())


def technical_summary(results: DataFrame) -> DataFrame:
    grade = F.when(F.col("total_data_sources") == 0, "insufficient_data").otherwise(band("mean_confidence", [(0.8, "excellent"), (0.6, "good"), (0.4, "fair")], "poor", inclusive=False))
    return _source_totals(results).select("total_data_sources", "high_confidence_sources", "projects_analyzed", grade.alias("data_quality_assessment"))


def budget_estimate(results: DataFrame) -> DataFrame:
    projects = results.groupBy("project_id").agg(F.count(F.lit(1)).alias("_n")).agg(F.count("project_id").alias("n"))
    base = F.least(F.col("n") * 5000, F.lit(200000))
    money = lambda e: F.concat(F.lit("$"), F.format_number(e.cast("double"), 0))
    return projects.select(money(base).alias("initial_setup"), money(base * 0.3).alias("annual_operational"), money(base * 1.3).alias("total_first_year"))


def report(results: DataFrame) -> DataFrame:
    """The whole report as one row of nested values; every part is a small aggregate."""
    ready = readiness(results)
    scored = report_score(overall(ready))

    def nested(df: DataFrame) -> Column:
        return df.agg(F.sort_array(F.collect_list(F.struct(*df.columns)))).scalar()

    return scored.select(
        F.struct(*scored.columns).alias("summary"), nested(key_findings(results, ready)).alias("key_findings"), nested(impact_estimates(scored)).alias("business_impact"),
        nested(compliance_frameworks(ready)).alias("compliance"), nested(risk_list(ready)).alias("risks"), nested(coverage_dependencies(ready)).alias("dependencies"),
        nested(technical_summary(results)).alias("technical"), nested(metric_distribution(results)).alias("distribution"), nested(budget_estimate(results)).alias("budget"),
    )


def report_json(results: DataFrame) -> DataFrame:
    built = report(results)
    return built.select(F.to_json(F.struct(*built.columns)).alias("report"))
