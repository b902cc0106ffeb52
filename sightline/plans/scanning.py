"""Registered scanning queries and their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions.columns import redact
from sightline.functions.rules import COMPLIANCE_DETECTORS, DETECTORS, FAMILY_REGIMES, INDUSTRY_DETECTORS, VARIANT_DETECTORS, DEFAULT_REGIMES
from sightline.operators import detect as det
from sightline.operators import longform as lf
from sightline.operators import sampling
from sightline.plans.oracle_views import TELEMETRY
from sightline.plans.registry import rounded
from sightline.sources import views
from sightline.sources.tables import loader

# Table, key and text columns of a scan.
SCANNED = {
    "documents": ("doc_id", ["text"]),
    "pages": ("page_id", ["url", "html"]),
    "conversations": ("conv_id", ["text"]),
    "events": ("event_id", ["event_type", "props"]),
}
# These patterns have "_" in a class, so the check reads the text as it is.
PLAIN_TEXT = {"email", "domain_user", "api_endpoint", "url_path"}


def long_form(spark, base):
    load = loader(spark, base)
    parts = [lf.to_long(load(t).select(key, *cols), t, key, cols) for t, (key, cols) in SCANNED.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fragments(spark, base):
    return lf.raw_fragments(long_form(spark, base))


def flat(df):
    """Arrays as text, because engines print them differently."""
    return rounded(df.withColumn("evidence", F.array_join("evidence", "|")))


def _counts(detectors, per_fragment=None):
    return lambda spark, base: det.match_counts(fragments(spark, base), detectors, per_fragment).filter(F.col("detector") != "")


def log_lines(spark, base):
    """The messages of the log lines, which have identifiers of every area."""
    return lf.to_long(views.telemetry(loader(spark, base)), "telemetry", "event_id", ["message"])


def _area(area):
    return lambda spark, base: flat(det.score(det.match_counts(lf.raw_fragments(log_lines(spark, base)), [d for d in DETECTORS if d.area == area])))


def _area_everywhere(area):
    """One area in the scanned tables and in the log lines."""
    return lambda spark, base: flat(det.score(det.match_counts(lf.raw_fragments(long_form(spark, base).unionByName(log_lines(spark, base))), [d for d in DETECTORS if d.area == area])))


def _industry(spark, base):
    return det.detect(fragments(spark, base), INDUSTRY_DETECTORS, 0.0)


def _scores(spark, base):
    return det.industry_scores(_industry(spark, base))


def _variants(spark, base):
    load = loader(spark, base)
    long = lf.to_long(load("pages"), "pages", "page_id", ["url"])
    return det.match_counts(lf.raw_fragments(long), VARIANT_DETECTORS).filter(F.col("detector") != "")


def _boosted(spark, base):
    found = _industry(spark, base)
    family = det.best_family(det.industry_scores(found)).scalar()
    return flat(det.boost(found, family))


def _expanded(spark, base):
    frags = lf.expand_fragments(long_form(spark, base))
    return frags.groupBy("table", "column", "origin").agg(F.count(F.lit(1)).alias("n_fragments"))


def _props_fragments(spark, base):
    long = lf.to_long(loader(spark, base)("events"), "events", "event_id", ["props"])
    return lf.expand_fragments(long).select("row_id", "origin", "fragment")


# ------------------------------------------------------------------------------ SQL
LONG_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS tbl, '{c}' AS col, CAST({key} AS VARCHAR) AS row_id, {c} AS value FROM {t} WHERE {c} IS NOT NULL"
    for t, (key, cols) in SCANNED.items() for c in cols
)


MESSAGE_SQL = "SELECT 'telemetry' AS tbl, 'message' AS col, CAST(event_id AS VARCHAR) AS row_id, message AS value FROM telemetry WHERE message IS NOT NULL"


def on_telemetry(sql: str) -> str:
    return sql.replace("WITH l AS", f"WITH {TELEMETRY}, l AS", 1)


def _found_sql(d, limit=None):
    # RE2 has ASCII word boundaries: letters with accents are shown to it as "_".
    text = "value" if d.name in PLAIN_TEXT else "regexp_replace(value, '[À-ÖØ-öø-ÿ]', '_', 'g')"
    flags = "(?i)" if d.ignore_case else ""
    found = f"regexp_extract_all({text}, '{flags}{d.pattern}')"
    return f"{found}[1:{limit}]" if limit else found


def _matches_sql(detectors, long=LONG_SQL, limit=None):
    parts = " UNION ALL ".join(
        f"SELECT tbl, col, '{d.area}' AS area, '{d.name}' AS detector, unnest(list_distinct({_found_sql(d, limit)})) AS m FROM l" for d in detectors
    )
    return f"WITH l AS MATERIALIZED ({long}), h AS ({parts})"


def _counts_sql(detectors, long=LONG_SQL, limit=None):
    return _matches_sql(detectors, long, limit) + """ SELECT tbl AS "table", col AS "column", area, detector, m AS match, count(*) AS n FROM h GROUP BY tbl, col, area, detector, m"""


def _score_ctes(detectors, threshold, long=LONG_SQL):
    return _matches_sql(detectors, long) + f""",
      d AS (SELECT tbl, col, area, detector, count(DISTINCT m) AS n_distinct, list_sort(list(DISTINCT m))[1:5] AS ev FROM h GROUP BY tbl, col, area, detector),
      f AS (SELECT tbl, col, count(*) AS n_fragments FROM l GROUP BY tbl, col),
      s AS (SELECT d.*, n_fragments, least(n_distinct / greatest(0.01 * n_fragments, 1.0), 1.0) AS confidence FROM d JOIN f USING (tbl, col)),
      k AS (SELECT * FROM s WHERE confidence > {threshold})"""


FLAT_SQL = """ SELECT tbl AS "table", col AS "column", area, detector, n_fragments, n_distinct, round(confidence, 6) AS confidence, array_to_string(ev, '|') AS evidence FROM k"""


def _industry_ctes():
    tests = " UNION ALL ".join(
        f"""SELECT '{d.family}' AS family, {d.multiplier} AS multiplier, tbl, col, area, detector, '{d.area}' AS want FROM k
        WHERE len(list_filter(ev, lambda e: regexp_matches(e, '{d.pattern}'))) > 0""" for d in INDUSTRY_DETECTORS)
    rank = " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(FAMILY_REGIMES))
    return _score_ctes(INDUSTRY_DETECTORS, 0.0) + f""", t AS ({tests}),
      g AS (SELECT family, CAST(sum(multiplier) AS DOUBLE) AS score, count(*) AS pattern_matches FROM t GROUP BY family),
      best AS (SELECT family FROM g ORDER BY score DESC, CASE family {rank} END LIMIT 1)"""


def _values(rows):
    return ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows)


QUERIES = {
    "read_whole_table": lambda spark, base: rounded(loader(spark, base)("customer")),
    "sample_rows": lambda spark, base: rounded(sampling.sample_rows(loader(spark, base)("customer"), "c_custkey", 0.1, 500)),
    "sample_k": lambda spark, base: sampling.sample_k(loader(spark, base)("events").select("event_id", "event_type"), "event_id"),
    "distinct_sample": lambda spark, base: sampling.distinct_sample(loader(spark, base)("part"), "p_brand"),
    "long_form": lambda spark, base: long_form(spark, base).groupBy("table", "column").agg(F.count("value").alias("n_values"), F.sum(F.length("value")).alias("n_chars")),
    "long_form_sampled": lambda spark, base: lf.to_long(loader(spark, base)("events"), "events", "event_id", ["event_type"], per_column=1000),
    "fragment_counts": _expanded,
    "fragments_of_json_column": _props_fragments,
    "matches_all": _counts(DETECTORS),
    "matches_first_ten": _counts([d for d in DETECTORS if d.name in ("ipv4", "http_status", "ports", "email")], 10),
    "detections_network": _area("network_presence"),
    "detections_endpoint": _area("endpoint_identity"),
    "detections_identity": _area_everywhere("identity_context"),
    "detections_application": _area_everywhere("application_telemetry"),
    "detections_cloud": _area("cloud_infrastructure"),
    "matches_industry": _counts(INDUSTRY_DETECTORS),
    "matches_compliance": _counts(COMPLIANCE_DETECTORS),
    "matches_variants": _variants,
    "detections": lambda spark, base: flat(det.detect(fragments(spark, base))),
    "detections_expanded": lambda spark, base: flat(det.detect(lf.expand_fragments(long_form(spark, base)))),
    "detections_redacted": lambda spark, base: flat(det.detect(fragments(spark, base)).withColumn("evidence", redact("evidence"))),
    "industry_scores": lambda spark, base: rounded(_scores(spark, base)),
    "industry_context": lambda spark, base: det.best_family(_scores(spark, base)),
    "detections_boosted": _boosted,
    "compliance_relevance": lambda spark, base: det.compliance_relevance(_scores(spark, base)),
    "recommended_patterns": lambda spark, base: det.recommended_patterns(_scores(spark, base)),
}

# Props is the one JSON column; no value of the scanned columns is well-formed XML or base64.
JSON_SQL = """SELECT 'events' AS tbl, 'props' AS col, CAST(event_id AS VARCHAR) AS row_id, unnest(json_keys(props)) AS value FROM events
  UNION ALL SELECT 'events', 'props', CAST(event_id AS VARCHAR), json_extract_string(props, '$.' || k) FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)"""
EXPANDED_SQL = f"{LONG_SQL} UNION ALL {JSON_SQL}"

ORACLES = {
    "fragment_counts": f"""SELECT tbl AS "table", col AS "column", 'raw' AS origin, count(*) AS n_fragments FROM ({LONG_SQL}) GROUP BY tbl, col
      UNION ALL SELECT tbl, col, 'json', count(*) FROM ({JSON_SQL}) GROUP BY tbl, col""",
    "detections_expanded": _score_ctes(DETECTORS, 0.3, EXPANDED_SQL) + FLAT_SQL,
    "read_whole_table": "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer",
    "sample_rows": f"""SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer
      WHERE CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 12) AS BIGINT) < {int(0.1 * sampling.STEPS)} ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 500""",
    "sample_k": "SELECT event_id, event_type FROM events ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 50",
    "distinct_sample": "SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL ORDER BY p_brand LIMIT 100",
    "long_form": f"""SELECT tbl AS "table", col AS "column", count(*) AS n_values, CAST(sum(length(value)) AS BIGINT) AS n_chars FROM ({LONG_SQL}) GROUP BY tbl, col""",
    "long_form_sampled": """SELECT 'events' AS "table", 'event_type' AS "column", CAST(event_id AS VARCHAR) AS row_id, event_type AS value FROM events
      WHERE event_type IS NOT NULL ORDER BY md5(CAST(event_id AS VARCHAR)), CAST(event_id AS VARCHAR), event_type LIMIT 1000""",
    "fragments_of_json_column": """SELECT CAST(event_id AS VARCHAR) AS row_id, 'raw' AS origin, props AS fragment FROM events
      UNION ALL SELECT CAST(event_id AS VARCHAR), 'json', unnest(json_keys(props)) FROM events
      UNION ALL SELECT CAST(event_id AS VARCHAR), 'json', json_extract_string(props, '$.' || k) FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""",
    "matches_all": _counts_sql(DETECTORS),
    "matches_first_ten": _counts_sql([d for d in DETECTORS if d.name in ("ipv4", "http_status", "ports", "email")], limit=10),
    **{
        f"detections_{n}": on_telemetry(_score_ctes([d for d in DETECTORS if d.area == a], -1, MESSAGE_SQL)) + FLAT_SQL
        for n, a in [("network", "network_presence"), ("endpoint", "endpoint_identity"), ("cloud", "cloud_infrastructure")]
    },
    **{
        f"detections_{n}": on_telemetry(_score_ctes([d for d in DETECTORS if d.area == a], -1, f"{LONG_SQL} UNION ALL {MESSAGE_SQL}")) + FLAT_SQL
        for n, a in [("identity", "identity_context"), ("application", "application_telemetry")]
    },
    "matches_industry": _counts_sql(INDUSTRY_DETECTORS),
    "matches_compliance": _counts_sql(COMPLIANCE_DETECTORS),
    "matches_variants": _counts_sql(VARIANT_DETECTORS, "SELECT 'pages' AS tbl, 'url' AS col, CAST(page_id AS VARCHAR) AS row_id, url AS value FROM pages WHERE url IS NOT NULL"),
    "detections": _score_ctes(DETECTORS, 0.3) + FLAT_SQL,
    "detections_redacted": _score_ctes(DETECTORS, 0.3) + """ SELECT tbl AS "table", col AS "column", area, detector, n_fragments, n_distinct, round(confidence, 6) AS confidence,
      array_to_string(list_transform(ev[1:3], lambda e: '<redacted:' || length(e) || '>'), '|') AS evidence FROM k""",
    "industry_scores": _industry_ctes() + " SELECT family, round(score, 6) AS score, pattern_matches, round(least(score / 10.0, 1.0), 6) AS confidence FROM g",
    "industry_context": _industry_ctes() + " SELECT coalesce((SELECT family FROM best), 'generic') AS detected_industry",
    "detections_boosted": _industry_ctes() + """, m AS (SELECT tbl, col, area, detector, exp(sum(ln(multiplier))) AS factor FROM t
        WHERE want = area AND family = (SELECT family FROM best) GROUP BY tbl, col, area, detector)
      SELECT k.tbl AS "table", k.col AS "column", k.area, k.detector, n_fragments, n_distinct, round(least(confidence * coalesce(factor, 1.0), 1.0), 6) AS confidence, array_to_string(ev, '|') AS evidence
      FROM k LEFT JOIN m ON m.tbl = k.tbl AND m.col = k.col AND m.area = k.area AND m.detector = k.detector""",
    "compliance_relevance": _industry_ctes() + f""" SELECT g.family, coalesce(r.regime, d.regime) AS regime FROM g
      LEFT JOIN (VALUES {_values([(f, x) for f, rs in FAMILY_REGIMES.items() for x in rs])}) r(family, regime) ON r.family = g.family
      LEFT JOIN (VALUES {_values([(x,) for x in DEFAULT_REGIMES])}) d(regime) ON r.family IS NULL""",
    "recommended_patterns": _industry_ctes() + f""" SELECT g.family, p.name, p.description, p.category FROM g
      JOIN (VALUES {_values([(d.family, d.name, d.description, d.area) for d in INDUSTRY_DETECTORS])}) p(family, name, description, category) ON p.family = g.family""",
}
