"""Registered coverage queries and their SQL checks."""

from __future__ import annotations

from sightline.operators import coverage as cov
from sightline.plans.oracle_views import ASSETS, with_views
from sightline.plans.registry import rounded
from sightline.sources import views
from sightline.sources.tables import loader

ANY = "(a_host IS NOT NULL OR b_host IS NOT NULL OR c_host IS NOT NULL)"
# How the roles are bound to the log types the test data has.
ROLE_INPUT = {
    "network": (["1-URGENT"], ["%ship\\_o%"]),
    "endpoint": (["2-HIGH"], ["%ship\\_f%"]),
    "cloud": (["1-URGENT", "2-HIGH"], ["%ship%"]),
}


def _on_assets(fn):
    return lambda spark, base: fn(views.assets(loader(spark, base)))


def _sql(body: str) -> str:
    return with_views(ASSETS, body=body)


def _by(dim: str, alias: str) -> str:
    return _sql(f"""SELECT coalesce({dim}, 'Unknown') AS {alias}, count(DISTINCT hostname) AS total_assets,
      count(DISTINCT CASE WHEN {ANY} THEN hostname END) AS assets_with_logging,
      round(count(DISTINCT CASE WHEN {ANY} THEN hostname END) * 100.0 / nullif(count(DISTINCT hostname), 0), 6) AS coverage_percentage
      FROM assets GROUP BY {dim}""")


def _of(key: str) -> str:
    return _sql(f"""SELECT count(DISTINCT {key}) AS total, count(DISTINCT CASE WHEN {ANY} THEN {key} END) AS with_logging,
      round(count(DISTINCT CASE WHEN {ANY} THEN {key} END) * 100.0 / nullif(count(DISTINCT {key}), 0), 6) AS coverage_percentage FROM assets WHERE {key} IS NOT NULL""")


def _role(role: str, extra_select: str, extra_filter: str = "") -> str:
    exact, like = ROLE_INPUT[role]
    test_exact = "a_log_type IN (" + ", ".join(f"'{x}'" for x in exact) + ")"
    test_like = " OR ".join("c_sourcetype LIKE '" + p.replace("\\_", "_") + "'" for p in like)
    return _sql(f"""SELECT '{role.title()}' AS role, log_type, count(DISTINCT hostname) AS asset_count{extra_select} FROM (
      SELECT CASE WHEN {test_exact} THEN a_log_type WHEN {test_like} THEN c_sourcetype ELSE 'Other' END AS log_type, hostname, ip_address, b_host
      FROM assets WHERE {test_exact} OR {test_like}{extra_filter}) r GROUP BY log_type""")


DIMS = {"infra_type": "infrastructure_type", "region": "region", "country": "country", "os": "operating_system", "platform": "platform", "class": "asset_class"}
NAMES = {"infra_type": "infra", "class": "asset_class"}

QUERIES = {
    "coverage_global": _on_assets(lambda a: rounded(cov.coverage_of(a))),
    "coverage_by_source": _on_assets(lambda a: rounded(cov.coverage_by_source(a))),
    **{f"coverage_by_{NAMES.get(d, d)}": _on_assets(lambda a, d=d, n=n: rounded(cov.coverage_by(a, d, n))) for d, n in DIMS.items()},
    "coverage_by_infra_and_log_type": _on_assets(cov.coverage_by_infra_and_log_type),
    "role_network": _on_assets(lambda a: cov.role_network(a, *ROLE_INPUT["network"])),
    "role_endpoint": _on_assets(lambda a: cov.role_endpoint(a, *ROLE_INPUT["endpoint"])),
    "role_cloud": _on_assets(lambda a: cov.role_cloud(a, *ROLE_INPUT["cloud"])),
    "coverage_fqdn": _on_assets(lambda a: rounded(cov.coverage_of(a, "fqdn"))),
    "coverage_ip": _on_assets(lambda a: rounded(cov.coverage_of(a, "ip_address"))),
    "log_volume": _on_assets(cov.log_volume),
    "agent_health": _on_assets(lambda a: rounded(cov.agent_health(a))),
    "kpi_table": _on_assets(cov.kpi_table),
    "uncovered_assets": _on_assets(cov.uncovered_assets),
    "partially_covered_assets": _on_assets(cov.partially_covered_assets),
    "hosts_in_no_source": _on_assets(cov.hosts_in_no_source),
}

ORACLES = {
    "coverage_global": _of("hostname"),
    "coverage_by_source": _sql(" UNION ALL ".join(
        f"""SELECT '{s}' AS log_source, count(DISTINCT {h}) AS assets_covered,
        round(count(DISTINCT {h}) * 100.0 / nullif((SELECT count(DISTINCT hostname) FROM assets), 0), 6) AS coverage_percentage FROM assets WHERE {h} IS NOT NULL"""
        for s, h in [("A", "a_host"), ("B", "b_host"), ("C", "c_host")])),
    **{f"coverage_by_{NAMES.get(d, d)}": _by(d, n) for d, n in DIMS.items()},
    "coverage_by_infra_and_log_type": _sql("""SELECT coalesce(infra_type, 'Unknown') AS infrastructure_type, coalesce(a_log_type, c_sourcetype, 'Unknown') AS log_type,
      count(DISTINCT hostname) AS asset_count, count(DISTINCT CASE WHEN a_log_type IS NOT NULL THEN hostname END) AS a_coverage,
      count(DISTINCT CASE WHEN c_sourcetype IS NOT NULL THEN hostname END) AS c_coverage, count(DISTINCT CASE WHEN b_host IS NOT NULL THEN hostname END) AS b_coverage
      FROM assets GROUP BY infra_type, coalesce(a_log_type, c_sourcetype), coalesce(a_log_type, c_sourcetype, 'Unknown')"""),
    "role_network": _role("network", ", count(DISTINCT ip_address) AS unique_ips"),
    "role_endpoint": _role("endpoint", ", count(DISTINCT CASE WHEN b_host IS NOT NULL THEN hostname END) AS agent_coverage", " OR b_host IS NOT NULL"),
    "role_cloud": _role("cloud", ""),
    "coverage_fqdn": _of("fqdn"),
    "coverage_ip": _of("ip_address"),
    "log_volume": _sql(" UNION ALL ".join(
        f"SELECT '{s}' AS source, CAST(sum(coalesce({c}, 0)) AS BIGINT) AS total_log_count, count(DISTINCT {h}) AS unique_hosts FROM assets WHERE {c} IS NOT NULL"
        for s, h, c in [("A", "a_host", "a_count"), ("C", "c_host", "c_count"), ("Combined", "hostname", "log_count")])),
    "agent_health": _sql("""SELECT coalesce(b_agent_health, 'Unknown') AS agent_health, coalesce(b_agent_status, 'Unknown') AS agent_status, count(DISTINCT b_host) AS agent_count,
      round(count(DISTINCT b_host) * 100.0 / (SELECT count(DISTINCT b_host) FROM assets), 6) AS percentage FROM assets WHERE b_host IS NOT NULL GROUP BY b_agent_health, b_agent_status"""),
    "kpi_table": _sql(f"""SELECT 'Total Assets' AS metric, CAST(count(DISTINCT hostname) AS DOUBLE) AS value, 'count' AS unit FROM assets
      UNION ALL SELECT 'Assets with Any Logging', CAST(count(DISTINCT CASE WHEN {ANY} THEN hostname END) AS DOUBLE), 'count' FROM assets
      UNION ALL SELECT 'Overall Coverage Percentage', round(count(DISTINCT CASE WHEN {ANY} THEN hostname END) * 100.0 / count(DISTINCT hostname), 2), '%' FROM assets"""
      + "".join(f" UNION ALL SELECT '{s} Coverage', round(count(DISTINCT {h}) * 100.0 / count(DISTINCT hostname), 2), '%' FROM assets" for s, h in [("A", "a_host"), ("B", "b_host"), ("C", "c_host")])),
    "uncovered_assets": _sql(f"""SELECT hostname, fqdn, ip_address, coalesce(region, 'Unknown') AS region, coalesce(country, 'Unknown') AS country,
      coalesce(infra_type, 'Unknown') AS infrastructure_type, coalesce(os, 'Unknown') AS operating_system, coalesce(class, 'Unknown') AS asset_class
      FROM assets WHERE NOT {ANY} AND hostname IS NOT NULL"""),
    "partially_covered_assets": _sql(f"""SELECT hostname, CASE WHEN a_host IS NOT NULL THEN 'Yes' ELSE 'No' END AS a_coverage, CASE WHEN b_host IS NOT NULL THEN 'Yes' ELSE 'No' END AS b_coverage,
      CASE WHEN c_host IS NOT NULL THEN 'Yes' ELSE 'No' END AS c_coverage, coalesce(infra_type, 'Unknown') AS infrastructure_type, coalesce(region, 'Unknown') AS region
      FROM assets WHERE hostname IS NOT NULL AND {ANY} AND NOT (a_host IS NOT NULL AND b_host IS NOT NULL AND c_host IS NOT NULL)"""),
    "hosts_in_no_source": _sql("""SELECT DISTINCT hostname FROM assets WHERE hostname IS NOT NULL AND hostname NOT IN (
      SELECT a_host FROM assets WHERE a_host IS NOT NULL UNION SELECT b_host FROM assets WHERE b_host IS NOT NULL UNION SELECT c_host FROM assets WHERE c_host IS NOT NULL)"""),
}
