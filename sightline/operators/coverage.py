"""Log coverage of an asset inventory.

Assets repeat (one row per asset and log type), so every measure counts distinct keys. The
operators reduce to one row per (dimension, key) first and count those rows, which costs one
shuffle with map-side combine; several DISTINCT aggregates side by side would multiply the
input rows instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.columns import any_present, as_col, cases, like_any, or_unknown, percent, stacked


class Source(NamedTuple):
    """A log source: its label and its host and count columns in the asset table."""

    label: str
    host: str
    count: str | None = None


SOURCES = (Source("A", "a_host", "a_count"), Source("B", "b_host"), Source("C", "c_host", "c_count"))
ALL = "__all__"


def has_logging(sources: Sequence[Source] = SOURCES) -> Column:
    return any_present([s.host for s in sources])


def distinct_counts(df: DataFrame, dims: Sequence[Column], key: Column | str, flags: Mapping[str, Column], total: str, approx: bool = False) -> DataFrame:
    """Per group: distinct keys, and distinct keys with each flag on at least one row.

    `approx` counts with sketches instead, which shuffles one small row per task and group.
    """
    names = [f"_d{i}" for i in range(len(dims))]
    rows = df.select(*[d.alias(n) for d, n in zip(dims, names)], as_col(key).alias("_key"), *[f.cast("int").alias(n) for n, f in flags.items()])
    if approx:
        return rows.groupBy(*names).agg(F.approx_count_distinct("_key").alias(total), *[F.approx_count_distinct(F.when(F.col(n) == 1, F.col("_key"))).alias(n) for n in flags])
    per_key = rows.groupBy(*names, "_key").agg(F.count(F.lit(1)).alias("_n"), *[F.max(n).alias(n) for n in flags])
    return per_key.groupBy(*names).agg(
        F.count("_key").alias(total),
        *[F.count_if(F.col("_key").isNotNull() & (F.col(n) == 1)).alias(n) for n in flags],
    )


def coverage_of(assets: DataFrame, key: str = "hostname", sources: Sequence[Source] = SOURCES, approx: bool = False) -> DataFrame:
    """One row: distinct keys, distinct keys seen by any source, percent."""
    counts = distinct_counts(assets.filter(F.col(key).isNotNull()), [], key, {"with_logging": has_logging(sources)}, "total", approx)
    return counts.withColumn("coverage_percentage", percent("with_logging", "total"))


def coverage_by(assets: DataFrame, dim: str, alias: str | None = None, sources: Sequence[Source] = SOURCES, approx: bool = False) -> DataFrame:
    """Coverage of distinct hosts within each value of one dimension, best covered first."""
    alias = alias or dim
    counts = distinct_counts(assets, [F.col(dim)], "hostname", {"assets_with_logging": has_logging(sources)}, "total_assets", approx)
    return counts.select(
        or_unknown("_d0").alias(alias), "total_assets", "assets_with_logging",
        percent("assets_with_logging", "total_assets").alias("coverage_percentage"),
    ).orderBy(F.desc("coverage_percentage"), alias)


def _distinct_members(assets: DataFrame, members: Mapping[str, Column]) -> DataFrame:
    """(member, n): distinct non-null values of several expressions in one pass."""
    long = assets.select(stacked(["member", "value"], *members.items()))
    return long.filter(F.col("value").isNotNull()).groupBy("member", "value").agg(F.count(F.lit(1)).alias("_n")).groupBy("member").agg(F.count("value").alias("n"))


def _one_row(counts: DataFrame, members: Sequence[str]) -> DataFrame:
    return counts.agg(*[F.coalesce(F.max(F.when(F.col("member") == m, F.col("n"))), F.lit(0)).alias(m) for m in members])


def coverage_by_source(assets: DataFrame, sources: Sequence[Source] = SOURCES) -> DataFrame:
    """Per source: distinct hosts and their share of all distinct hosts."""
    members = {ALL: F.col("hostname"), **{s.label: F.col(s.host) for s in sources}}
    wide = _one_row(_distinct_members(assets, members), list(members))
    rows = stacked(["log_source", "assets_covered", "_all"], *[(s.label, F.col(f"`{s.label}`"), F.col(ALL)) for s in sources])
    return wide.select(rows).select("log_source", "assets_covered", percent("assets_covered", "_all").alias("coverage_percentage"))


def coverage_by_infra_and_log_type(assets: DataFrame) -> DataFrame:
    flags = {"a_coverage": F.col("a_log_type").isNotNull(), "c_coverage": F.col("c_sourcetype").isNotNull(), "b_coverage": F.col("b_host").isNotNull()}
    counts = distinct_counts(assets, [F.col("infra_type"), F.coalesce("a_log_type", "c_sourcetype")], "hostname", flags, "asset_count")
    return counts.select(
        or_unknown("_d0").alias("infrastructure_type"), or_unknown("_d1").alias("log_type"), "asset_count", *flags,
    ).orderBy("infrastructure_type", F.desc("asset_count"), "log_type")


def role_bucket(log_types: Sequence[str], patterns: Sequence[str], log_type: str = "a_log_type", source_type: str = "c_sourcetype") -> tuple[Column, Column]:
    """(bucket, matches): an exact log type first, then a source type pattern, else Other."""
    exact, pattern = F.col(log_type).isin(*log_types), like_any(source_type, patterns)
    return cases([(exact, F.col(log_type)), (pattern, F.col(source_type))], "Other"), F.coalesce(exact, F.lit(False)) | F.coalesce(pattern, F.lit(False))


def role_network(assets: DataFrame, log_types: Sequence[str], patterns: Sequence[str]) -> DataFrame:
    """Distinct hosts and addresses by log type of the network role."""
    bucket, match = role_bucket(log_types, patterns)
    rows = assets.filter(match).select(
        bucket.alias("log_type"),
        stacked(["member", "value"], ("host", F.col("hostname")), ("ip", F.col("ip_address"))),
    )
    return (
        rows.groupBy("log_type", "member", "value").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("log_type")
        .agg(F.count(F.when(F.col("member") == "host", F.col("value"))).alias("asset_count"), F.count(F.when(F.col("member") == "ip", F.col("value"))).alias("unique_ips"))
        .select(F.lit("Network").alias("role"), "log_type", "asset_count", "unique_ips")
        .orderBy(F.desc("asset_count"), "log_type")
    )


def role_endpoint(assets: DataFrame, log_types: Sequence[str], patterns: Sequence[str], agent: str = "b_host") -> DataFrame:
    """Distinct hosts by log type of the endpoint role; any row with an agent counts too."""
    bucket, match = role_bucket(log_types, patterns)
    rows = assets.filter(match | F.col(agent).isNotNull())
    counts = distinct_counts(rows, [bucket], "hostname", {"agent_coverage": F.col(agent).isNotNull()}, "asset_count")
    return counts.select(F.lit("Endpoint").alias("role"), F.col("_d0").alias("log_type"), "asset_count", "agent_coverage").orderBy(F.desc("asset_count"), "log_type")


def role_cloud(assets: DataFrame, log_types: Sequence[str], patterns: Sequence[str]) -> DataFrame:
    bucket, match = role_bucket(log_types, patterns)
    counts = distinct_counts(assets.filter(match), [bucket], "hostname", {}, "asset_count")
    return counts.select(F.lit("Cloud").alias("role"), F.col("_d0").alias("log_type"), "asset_count").orderBy(F.desc("asset_count"), "log_type")


def log_volume(assets: DataFrame, sources: Sequence[Source] = SOURCES) -> DataFrame:
    """Log count and distinct hosts per counting source, and for all of them combined."""
    parts = [(s.label, s.host, s.count) for s in sources if s.count] + [("Combined", "hostname", "log_count")]
    long = assets.select(stacked(["source", "host", "cnt"], *[(label, F.col(host), F.col(count)) for label, host, count in parts]))
    per_host = long.filter(F.col("cnt").isNotNull()).groupBy("source", "host").agg(F.sum("cnt").alias("cnt"))
    return per_host.groupBy("source").agg(F.sum("cnt").alias("total_log_count"), F.count("host").alias("unique_hosts"))


def agent_health(assets: DataFrame, agent: str = "b_host", health: str = "b_agent_health", status: str = "b_agent_status") -> DataFrame:
    """Distinct agents by health and status, with their share of all distinct agents."""
    agents = assets.filter(F.col(agent).isNotNull())
    everyone = agents.groupBy(agent).agg(F.count(F.lit(1)).alias("_n")).agg(F.count(agent))
    counts = distinct_counts(agents, [F.col(health), F.col(status)], agent, {}, "agent_count")
    return counts.select(
        or_unknown("_d0").alias("agent_health"), or_unknown("_d1").alias("agent_status"), "agent_count",
        percent("agent_count", everyone.scalar()).alias("percentage"),
    ).orderBy(F.desc("agent_count"), "agent_health", "agent_status")


def kpi_table(assets: DataFrame, sources: Sequence[Source] = SOURCES) -> DataFrame:
    """Headline figures as (metric, value, unit) rows from one pass over the assets."""
    members = {ALL: F.col("hostname"), "__logged__": F.when(has_logging(sources), F.col("hostname")), **{s.label: F.col(s.host) for s in sources}}
    wide = _one_row(_distinct_members(assets, members), list(members))
    share = lambda m: F.round(percent(F.col(f"`{m}`"), F.col(ALL)), 2)
    figures = [
        ("Total Assets", F.col(ALL).cast("double"), "count"),
        ("Assets with Any Logging", F.col("__logged__").cast("double"), "count"),
        ("Overall Coverage Percentage", share("__logged__"), "%"),
        *[(f"{s.label} Coverage", share(s.label), "%") for s in sources],
    ]
    return wide.select(stacked(["metric", "value", "unit"], *figures))


def uncovered_assets(assets: DataFrame, sources: Sequence[Source] = SOURCES) -> DataFrame:
    """Rows with a host that no source has seen."""
    unknown = {"region": "region", "country": "country", "infra_type": "infrastructure_type", "os": "operating_system", "class": "asset_class"}
    return assets.filter(F.col("hostname").isNotNull() & ~has_logging(sources)).select(
        "hostname", "fqdn", "ip_address", *[or_unknown(c).alias(a) for c, a in unknown.items()]
    ).orderBy("region", "country", "infrastructure_type", "hostname")


def partially_covered_assets(assets: DataFrame, sources: Sequence[Source] = SOURCES) -> DataFrame:
    """Rows with a host that some sources have seen and others have not."""
    seen = sum((F.col(s.host).isNotNull().cast("int") for s in sources), F.lit(0))
    flag = lambda s: F.when(F.col(s.host).isNotNull(), "Yes").otherwise("No").alias(f"{s.label.lower()}_coverage")
    return assets.filter(F.col("hostname").isNotNull() & (seen > 0) & (seen < len(sources))).select(
        "hostname", *[flag(s) for s in sources], or_unknown("infra_type").alias("infrastructure_type"), or_unknown("region").alias("region")
    ).orderBy("infrastructure_type", "region", "hostname")


def hosts_in_no_source(assets: DataFrame, sources: Sequence[Source] = SOURCES) -> DataFrame:
    """The same question over normalised inputs: hosts with no row in any source table."""
    known = assets.select(F.explode(F.array(*[F.col(s.host) for s in sources])).alias("hostname")).filter(F.col("hostname").isNotNull()).distinct()
    return assets.select("hostname").filter(F.col("hostname").isNotNull()).distinct().join(known, "hostname", "left_anti")
