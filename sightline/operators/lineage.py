"""Table lineage from job history, for all tables in one pass over the references."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.columns import first_label, qualified, stacked
from sightline.functions.rules import LAYER_WORDS
from sightline.operators.sampling import top_per_group


def unnest_references(jobs: DataFrame) -> DataFrame:
    """One row per job and referenced table of a nested job history."""
    return jobs.select(
        "job_id", "creation_time", "user_email", "job_type", "total_bytes", "total_cost_ms",
        F.col("destination.dataset").alias("dst_dataset"), F.col("destination.table").alias("dst_table"),
        F.inline("referenced").alias("ref_dataset", "ref_table"),
    )


def keyed(refs: DataFrame) -> DataFrame:
    return refs.withColumn("target", qualified("dst_dataset", "dst_table")).withColumn("source", qualified("ref_dataset", "ref_table"))


def newest(refs: DataFrame) -> Column:
    return refs.agg(F.max("creation_time")).scalar()


def within_days(refs: DataFrame, as_of: Column, days: int) -> DataFrame:
    return refs.filter(F.col("creation_time") >= as_of - F.make_dt_interval(F.lit(days)))


def table_edges(refs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Distinct (source, target) pairs of recent jobs, between different datasets."""
    return keyed(within_days(refs, as_of, days).filter(F.col("ref_dataset") != F.col("dst_dataset"))).select("source", "target").distinct()


def upstream(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("table_key"), F.col("source").alias("upstream"))


def downstream(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("table_key"), F.col("target").alias("downstream"))


def ingestion_pattern(refs: DataFrame, as_of: Column, days: int = 30, rows: int = 30) -> DataFrame:
    """How often and how much each table is written to.

    References of a job are first reduced to the job, then to (table, day, job type); the
    latest 30 such rows of a table make up the pattern.
    """
    day = F.to_date("creation_time")
    jobs = keyed(within_days(refs, as_of, days)).groupBy("target", "job_id", day.alias("day"), "job_type").agg(F.max("total_bytes").alias("total_bytes"))
    daily = jobs.groupBy("target", "day", "job_type").agg(F.count(F.lit(1)).alias("job_count"), F.sum("total_bytes").alias("total_bytes"))
    return _pattern(daily, rows)


def _pattern(daily: DataFrame, rows: int) -> DataFrame:
    recent = top_per_group(daily, ["target"], [F.desc("day"), F.col("job_type")], rows)
    n = F.count(F.lit(1))
    return recent.groupBy(F.col("target").alias("table_key")).agg(
        F.avg("job_count").alias("avg_daily_jobs"), F.sum("total_bytes").alias("total_bytes"), n.alias("pattern_rows"),
        F.when(n > 20, "daily").otherwise("irregular").alias("ingestion_frequency"),
    )


def access_days(refs: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Per table and day: queries, distinct users, mean cost."""
    recent = keyed(within_days(refs, as_of, days).filter(F.col("job_type") == "QUERY"))
    per_user = recent.groupBy("source", F.to_date("creation_time").alias("day"), "user_email").agg(F.count(F.lit(1)).alias("n"), F.sum("total_cost_ms").alias("cost"))
    return per_user.groupBy(F.col("source").alias("table_key"), "day").agg(
        F.sum("n").alias("query_count"), F.count("user_email").alias("unique_users"), (F.sum("cost") / F.sum("n")).alias("avg_cost")
    )


def access_pattern(daily: DataFrame) -> DataFrame:
    mean = F.avg("query_count")
    return daily.groupBy("table_key").agg(
        mean.alias("avg_daily_queries"), F.sum("unique_users").alias("unique_users_count"), F.when(mean > 10, "high").otherwise("low").alias("access_frequency")
    )


def data_flows(edges: DataFrame, tables: DataFrame, ingestion: DataFrame, access: DataFrame) -> DataFrame:
    """One flow per edge, between the known tables (`table_key`) and their neighbours.

    An edge into a known table is an ingestion, an edge out of one a transformation; an edge
    that is both counts as a transformation.
    """
    known = tables.select("table_key").distinct()
    arriving = (
        edges.join(known, F.col("target") == F.col("table_key"), "left_semi")
        .join(ingestion.select(F.col("table_key").alias("target"), F.col("ingestion_frequency").alias("frequency")), "target", "left")
        .withColumn("flow_type", F.lit("ingestion"))
    )
    leaving = (
        edges.join(known, F.col("source") == F.col("table_key"), "left_semi")
        .join(access.select(F.col("table_key").alias("source"), F.col("access_frequency").alias("frequency")), "source", "left")
        .withColumn("flow_type", F.lit("transformation"))
    )
    both = arriving.unionByName(leaving).withColumn("frequency", F.coalesce("frequency", F.lit("unknown")))
    later = F.when(F.col("flow_type") == "transformation", 1).otherwise(0)
    return both.groupBy("source", "target").agg(F.max_by(F.struct("flow_type", "frequency"), later).alias("_f")).select("source", "target", "_f.flow_type", "_f.frequency")


def layer_of(table: Column | str) -> Column:
    """Layer by a fragment of the bare table name."""
    table = F.col(table) if isinstance(table, str) else table
    return first_label(F.lower(F.element_at(F.split(table, r"\."), -1)), LAYER_WORDS, "unknown")


def degrees(edges: DataFrame) -> DataFrame:
    one, none = F.lit(1), F.lit(0)
    ends = edges.select(stacked(["table_key", "i", "o"], (F.col("target"), one, none), (F.col("source"), none, one)))
    return ends.groupBy("table_key").agg(F.sum("i").alias("input_count"), F.sum("o").alias("output_count"))


def transformation_points(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables of a known layer or with inputs: degrees and a complexity band."""
    counted = tables.select("table_key").distinct().join(degrees(edges), "table_key", "left")
    counted = counted.withColumns({"input_count": F.coalesce("input_count", F.lit(0)), "output_count": F.coalesce("output_count", F.lit(0)), "transformation_type": layer_of("table_key")})
    links = F.col("input_count") + F.col("output_count")
    complexity = F.when(links == 0, "isolated").when(links <= 2, "simple").when(links <= 5, "moderate").otherwise("complex")
    return counted.filter((F.col("transformation_type") != "unknown") | (F.col("input_count") > 0)).withColumn("complexity", complexity)


def dependency_health(edges: DataFrame, tables: DataFrame, row_counts: DataFrame) -> DataFrame:
    """Tables whose upstream tables are empty; upstreams without a known count are ignored."""
    links = upstream(edges).join(row_counts.select(F.col("table_key").alias("upstream"), "row_count"), "upstream", "left")
    empty = F.when(F.col("row_count") == 0, F.col("upstream"))
    # The list is limited by the number of tables that feed one table.
    per_table = links.groupBy("table_key").agg(F.count(F.lit(1)).alias("dependency_count"), F.sort_array(F.collect_set(empty)).alias("critical_dependencies"))
    joined = tables.select("table_key").distinct().join(per_table, "table_key", "left")
    critical = F.coalesce("critical_dependencies", F.array().cast("array<string>"))
    return joined.select(
        "table_key", F.coalesce("dependency_count", F.lit(0)).alias("dependency_count"), critical.alias("critical_dependencies"),
        F.when(F.size(critical) > 0, "critical").otherwise("healthy").alias("dependency_health"),
    )


def lineage_report(edges: DataFrame, tables: DataFrame, ingestion: DataFrame, access: DataFrame, row_counts: DataFrame) -> DataFrame:
    """Everything known about each table, on one row."""
    points = transformation_points(edges, tables).drop("input_count", "output_count")
    counted = tables.select("table_key").distinct().join(degrees(edges), "table_key", "left")
    joined = counted
    for part in (row_counts, ingestion.drop("pattern_rows"), access, points, dependency_health(edges, tables, row_counts)):
        joined = joined.join(part, "table_key", "left")
    defaults = {"input_count": 0, "output_count": 0, "ingestion_frequency": "unknown", "access_frequency": "unknown"}
    return joined.fillna(defaults)


# ------------------------------------------------------------------------- rollup by day
@dataclass(frozen=True)
class Rollup:
    """The job history by day: what was written (target, day, job_type), read (source, day) and linked
    (source, target, day). Everything in the lineage report follows from these; they are as small as
    the number of tables and days, and days can be added one by one."""

    writes: DataFrame
    reads: DataFrame
    links: DataFrame


def rolled_up(refs: DataFrame) -> Rollup:
    """The rollup of a job history. `refs` is read by three groupings, so it should be stored."""
    rows = keyed(refs).withColumn("day", F.to_date("creation_time"))
    jobs = rows.groupBy("target", "day", "job_type", "job_id").agg(F.max("total_bytes").alias("bytes"))
    writes = jobs.groupBy("target", "day", "job_type").agg(F.count(F.lit(1)).alias("job_count"), F.sum("bytes").alias("total_bytes"))
    users = rows.filter(F.col("job_type") == "QUERY").groupBy("source", "day", "user_email").agg(F.count(F.lit(1)).alias("n"), F.sum("total_cost_ms").alias("cost"))
    reads = users.groupBy("source", "day").agg(F.sum("n").alias("query_count"), F.count("user_email").alias("unique_users"), F.sum("cost").alias("cost"), F.hll_sketch_agg("user_email").alias("users"))
    links = rows.groupBy("source", "target", (F.col("ref_dataset") != F.col("dst_dataset")).alias("crosses"), "day").agg(F.count(F.lit(1)).alias("n"))
    return Rollup(writes, reads, links)


def store_run(rollup: Rollup, path: str, run: str) -> None:
    """Add the days of a run to a stored rollup. A run holds whole days; one that is repeated replaces
    what it stored before."""
    for name in ("writes", "reads", "links"):
        rows = getattr(rollup, name).withColumn("run", F.lit(run))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{path}/{name}")


def load_rollup(spark: SparkSession, path: str) -> Rollup:
    return Rollup(*[spark.read.parquet(f"{path}/{name}").drop("run") for name in ("writes", "reads", "links")])


def _last_days(df: DataFrame, as_of: Column, days: int) -> DataFrame:
    return df.filter(F.col("day") >= F.date_sub(as_of, days))


def report_from_rollup(rollup: Rollup, ingestion_days: int = 30, access_days_: int = 7, rows: int = 30) -> DataFrame:
    """The lineage report from a rollup, over whole days up to the newest one, with `users_estimate`: the
    distinct users of all days of access together, which counts by day cannot give."""
    as_of = rollup.writes.agg(F.max("day")).scalar()
    edges = _last_days(rollup.links.filter("crosses"), as_of, ingestion_days).select("source", "target").distinct()
    ingestion = _pattern(_last_days(rollup.writes, as_of, ingestion_days), rows)
    daily = _last_days(rollup.reads, as_of, access_days_).withColumnRenamed("source", "table_key")
    access = access_pattern(daily).join(daily.groupBy("table_key").agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users_estimate")), "table_key")
    written = rollup.writes.groupBy(F.col("target").alias("table_key")).agg(F.sum("job_count").alias("n"))
    read = rollup.links.select(F.col("source").alias("table_key"), F.lit(0).cast("bigint").alias("n")).distinct()
    row_counts = written.unionByName(read).groupBy("table_key").agg(F.sum("n").alias("row_count"))
    return lineage_report(edges, written.select("table_key"), ingestion, access, row_counts)
