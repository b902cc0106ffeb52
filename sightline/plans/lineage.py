"""Registered lineage queries and their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions.columns import qualified
from sightline.functions.rules import LAYER_WORDS
from sightline.operators import lineage as lin
from sightline.plans.oracle_views import BATCH_REFS, JOB_REFS, with_views
from sightline.plans.registry import rounded
from sightline.session import ensure_checkpoint_dir
from sightline.sources import views
from sightline.sources.tables import loader, staged


class Parts:
    """The inputs of the lineage reports; every one stays lazy, but for the history where many use it."""

    def __init__(self, spark, base, stored=False):
        self.refs = lin.unnest_references(views.nested_jobs(loader(spark, base)))
        if stored:
            ensure_checkpoint_dir(spark)
            self.refs = self.refs.checkpoint()
        self.as_of = lin.newest(self.refs)
        self.edges = lin.table_edges(self.refs, self.as_of)
        self.ingestion = lin.ingestion_pattern(self.refs, self.as_of)
        self.access = lin.access_pattern(lin.access_days(self.refs, self.as_of))
        # Tables that jobs write are the known ones; what is only read lies outside.
        self.tables = self.refs.select(qualified("dst_dataset", "dst_table").alias("table_key")).distinct()

    def row_counts(self):
        """Jobs that write a table stand for its rows; tables nobody writes are empty."""
        written = lin.keyed(self.refs).groupBy("target", "job_id").agg(F.count(F.lit(1)).alias("_n")).groupBy(F.col("target").alias("table_key")).agg(F.count(F.lit(1)).alias("n"))
        read = lin.keyed(self.refs).select(F.col("source").alias("table_key"), F.lit(0).cast("bigint").alias("n")).distinct()
        return written.unionByName(read).groupBy("table_key").agg(F.sum("n").alias("row_count"))


def _with(fn, stored=False):
    return lambda spark, base: rounded(fn(Parts(spark, base, stored)))


def _joined(df, *names):
    return df.select(*[F.array_join(c, "|").alias(c) if c in names else F.col(c) for c in df.columns])


def _day(df):
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _batch_refs(spark, base):
    return lin.unnest_references(views.batch_jobs(loader(spark, base)))


def _rollup(spark, base):
    """The history is read once; its years are added to the stored rollup in two runs, one of them repeated."""
    ensure_checkpoint_dir(spark)
    refs = _batch_refs(spark, base).checkpoint()
    path = staged(spark, "rollup")
    old = F.year("creation_time") < 1996
    for run, part in (("old", refs.filter(old)), ("new", refs.filter(~old)), ("old", refs.filter(old))):
        lin.store_run(lin.rolled_up(part), path, run)
    return rounded(_joined(lin.report_from_rollup(lin.load_rollup(spark, path)), "critical_dependencies").drop("users_estimate"))


QUERIES = {
    "unnested_jobs": lambda spark, base: lin.keyed(_batch_refs(spark, base)).select("job_id", "user_email", "job_type", "total_bytes", "source", "target"),
    "lineage_from_rollup": _rollup,
    "referenced_tables": _with(lambda p: lin.keyed(p.refs).select("job_id", "source", "target")),
    "upstream_tables": _with(lambda p: lin.upstream(p.edges)),
    "downstream_tables": _with(lambda p: lin.downstream(p.edges)),
    "ingestion_pattern": _with(lambda p: p.ingestion),
    "access_days": _with(lambda p: _day(lin.access_days(p.refs, p.as_of))),
    "access_pattern": _with(lambda p: p.access),
    "data_flows": _with(lambda p: lin.data_flows(p.edges, p.tables, p.ingestion, p.access)),
    "table_layers": _with(lambda p: lin.degrees(p.edges).withColumn("layer", lin.layer_of("table_key"))),
    "transformation_points": _with(lambda p: lin.transformation_points(p.edges, p.tables)),
    "upstream_row_counts": _with(lambda p: lin.upstream(p.edges).join(p.row_counts().withColumnRenamed("table_key", "upstream"), "upstream", "left")),
    "dependency_health": _with(lambda p: _joined(lin.dependency_health(p.edges, p.tables, p.row_counts()), "critical_dependencies")),
    "lineage_report": _with(lambda p: _joined(lin.lineage_report(p.edges, p.tables, p.ingestion, p.access, p.row_counts()), "critical_dependencies"), stored=True),
}

# ------------------------------------------------------------------------------ SQL
LAYER = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(split_part(k, '.', -1)), '{w}')" for w in ws) + f" THEN '{layer}'" for layer, ws in LAYER_WORDS.items()) + " ELSE 'unknown' END"
BASE = f"""r AS (SELECT *, concat(dst_dataset, '.', dst_table) AS target, concat(ref_dataset, '.', ref_table) AS source, max(creation_time) OVER () AS now FROM job_refs),
e AS (SELECT DISTINCT source, target FROM r WHERE creation_time >= now - INTERVAL 30 DAY AND ref_dataset <> dst_dataset),
t AS (SELECT DISTINCT target AS k FROM r),
ing AS (SELECT target AS k, avg(jobs) AS avg_daily_jobs, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(*) AS pattern_rows, CASE WHEN count(*) > 20 THEN 'daily' ELSE 'irregular' END AS ingestion_frequency FROM (
  SELECT target, CAST(creation_time AS DATE) AS d, job_type, count(*) AS jobs, sum(total_bytes) AS bytes, row_number() OVER (PARTITION BY target ORDER BY CAST(creation_time AS DATE) DESC, job_type) AS rn
  FROM (SELECT DISTINCT target, job_id, creation_time, job_type, total_bytes FROM r WHERE creation_time >= now - INTERVAL 30 DAY) GROUP BY target, CAST(creation_time AS DATE), job_type) WHERE rn <= 30 GROUP BY target),
ad AS (SELECT source AS k, CAST(creation_time AS DATE) AS d, count(*) AS query_count, count(DISTINCT user_email) AS unique_users, avg(total_cost_ms) AS avg_cost FROM r
  WHERE creation_time >= now - INTERVAL 7 DAY AND job_type = 'QUERY' GROUP BY source, CAST(creation_time AS DATE)),
acc AS (SELECT k, avg(query_count) AS avg_daily_queries, CAST(sum(unique_users) AS BIGINT) AS unique_users_count, CASE WHEN avg(query_count) > 10 THEN 'high' ELSE 'low' END AS access_frequency FROM ad GROUP BY k),
deg AS (SELECT k, CAST(sum(i) AS BIGINT) AS input_count, CAST(sum(o) AS BIGINT) AS output_count FROM (SELECT target AS k, 1 AS i, 0 AS o FROM e UNION ALL SELECT source, 0, 1 FROM e) GROUP BY k),
rc AS (SELECT k, count(DISTINCT job_id) AS row_count FROM (SELECT target AS k, job_id FROM r UNION ALL SELECT source, NULL FROM r) GROUP BY k),
td AS (SELECT t.k, coalesce(input_count, 0) AS input_count, coalesce(output_count, 0) AS output_count, {LAYER.replace("(k,", "(t.k,")} AS transformation_type FROM t LEFT JOIN deg ON deg.k = t.k),
tp AS (SELECT *, CASE WHEN input_count + output_count = 0 THEN 'isolated' WHEN input_count + output_count <= 2 THEN 'simple' WHEN input_count + output_count <= 5 THEN 'moderate' ELSE 'complex' END AS complexity FROM td WHERE transformation_type <> 'unknown' OR input_count > 0),
dh AS (SELECT t.k, count(e.source) AS dependency_count, coalesce(string_agg(CASE WHEN row_count = 0 THEN source END, '|' ORDER BY source), '') AS critical_dependencies,
  CASE WHEN count(CASE WHEN row_count = 0 THEN 1 END) > 0 THEN 'critical' ELSE 'healthy' END AS dependency_health FROM t LEFT JOIN e ON e.target = t.k LEFT JOIN rc ON rc.k = e.source GROUP BY t.k)"""


def _sql(body):
    return with_views(JOB_REFS, BASE, body=body)


ORACLES = {
    "referenced_tables": _sql("SELECT job_id, source, target FROM r"),
    "upstream_tables": _sql("SELECT target AS table_key, source AS upstream FROM e"),
    "downstream_tables": _sql("SELECT source AS table_key, target AS downstream FROM e"),
    "ingestion_pattern": _sql("SELECT k AS table_key, round(avg_daily_jobs, 6) AS avg_daily_jobs, total_bytes, pattern_rows, ingestion_frequency FROM ing"),
    "access_days": _sql("SELECT k AS table_key, strftime(d, '%Y-%m-%d') AS day, query_count, unique_users, round(avg_cost, 6) AS avg_cost FROM ad"),
    "access_pattern": _sql("SELECT k AS table_key, round(avg_daily_queries, 6) AS avg_daily_queries, unique_users_count, access_frequency FROM acc"),
    "data_flows": _sql("""SELECT source, target, CASE WHEN source IN (SELECT k FROM t) THEN 'transformation' ELSE 'ingestion' END AS flow_type,
      coalesce(CASE WHEN source IN (SELECT k FROM t) THEN access_frequency ELSE ingestion_frequency END, 'unknown') AS frequency FROM e LEFT JOIN acc ON acc.k = e.source LEFT JOIN ing ON ing.k = e.target"""),
    "table_layers": _sql(f"SELECT k AS table_key, input_count, output_count, {LAYER} AS layer FROM deg"),
    "transformation_points": _sql("SELECT k AS table_key, input_count, output_count, transformation_type, complexity FROM tp"),
    "upstream_row_counts": _sql("SELECT target AS table_key, source AS upstream, row_count FROM e LEFT JOIN rc ON rc.k = e.source"),
    "dependency_health": _sql("SELECT k AS table_key, dependency_count, critical_dependencies, dependency_health FROM dh"),
    "lineage_report": _sql("""SELECT t.k AS table_key, coalesce(deg.input_count, 0) AS input_count, coalesce(deg.output_count, 0) AS output_count, row_count, round(avg_daily_jobs, 6) AS avg_daily_jobs, total_bytes,
      coalesce(ingestion_frequency, 'unknown') AS ingestion_frequency, round(avg_daily_queries, 6) AS avg_daily_queries, unique_users_count, coalesce(access_frequency, 'unknown') AS access_frequency,
      transformation_type, complexity, dependency_count, critical_dependencies, dependency_health
      FROM t LEFT JOIN deg ON deg.k = t.k LEFT JOIN rc ON rc.k = t.k LEFT JOIN ing ON ing.k = t.k LEFT JOIN acc ON acc.k = t.k LEFT JOIN tp ON tp.k = t.k LEFT JOIN dh ON dh.k = t.k"""),
}
# The same over whole days.
_DAYS = BASE
for _n in (7, 30):
    _DAYS = _DAYS.replace(f"creation_time >= now - INTERVAL {_n} DAY", f"CAST(creation_time AS DATE) >= CAST(now AS DATE) - {_n}")
ORACLES["lineage_from_rollup"] = with_views(BATCH_REFS, _DAYS, body=ORACLES["lineage_report"][ORACLES["lineage_report"].rindex("SELECT t.k AS table_key"):])
ORACLES["unnested_jobs"] = with_views(BATCH_REFS, body="SELECT job_id, user_email, job_type, total_bytes, concat(ref_dataset, '.', ref_table) AS source, concat(dst_dataset, '.', dst_table) AS target FROM job_refs")
