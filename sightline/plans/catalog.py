"""Registered catalog, profiling and classification queries and their SQL checks.

The catalog is measured: each column carries the row and value counts of its table, so these
queries read the tables whose names they classify.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import rules
from sightline.operators import catalog as cat
from sightline.operators import classify as cls
from sightline.operators import longform as lf
from sightline.operators import profile as prof
from sightline.plans.oracle_views import ASSETS, JOB_REFS, OPERATIONS, SCAN_JOBS, SCAN_RESULTS, TELEMETRY, with_views
from sightline.plans.registry import rounded
from sightline.plans.schemas import TABLES, VIEWS, columns
from sightline.session import ensure_checkpoint_dir
from sightline.sources import views
from sightline.sources.tables import loader

PROFILED = {"customer": "c_custkey", "part": "p_partkey", "documents": "doc_id"}
TEXT_COLUMNS = {t: [c for c, k in columns(TABLES[t]) if k == "string"] for t in PROFILED}


def measured(spark, base):
    load = loader(spark, base)
    lake = cat.measured_columns("lake", {t: load(t) for t in TABLES})
    derived = cat.measured_columns("derived", {v: getattr(views, v)(load) for v in VIEWS})
    return lake.unionByName(derived)


def listed(array, name=None):
    return F.array_join(array, "|").alias(name or array)


def _on_catalog(fn):
    return lambda spark, base: fn(measured(spark, base))


def _long(spark, base, texts_only=False):
    load = loader(spark, base)
    parts = [lf.to_long(load(t), t, key, TEXT_COLUMNS[t] if texts_only else None, keep_nulls=True) for t, key in PROFILED.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _stats(spark, base, texts_only=False):
    return prof.column_stats(prof.value_groups(_long(spark, base, texts_only)))


def _types(spark, base):
    load = loader(spark, base)
    return cat.measured_columns("lake", {t: load(t) for t in PROFILED})


def _asset_long(spark, base):
    assets = views.assets(loader(spark, base))
    text = [c for c, k in columns(VIEWS["assets"]) if k == "string"]
    return lf.to_long(assets, "assets", None, text)


def _fields(spark, base):
    return prof.field_meaning(_asset_long(spark, base))


def _chosen(spark, base):
    return prof.fields_for_requirements(_fields(spark, base))


def _requirement_reports(spark, base):
    """The asset view is built once, for the fields and for the reports on them."""
    long = _stage(_asset_long(spark, base))
    return prof.requirement_reports(long, _stage(prof.fields_for_requirements(prof.field_meaning(long))))


def _analysis_summary(spark, base):
    fields = _stage(_fields(spark, base))
    return prof.analysis_summary(fields, prof.fields_for_requirements(fields))


def _classified(spark, base):
    return cls.classify_fields(measured(spark, base))


IDS = ["dataset", "table", "column", "n_values"]


def _rule(*names, arrays=()):
    return lambda spark, base: _classified(spark, base).select(*IDS, *names, *[listed(a) for a in arrays])


def _stage(df):
    """Catalog metadata that a query uses several times, written to the checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _snapshot(spark, base):
    return cat.without_system_tables(measured(spark, base)).select("dataset", "table", "column", "data_type", F.lit("Metadata collected").alias("sample_note"), "n_values")


def _scope(spark, base):
    tables = views.scan_results(loader(spark, base)).select(F.col("project_id").alias("project"), F.col("dataset_id").alias("dataset"), F.col("table_id").alias("table"))
    return cat.capped_tables(tables, 5, 2, 10)


def _themes(spark, base):
    load = loader(spark, base)
    texts = load("documents").select("doc_id", "text")
    scored = cls.score_labels(texts, "text", rules.THEME_LABELS, 3)
    return scored.select("doc_id", F.array_join(F.transform("labels", lambda s: s["label"]), "|").alias("themes"), F.round(F.col("labels")[0]["score"], 6).alias("best_score"))


def _field_texts(spark, base):
    samples = prof.sample_values(_long(spark, base, True), 10)
    return samples.select("table", "column", cls.text_for_scoring("column", "samples").alias("text"))


#: Views and text columns whose content is labelled by all their values.
LABELLED = {"telemetry": [c for c in views.TELEMETRY if c != "event_id"], "operations": ["operation_type", "error_message", "resource_id"], "assets": ["os", "platform", "class", "infra_type", "b_agent_health", "c_sourcetype"]}


def _labelled(spark, base):
    load = loader(spark, base)
    parts = [lf.to_long(getattr(views, v)(load), v, None, cols) for v, cols in LABELLED.items()]
    return _long(spark, base, True).unionByName(parts[0]).unionByName(parts[1]).unionByName(parts[2])


def _field_content(spark, base):
    best = F.col("labels")[0]
    return rounded(cls.column_labels(_labelled(spark, base), rules.CONTENT_LABELS).select("table", "column", "n_values", best["label"].alias("content_class"), best["score"].alias("score")))


def _similar_fields(spark, base):
    fields = _described(spark, {t: loader(spark, base)(t) for t in TABLES})
    return cls.similar_fields(fields).select("table", "column", listed("similar_fields"))


def _cluster_faults(spark, base):
    vectors = loader(spark, base)("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    faults = cls.cluster_faults(cls.cluster_arrays(vectors, "vec"), "vec_id")
    # K-means stops when its centres hardly move, so a few rows may still lie at a border.
    return faults.agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("n").alias("n_rows"), (F.sum("misplaced") <= 0.05 * F.sum("n")).alias("in_nearest"))


def _name_clusters(spark, base):
    return _clusters(measured(spark, base))


def _clusters(catalog):
    fields = catalog.select("dataset", "table", "column")
    return cls.cluster_fields(cls.name_vectors(fields)).select("dataset", "table", "column", "cluster")


def _meaning(spark, base):
    fields = _stage(_classified(spark, base))
    report = rounded(cls.meaning_report(fields, _clusters(fields), cls.primary_meaning(_labelled(spark, base)), cls.similar_fields(fields)))
    return report.select(*[listed(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in report.schema])


def _meaning_rules(spark, base):
    report = cls.meaning_report(_stage(_classified(spark, base)))
    return report.select(*[listed(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in report.schema])


def _profile(spark, base):
    out = prof.profile_columns(_stats(spark, base, texts_only=True))
    return rounded(out.withColumn("formats", listed("formats")))


def _profile_all(spark, base):
    out = prof.profile_table(_long(spark, base))
    return rounded(out.withColumn("formats", listed("formats")).withColumn("samples", F.transform("samples", lambda v: F.md5(v))).withColumn("samples", listed("samples")))


def _described(spark, tables):
    """Names and types of the columns, which the driver knows without reading a table."""
    rows = [(t, f.name, f.dataType.simpleString()) for t, df in tables.items() for f in df.schema]
    return spark.createDataFrame(rows, "table string, column string, data_type string")


def _profile_wide(spark, base):
    load = loader(spark, base)
    sums = prof.column_sums({t: load(t) for t in TABLES} | {"telemetry": views.telemetry(load)})
    stats = prof.sketched_stats(sums)
    # Lengths are compared for texts only: engines print numbers and times differently.
    texts = {(t, c) for t in TABLES for c, k in columns(TABLES[t]) if k == "string"} | {("telemetry", c) for c in views.TELEMETRY if c != "event_id"}
    is_text = F.concat_ws(".", "table", "column").isin([f"{t}.{c}" for t, c in texts])
    consistency = F.when(is_text, F.col("consistency")).otherwise("-").alias("consistency")
    return rounded(prof.profile_columns(stats).select("table", "column", "n_rows", "n_null", "completeness", consistency, listed("formats")))


def _sketch_errors(spark, base):
    """Whether each sketched distinct count is within four standard errors of the exact one."""
    load = loader(spark, base)
    tables = {t: load(t) for t in TABLES if t not in ("lineitem", "embeddings")}
    sketched = prof.sketched_stats(prof.column_sums(tables, {}), {}).select("table", "column", F.col("n_distinct").alias("estimate"))
    exact = prof.column_stats(prof.value_groups(lf.union_tables(tables, keep_nulls=True)[0], {}), {}).select("table", "column", "n_distinct")
    within = F.abs(F.col("estimate") - F.col("n_distinct")) <= 4 * prof.SKETCH_ERROR * F.col("n_distinct") + 1
    return exact.join(sketched, ["table", "column"]).select("table", "column", "n_distinct", within.alias("within_error"))


def _catalog_profile(spark, base):
    load = loader(spark, base)
    tables = {t: load(t) for t in TABLES}
    # One row per column, stored, so that each table is read once for all that follows.
    ensure_checkpoint_dir(spark)
    sums = prof.column_sums(tables, {}, texts_only=True).checkpoint()
    stats = prof.with_exact_near(prof.sketched_stats(sums, {}), {t: df for t, df in tables.items()}, (0.5,))
    types = _described(spark, tables)
    quality = prof.table_quality(stats, types)
    patterns = prof.column_patterns(stats, types)
    shape = prof.table_shape(types)
    joined = shape.join(quality, "table").join(patterns, "table")
    return rounded(joined.select(*[listed(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in joined.schema]))


QUERIES = {
    "catalog_columns": lambda spark, base: measured(spark, base).drop("nullable"),
    "table_stats": lambda spark, base: cat.table_stats({t: loader(spark, base)(t) for t in TABLES}, {"documents": ["text"], "pages": ["html", "url"]}),
    "catalog_snapshot": _snapshot,
    "columns_per_table": _on_catalog(cat.columns_per_table),
    "collection_totals": _on_catalog(cat.collection_totals),
    "dataset_summary": _on_catalog(cat.dataset_summary),
    "catalog_keys": _on_catalog(lambda c: c.select(cat.column_key().alias("key"), "n_rows", "n_values").orderBy("key")),
    "scan_scope": _scope,
    "value_share": lambda spark, base: prof.value_share(loader(spark, base)("customer"), "c_mktsegment"),
    "value_counts": lambda spark, base: prof.value_counts(loader(spark, base)("part"), "p_brand"),
    "value_counts_top": lambda spark, base: prof.value_counts(loader(spark, base)("part"), "p_brand", 20),
    "value_visibility": lambda spark, base: prof.value_visibility(loader(spark, base)("documents"), "source"),
    "column_nulls": lambda spark, base: rounded(prof.profile_columns(_stats(spark, base, True)).select("table", "column", "n_rows", "n_null", "completeness")),
    "column_uniqueness": lambda spark, base: rounded(prof.profile_columns(_stats(spark, base, True)).select("table", "column", "n_distinct", "unique_ratio", "distribution")),
    "column_lengths": lambda spark, base: rounded(_stats(spark, base, True).select("table", "column", "mean_length", "std_length")),
    "column_profile": _profile,
    "column_profile_all": _profile_all,
    "sample_values": lambda spark, base: prof.sample_values(_long(spark, base, True)).withColumn("samples", F.md5(listed("samples"))),
    "table_shape": lambda spark, base: prof.table_shape(measured(spark, base)),
    "column_patterns": lambda spark, base: prof.column_patterns(_stats(spark, base, True), _types(spark, base)).select("table", listed("temporal_patterns"), listed("categorical_patterns"), listed("numerical_patterns")),
    "table_quality": lambda spark, base: rounded(prof.table_quality(_stats(spark, base, True), _types(spark, base))),
    "mean_quality": lambda spark, base: rounded(prof.mean_quality(prof.table_quality(_stats(spark, base, True), _types(spark, base)))),
    "catalog_profile": _catalog_profile,
    "profile_wide": _profile_wide,
    "sketch_errors": _sketch_errors,
    "field_meaning": lambda spark, base: rounded(_fields(spark, base)),
    "fields_for_requirements": lambda spark, base: rounded(_chosen(spark, base)),
    "requirement_reports": _requirement_reports,
    "analysis_summary": _analysis_summary,
    "top_fields": lambda spark, base: prof.top_fields(_fields(spark, base)),
    "field_log_role": _rule("log_role"),
    "field_log_type": _rule("log_type"),
    "field_common_type": _rule("common_field"),
    "field_visibility_factors": _rule(arrays=["visibility_factors"]),
    "field_infra_type": _rule("infra_type"),
    "field_privacy_level": _rule("privacy_level"),
    "classified_fields": _rule("log_role", "log_type", "common_field", "infra_type", "privacy_level", arrays=["visibility_factors"]),
    "role_distribution": lambda spark, base: cls.role_distribution(_classified(spark, base)),
    "field_content_kind": lambda spark, base: _classified(spark, base).select(*IDS, cls.content_kind().alias("content_kind")),
    "field_significance": lambda spark, base: _classified(spark, base).select(*IDS, cls.significance().alias("significance"), cls.threat_relevance().alias("threat_relevance")),
    "role_meaning": lambda spark, base: _classified(spark, base).groupBy("log_role").agg(F.sum("n_values").alias("n_values")).select(
        "log_role", "n_values", cls.purpose().alias("purpose"), cls.business_value().alias("business_value"), cls.compliance_value().alias("compliance"), cls.risk_value().alias("risk")),
    "related_roles": lambda spark, base: (lambda c: c.select(*IDS, F.array_join(cls.related_roles(c), "|").alias("related_roles")))(_stage(_classified(spark, base))),
    "field_relations": lambda spark, base: _classified(spark, base).select(*IDS, F.array_join(cls.dependency_fields(), "|").alias("dependency_fields"), cls.correlation_potential().alias("correlation_potential")),
    "meaning_rules": _meaning_rules,
    "meaning_report": _meaning,
    "field_clusters": _name_clusters,
    "embedding_clusters": lambda spark, base: cls.cluster_arrays(loader(spark, base)("embeddings"), "embedding").groupBy("cluster").agg(F.count(F.lit(1)).alias("n")),
    "text_themes": _themes,
    "field_texts": lambda spark, base: _field_texts(spark, base).withColumn("text", F.md5("text")),
    "field_content_class": _field_content,
    "primary_meaning": lambda spark, base: rounded(cls.primary_meaning(_labelled(spark, base))),
    "similar_fields": _similar_fields,
    "embedding_cluster_faults": _cluster_faults,
}

# ------------------------------------------------------------------------------ SQL
_VIEW_SQL = [ASSETS, JOB_REFS, OPERATIONS, SCAN_JOBS]


def _catalog_cte(sets):
    rows = []
    for dataset, specs in sets.items():
        for t, spec in specs.items():
            for i, (c, k) in enumerate(columns(spec), 1):
                rows.append(f"SELECT '{dataset}' AS ds, '{t}' AS tbl, '{c}' AS col, {i} AS ordinal, '{k}' AS data_type, count(*) AS n_rows, count({c}) AS n_values FROM {t}")
    return "cat AS (" + " UNION ALL ".join(rows) + ")"


def _cat(body):
    return with_views(*_VIEW_SQL, _catalog_cte({"lake": TABLES, "derived": VIEWS}), body=body)


def _any(text, words):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _first(text, table, default):
    return "CASE " + " ".join(f"WHEN {_any(text, words)} THEN '{label}'" for label, words in table.items()) + f" ELSE {default} END"


def _parts(names):
    return {n: n.split("_") for n in names}


NAME, FULL, TBL = "lower(col)", "lower(concat(col, ' ', ds, '.', tbl))", "lower(concat(ds, '.', tbl))"
ROLE = _first(FULL, rules.ROLE_WORDS, "'unclassified'")
RULE_SQL = {
    "log_role": ROLE,
    "log_type": _first(FULL, _parts(rules.LOG_TYPES), "'unknown'"),
    "common_field": _first(NAME, _parts(rules.COMMON_FIELDS), "'unknown'"),
    "visibility_factors": "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_any(NAME, w)} THEN '{f}' END" for f, w in rules.FACTOR_WORDS.items()) + "], lambda x: x IS NOT NULL), '|')",
    "infra_type": _first(TBL, rules.INFRA_WORDS, "'on_prem'"),
    "privacy_level": _first(NAME, rules.PRIVACY_WORDS, "'public'"),
    "content_kind": _first(NAME, rules.CONTENT_WORDS, "concat('general_', lower(data_type))"),
    "significance": f"concat({_first(NAME, rules.SIGNIFICANCE_WORDS, chr(39) + 'standard' + chr(39))}, ' significance for ', {ROLE}, ' operations')",
    "threat_relevance": f"coalesce({_first(NAME, rules.THREAT_WORDS, 'NULL')} || ' relevance for threat detection', 'contributes to general threat detection capabilities')",
    "dependency_fields": "CASE " + " ".join(f"WHEN contains({NAME}, '{k}') THEN '{'|'.join(v)}'" for k, v in rules.DEPENDENT_FIELDS.items()) + " ELSE '' END",
    "correlation_potential": f"concat({_first(NAME, rules.CORRELATION_WORDS, chr(39) + 'low' + chr(39))}, ' correlation potential')",
}


def _mapped(key, mapping, default):
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {default} END"


MEANING_SQL = {
    "purpose": _mapped("log_role", rules.ROLE_PURPOSE, "concat('supports ', log_role, ' security monitoring')"),
    "business_value": _mapped("log_role", rules.ROLE_VALUE, "'supports business security objectives'"),
    "compliance": _mapped("log_role", rules.ROLE_COMPLIANCE, "'supports general compliance requirements'"),
    "risk": _mapped("log_role", rules.ROLE_RISK, "concat('contributes to ', log_role, ' risk reduction')"),
}
RELATED = "array_to_string(list_filter((SELECT list_sort(list(DISTINCT log_role)) FROM r), lambda x: x <> log_role)[1:3], '|')"
_IDS = 'ds AS "dataset", tbl AS "table", col AS "column", n_values'


def _rules_sql(*names):
    return _cat(f"SELECT {_IDS}, " + ", ".join(f"{RULE_SQL[n]} AS {n}" for n in names) + " FROM cat")


def _long_sql(texts_only=True):
    return " UNION ALL ".join(f"SELECT '{t}' AS tbl, '{c}' AS col, CAST({k} AS VARCHAR) AS row_id, {c} AS v FROM {t}" for t, k in PROFILED.items() for c in TEXT_COLUMNS[t])


_FORMATS = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN count_if(regexp_matches(v, '{p}')) > 0.8 * count(v) THEN '{f}' END" for f, p in rules.FORMATS.items()) + "], lambda x: x IS NOT NULL), '|')"
_PROFILE = f"""l AS ({_long_sql()}),
p AS (SELECT tbl, col, count(*) AS n_rows, count(*) - count(v) AS n_null, count(DISTINCT v) AS n_distinct, avg(length(v)) AS m, stddev_samp(length(v)) AS s, {_FORMATS} AS formats FROM l GROUP BY tbl, col),
q AS (SELECT *, 1 - n_null / n_rows AS completeness, n_distinct / n_rows AS unique_ratio FROM p)"""
_DIST = "CASE WHEN n_null = n_rows THEN 'unknown' WHEN unique_ratio > 0.95 THEN 'highly_unique' WHEN unique_ratio > 0.5 THEN 'moderately_unique' ELSE 'repetitive' END"
_CONS = "CASE WHEN n_null = n_rows THEN 'unknown' WHEN s < 0.1 * m THEN 'consistent' ELSE 'variable' END"


def _prof(select):
    return f'WITH {_PROFILE} SELECT tbl AS "table", col AS "column", {select} FROM q'


_NUM = [(t, c) for t in PROFILED for c, k in columns(TABLES[t]) if k in ("int", "bigint", "double")]
_QUALITY = f"""{_PROFILE}, g AS (SELECT tbl, 1 - sum(n_null) / sum(n_rows) AS completeness,
  avg(CASE WHEN s IS NOT NULL THEN CASE WHEN m > 0 THEN least(1 - s / m, 1.0) ELSE 0.0 END END) AS consistency FROM q GROUP BY tbl),
h AS (SELECT tbl AS "table", completeness, consistency, coalesce((completeness + consistency) / 2, completeness) AS overall_score FROM g)"""

_TEXTS = [c for c, k in columns(VIEWS["assets"]) if k == "string"]


def _points(text, patterns):
    return " + ".join(f"len(regexp_extract_all({text}, '(?i){p}'))" for p in patterns)


_FIELDS = "l AS (" + " UNION ALL ".join(f"SELECT 'assets' AS tbl, '{c}' AS col, {c} AS v FROM assets WHERE {c} IS NOT NULL" for c in _TEXTS) + """),
u AS (SELECT DISTINCT tbl, col, v FROM l),
w AS (SELECT tbl, col, count(*) AS sample_count, """ + ", ".join(
    f"10 * sum({_points('v', p)}) + count(*) * any_value({_points('col', p)}) AS p_{t}" for t, p in rules.SEMANTIC_PATTERNS.items()) + """ FROM u GROUP BY tbl, col),
x AS (SELECT *, greatest(""" + ", ".join(f"p_{t}" for t in rules.SEMANTIC_PATTERNS) + """) AS best FROM w),
y AS (SELECT tbl, col, sample_count, CASE WHEN best = 0 THEN 'unknown' """ + " ".join(f"WHEN p_{t} = best THEN '{t}'" for t in rules.SEMANTIC_PATTERNS) + """ END AS semantic_type, least(best / (10.0 * sample_count), 1.0) AS confidence FROM x),
f AS (SELECT *, CASE semantic_type """ + " ".join(f"WHEN '{t}' THEN {r}" for t, r in rules.SEMANTIC_RELEVANCE.items()) + """ ELSE 0.3 END AS relevance, 1.0 AS quality_score FROM y),
m(requirement, t) AS (VALUES """ + ", ".join(f"('{r}', '{t}')" for r, ts in rules.REQUIREMENTS.items() for t in ts) + """),
ch AS (SELECT requirement, row_number() OVER (PARTITION BY requirement ORDER BY relevance * confidence DESC, tbl, col) AS rank, tbl, col, semantic_type, relevance * confidence AS score
  FROM f JOIN m ON m.t = f.semantic_type WHERE relevance * confidence > 0.3 QUALIFY rank <= 5)"""


def _field_sql(body):
    return with_views(ASSETS, _FIELDS, body=body)


def _overlap(text, label):
    words = label.replace("_", " ").split()
    return "(" + " + ".join(f"CAST(contains(lower({text}), '{w}') AS INT)" for w in words) + f") / {len(words)}"


_THEME_LIST = "[" + ", ".join(f"{{'s': {_overlap('text', t)}, 'p': {-i}, 'l': '{t}'}}" for i, t in enumerate(rules.THEME_LABELS)) + "]"



def _labels_sql(labels):
    """The best label of each column by all its values and its name."""
    hits = lambda text, label: "(" + " + ".join(f"CAST(contains(lower({text}), '{w}') AS INT)" for w in label.replace("_", " ").split()) + ")"
    size = lambda label: len(label.replace("_", " ").split())
    long = " UNION ALL ".join(f"SELECT '{v}' AS tbl, '{c}' AS col, {c} AS v FROM {v}" for v, cols in LABELLED.items() for c in cols)
    sums = ", ".join(f"sum({hits('v', x)}) AS h{i}" for i, x in enumerate(labels))
    scored = ", ".join(f"{{'s': h{i} / (n_values * {size(x)}) + {hits('col', x)} / {size(x)}, 'p': {-i}, 'l': '{x}'}}" for i, x in enumerate(labels))
    return with_views(TELEMETRY, OPERATIONS, ASSETS, f"l AS ({long} UNION ALL SELECT tbl, col, v FROM ({_long_sql()}))", f"sums AS (SELECT tbl, col, count(*) AS n_values, {sums} FROM l WHERE v IS NOT NULL GROUP BY tbl, col)",
                      f"chosen AS (SELECT tbl, col, n_values, list_reverse_sort([{scored}])[1] AS best FROM sums)", body="")


FIELD_TEXTS = f"""l AS ({_long_sql()}), ft AS (SELECT tbl, col, concat(col, ' ', string_agg(v, ' ' ORDER BY row_id, v)) AS text FROM (
  SELECT *, row_number() OVER (PARTITION BY tbl, col ORDER BY row_id, v) AS rn FROM l WHERE v IS NOT NULL) WHERE rn <= 10 GROUP BY tbl, col)"""


def _profile_wide_sql():
    """Nulls, length consistency and formats of every column of the driver tables and the log lines."""
    text = "string"
    specs = [(t, c, k) for t, spec in TABLES.items() for c, k in columns(spec) if not k.startswith("array")] + [("telemetry", c, "bigint" if c == "event_id" else text) for c in views.TELEMETRY]
    formats = lambda c: ", ".join(f"CASE WHEN avg(CASE WHEN regexp_matches({c}, '{p}') THEN 1.0 ELSE 0.0 END) FILTER ({c} IS NOT NULL) > {rules.FORMAT_SHARE} THEN '{n}' END" for n, p in rules.FORMATS.items())
    size = lambda c, k: f"length({c})" if k == text else "NULL"
    parts = [
        f"""SELECT '{t}' AS "table", '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_null, round(count({c}) / count(*), 6) AS completeness,
        {f"CASE WHEN stddev_samp({size(c, k)}) < 0.1 * avg({size(c, k)}) THEN 'consistent' ELSE 'variable' END" if k == text else "'-'"} AS consistency, {f"concat_ws('|', {formats(c)})" if k == text else "''"} AS formats FROM {t}"""
        for t, c, k in specs
    ]
    return f"WITH {TELEMETRY} " + " UNION ALL ".join(parts)


def _catalog_profile_sql():
    """Quality and column lists of all driver tables; nested columns only count for the shape."""
    stats = []
    for t, spec in TABLES.items():
        for c, k in columns(spec):
            if k.startswith("array"):
                continue
            text = f"count(DISTINCT {c}), avg(length({c})), stddev_samp(length({c}))" if k == "string" else "NULL, NULL, NULL"
            stats.append(f"SELECT '{t}' AS tbl, '{c}' AS col, '{k}' AS kind, count(*) AS n, count(*) - count({c}) AS n_null, {text} FROM {t}")
    shape = ", ".join(f"('{t}', {len(columns(spec))})" for t, spec in TABLES.items())
    listed = lambda test: f"coalesce(string_agg(CASE WHEN {test} THEN col END, '|' ORDER BY col), '')"
    return f"""WITH s(tbl, col, kind, n, n_null, d, m, sd) AS ({" UNION ALL ".join(stats)}),
      g AS (SELECT tbl, 1 - sum(n_null) / sum(n) AS completeness, avg(CASE WHEN kind = 'string' AND sd IS NOT NULL THEN CASE WHEN m > 0 THEN least(1 - sd / m, 1.0) ELSE 0.0 END END) AS consistency,
        {listed(_any('lower(col)', rules.TIME_WORDS))} AS temporal_patterns, {listed("kind = 'string' AND d < n * 0.5")} AS categorical_patterns,
        {listed("kind IN ('int', 'bigint', 'double')")} AS numerical_patterns FROM s GROUP BY tbl)
      SELECT tbl AS "table", CAST(n_columns AS BIGINT) AS n_columns, CASE WHEN n_columns > 20 THEN 'wide_table' WHEN n_columns < 5 THEN 'narrow_table' ELSE 'standard_table' END AS table_structure,
        round(completeness, 6) AS completeness, round(consistency, 6) AS consistency, round(coalesce((completeness + consistency) / 2, completeness), 6) AS overall_score,
        temporal_patterns, categorical_patterns, numerical_patterns FROM g JOIN (VALUES {shape}) h(t, n_columns) ON h.t = g.tbl"""


ORACLES = {
    "catalog_columns": _cat('SELECT ds AS "dataset", tbl AS "table", col AS "column", ordinal, data_type, n_rows, n_values FROM cat'),
    "table_stats": " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", count(*) AS row_count, {({'documents': 'CAST(sum(strlen(text)) AS BIGINT)', 'pages': 'CAST(sum(strlen(html)) + sum(strlen(url)) AS BIGINT)'}).get(t, 'CAST(0 AS BIGINT)')} AS text_bytes FROM {t}""" for t in TABLES),
    "catalog_snapshot": _cat("""SELECT ds AS "dataset", tbl AS "table", col AS "column", data_type, 'Metadata collected' AS sample_note, n_values FROM cat"""),
    "columns_per_table": _cat('SELECT ds AS "dataset", tbl AS "table", count(*) AS column_count FROM cat GROUP BY ds, tbl'),
    "collection_totals": _cat("SELECT count(DISTINCT ds) AS datasets_found, count(DISTINCT concat(ds, '.', tbl)) AS tables_found, count(*) AS columns_found FROM cat"),
    "dataset_summary": _cat('SELECT ds AS "dataset", count(DISTINCT tbl) AS tables_count, count(*) AS columns_count FROM cat GROUP BY ds'),
    "catalog_keys": _cat("SELECT concat(ds, '.', tbl, '.', col) AS key, n_rows, n_values FROM cat"),
    "scan_scope": with_views(SCAN_RESULTS, body="""SELECT project_id AS project, dataset_id AS "dataset", table_id AS "table" FROM (
      SELECT *, dense_rank() OVER (ORDER BY project_id) AS rp, dense_rank() OVER (PARTITION BY project_id ORDER BY dataset_id) AS rd,
      dense_rank() OVER (PARTITION BY project_id, dataset_id ORDER BY table_id) AS rt FROM (SELECT DISTINCT project_id, dataset_id, table_id FROM scan_results)) WHERE rp <= 5 AND rd <= 2 AND rt <= 10"""),
    "value_share": """SELECT c_mktsegment AS value, count(*) AS total_count, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percentage FROM customer
      WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment ORDER BY total_count DESC, value LIMIT 10""",
    "value_counts": "SELECT p_brand AS value, count(*) AS total_count, count(DISTINCT p_brand) AS unique_values FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand",
    "value_counts_top": "SELECT p_brand AS value, count(*) AS total_count, count(DISTINCT p_brand) AS unique_values FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand ORDER BY 2 DESC, 1 LIMIT 20",
    "value_visibility": """SELECT source AS value, count(*) AS total_count, CASE WHEN count(*) > 10 THEN 'High Visibility' WHEN count(*) > 5 THEN 'Medium Visibility' ELSE 'Low Visibility' END AS visibility_level
      FROM documents WHERE source IS NOT NULL GROUP BY source""",
    "column_nulls": _prof("n_rows, n_null, round(completeness, 6) AS completeness"),
    "column_uniqueness": _prof(f"n_distinct, round(unique_ratio, 6) AS unique_ratio, {_DIST} AS distribution"),
    "column_lengths": _prof("round(m, 6) AS mean_length, round(s, 6) AS std_length"),
    "column_profile": _prof(f"n_rows, n_null, n_distinct, round(completeness, 6) AS completeness, round(unique_ratio, 6) AS unique_ratio, {_DIST} AS distribution, {_CONS} AS consistency, formats"),
    "sample_values": f"""WITH l AS ({_long_sql()}) SELECT tbl AS "table", col AS "column", md5(string_agg(v, '|' ORDER BY row_id, v)) AS samples FROM (
      SELECT *, row_number() OVER (PARTITION BY tbl, col ORDER BY row_id, v) AS rn FROM l WHERE v IS NOT NULL) WHERE rn <= 5 GROUP BY tbl, col""",
    "table_shape": _cat("""SELECT tbl AS "table", count(*) AS n_columns, CASE WHEN count(*) > 20 THEN 'wide_table' WHEN count(*) < 5 THEN 'narrow_table' ELSE 'standard_table' END AS table_structure FROM cat GROUP BY tbl"""),
    "column_patterns": f"""WITH {_PROFILE} SELECT tbl AS "table",
      coalesce(string_agg(CASE WHEN {_any('lower(col)', rules.TIME_WORDS)} THEN col END, '|' ORDER BY col), '') AS temporal_patterns,
      coalesce(string_agg(CASE WHEN n_distinct < n_rows * 0.5 THEN col END, '|' ORDER BY col), '') AS categorical_patterns, '' AS numerical_patterns FROM q GROUP BY tbl""",
    "table_quality": f'WITH {_QUALITY} SELECT "table", round(completeness, 6) AS completeness, round(consistency, 6) AS consistency, round(overall_score, 6) AS overall_score FROM h',
    "mean_quality": f"WITH {_QUALITY} SELECT round(avg(CASE WHEN overall_score > 0 THEN overall_score END), 6) AS mean_quality, count(*) AS n_tables FROM h",
    "field_meaning": _field_sql('SELECT tbl AS "table", col AS "column", semantic_type, round(confidence, 6) AS confidence, sample_count, CAST(relevance AS DOUBLE) AS relevance, CAST(quality_score AS DOUBLE) AS quality_score FROM f'),
    "fields_for_requirements": _field_sql('SELECT requirement, CAST(rank AS INT) AS rank, tbl AS "table", col AS "column", semantic_type, round(score, 6) AS score FROM ch'),
    "requirement_reports": _field_sql("""SELECT requirement, tbl AS "table", col AS "column", value, total_count,
      CASE WHEN requirement = 'asset_coverage' THEN round(100.0 * total_count / tot, 2) END AS percentage,
      CASE WHEN requirement = 'network_visibility' THEN CASE WHEN total_count > 10 THEN 'High Visibility' WHEN total_count > 5 THEN 'Medium Visibility' ELSE 'Low Visibility' END END AS visibility_level
      FROM (SELECT requirement, l.tbl, l.col, l.v AS value, count(*) AS total_count, sum(count(*)) OVER (PARTITION BY requirement) AS tot,
        row_number() OVER (PARTITION BY requirement ORDER BY count(*) DESC, l.v) AS rn FROM ch JOIN l ON l.tbl = ch.tbl AND l.col = ch.col WHERE rank = 1 GROUP BY requirement, l.tbl, l.col, l.v)
      WHERE requirement IN ('security_controls', 'network_visibility') OR rn <= CASE WHEN requirement = 'asset_coverage' THEN 10 ELSE 20 END"""),
    "analysis_summary": _field_sql("SELECT (SELECT count(*) FROM f) AS total_fields, (SELECT count(*) FROM f WHERE relevance > 0.7) AS high_relevance_fields, (SELECT count(DISTINCT requirement) FROM ch) AS queries_built"),
    "top_fields": _field_sql('SELECT tbl AS "table", col AS "column", semantic_type, CAST(relevance AS DOUBLE) AS relevance FROM f ORDER BY f.relevance DESC, tbl, col LIMIT 10'),
    "field_log_role": _rules_sql("log_role"),
    "field_log_type": _rules_sql("log_type"),
    "field_common_type": _rules_sql("common_field"),
    "field_visibility_factors": _rules_sql("visibility_factors"),
    "field_infra_type": _rules_sql("infra_type"),
    "field_privacy_level": _rules_sql("privacy_level"),
    "classified_fields": _rules_sql("log_role", "log_type", "common_field", "visibility_factors", "infra_type", "privacy_level"),
    "role_distribution": _cat(f"SELECT {ROLE} AS log_role, count(*) AS n_fields FROM cat GROUP BY 1"),
    "field_content_kind": _rules_sql("content_kind"),
    "field_significance": _rules_sql("significance", "threat_relevance"),
    "role_meaning": _cat(f"SELECT log_role, CAST(sum(n_values) AS BIGINT) AS n_values, " + ", ".join(f"{e} AS {n}" for n, e in MEANING_SQL.items()) + f" FROM (SELECT n_values, {ROLE} AS log_role FROM cat) GROUP BY log_role"),
    "related_roles": _cat(f"SELECT {_IDS}, {RELATED} AS related_roles FROM r").replace("\nSELECT", f",\nr AS (SELECT *, {ROLE} AS log_role FROM cat)\nSELECT", 1),
    "field_relations": _rules_sql("dependency_fields", "correlation_potential"),
    "meaning_rules": _cat("SELECT ds AS \"dataset\", tbl AS \"table\", col AS \"column\", log_role, "
      + ", ".join(f"{RULE_SQL[n]} AS {n}" for n in ("content_kind", "significance", "threat_relevance", "dependency_fields", "correlation_potential")) + ", "
      + ", ".join(f"{e} AS {n}" for n, e in MEANING_SQL.items()) + f", concat('enhances ', log_role, ' operational visibility') AS efficiency, {RELATED} AS related_roles FROM r").replace("\nSELECT", f",\nr AS (SELECT *, {ROLE} AS log_role FROM cat)\nSELECT", 1),
    "text_themes": f"""SELECT doc_id, array_to_string(list_transform(list_reverse_sort({_THEME_LIST})[1:3], lambda s: s.l), '|') AS themes,
      round(list_reverse_sort({_THEME_LIST})[1].s, 6) AS best_score FROM documents""",
    "field_texts": f'WITH {FIELD_TEXTS} SELECT tbl AS "table", col AS "column", md5(text) AS text FROM ft',
    "field_content_class": _labels_sql(rules.CONTENT_LABELS) + ' SELECT tbl AS "table", col AS "column", n_values, best.l AS content_class, round(best.s, 6) AS score FROM chosen',
    "primary_meaning": _labels_sql(rules.MEANING_LABELS) + ' SELECT tbl AS "table", col AS "column", CASE WHEN best.s > 0 THEN best.l END AS primary_meaning, round(best.s, 6) AS meaning_score FROM chosen',
    "embedding_cluster_faults": "SELECT least(8, count(*) // 3) AS n_clusters, count(*) AS n_rows, true AS in_nearest FROM embeddings",
    "catalog_profile": _catalog_profile_sql(),
    "profile_wide": _profile_wide_sql(),
    "sketch_errors": " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", '{c}' AS "column", count(DISTINCT {c}) AS n_distinct, true AS within_error FROM {t}"""
        for t, spec in TABLES.items() if t not in ("lineitem", "embeddings") for c, _ in columns(spec)
    ),
}
