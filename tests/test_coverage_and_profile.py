import pytest
from pyspark.sql import functions as F

from sightline.functions import rules
from sightline.functions.columns import band, percent
from sightline.operators import catalog as cat
from sightline.operators import classify as cls
from sightline.operators import coverage as cov
from sightline.operators import longform as lf
from sightline.operators import profile as prof
from sightline.operators import sampling

ASSET = "hostname string, fqdn string, ip_address string, region string, country string, infra_type string, os string, class string, a_host string, a_log_type string, a_count bigint, b_host string, c_host string, c_sourcetype string, c_count bigint, log_count bigint"


def assets(spark, rows):
    names = [p.strip().split(" ")[0] for p in ASSET.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ASSET)


def test_repeated_and_missing_hosts(spark):
    df = assets(spark, [
        {"hostname": "h1", "region": "EU", "a_host": "h1"}, {"hostname": "h1", "region": "EU"}, {"hostname": "h2", "region": "EU"},
        {"hostname": None, "region": None, "c_host": "x"}, {"hostname": "h3", "region": None, "b_host": "h3"},
    ])
    row = cov.coverage_of(df).first()
    assert (row["total"], row["with_logging"], round(row["coverage_percentage"], 4)) == (3, 2, 66.6667)
    by = {r["region"]: (r["total_assets"], r["assets_with_logging"], r["coverage_percentage"]) for r in cov.coverage_by(df, "region").collect()}
    assert by == {"EU": (2, 1, 50.0), "Unknown": (1, 1, 100.0)}
    assert {r["log_source"]: r["assets_covered"] for r in cov.coverage_by_source(df).collect()} == {"A": 1, "B": 1, "C": 1}


def test_group_without_hosts_has_no_percentage(spark):
    df = assets(spark, [{"hostname": None, "region": "EU", "a_host": "x"}])
    row = cov.coverage_by(df, "region").first()
    assert (row["total_assets"], row["assets_with_logging"], row["coverage_percentage"]) == (0, 0, None)


def test_empty_inventory(spark):
    df = assets(spark, [])
    assert cov.coverage_of(df).first()["coverage_percentage"] is None
    assert [r["value"] for r in cov.kpi_table(df).collect()][:2] == [0.0, 0.0]
    assert cov.coverage_by_source(df).count() == 3


def test_roles_prefer_the_exact_log_type(spark):
    types, patterns = rules.ROLE_LOG_TYPES["Network"], rules.ROLE_SOURCE_TYPES["Network"]
    df = assets(spark, [
        {"hostname": "h1", "ip_address": "1", "a_log_type": "DNS", "c_sourcetype": "my_proxy"},
        {"hostname": "h2", "ip_address": "1", "a_log_type": "other", "c_sourcetype": "my_proxy"},
        {"hostname": "h3", "a_log_type": "other", "c_sourcetype": "nothing"},
    ])
    got = {r["log_type"]: (r["asset_count"], r["unique_ips"]) for r in cov.role_network(df, types, patterns).collect()}
    assert got == {"DNS": (1, 1), "my_proxy": (1, 1)}
    df = assets(spark, [{"hostname": "h1", "b_host": "h1"}, {"hostname": "h2", "a_log_type": "EDR"}])
    got = {r["log_type"]: (r["asset_count"], r["agent_coverage"]) for r in cov.role_endpoint(df, rules.ROLE_LOG_TYPES["Endpoint"], rules.ROLE_SOURCE_TYPES["Endpoint"]).collect()}
    assert got == {"Other": (1, 1), "EDR": (1, 0)}


def test_gaps(spark):
    df = assets(spark, [{"hostname": "h1", "a_host": "h1", "b_host": "h1", "c_host": "h1"}, {"hostname": "h2", "a_host": "h2"}, {"hostname": "h3"}])
    assert [r["hostname"] for r in cov.uncovered_assets(df).collect()] == ["h3"]
    assert [tuple(r)[:4] for r in cov.partially_covered_assets(df).collect()] == [("h2", "Yes", "No", "No")]
    assert [r["hostname"] for r in cov.hosts_in_no_source(df).collect()] == ["h3"]


def test_coverage_shuffles_with_partial_aggregation(spark):
    df = assets(spark, [{"hostname": "h1"}])
    plan = cov.coverage_by(df, "region")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "partial_" in plan


def test_approximate_counts_are_close(spark):
    df = spark.range(5000).select(F.concat(F.lit("h"), F.col("id")).alias("hostname"), F.lit("EU").alias("region"), F.when(F.col("id") % 2 == 0, "x").alias("a_host"), F.lit(None).cast("string").alias("b_host"), F.lit(None).cast("string").alias("c_host"))
    row = cov.coverage_by(df, "region", approx=True).first()
    assert abs(row["total_assets"] - 5000) < 500 and abs(row["coverage_percentage"] - 50) < 8


def test_bands_at_the_bounds(spark):
    df = spark.createDataFrame([(0.8,), (0.7,), (0.3,)], "v double")
    pick = lambda inclusive: [r[0] for r in df.select(band("v", [(0.8, "a"), (0.7, "b")], "c", inclusive)).collect()]
    assert pick(True) == ["a", "b", "c"] and pick(False) == ["b", "c", "c"]
    assert spark.range(1).select(percent(F.lit(1), F.lit(0))).first()[0] is None


# ---------------------------------------------------------------------------- profiles
def stats_of(spark, columns, schema):
    df = spark.createDataFrame(columns, schema)
    long = lf.to_long(df, "t", None, keep_nulls=True)
    return prof.column_stats(prof.value_groups(long))


def test_profile_edges(spark):
    rows = [(None, "same", f"u{i}", "x" * (1 + 20 * i)) for i in range(4)]
    stats = stats_of(spark, rows, "empty string, one string, uniq string, sizes string")
    got = {r["column"]: r for r in prof.profile_columns(stats).collect()}
    assert (got["empty"]["n_null"], got["empty"]["completeness"], got["empty"]["distribution"], got["empty"]["consistency"]) == (4, 0.0, "unknown", "unknown")
    assert (got["one"]["n_distinct"], got["one"]["distribution"], got["one"]["consistency"]) == (1, "repetitive", "consistent")
    assert got["uniq"]["distribution"] == "highly_unique"
    assert got["sizes"]["consistency"] == "variable"


def test_single_row_is_variable(spark):
    stats = stats_of(spark, [("abc",)], "c string")
    row = prof.profile_columns(stats).first()
    assert row["consistency"] == "variable" and stats.first()["std_length"] is None


def test_distribution_bounds_are_exclusive(spark):
    half = stats_of(spark, [("a",), ("a",), ("b",), ("b",)], "c string")
    assert prof.profile_columns(half).first()["distribution"] == "repetitive"
    most = stats_of(spark, [(f"v{min(i, 18)}",) for i in range(20)], "c string")
    row = prof.profile_columns(most).first()
    assert (row["unique_ratio"], row["distribution"]) == (0.95, "moderately_unique")


def test_long_values_are_told_apart(spark):
    stats = stats_of(spark, [("x" * 5000 + "a",), ("x" * 5000 + "b",), ("x" * 5000 + "b",)], "c string")
    assert stats.first()["n_distinct"] == 2


def test_formats(spark):
    good = {
        "email": "a@b.org", "ip_address": "10.0.0.1", "uuid": "123e4567-e89b-12d3-a456-426614174000",
        "timestamp": "2024-01-02 03:04:05.6", "url": "http://x.y/z", "phone": "+1 (555) 123-4567",
    }
    rows = [tuple(good.values())] * 5 + [("none",) * 6]
    stats = stats_of(spark, rows, ", ".join(f"{n} string" for n in good))
    assert {r["column"]: r["formats"] for r in prof.profile_columns(stats).collect()} == {n: [n] for n in good}
    four_of_five = stats_of(spark, [("a@b.org",)] * 4 + [("none",)], "c string")
    assert prof.profile_columns(four_of_five).first()["formats"] == []


def test_table_quality_ignores_single_values(spark):
    df = spark.createDataFrame([("aa", None), ("bb", "x")], "a string, b string")
    stats = prof.column_stats(prof.value_groups(lf.to_long(df, "t", None, keep_nulls=True)))
    row = prof.table_quality(stats, cat.measured_columns("d", {"t": df})).first()
    assert (row["completeness"], row["consistency"], row["overall_score"]) == (0.75, 1.0, 0.875)


def test_sample_values_and_profile_table(spark):
    df = spark.createDataFrame([(i, None if i == 0 else f"v{i}") for i in range(9)], "id int, v string")
    row = prof.profile_table(lf.to_long(df, "t", "id", ["v"], keep_nulls=True)).first()
    assert row["samples"] == ["v1", "v2", "v3", "v4", "v5"] and row["n_null"] == 1


def test_field_meaning_scores_each_value(spark):
    df = spark.createDataFrame([(f"10.0.0.{i}", f"web{i}.example.com", "plain") for i in range(12)], "addr string, machine string, other string")
    got = {r["column"]: (r["semantic_type"], r["confidence"], r["relevance"]) for r in prof.field_meaning(lf.to_long(df, "t")).collect()}
    assert got["addr"] == ("ip_address", 1.0, 0.9)
    assert got["machine"] == ("hostname", 1.0, 0.9)
    assert got["other"] == ("unknown", 0.0, 0.3)


def test_field_meaning_looks_at_all_values(spark):
    # One value in twenty is an address; a look at a few may miss it.
    df = spark.createDataFrame([(f"10.0.0.{i}" if i % 20 == 0 else f"v{i}",) for i in range(200)], "other string")
    row = prof.field_meaning(lf.to_long(df, "t")).first()
    assert (row["semantic_type"], row["sample_count"]) == ("ip_address", 200) and 0 < row["confidence"] < 0.1
    quick = prof.field_meaning(lf.to_long(df, "t"), 100, 10).first()
    assert quick["sample_count"] == 100


def test_requirement_reports(spark):
    df = spark.createDataFrame([(f"10.0.0.{i % 12}",) for i in range(100)], "addr string")
    long = lf.to_long(df, "t")
    chosen = prof.fields_for_requirements(prof.field_meaning(long))
    assert {r["requirement"] for r in chosen.collect()} == {"asset_coverage", "network_visibility"}
    out = prof.requirement_reports(long, chosen).groupBy("requirement").count().collect()
    assert {r["requirement"]: r["count"] for r in out} == {"asset_coverage": 10, "network_visibility": 12}


def test_reports_do_not_deal_values_out_by_column(spark, capsys):
    long = lf.to_long(spark.createDataFrame([(f"10.0.0.{i % 12}",) for i in range(100)], "addr string"), "t")
    chosen = prof.fields_for_requirements(prof.field_meaning(long))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        prof.requirement_reports(long, chosen).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_a_task_keeps_only_its_first_values(spark):
    rows = [("t", f"c{i % 2}", None if i % 50 == 0 else str(i % 300), f"v{i % 7}") for i in range(1000)]
    long = spark.createDataFrame(rows, "table string, column string, row_id string, value string").repartition(3)
    assert prof._first_of_each_task(long, 4).count() <= 3 * 2 * 4
    got = {r["column"]: r["samples"] for r in prof.sample_values(long, 25).collect()}
    for c in ("c0", "c1"):
        want = sorted((r[2] is not None, r[2] or "", r[3]) for r in rows if r[1] == c)[:25]
        assert got[c] == [v for *_, v in want]


# -------------------------------------------------------------------- catalog and rules
def test_registered_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS probe")
    spark.sql("DROP TABLE IF EXISTS probe.events_log")
    spark.sql("CREATE TABLE probe.events_log (user_name STRING, day DATE) USING parquet PARTITIONED BY (day)")
    try:
        assert "probe" in {r["dataset"] for r in cat.list_datasets(spark).collect()}
        assert [r["table"] for r in cat.list_tables(spark, "probe").collect()] == ["events_log"]
        flags = {r["column"]: r["is_partition"] for r in cat.list_columns(spark, "probe", ["events_log"]).collect()}
        assert flags == {"user_name": False, "day": True}
    finally:
        spark.sql("DROP TABLE probe.events_log")
        spark.sql("DROP DATABASE probe")


def test_system_and_scratch_tables_are_left_out(spark):
    rows = [("sys", "a"), ("d", "x_BACKUP_1"), ("d", "temp_y"), ("d", "tempy"), ("INFORMATION_SCHEMA", "b")]
    df = spark.createDataFrame(rows, "dataset string, table string")
    assert [r["table"] for r in cat.without_system_tables(df).collect()] == ["tempy"]


def test_table_stats_of_empty_table(spark):
    row = cat.table_stats({"e": spark.createDataFrame([], "s string")}, {"e": ["s"]}).first()
    assert (row["row_count"], row["text_bytes"]) == (0, 0)


@pytest.mark.parametrize("column, role, kind, privacy, factors", [
    ("src_ip_addr", "network", "ip_address", "public", ["ipam_public_ip_coverage"]),
    ("user_email", "identity_authentication", "user_info", "restricted", []),
    ("session_token", "application", "general_string", "confidential", []),
    ("hostname", "endpoint", "system_info", "restricted", ["url_fqdn_coverage", "cmdb_asset_visibility"]),
    ("qty", "unclassified", "general_string", "public", []),
])
def test_name_rules(spark, column, role, kind, privacy, factors):
    df = spark.createDataFrame([("d", "t", column, "STRING")], "dataset string, table string, column string, data_type string")
    row = cls.classify_fields(df).withColumn("content_kind", cls.content_kind()).first()
    assert (row["log_role"], row["content_kind"], row["privacy_level"], row["visibility_factors"]) == (role, kind, privacy, factors)


def test_related_roles_and_relations(spark):
    rows = [("d", "t", c, "string") for c in ["src_ip", "hostname", "vpc", "user_id", "qty"]]
    fields = cls.classify_fields(spark.createDataFrame(rows, "dataset string, table string, column string, data_type string"))
    got = {r["column"]: r for r in cls.meaning_report(fields).collect()}
    assert got["src_ip"]["related_roles"] == ["cloud", "endpoint", "identity_authentication"]
    assert got["user_id"]["dependency_fields"] == ["session", "authentication", "domain"]
    assert got["user_id"]["correlation_potential"] == "high correlation potential"
    assert got["hostname"]["threat_relevance"] == "contributes to general threat detection capabilities"


def test_label_scoring_with_and_without_model(spark):
    df = spark.createDataFrame([("1", "network traffic analysis of x"), ("2", None)], "id string, text string")
    plain = {r["id"]: [x["label"] for x in r["labels"]] for r in cls.score_labels(df, "text", rules.THEME_LABELS, 1).collect() if r["labels"]}
    assert plain["1"] == ["network_traffic_analysis"]

    def load():
        return lambda texts, labels: [[float(len(t) % (i + 2)) for i in range(len(labels))] for t in texts]

    scored = cls.score_labels(df, "text", ["a", "b", "c"], 2, load).collect()
    assert [len(r["labels"]) for r in scored] == [2, 2]


def test_clusters_need_more_than_five_rows(spark):
    names = lambda n: spark.createDataFrame([(f"field_{i}",) for i in range(n)], "column string")
    assert cls.cluster_fields(cls.name_vectors(names(5))).filter("cluster is not null").count() == 0
    assert cls.cluster_fields(cls.name_vectors(names(9))).select("cluster").distinct().count() <= 3


def test_samples_are_repeatable(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    once = [r["k"] for r in sampling.sample_rows(df, "k", 0.1, 500).collect()]
    assert once == [r["k"] for r in sampling.sample_rows(df.repartition(7), "k", 0.1, 500).collect()]
    assert 120 < len(once) < 280
    assert len(sampling.sample_rows(df, "k", 0.5, 20).collect()) == 20
    many = spark.range(10_000).withColumnRenamed("id", "k")
    assert [sampling.sample_rows(many, "k", r, 20_000).count() for r in (0, 1e-8, 1.0)] == [0, 0, 10_000]
    assert 0 < sampling.sample_rows(spark.range(4_000_000).withColumnRenamed("id", "k"), "k", 1e-6, 100).count() < 20
    assert len({r["k"] for r in sampling.sample_k(df, "k", 50).collect()}) == 50


# ------------------------------------------------------------- one pass over a table
def wide_rows(spark, n=400):
    rows = [(i, f"user{i}@example.com" if i % 5 else None, "x" * (i % 3), float(i % 7), None) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, mail string, short string, v double, nothing string")


def test_one_pass_gives_what_the_long_form_gives(spark):
    tables = {"t": wide_rows(spark), "empty": wide_rows(spark).limit(0)}
    exact = {(r["table"], r["column"]): r for r in prof.column_stats(prof.value_groups(lf.union_tables(tables, keep_nulls=True)[0])).collect()}
    got = {(r["table"], r["column"]): r for r in prof.sketched_stats(prof.column_sums(tables)).collect()}
    assert {k for k in got if k[0] == "t"} == set(exact)
    for key, want in exact.items():
        for c in ("n_rows", "n_null"):
            assert got[key][c] == want[c]
        if key[1] in ("mail", "short", "nothing"):
            for c in ("mean_length", "std_length"):
                assert got[key][c] == pytest.approx(want[c], abs=1e-9)
            assert (got[key]["_share_email"] or 0) == pytest.approx(want["_share_email"] or 0)  # no match: null there, 0 here
        assert abs(got[key]["n_distinct"] - want["n_distinct"]) <= 4 * prof.SKETCH_ERROR * want["n_distinct"] + 1
    assert got["empty", "mail"]["n_rows"] == 0 and got["empty", "mail"]["n_distinct"] == 0


def test_sums_of_parts_add_up(spark):
    df = wide_rows(spark)
    whole = prof.sketched_stats(prof.column_sums({"t": df}))
    parts = prof.added_sums(*[prof.column_sums({"t": df.where(f"id % 3 = {i}")}) for i in range(3)])
    rounded = lambda s: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in s.collect())
    assert rounded(prof.sketched_stats(parts)) == rounded(whole)


def test_distinct_counts_near_a_bound_are_exact(spark):
    df = spark.range(20_000).selectExpr("CAST(id AS string) AS unique", "CAST(id % 10000 AS string) AS half", "CAST(id % 3 AS string) AS few")
    stats = prof.with_exact_near(prof.sketched_stats(prof.column_sums({"t": df}, {}), {}), {"t": df}, (0.5,))
    got = {r["column"]: r["n_distinct"] for r in stats.collect()}
    assert got["half"] == 10_000 and got["few"] == 3 and abs(got["unique"] - 20_000) < 20_000 * 4 * prof.SKETCH_ERROR


# ----------------------------------------------------------------- labels, names, clusters
def test_labels_see_every_value_to_its_end(spark):
    rows = [("t", "a", str(i), "nothing here") for i in range(300)] + [("t", "a", str(1000 + i), "x" * 5000 + " threat intelligence") for i in range(100)]
    rows += [("t", "user_name", "1", None), ("t", "b", "1", "user authentication data"), ("t", "empty", "1", None)]
    long = spark.createDataFrame(rows, "table string, column string, row_id string, value string")
    got = {r["column"]: (r["n_values"], r["labels"][0]["label"], r["labels"][0]["score"]) for r in cls.column_labels(long, rules.CONTENT_LABELS).collect()}
    assert got["a"] == (400, "threat_intelligence_data", pytest.approx(100 * 2 / (400 * 3)))
    assert got["b"] == (1, "user_authentication_data", 1.0) and "empty" not in got


def test_primary_meaning_and_similar_fields_in_the_report(spark):
    long = spark.createDataFrame([("t", "traffic", "1", "network traffic"), ("t", "zzz", "1", "q")], "table string, column string, row_id string, value string")
    meaning = {r["column"]: r["primary_meaning"] for r in cls.primary_meaning(long).collect()}
    assert meaning == {"traffic": "stores network traffic information", "zzz": None}
    fields = spark.createDataFrame([("d", "t", "user_name"), ("d", "t", "user_names"), ("d", "u", "zzz"), ("d", "t", "traffic")], "dataset string, table string, column string")
    similar = {r["column"]: r["similar_fields"] for r in cls.similar_fields(fields).collect()}
    assert similar == {"user_name": ["t.user_names"], "user_names": ["t.user_name"], "zzz": [], "traffic": []}
    classified = fields.withColumns({"log_role": F.lit("network"), "data_type": F.lit("string")})
    report = {r["column"]: r for r in cls.meaning_report(classified, None, cls.primary_meaning(long), cls.similar_fields(fields)).collect()}
    assert report["traffic"]["primary_meaning"] and report["user_name"]["similar_fields"] == ["t.user_names"] and report["zzz"]["primary_meaning"] is None


def test_cluster_faults_tell_good_from_bad(spark):
    rows = [(i, [float(i % 2) * 10 + i / 1000, 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>")
    good = cls.cluster_faults(cls.cluster_arrays(df, "vec", most=2), "id").collect()
    assert sorted((r["n"], r["misplaced"]) for r in good) == [(20, 0), (20, 0)]
    bad = cls.cluster_faults(df.withColumn("cluster", (F.col("id") < 3).cast("int")), "id").collect()
    assert sum(r["misplaced"] for r in bad) > 0
