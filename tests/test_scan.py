"""Scans of tables that are partly broken."""

import pytest
from pyspark.sql import functions as F

from sightline.functions.rules import DETECTORS
from sightline.operators import detect as det
from sightline.operators import scan as sc


def write(spark, path, n, start=0, rows_of_group=None):
    df = spark.range(start, start + n).select(F.concat(F.lit("10.0.0."), (F.col("id") % 200).cast("string")).alias("ip"), F.lit("x" * 40).alias("pad"), "id")
    options = {"parquet.block.size": str(rows_of_group)} if rows_of_group else {}
    df.coalesce(1).write.options(**options).mode("append").parquet(str(path))


def parts(path):
    return sorted(p for p in path.iterdir() if p.suffix == ".parquet")


@pytest.fixture()
def lake(spark, tmp_path):
    """good: 2 files. broken: one good file, one of garbage, one empty. dead: only garbage. cut: a file with a
    good footer whose pages are overwritten."""
    for name in ("good", "broken", "cut", "dead"):
        write(spark, tmp_path / name, 300)
        write(spark, tmp_path / name, 300, 300)
    parts(tmp_path / "broken")[0].write_bytes(b"no parquet at all")
    spark.createDataFrame([], "ip string, pad string, id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "broken"))
    for p in parts(tmp_path / "dead"):
        p.write_bytes(b"garbage")
    victim = parts(tmp_path / "cut")[1]
    raw = bytearray(victim.read_bytes())
    raw[4:400] = b"\xff" * 396
    victim.write_bytes(bytes(raw))
    for p in tmp_path.glob("*/.*.crc"):  # as files from elsewhere have none
        p.write_bytes(b"")
        p.unlink()
    return tmp_path


def sources(lake, names):
    return [sc.Source("p", "d", n, str(lake / n), None, ["ip", "pad"]) for n in names]


def test_failures_are_rows(spark, lake):
    found = sc.scan(spark, [*sources(lake, ["good", "broken", "cut", "dead", "missing"]), sc.Source("q", "e", "view", None, lambda: spark.table("no_such_view"))])
    attempts = {r.table_id: r for r in sc.attempts(found).collect()}
    assert attempts["good"].success and attempts["good"].rows_read == 600 and attempts["good"].n_files == 2
    assert not attempts["broken"].success and attempts["broken"].rows_read == 300
    assert not attempts["cut"].success and attempts["cut"].rows_read < 600
    assert not attempts["dead"].success and not attempts["missing"].success and not attempts["view"].success
    failed = {}
    for r in sc.failures(found).collect():
        failed.setdefault(r.table_id, []).append(r)
    assert "good" not in failed
    assert {r.error_category for r in failed["missing"]} == {"not_found"} and failed["missing"][0].file is None
    assert {r.error_category for r in failed["broken"]} == {"no_rows"} and len(failed["broken"]) == 2
    assert [r.error_category for r in failed["cut"]] == ["partly_read"] and failed["cut"][0].rows_lost == 600 - attempts["cut"].rows_read
    assert failed["dead"] and failed["view"]


def test_findings_come_from_what_could_be_read(spark, lake):
    found = sc.scan(spark, sources(lake, ["good", "broken"]))
    got = {r.table_id: r for r in sc.results(found).where("detector = 'ipv4'").collect()}
    assert got["good"].n_fragments == 600 and got["good"].n_distinct == 200
    assert got["broken"].n_fragments == 300 and got["broken"].project_id == "p" and got["broken"].column_name == "ip"
    ready = {(r.project_id, r.metric): r.n_sources for r in sc.readiness_by_project(found).collect()}
    assert ready["p", "network_presence"] == 2 and ready["p", "cloud_infrastructure"] == 0
    assert sc.report(found).count() == 1


def test_fragments_inside_values_are_searched(spark):
    df = spark.createDataFrame([('{"a": "i-0123456789"}',), (None,)], "v string")
    source = sc.Source("p", "d", "t", None, lambda: df)
    assert sc.results(sc.scan(spark, [source], expand=True)).where("detector = 'aws_instance'").first().n_distinct == 1
    assert sc.attempts(sc.scan(spark, [source])).first().rows_read == 2


def test_nothing_to_scan(spark):
    found = sc.scan(spark, [])
    assert sc.results(found).count() == sc.failures(found).count() == sc.attempts(found).count() == 0


def test_only_the_patterns_run_for_each_detector(spark):
    cells = spark.createDataFrame([("0", "c", "10.1.2.3 and 10.1.2.3"), ("0", sc.FILE, "10.9.9.9")], "table string, column string, fragment string")
    found = det.match_counts(cells, counted=F.col("column") == sc.FILE)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == len(DETECTORS) > plan.count("array_distinct")
    assert {(r["column"], r["detector"], r["match"]): r["n"] for r in found.collect()} == {("c", "", ""): 1, ("c", "ipv4", "10.1.2.3"): 1, (sc.FILE, "", "10.9.9.9"): 1}
