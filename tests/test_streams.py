"""Streams over files, in several micro-batches, against brute force and batch results."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.functions.rules import DETECTORS
from sightline.streaming import streams as st

SCHEMA = "user_id bigint, event_type string, event_id bigint, ts timestamp, success boolean, resource_id string, text string, value double"


def micros(minute):
    return 1_704_067_200_000_000 + minute * 60_000_000


def write(spark, folder, batches):
    """One file per batch, in order of arrival."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "user_id bigint, event_type string, event_id bigint, at bigint, success boolean, resource_id string, text string, value double")
        target = f"{folder}/part{i}"
        df.withColumn("ts", F.timestamp_micros("at")).drop("at").coalesce(1).write.parquet(target)


def stream(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(folder))


def event(i, minute, user=1, kind="a", ok=True, resource="r", text="", value=1.0):
    return (user, kind, i, micros(minute), ok, resource, text, value)


@pytest.fixture()
def calls():
    rnd = random.Random(2)
    rows = [event(i, i * 2, user=rnd.randrange(2), ok=rnd.random() < 0.4, resource=f"r{rnd.randrange(2)}") for i in range(120)]
    return [rows[:40], rows[40:80], rows[80:]]


def stored_table(spark, folder, calls):
    """A table as a folder of four files, newest first."""
    rows = sorted((r for b in calls for r in b), key=lambda r: r[2])
    parts = [rows[i : i + 30] for i in range(0, 120, 30)][::-1]
    for i, part in enumerate(parts):
        df = spark.createDataFrame(part, "user_id bigint, event_type string, event_id bigint, at bigint, success boolean, resource_id string, text string, value double")
        df.withColumn("ts", F.timestamp_micros("at")).drop("at").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
        df.withColumn("ts", F.timestamp_micros("at")).drop("at").coalesce(1).write.mode("append").parquet(f"{folder}/events_old.parquet")
    return spark.createDataFrame([], SCHEMA).schema


def test_a_folder_in_wrong_order_of_time_keeps_its_rows(spark, tmp_path, calls):
    schema = stored_table(spark, tmp_path, calls)
    read = lambda: st.read_stream(spark, str(tmp_path), "events", schema, 1)
    keys = ["window_start", "user_id", "event_type"]
    out = st.latest(st.run_available(st.request_windows(read(), watermark="36500 days"), "update"), keys)
    assert out.agg(F.sum("requests")).first()[0] == 120 * 6
    short = st.latest(st.run_available(st.request_windows(read()), "update"), keys)
    assert short.agg(F.sum("requests")).first()[0] < 120 * 6
    assert st.run_available(st.audit_log(read().withColumn("props", F.lit("{}"))), "append").count() == 120


def test_late_rows_are_counted(spark, calls):
    rows = [(i, r[3] // 60_000_000) for i, b in enumerate(calls[::-1]) for r in b]
    df = spark.createDataFrame(rows, "file int, m bigint").select("file", F.timestamp_seconds(F.col("m") * 60).alias("ts"))
    got = {r["file"]: (r["late"], r["rows"]) for r in st.late_rows(df, "file").collect()}
    assert got == {0: (0, 40), 1: (40, 40), 2: (40, 40)}


def test_an_empty_stream_gives_an_empty_frame(spark, tmp_path):
    (tmp_path / "events.parquet").mkdir()
    schema = spark.createDataFrame([], SCHEMA).schema
    out = st.run_available(st.audit_log(st.read_stream(spark, str(tmp_path), "events", schema).withColumn("props", F.lit("{}"))), "append")
    assert out.count() == 0 and "batch" in out.columns


def test_late_and_duplicate_events(spark, tmp_path):
    line = "GET /api/x 404"
    write(spark, tmp_path, [
        [event(1, 0, text=line), event(2, 1, text=line)],
        [event(2, 1, text=line), event(3, 2, text=line)],  # 2 arrives twice
        [event(4, 5000, text=line)],
        [event(6, 5001, text=line)],  # late rows are judged by the watermark of the batch before
        [event(5, 3, text=line)],  # days late, dropped
    ])
    status = [d for d in DETECTORS if d.name == "http_status"]
    out = st.latest(st.run_available(st.live_detections(stream(spark, tmp_path), status), "update"), ["window_start", "detector"])
    assert sorted(r["n_matches"] for r in out.collect()) == [2, 3]


def test_windows_over_several_batches(spark, tmp_path, calls):
    write(spark, tmp_path, calls)
    out = st.latest(st.run_available(st.request_windows(stream(spark, tmp_path)), "update"), ["window_start", "user_id", "event_type"])
    # Every event lies in six windows of an hour that start every ten minutes.
    assert out.agg(F.sum("requests")).first()[0] == 120 * 6


def test_append_mode_holds_back_open_windows(spark, tmp_path, calls):
    write(spark, tmp_path, calls)
    closed = st.run_available(st.rate_windows(stream(spark, tmp_path)), "append")
    every = st.latest(st.run_available(st.rate_windows(stream(spark, tmp_path)), "update"), ["window_start"])
    assert 0 < closed.count() < every.count()


def test_audit_rows_are_written_once(spark, tmp_path, calls):
    write(spark, tmp_path, calls)
    log = stream(spark, tmp_path).withColumn("props", F.lit("{}"))
    assert st.run_available(st.audit_log(log), "append").count() == 120
