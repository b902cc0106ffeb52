"""Operations that leave the state, and windows with their late rows."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sightline.operators import ops
from sightline.streaming import operations as so
from sightline.streaming import streams as st

EVENT = "event_id bigint, operation_id bigint, kind string, ts timestamp, rows_scanned bigint, error_count int, operation_type string, resource_id string, error_message string"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(minutes):
    return START + timedelta(minutes=minutes)


def event(i, operation, kind, minutes, rows=1, errors=0, message=None):
    return i, operation, kind, at(minutes), rows, errors, f"type{i}", f"res{operation}", message


def stream_of(spark, path, schema, arrivals):
    """Each arrival is one file and one batch."""
    for n, rows in enumerate(arrivals):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
    from pyspark.sql.types import _parse_datatype_string

    return st.read_stream(spark, str(path), "events", _parse_datatype_string(schema) if isinstance(schema, str) else schema, 1)


@pytest.fixture()
def run(spark, tmp_path):
    def go(arrivals, **options):
        stream = stream_of(spark, tmp_path, EVENT, arrivals).withColumn("at_micros", F.unix_micros("ts"))
        emitted, left = so.run_operations(so.closed_operations(stream, **options))
        twin = ops.fold_operation_events(spark.createDataFrame([r for a in arrivals for r in a], EVENT).withColumn("at_micros", F.unix_micros("ts")))
        return {r.operation_id: r for r in emitted.collect()}, {r.operation_id: r for r in left.collect()}, {r.operation_id: r for r in twin.collect()}

    return go


def test_ended_operations_leave_and_equal_the_batch_twin(run):
    arrivals = [
        [event(1, 1, "start", 0), event(2, 1, "update", 1, 10, 2), event(3, 2, "start", 2), event(4, 3, "start", 3)],
        [event(6, 1, "end", 5, message="broke"), event(5, 1, "update", 4, 5)],
        [event(7, 2, "end", 30), event(8, 4, "start", 60)],
        [event(9, 5, "start", 200), event(10, 4, "update", 199)],
    ]
    emitted, left, twin = run(arrivals, idle_ms=100 * 60_000)
    assert set(emitted) == {1, 2, 3} and set(left) == {4, 5}  # 3 had no event for too long
    for i, r in emitted.items():
        for c in so.RECORD.fieldNames():
            assert r[c] == twin[i][c], (i, c)
    assert emitted[1].error_count == 3 and not emitted[1].success and emitted[3].active
    assert left[4].rows_scanned == 2


def test_an_operation_may_come_again_after_it_has_left(run):
    emitted, left, _ = run([[event(1, 1, "start", 0), event(2, 1, "end", 1)], [event(3, 9, "start", 500)], [event(4, 1, "start", 505), event(5, 9, "update", 506)]], idle_ms=10**9)
    assert set(emitted) == {1} and set(left) == {1, 9} and left[1].rows_scanned == 1


def test_operations_of_one_bucket_leave_at_their_own_time(run, monkeypatch):
    monkeypatch.setattr(so, "BUCKETS", 1)
    arrivals = [
        [event(10 * i + 1, i, "start", i) for i in range(1, 6)] + [event(100, None, "start", 1)],
        [event(10 * i + 2, i, "end", 5 + i, None if i == 3 else 2) for i in (1, 2, 3)],
        [event(90, 8, "start", 60)],
        [event(91, 8, "update", 61), event(92, 4, "update", 60, 7)],
        [event(93, 9, "start", 300)],
    ]
    emitted, left, twin = run(arrivals, idle_ms=100 * 60_000)
    assert (set(emitted), set(left)) == ({1, 2, 3, 4, 5, 8, None}, {9})
    for i, r in emitted.items():
        assert {c: r[c] for c in so.RECORD.fieldNames()} == {c: twin[i][c] for c in so.RECORD.fieldNames()}, i
    assert emitted[4].active and emitted[4].rows_scanned == 8


def test_no_events(run):
    emitted, _, _ = run([[]])
    assert emitted == {}


def test_windows_and_late_rows_are_all_rows(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, event_type string"
    arrivals = [
        [(i, at(i), "a") for i in range(0, 60)],
        [(100 + i, at(60 + i), "b") for i in range(30)] + [(200, at(10), "a"), (201, at(55), "a"), (202, None, "a")],
        [(300, at(79), "a"), (301, at(70), "b"), (302, at(0), "b"), (303, at(95), "b")],
    ]
    windows, late = so.run_windows(stream_of(spark, tmp_path, schema, arrivals), ["event_type"], {"n": F.count(F.lit(1))}, "1 hour", "10 minutes")
    assert {r.event_id: r.batch for r in late.collect()} == {200: 1, 301: 2, 302: 2}
    got = {(r.window_start, r.event_type): r.n for r in windows.collect()}
    assert sum(got.values()) + late.count() == sum(map(len, arrivals)) - 1  # a row without time is in no window
    first, second = at(0).replace(tzinfo=None), at(60).replace(tzinfo=None)
    assert got == {(first, "a"): 61, (second, "a"): 1, (second, "b"): 31}


def test_no_rows_no_windows(spark, tmp_path):
    stream = stream_of(spark, tmp_path, "event_id bigint, ts timestamp, event_type string", [[]])
    windows, late = so.run_windows(stream, ["event_type"], {"n": F.count(F.lit(1))}, "1 hour", "10 minutes")
    assert windows.count() == late.count() == 0


def test_events_fold_in_any_order():
    events = [(1, "start", 10, 1, 0, "x", "r", None), (2, "update", 20, 5, 1, "y", "r", None), (3, "end", 30, None, 0, "z", "q", "failed")]
    whole = so.folded(so.NOTHING, events)
    assert whole == so.folded(so.folded(so.NOTHING, events[::-1][:2]), events[:1]) and whole[:7] == (10, 30, 6, 2, "z", "q", True)
