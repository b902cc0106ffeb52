"""Operations as keyed state that ends, and windows with their late rows beside them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sightline.session import ensure_checkpoint_dir

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

RECORD = T.StructType([
    T.StructField("operation_id", T.LongType()), T.StructField("start_micros", T.LongType()), T.StructField("end_micros", T.LongType()), T.StructField("rows_scanned", T.LongType()),
    T.StructField("error_count", T.LongType()), T.StructField("operation_type", T.StringType()), T.StructField("resource_id", T.StringType()), T.StructField("success", T.BooleanType()), T.StructField("active", T.BooleanType()),
])
#: The operation and its record so far, the order of its last event, and when it leaves the state.
STATE = T.StructType([
    T.StructField("operation_id", T.LongType()),
    T.StructField("start_micros", T.LongType()), T.StructField("end_micros", T.LongType()), T.StructField("rows_scanned", T.LongType()), T.StructField("error_count", T.LongType()),
    T.StructField("operation_type", T.StringType()), T.StructField("resource_id", T.StringType()), T.StructField("failed_end", T.BooleanType()), T.StructField("last_micros", T.LongType()), T.StructField("last_event", T.LongType()),
    T.StructField("newest_micros", T.LongType()), T.StructField("leaves_ms", T.LongType()),
])
#: Operations are kept by so many buckets of their ids: one call of the state for many operations.
BUCKETS = 4096
EVENT = ["event_id", "kind", "at_micros", "rows_scanned", "error_count", "operation_type", "resource_id", "error_message"]
NOTHING = (None, None, None, None, None, None, False, None, None, None, None)


def _none(value):
    return None if value is None or value is pd.NaT or value != value else value


def folded(state: tuple, rows: list[tuple]) -> tuple:
    """The state after more events (event_id, kind, at_micros, rows_scanned, error_count, operation_type,
    resource_id, error_message), in whatever order they come."""
    start, end, scanned, errors, kind_of, resource, failed, last, last_id, newest, leaves = state
    for event_id, kind, at, more, faults, operation_type, resource_id, message in rows:
        if kind == "start":
            start = at if start is None else min(start, at)
        if kind == "end":
            end = at if end is None else max(end, at)
        scanned = scanned if more is None else (scanned or 0) + more
        errors = (errors or 0) + (faults or 0)
        if kind == "end" and message is not None:
            errors, failed = errors + 1, True
        newest = at if newest is None else max(newest, at)
        if (last, last_id) == (None, None) or (at, event_id) > (last, last_id):
            last, last_id, kind_of, resource = at, event_id, operation_type, resource_id
    return start, end, scanned, errors, kind_of, resource, failed, last, last_id, newest, leaves


def records(done: list[tuple]) -> pd.DataFrame:
    """The records of (operation_id, state)."""
    rows = [(i, start, end, scanned, errors, kind, resource, not failed, end is None) for i, (start, end, scanned, errors, kind, resource, failed, *_) in done]
    return pd.DataFrame(rows, columns=RECORD.fieldNames()).astype(dict.fromkeys(("operation_id", "start_micros", "end_micros", "rows_scanned", "error_count"), "Int64"))


class Operations(StatefulProcessor):
    """One record per operation. It is emitted and leaves the state `grace` after its last event if it has
    ended, or `idle` after it if no end has come. A key is a bucket of operations, whose timer is that of
    the first one to leave."""

    def __init__(self, grace_ms: int, idle_ms: int):
        self.grace, self.idle = grace_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("operation", STATE)

    def _known(self) -> dict[int, tuple]:
        return {r[0]: r[1:] for r in map(tuple, self.state.get())} if self.state.exists() else {}

    def _keep(self, known: dict[int, tuple], timer: int | None) -> None:
        """Store the operations, and move the timer if another one is the first to leave."""
        if known:
            self.state.put([(i, *(int(v) if isinstance(v, float) else v for v in state)) for i, state in known.items()])
        else:
            self.state.clear()
        first = min((state[-1] for state in known.values()), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, now = self._known(), timerValues.getCurrentWatermarkInMs()
        timer = min((state[-1] for state in known.values()), default=None)
        # Rows come before timers: these are due, and what comes now is another run of the operation.
        due = [i for i, state in known.items() if state[-1] <= now]
        if due:
            yield records([(i, known.pop(i)) for i in due])
        for part in rows:
            ids = [None if _none(i) is None else int(i) for i in part["operation_id"]]
            for i, *row in zip(ids, *(map(_none, part[c].tolist()) for c in EVENT)):
                state = folded(known.get(i, NOTHING), [row])
                known[i] = (*state[:-1], int(state[-2]) // 1000 + (self.grace if state[1] is not None else self.idle))
        self._keep(known, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, now = self._known(), timerValues.getCurrentWatermarkInMs()
        due = [i for i, state in known.items() if state[-1] <= now]
        if due:
            yield records([(i, known.pop(i)) for i in due])
            self._keep(known, None)  # the timer that has expired is gone

    def close(self) -> None:
        pass


def closed_operations(events: DataFrame, ts: str = "ts", watermark: str = "10 minutes", grace_ms: int = 60_000, idle_ms: int = 86_400_000) -> DataFrame:
    """Stream of records of operations that have left the state; see `Operations`. Events behind the
    watermark do not come in; `run_windows` keeps such rows."""
    # As text, because pandas turns whole numbers into floats where one is missing.
    keyed = {"_bucket": F.pmod(F.xxhash64("operation_id"), F.lit(BUCKETS)), "operation_id": F.col("operation_id").cast("string")}
    return (
        events.withWatermark(ts, watermark).withColumns(keyed).groupBy("_bucket")
        .transformWithStateInPandas(statefulProcessor=Operations(grace_ms, idle_ms), outputStructType=RECORD, outputMode="Append", timeMode="EventTime")
    )


def run_operations(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Run over what is available: (records emitted, operations still in the state)."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/operations-{uuid.uuid4()}"
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")

        query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)
    emitted = _read(spark, f"{root}/rows", RECORD)
    left = spark.read.format("statestore").option("path", f"{root}/state").option("stateVarName", "operation").load()
    return emitted, left.select("list_element.*")


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:  # nothing was available, so no batch was written
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run_windows(events: DataFrame, keys: list[str], sums: dict[str, Column], length: str, delay: str, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Run a stream over what is available: (windows, late). Windows are sums by tumbling window and keys of
    the rows on time; late are the rows that come more than `delay` after the newest row of all earlier batches.

    Each batch writes its newest time, its late rows and the partial sums of the others to its own
    folders and overwrites them when it is retried, so every row counts once, in exactly one of the two.
    Nothing is held in memory between batches; partial sums are added up when they are read.
    """
    spark = events.sparkSession
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/windows-{uuid.uuid4()}"
    number_of = T.StructField("batch", T.LongType())
    newest_schema = T.StructType([T.StructField("newest", T.TimestampType()), number_of])

    def partial(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.window(ts, length).getField("start").alias("window_start"), *keys).agg(*[e.alias(n) for n, e in sums.items()])

    def write(batch: DataFrame, number: int) -> None:
        seen = _read(batch.sparkSession, f"{root}/newest", newest_schema).filter(F.col("batch") < number).agg(F.max("newest")).scalar()
        is_late = F.coalesce(F.col(ts) < seen - F.expr(f"INTERVAL {delay}"), F.lit(False))
        batch.filter(is_late).write.mode("overwrite").parquet(f"{root}/late/batch={number}")
        partial(batch.filter(~is_late)).write.mode("overwrite").parquet(f"{root}/windows/batch={number}")
        batch.agg(F.max(ts).alias("newest")).write.mode("overwrite").parquet(f"{root}/newest/batch={number}")

    query = events.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    schema = partial(spark.createDataFrame([], events.schema)).schema
    parts = _read(spark, f"{root}/windows", T.StructType([*schema.fields, number_of]))
    windows = parts.groupBy("window_start", *keys).agg(*[F.sum(n).alias(n) for n in sums])
    return windows, _read(spark, f"{root}/late", T.StructType([*events.schema.fields, number_of]))
