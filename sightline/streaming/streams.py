"""Structured Streaming forms of the operational queries.

Window operators keep open windows only: a window ends when the watermark passes it. Rows that
come later than `watermark` are dropped by them, so callers pick it by how late rows may come, and
`late_rows` counts what a delay would drop.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.columns import stacked
from sightline.functions.rules import Detector
from sightline.operators.detect import found_in
from sightline.session import ensure_checkpoint_dir

WATERMARK = "10 minutes"
FILES_PER_BATCH = 8


def read_stream(spark: SparkSession, base: str, name: str, schema: T.StructType, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Stream over the files of a Parquet table, which is one file or a folder of them. NTZ
    timestamps become timestamps, because a watermark accepts only those."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    # A stream over a plain path wants a folder; a pattern that only this name matches takes both.
    stream = reader.parquet(f"{base}/{name}.parque[t]")
    ntz = [f.name for f in schema if isinstance(f.dataType, T.TimestampNTZType)]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else stream


def run_available(stream: DataFrame, mode: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Process what is available and return the emitted rows with their `batch` number.

    Each batch goes to its own folder below the shared checkpoint folder and is overwritten
    when it is retried, so every row is written once.
    """
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4()}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{root}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    try:
        return spark.read.schema(schema).parquet(f"{root}/rows")
    except AnalysisException as e:  # nothing was available, so no batch was written
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def late_rows(events: DataFrame, arrival: str, delay: str = WATERMARK, ts: str = "ts") -> DataFrame:
    """How many rows of a stored table each arrival brings later than `delay` after the newest row
    of all earlier arrivals: what a watermark of that delay may drop."""
    newest = events.groupBy(arrival).agg(F.max(ts).alias("_newest"))
    before = Window.orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)  # one row per arrival
    seen = newest.select(arrival, F.max("_newest").over(before).alias("_seen"))
    late = F.col(ts) < F.col("_seen") - F.expr(f"INTERVAL {delay}")
    return events.join(seen, arrival).groupBy(arrival).agg(F.count_if(late).alias("late"), F.count(F.lit(1)).alias("rows"))


def latest(emitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last emitted row per key of an update-mode stream."""
    values = [c for c in emitted.columns if c not in (*keys, "batch")]
    return emitted.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last")).select(*keys, "_last.*")


def request_windows(events: DataFrame, length: str = "1 hour", slide: str = "10 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Requests per user and action in sliding windows."""
    windowed = events.withWatermark("ts", watermark).groupBy(F.window("ts", length, slide), "user_id", "event_type")
    return windowed.agg(F.count(F.lit(1)).alias("requests")).select(F.col("window.start").alias("window_start"), "user_id", "event_type", "requests")


def rate_windows(events: DataFrame, length: str = "5 minutes", slide: str = "1 minute", watermark: str = WATERMARK) -> DataFrame:
    """Errors and durations in sliding windows; the rates follow from the emitted sums."""
    counted = events.withWatermark("ts", watermark).groupBy(F.window("ts", length, slide)).agg(
        F.count_if(F.col("event_type") == "error").alias("errors"), F.avg("value").alias("mean_duration")
    )
    return counted.select(
        F.col("window.start").alias("window_start"), "errors", (F.col("errors") / 300.0).alias("errors_per_second"), "mean_duration",
        (F.col("errors") / 300.0 > 0.1).alias("failing"), (F.col("mean_duration") > 300).alias("slow"),
    )


def live_detections(lines: DataFrame, detectors: Sequence[Detector], length: str = "1 day", watermark: str = WATERMARK) -> DataFrame:
    """Matches per detector in tumbling windows, each event counted once."""
    once = lines.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
    found = once.select("ts", stacked(["detector", "found"], *[(d.name, found_in(F.col("text"), d)) for d in detectors]))
    return (
        found.filter(F.size("found") > 0)
        .groupBy(F.window("ts", length), "detector")
        .agg(F.sum(F.size("found")).alias("n_matches"))
        .select(F.col("window.start").alias("window_start"), "detector", "n_matches")
    )


def audit_log(events: DataFrame) -> DataFrame:
    """Append-only audit rows."""
    return events.select("event_id", "user_id", F.col("event_type").alias("action"), F.col("props").alias("details"), "ts")
