"""Reading tables and earlier results, and writing results."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.session import ensure_checkpoint_dir

Loader = Callable[[str], DataFrame]


def read_table(spark: SparkSession, name: str, base: str | None = None) -> DataFrame:
    """One table at full width: a Parquet table below `base`, else a catalog table."""
    return spark.read.parquet(f"{base}/{name}.parquet") if base else spark.table(name)


def loader(spark: SparkSession, base: str | None = None) -> Loader:
    """Reads tables by name, each one only once."""
    known: dict[str, DataFrame] = {}

    def load(name: str) -> DataFrame:
        if name not in known:
            known[name] = read_table(spark, name, base)
        return known[name]

    return load


def load_stage(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """Output of an earlier stage, with an explicit schema so that nothing is inferred."""
    return spark.read.format(fmt).schema(schema).load(path)


def write_results(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    df.write.mode(mode).format(fmt).save(path)


def append_scan_results(df: DataFrame, path: str, job_id: str, created_at: str) -> None:
    """Add one row per detection, tagged with its job and load time, to the results table.

    A job owns its partition and overwrites it alone, so a job that is run again leaves one set of
    rows, and other jobs keep theirs. A job without rows leaves what it stored before.
    """
    (
        df.withColumn("job_id", F.lit(job_id))
        .withColumn("created_at", F.lit(created_at).cast("timestamp"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("job_id")
        .parquet(path)
    )


def snapshot_columns(catalog: DataFrame, table: str, note: str = "Metadata collected", path: str | None = None) -> None:
    """Replace a metadata table by the current column list, with a note and the load time."""
    writer = (
        catalog.select("dataset", "table", "column", "data_type")
        .withColumn("sample_note", F.lit(note))
        .withColumn("scan_timestamp", F.current_timestamp())
        .write.mode("overwrite")
    )
    (writer.option("path", path) if path else writer).saveAsTable(table)


def staged(spark: SparkSession, name: str) -> str:
    """A new place for a table in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"
