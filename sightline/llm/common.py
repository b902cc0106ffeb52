"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.session import ensure_checkpoint_dir

#: Rows of an Arrow batch, and bytes of text that are worked on at once inside a task.
BATCH_ROWS, SLICE_BYTES = 500, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(5))


def held_out(key: str = "doc_id") -> Column:
    """Fold 0 is never learned from. A null id is in no fold: not held out, and not learned from."""
    return F.coalesce(fold(key) == 0, F.lit(False))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_columns_in_arrow(df: DataFrame, inputs: list[str], outputs: dict[str, T.DataType], work: Callable[[], Callable[..., list[pa.Array]]]) -> DataFrame:
    """All columns of `df`, with `outputs` added (replacing columns of that name).

    `work` is called once per task and gives a function from the input columns of a slice of at
    most SLICE_BYTES (or one row) to the output columns. No row is moved or dropped.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    lower = {c.lower() for c in outputs}
    kept = [f for f in df.schema.fields if f.name.lower() not in lower]
    extra = [c for c in inputs if c not in {f.name for f in kept}]
    # Neutral names on the way: a name with a dot cannot be looked up unquoted.
    schema = T.StructType([T.StructField(f"column {i}", t, True) for i, t in enumerate([*(f.dataType for f in kept), *outputs.values()])])
    n = len(kept)
    source = df.select(*[F.col(f"`{c}`").alias(f"column {i}") for i, c in enumerate([*(f.name for f in kept), *extra])])
    where = [next((i for i, f in enumerate(kept) if f.name == c), None) for c in inputs]
    where = [n + extra.index(c) if i is None else i for c, i in zip(inputs, where, strict=True)]
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Lists of words have no cycles, and walking them all again and again is dear.
        gc.disable()
        try:
            do = work()
            for batch in batches:
                for part in slices(batch, where[0]):
                    made = do(*[part.column(i) for i in where])
                    yield pa.RecordBatch.from_arrays([*part.columns[:n], *made], names=names)
        finally:
            # Workers serve other tasks later: nothing of this one stays.
            do = part = made = None
            gc.enable()
            gc.collect()

    made = source.mapInArrow(run, schema)
    return made.select(*[F.col(f"`column {i}`").alias(c) for i, c in enumerate([*(f.name for f in kept), *outputs])])


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most SLICE_BYTES of text in one column, one row at least; the whole
    batch if the column is no text."""
    if not batch.num_rows:
        return
    if not pa.types.is_string(batch.column(column).type) and not pa.types.is_large_string(batch.column(column).type):
        yield batch
        return
    _, offsets = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and where each text starts and ends; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def bounded_rows(df: DataFrame, order: Column, bound: int) -> DataFrame:
    """At most `bound` rows, those that come first in a hashed order; the same ones on every run."""
    return df.orderBy(F.xxhash64(order), order).limit(bound)


def stored(df: DataFrame) -> DataFrame:
    """Written once to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stage_folder(spark: SparkSession) -> str:
    """A new place in the shared checkpoint folder for tables between stages."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stages-{uuid4().hex}"


def set_aside(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str, Callable[[DataFrame], DataFrame]]:
    """The rows under neutral column names, the new name of the text, and the way back. So an
    operator can add columns beside any others."""
    names = docs.columns
    df = docs.select(*[F.col(f"`{c}`").alias(f"column {i}") for i, c in enumerate(names)])
    return df, f"column {names.index(text)}", lambda made: made.select(*[F.col(f"`column {i}`").alias(c) for i, c in enumerate(names)])
