"""Order-dependent measures over groups of any size.

A window over a whole table or over one hot key would put all its rows into one task. Here
the rows are range-partitioned by key and order, so a large key spans many blocks; each block
is summarised, the summaries (one row per key and block) are combined in order, and the rows
add what came before their block. The sorted blocks are written to the checkpoint folder,
which fixes the block of every row even if executors are lost later.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.columns import as_col
from sightline.session import ensure_checkpoint_dir

BLOCK_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in the low bits


def _blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    by = [F.col(k) for k in keys] + [as_col(o) for o in order]
    numbered = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    return (
        numbered.checkpoint()
        .withColumn("_block", F.shiftright("_id", BLOCK_BITS))
        .withColumn("_pos", F.col("_id").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)))
        .drop("_id")
    )


def _with_blocks(rows: DataFrame, blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = blocks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), *[c for c in blocks.columns if c not in keys and c != "_block"])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = rows.join(renamed, reduce(and_, same, F.col("_block") == F.col("_b")))
    return joined.drop("_b", *[f"_k{i}" for i in range(len(keys))])


def _earlier(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def with_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str = "rank") -> DataFrame:
    """Row number within each key, from 1. The order has to be total."""
    rows = _blocks(df, keys, order)
    blocks = rows.groupBy(*keys, "_block").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(_earlier(keys)), F.lit(0))).drop("_rows")
    ranked = _with_blocks(rows, blocks, keys)
    return ranked.withColumn(out, F.col("_before") + F.col("_pos") - F.col("_first") + 1).drop("_before", "_pos", "_first", "_block")


def with_running(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column | str) -> DataFrame:
    """Adds `running` (sum of value up to the row) and `lowest` (least running sum so far)."""
    inside = Window.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _blocks(df.withColumn("_v", as_col(value)), keys, order)
    rows = rows.withColumn("_s", F.sum("_v").over(inside)).withColumn("_m", F.min("_s").over(inside))
    blocks = rows.groupBy(*keys, "_block").agg(F.sum("_v").alias("_end"), F.min("_s").alias("_low"))
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_end").over(_earlier(keys)), F.lit(0)))
    blocks = blocks.withColumn("_floor", F.min(F.col("_base") + F.col("_low")).over(_earlier(keys))).drop("_end", "_low")
    joined = _with_blocks(rows, blocks, keys)
    return (
        joined.withColumn("running", F.col("_base") + F.col("_s"))
        .withColumn("lowest", F.least(F.col("_floor"), F.col("_base") + F.col("_m")))
        .drop("_v", "_s", "_m", "_base", "_floor", "_block", "_pos")
    )


def with_last_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, measures: dict[str, Column], rank: str = "rank", stretch: int = 100_000) -> DataFrame:
    """Aggregates over each row and the n - 1 rows before it.

    `measures` are aggregate expressions. Rows are windowed in stretches of fixed length; the
    last n - 1 rows of a stretch are repeated at the start of the next one.
    """
    stretch = max(stretch, n)
    ranked = with_rank(df, keys, order, rank)
    at = F.floor((F.col(rank) - 1) / stretch)
    tail = (F.col(rank) - 1) % stretch >= stretch - (n - 1)
    copies = ranked.withColumn("_at", at).withColumn("_part", F.explode(F.when(tail, F.array("_at", F.col("_at") + 1)).otherwise(F.array("_at"))))
    frame = Window.partitionBy(*keys, "_part").orderBy(rank).rowsBetween(-(n - 1), Window.currentRow)
    out = copies
    for name, expr in measures.items():
        out = out.withColumn(name, expr.over(frame))
    return out.filter(F.col("_part") == F.col("_at")).drop("_at", "_part")


def element_at_fraction(df: DataFrame, keys: Sequence[str], value: str, tie: str, percentile: int) -> DataFrame:
    """Per key the element at index int(p/100 * (n - 1)) of the sorted values."""
    ranked = with_rank(df.filter(F.col(value).isNotNull()), keys, [value, tie])
    counts = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # Rational arithmetic: 0.95 has no exact double.
    wanted = counts.withColumn("rank", F.floor((F.col("_n") - 1) * percentile / 100) + 1)
    joined = ranked.join(wanted, [*keys, "rank"])
    return joined.select(*keys, F.col("_n").alias("n"), F.col(value).alias(f"p{percentile}"))
