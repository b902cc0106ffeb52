"""Repeatable samples. Plain `DataFrame.sample` serves where a sample may differ per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.columns import digest

STEPS = 16**12  # a rate is compared with the first twelve hex digits of the key digest, as a number


def sample_rows(df: DataFrame, key: str, rate: float, cap: int) -> DataFrame:
    """About `rate` of all rows by key digest, at most `cap` of them, those of least digest. Rate 0
    keeps none, rate 1 all."""
    place = F.conv(F.substring(digest(key), 1, 12), 16, 10).cast("bigint")
    # The limit of a sort is taken per task first, so no task sees more than its share.
    return df.filter(place < F.lit(int(rate * STEPS)).cast("bigint")).orderBy(digest(key), key).limit(cap)


def sample_k(df: DataFrame, key: str, k: int = 50) -> DataFrame:
    """k pseudo-random rows."""
    return df.orderBy(digest(key), key).limit(k)


def distinct_sample(df: DataFrame, column: str, n: int = 100) -> DataFrame:
    """Up to n distinct values of a column, smallest first."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(n)


def top_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """First k rows of each group; the rank limit is applied before the shuffle as well."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("_rn") <= k).drop("_rn")
