"""The catalog as rows: dataset, table, column. Only metadata passes through the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.columns import like_any, qualified
from sightline.functions.rules import SCRATCH_TABLES, SYSTEM_SCHEMAS
from sightline.operators.sampling import top_per_group

CATALOG_SCHEMA = "dataset string, table string, column string, ordinal int, data_type string, nullable boolean, is_partition boolean, is_clustering boolean"


def list_datasets(spark: SparkSession) -> DataFrame:
    rows = [(d.name,) for d in spark.catalog.listDatabases() if d.name not in SYSTEM_SCHEMAS]
    return spark.createDataFrame(rows, "dataset string").orderBy("dataset")


def list_tables(spark: SparkSession, dataset: str) -> DataFrame:
    """Base tables of a dataset; views and temporary tables are left out."""
    rows = [(dataset, t.name) for t in spark.catalog.listTables(dataset) if t.tableType in ("MANAGED", "EXTERNAL")]
    return spark.createDataFrame(rows, "dataset string, table string").orderBy("table")


def list_columns(spark: SparkSession, dataset: str, tables: Sequence[str]) -> DataFrame:
    """Columns of registered tables, with partition and bucketing flags."""
    rows = [
        (dataset, t, c.name, i, c.dataType, c.nullable, c.isPartition, c.isBucket)
        for t in tables for i, c in enumerate(spark.catalog.listColumns(f"{dataset}.{t}"), 1)
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def without_system_tables(catalog: DataFrame) -> DataFrame:
    """Drop system schemas and backup or scratch tables."""
    return catalog.filter(~F.col("dataset").isin(SYSTEM_SCHEMAS) & ~like_any("table", SCRATCH_TABLES))


def table_stats(tables: Mapping[str, DataFrame], size_columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Rows per table, 0 for an empty one; with text columns named, also their bytes."""
    parts = []
    for name, df in tables.items():
        texts = (size_columns or {}).get(name, [])
        size = reduce(lambda a, c: a + F.coalesce(F.sum(F.octet_length(c)), F.lit(0)), texts, F.lit(0).cast("bigint"))
        parts.append(df.agg(F.count(F.lit(1)).alias("row_count"), size.alias("text_bytes")).select(F.lit(name).alias("table"), "row_count", "text_bytes"))
    return reduce(DataFrame.unionByName, parts)


def measured_columns(dataset: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Catalog rows of the given tables with row and value counts, one aggregate per table."""
    parts, described = [], []
    for name, df in tables.items():
        columns = df.schema.fields
        counts = df.selectExpr("count(1) AS n_rows", *[f"count(`{f.name}`) AS `{f.name}`" for f in columns])
        parts.append(counts.unpivot("n_rows", [f.name for f in columns], "column", "n_values").withColumn("table", F.lit(name)))
        described += [(dataset, name, f.name, i, f.dataType.simpleString(), f.nullable) for i, f in enumerate(columns, 1)]
    measured = reduce(DataFrame.unionByName, parts)
    # One row of metadata per column, known to the driver.
    schema = "dataset string, table string, column string, ordinal int, data_type string, nullable boolean"
    catalog = measured.sparkSession.createDataFrame(described, schema)
    return catalog.join(measured, ["table", "column"]).select("dataset", "table", "column", "ordinal", "data_type", "nullable", "n_rows", "n_values")


def columns_per_table(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("dataset", "table").agg(F.count(F.lit(1)).alias("column_count")).orderBy("dataset", "table")


def collection_totals(catalog: DataFrame) -> DataFrame:
    """Distinct datasets, distinct tables and columns of the whole catalog."""
    tables = catalog.groupBy("dataset", "table").agg(F.count(F.lit(1)).alias("_n"))
    datasets = tables.groupBy("dataset").agg(F.count(F.lit(1)).alias("_t"), F.sum("_n").alias("_n"))
    return datasets.agg(F.count("dataset").alias("datasets_found"), F.sum("_t").alias("tables_found"), F.sum("_n").alias("columns_found"))


def dataset_summary(catalog: DataFrame) -> DataFrame:
    tables = catalog.groupBy("dataset", "table").agg(F.count(F.lit(1)).alias("_n"))
    return tables.groupBy("dataset").agg(F.count(F.lit(1)).alias("tables_count"), F.sum("_n").alias("columns_count")).orderBy("dataset")


def capped_tables(tables: DataFrame, projects: int = 50, datasets: int = 20, per_dataset: int = 100) -> DataFrame:
    """Scan scope: the first projects, datasets of each, and tables of each dataset, by name."""
    listed = tables.select("project", "dataset", "table").distinct()
    chosen = listed.select("project").distinct().orderBy("project").limit(projects)
    scoped = listed.join(chosen, "project", "left_semi")
    kept = top_per_group(scoped.select("project", "dataset").distinct(), ["project"], [F.col("dataset")], datasets)
    return top_per_group(scoped.join(kept, ["project", "dataset"], "left_semi"), ["project", "dataset"], [F.col("table")], per_dataset)


def column_key() -> Column:
    return qualified("dataset", "table", "column")
