"""From a list of tables to findings, readiness and failures in one pass over the data.

All tables are read by one job. What cannot be read does not end it: a table whose plan fails, a file
that is gone or broken, and a file that breaks off in the middle become rows of the failures. The
rows that each file has delivered are counted by the same pass that searches the values, and are
compared with the rows that its footer promises.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.rules import DETECTORS, SCAN_ERROR_WORDS, Detector
from sightline.operators import longform as lf
from sightline.operators import readiness as rd
from sightline.operators.detect import MIN_CONFIDENCE, match_counts, score
from sightline.operators.ops import error_category
from sightline.session import ensure_checkpoint_dir

#: Name of the pseudo column that counts rows; its value is the file, or NO_FILE.
FILE, NO_FILE = " file", "-"
TABLE = ["project_id", "dataset_id", "table_id"]
READ = {"ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"}


@dataclass(frozen=True)
class Source:
    """A table to scan: files at a path, or what `load` gives. Without `columns`, all flat ones."""

    project: str
    dataset: str
    table: str
    path: str | None = None
    load: Callable[[], DataFrame] | None = None
    columns: Sequence[str] | None = None
    format: str = "parquet"


@dataclass(frozen=True)
class Scan:
    """counts: matches by value and rows by file, stored. listed: files by table with the rows promised.
    failed: (number, message) of the tables whose plan failed."""

    sources: Sequence[Source]
    counts: DataFrame
    listed: DataFrame
    failed: DataFrame


def read_files(spark: SparkSession, source: Source) -> DataFrame:
    """The files of a table, without those that cannot be read. The schema comes from the first file, or
    from all of them if that one is broken."""
    reader = spark.read.format(source.format).options(**READ)
    try:
        return reader.load(source.path)
    except AnalysisException:
        if source.format != "parquet":
            raise
        return spark.read.format(source.format).options(**READ, mergeSchema="true").load(source.path)


def _long(number: int, df: DataFrame, source: Source) -> DataFrame:
    """The cells of a table as rows, and one more row for each row of it."""
    columns = list(source.columns or lf.flat_columns(df))
    file = F.col("_metadata.file_path") if source.path else F.lit(NO_FILE)
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("fragment")) for c in columns]
    rows = df.select(F.inline(F.array(F.struct(F.lit(FILE).alias("column"), file.alias("fragment")), *cells)))
    return rows.filter(F.col("fragment").isNotNull()).select(F.lit(str(number)).alias("table"), "column", "fragment")


def _listed(spark: SparkSession, number: int, source: Source) -> DataFrame:
    """(table, file, promised): every file with its rows, which come from footers alone; null if the
    footer gives none. Hidden files are no data, as Spark reads it."""
    files = spark.read.format("binaryFile").options(ignoreMissingFiles="true", recursiveFileLookup="true").load(source.path).select(F.col("path").alias("file"))
    rows = read_files(spark, source).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("promised"))
    same = F.regexp_replace("file", "^file:/+", "/") == F.regexp_replace("f", "^file:/+", "/")
    return files.join(rows, same, "left").select(F.lit(str(number)).alias("table"), "file", "promised")


def scan(spark: SparkSession, sources: Sequence[Source], detectors: Sequence[Detector] = DETECTORS, expand: bool = False) -> Scan:
    """Search all tables. Runs the pass over the data at once and stores its counts in the checkpoint folder.

    With `expand` the fragments inside JSON, XML and base64 values are searched too. An empty table
    has no row in the counts; a table without readable files is listed with its files.
    """
    ensure_checkpoint_dir(spark)
    parts, listed, failed = [], [], []
    for number, source in enumerate(sources):
        try:
            df = source.load() if source.load else read_files(spark, source)
            long = _long(number, df, source)
            if source.path:
                listed.append(_listed(spark, number, source))
            parts.append(long)
        except PySparkException as e:
            failed.append((str(number), str(e).splitlines()[0]))
    none = spark.createDataFrame([], "table string, column string, fragment string")
    cells = reduce(DataFrame.unionByName, parts, none)
    is_file = F.col("column") == FILE
    if expand:
        inside = lf.expand_fragments(cells.filter(~is_file).select("table", "column", F.lit(None).cast("string").alias("row_id"), F.col("fragment").alias("value")))
        cells = cells.filter(is_file).unionByName(inside.select("table", "column", "fragment"))
    counts = match_counts(cells, detectors, counted=is_file).checkpoint()
    files = reduce(DataFrame.unionByName, listed, spark.createDataFrame([], "table string, file string, promised bigint"))
    return Scan(tuple(sources), counts, files, spark.createDataFrame(failed, "table string, message string"))


def _named(found: Scan, df: DataFrame) -> DataFrame:
    """The number of a table replaced by its project, dataset and name."""
    names = F.array(*[F.struct(F.lit(s.project).alias("project_id"), F.lit(s.dataset).alias("dataset_id"), F.lit(s.table).alias("table_id")) for s in found.sources]).cast("array<struct<project_id:string,dataset_id:string,table_id:string>>")
    rest = [c for c in df.columns if c != "table"]
    return df.withColumn("_name", F.get(names, F.col("table").cast("int"))).select("_name.*", *rest)


def results(found: Scan, threshold: float = MIN_CONFIDENCE) -> DataFrame:
    """Findings above the threshold, in the form that the readiness rollups take."""
    scored = score(found.counts.filter(F.col("column") != FILE)).filter(F.col("confidence") > threshold)
    return _named(found, scored).select(*TABLE, F.col("column").alias("column_name"), F.col("area").alias("metric_type"), "detector", "n_fragments", "n_distinct", "confidence", "evidence")


def _files(found: Scan) -> DataFrame:
    """(table, file, promised, delivered) of all files listed."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    got = found.counts.filter(F.col("column") == FILE).select(F.col("table").alias("t"), F.col("match").alias("f"), F.col("n").alias("delivered"))
    return found.listed.join(got, (F.col("table") == F.col("t")) & (plain("file") == plain("f")), "left").select("table", "file", "promised", F.coalesce("delivered", F.lit(0)).alias("delivered"))


def failures(found: Scan) -> DataFrame:
    """Tables that could not be planned (no file), files that gave no row (empty or unreadable), and
    files of which rows are missing, with the number of rows lost where it is known."""
    lost = _files(found).withColumn("rows_lost", F.col("promised") - F.col("delivered")).filter(F.col("promised").isNull() | (F.col("rows_lost") > 0))
    kind = F.when(F.col("promised").isNull(), "no_rows").otherwise("partly_read")
    text = F.when(F.col("promised").isNull(), "empty or unreadable file").otherwise("file breaks off")
    broken = lost.select("table", "file", kind.alias("error_category"), text.alias("error_message"), "rows_lost")
    message = F.regexp_replace("message", r"^\[([A-Z_.]+)\].*$", "$1")
    category = error_category(F.regexp_replace(message, "_", " "), SCAN_ERROR_WORDS, "unknown")
    unplanned = found.failed.select("table", F.lit(None).cast("string").alias("file"), category.alias("error_category"), F.substring(message, 1, 100).alias("error_message"), F.lit(None).cast("bigint").alias("rows_lost"))
    return _named(found, broken.unionByName(unplanned))


def attempts(found: Scan) -> DataFrame:
    """Every table: files, files with losses, rows read, and whether all of it was read."""
    spark = found.counts.sparkSession
    tables = spark.createDataFrame([(str(i),) for i in range(len(found.sources))], "table string")
    rows = found.counts.filter(F.col("column") == FILE).groupBy("table").agg(F.sum("n").alias("rows_read"))
    lossy = F.col("promised").isNull() | (F.col("delivered") < F.col("promised"))
    files = _files(found).groupBy("table").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(lossy).alias("files_with_losses"))
    joined = tables.join(rows, "table", "left").join(files, "table", "left").join(found.failed.select("table", F.lit(True).alias("failed")), "table", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return _named(found, joined.select("table", zero("rows_read"), zero("n_files"), zero("files_with_losses"), (F.col("failed").isNull() & (F.coalesce("files_with_losses", F.lit(0)) == 0)).alias("success")))


def readiness_by_project(found: Scan) -> DataFrame:
    """Readiness of each metric and the overall status of each project that has findings."""
    ready = rd.readiness(results(found), ["project_id"])
    total = rd.overall(ready, ["project_id"]).select("project_id", "ready_areas", "percentage", F.col("status").alias("overall_status"))
    return ready.join(total, "project_id")


def report(found: Scan) -> DataFrame:
    """One row: the report over all findings, the tables attempted and what failed."""
    def nested(df: DataFrame) -> Column:
        return df.agg(F.sort_array(F.collect_list(F.struct(*df.columns)))).scalar()

    return rd.report(results(found)).withColumn("attempts", nested(attempts(found))).withColumn("failures", nested(failures(found)))
