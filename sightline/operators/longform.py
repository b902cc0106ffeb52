"""Tables as (table, column, row_id, value) rows, and the fragments inside the values."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.columns import digest
from sightline.functions.rules import SCAN_ERROR_WORDS
from sightline.operators.ops import error_category

NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
# Tokens of a JSON text: strings (keys and leaves), numbers and booleans, at any depth.
# Possessive and without a choice inside the repetition, so that no text is too long for the matcher.
JSON_TOKENS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*+|true|false'
BASE64_TEXT = r"^[A-Za-z0-9+/]++={0,2}$"
# Decoded bytes must be printable text, which keeps ordinary short words out.
PRINTABLE = r"^[\p{L}\p{M}\p{N}\p{P}\p{S}\p{Z}\t\r\n]+$"
# An element, or what may stand before the first one: declaration, instruction, comment, document type.
XML_START = r"^<(?:\?[A-Za-z_]|!--|!DOCTYPE\b|[A-Za-z_][^\s<>/!]*[\s/>])"


def flat_columns(df: DataFrame) -> list[str]:
    """Columns that have a text form; nested and binary ones are left out."""
    return [f.name for f in df.schema if not isinstance(f.dataType, NESTED)]


def to_long(df: DataFrame, table: str, key: str | None = None, columns: Sequence[str] | None = None,
            keep_nulls: bool = False, per_column: int | None = None) -> DataFrame:
    """One row per cell as text. `per_column` is the optional sampling cap of a quick scan."""
    columns = list(columns or flat_columns(df))
    cells = [F.col(f"`{c}`").cast("string").alias(c) for c in columns]
    row_id = F.col(key).cast("string") if key else F.lit(None).cast("string")
    long = df.select(row_id.alias("row_id"), *cells) if "row_id" not in columns else df.select(*cells)
    long = long.unpivot(["row_id"], columns, "column", "value").select(F.lit(table).alias("table"), "column", "row_id", "value")
    if not keep_nulls:
        long = long.filter(F.col("value").isNotNull())
    if per_column:
        order = Window.partitionBy("table", "column").orderBy(digest("row_id"), "row_id", "value")
        long = long.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= per_column).drop("_rn")
    return long


def union_tables(tables: Mapping[str, DataFrame], keys: Mapping[str, str] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Long form of many tables in one frame, so that one job scans them all, and what failed.

    A table whose plan cannot be resolved (dropped, no permission, no such key) does not stop the
    others; it is a row (table, error_category, error_message) of the second frame. A file that
    turns out to be broken while it is read still fails the job.
    """
    parts, failed = [], []
    for name, df in tables.items():
        try:
            parts.append(to_long(df, name, (keys or {}).get(name), **options))
        except AnalysisException as e:
            failed.append((name, str(e).splitlines()[0]))
    if not parts:
        raise ValueError(f"none of the tables can be read: {failed}")
    long = reduce(DataFrame.unionByName, parts)
    failures = long.sparkSession.createDataFrame(failed, "table string, error_message string")
    category = error_category(words=SCAN_ERROR_WORDS, default="unknown")
    return long, failures.select("table", category.alias("error_category"), "error_message")


@F.pandas_udf(T.ArrayType(T.StringType()))
def xml_parts(texts: pd.Series) -> pd.Series:
    """Element texts and tags of well-formed XML, None otherwise.

    The built-in XML functions end the whole query on malformed text. Texts that declare entities
    are not taken apart, since these may refer to other files or grow.
    """

    def parts(text):
        if text is None or "<!ENTITY" in text:
            return None
        try:
            out = []
            for element in ET.fromstring(text).iter():
                if element.text and element.text.strip():
                    out.append(element.text.strip())
                out.append(str(element.tag))
            return out
        except (ET.ParseError, ValueError):
            return None

    return texts.map(parts)


def expand_fragments(long: DataFrame) -> DataFrame:
    """Each value plus the parts of the first form it takes: JSON, then XML, then base64.

    Malformed input adds nothing. `origin` tells where a fragment comes from.
    """
    value = F.col("value")
    text = F.trim(value)
    framed = lambda left, right: text.startswith(left) & text.endswith(right)
    is_json, is_xml = framed("{", "}") | framed("[", "]"), framed("<", ">")
    # Wrapped in brackets, text after the first value is an error instead of being ignored.
    valid = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
    tokens = F.array_join(F.regexp_extract_all(text, F.lit(JSON_TOKENS), F.lit(0)), ",")
    json_parts = F.from_json(F.concat(F.lit("["), tokens, F.lit("]")), "array<string>")
    binary = F.try_to_binary(value, F.lit("base64"))
    decoded = F.when(F.is_valid_utf8(binary.cast("string")), binary.cast("string"))
    decoded = F.when(decoded.rlike(PRINTABLE), decoded)
    is_base64 = (F.length(value) >= 4) & (F.length(value) % 4 == 0) & value.rlike(BASE64_TEXT)
    part = lambda origin, texts: F.transform(F.array_compact(texts), lambda t: F.struct(F.lit(origin).alias("origin"), t.alias("fragment")))
    none = F.array().cast("array<struct<origin:string,fragment:string>>")
    found = (
        F.when(is_json, F.when(valid, part("json", json_parts)).otherwise(none))
        .when(is_xml, F.coalesce(part("xml", F.col("_xml")), none))
        .when(is_base64, part("base64", F.array(decoded)))
        .otherwise(none)
    )
    raw = F.array(F.struct(F.lit("raw").alias("origin"), value.alias("fragment")))
    return (
        long.withColumn("_xml", xml_parts(F.when(is_xml & text.rlike(XML_START), value)))
        .select("table", "column", "row_id", F.posexplode(F.concat(raw, found)).alias("fragment_no", "_f"))
        .select("table", "column", "row_id", "fragment_no", "_f.origin", "_f.fragment")
    )


def raw_fragments(long: DataFrame) -> DataFrame:
    """The values themselves as fragments, without looking inside them."""
    return long.select("table", "column", "row_id", F.lit(0).alias("fragment_no"), F.lit("raw").alias("origin"), F.col("value").alias("fragment"))
