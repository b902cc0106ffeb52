"""Column profiles, table quality and field meaning, all over the long form of the tables.

The cell values are reduced to one row per distinct value first. Long texts are grouped by a
digest, so the shuffle carries short keys and never whole documents.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.columns import band, contains_any, percent, stacked
from sightline.functions.rules import DEFAULT_RELEVANCE, FORMAT_LENGTHS, FORMAT_NEEDS, FORMAT_SHARE, FORMATS, REQUIREMENTS, SEMANTIC_PATTERNS, SEMANTIC_RELEVANCE, TIME_WORDS
from sightline.operators.sampling import top_per_group

COLUMN = ["table", "column"]
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
LONG_TEXT = 64
NUMERIC_TYPES = ["tinyint", "smallint", "int", "bigint", "float", "double"]


def matches_format(value: Column, name: str, pattern: str) -> Column:
    """Format test; the length decides most values before the pattern runs."""
    shortest, longest = FORMAT_LENGTHS.get(name, (0, None))
    fits = F.length(value) >= shortest if longest is None else F.length(value).between(shortest, longest)
    if name in FORMAT_NEEDS:
        fits = fits & value.contains(FORMAT_NEEDS[name])
    return F.when(value.isNotNull(), F.when(fits, value.rlike(pattern)).otherwise(False))


def value_groups(long: DataFrame, formats: Mapping[str, str] = FORMATS) -> DataFrame:
    """One row per column and distinct value (or NULL): count, length, formats matched.

    Short values are tested for their format after they are grouped, once per distinct value;
    long ones before, because only their digest is kept.
    """
    value = F.col("value")
    is_long = F.length(value) > LONG_TEXT
    flags = {f"_f_{n}": (n, p) for n, p in formats.items()}
    grouped = (
        long.select(
            *COLUMN, F.when(is_long, F.md5(value)).otherwise(value).alias("_key"), F.length(value).alias("_len"),
            *[F.when(is_long, matches_format(value, n, p)).alias(f) for f, (n, p) in flags.items()],
        )
        .groupBy(*COLUMN, "_key", "_len", *flags)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return grouped.withColumns({f: F.coalesce(F.col(f), matches_format(F.col("_key"), n, p)) for f, (n, p) in flags.items()})


def column_stats(groups: DataFrame, formats: Mapping[str, str] = FORMATS) -> DataFrame:
    """Per column: rows, nulls, distinct values, length statistics, share of each format."""
    n, size, present = F.col("_n"), F.col("_len").cast("double"), F.col("_key").isNotNull()
    total = F.sum(F.when(present, n))
    mean = F.try_divide(F.sum(n * size), total)
    # Sample standard deviation from weighted sums; undefined for a single value.
    spread = F.try_divide(F.sum(n * size * size) - F.sum(n * size) * mean, total - 1)
    stats = groups.groupBy(*COLUMN).agg(
        F.sum("_n").alias("n_rows"),
        F.coalesce(F.sum(F.when(~present, n)), F.lit(0)).alias("n_null"),
        F.count("_key").alias("n_distinct"),
        mean.alias("mean_length"),
        F.sqrt(F.greatest(spread, F.lit(0.0))).alias("_spread"),
        *[F.try_divide(F.sum(F.when(F.col(f"_f_{f}"), n)), total).alias(f"_share_{f}") for f in formats],
    )
    single = F.col("n_rows") - F.col("n_null") < 2
    return stats.withColumn("std_length", F.when(~single, F.col("_spread"))).drop("_spread")


# ------------------------------------------------------------- one pass over a table
SKETCH_BITS = 14
#: Relative standard error of a sketched distinct count.
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def column_sums(tables: Mapping[str, DataFrame], formats: Mapping[str, str] = FORMATS, texts_only: bool = False) -> DataFrame:
    """Per column of the given tables: counts, sums of lengths, matches of each format, and a sketch of
    the distinct values, all from one aggregate, so that each table is read once and nothing but one
    row a task is shuffled. Sums of parts of a table can be added up by `added_sums`. With
    `texts_only` other columns are only counted."""
    parts = []
    for name, df in tables.items():
        aggregates, rows = [F.count(F.lit(1)).alias("_n")], []
        for i, field in enumerate(f for f in df.schema if not isinstance(f.dataType, NESTED)):
            column = F.col(f"`{field.name}`")
            is_text = isinstance(field.dataType, T.StringType)
            aggregates.append(F.count(column).alias(f"_c{i}"))
            lengths, sketch = [F.lit(None).cast("double")] * 2, F.lit(None).cast("binary")
            if is_text or not texts_only:
                size = F.length(column.cast("string")).cast("double")
                key = F.when(column.isNotNull(), F.xxhash64(column))
                aggregates += [F.sum(size).alias(f"_s{i}"), F.sum(size * size).alias(f"_q{i}"), F.hll_sketch_agg(key, SKETCH_BITS).alias(f"_h{i}")]
                lengths, sketch = [F.col(f"_s{i}"), F.col(f"_q{i}")], F.col(f"_h{i}")
            aggregates += [F.count_if(matches_format(column, f, p)).alias(f"_f{i}_{f}") for f, p in formats.items() if is_text]
            hits = [F.col(f"_f{i}_{f}") if is_text else F.lit(0).cast("bigint") for f in formats]
            rows.append(F.struct(F.lit(field.name).alias("column"), F.col("_n").alias("n_rows"), F.col(f"_c{i}").alias("n_values"), lengths[0].alias("length_sum"), lengths[1].alias("length_squares"),
                                 F.array(*hits).alias("format_counts"), sketch.alias("sketch")))
        if rows:
            parts.append(df.agg(*aggregates).select(F.lit(name).alias("table"), F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


def added_sums(*parts: DataFrame) -> DataFrame:
    """The sums of several parts of the same tables as those of the whole."""
    n = F.max(F.size("format_counts"))
    rows = reduce(DataFrame.unionByName, parts)
    at = F.posexplode("format_counts").alias("_at", "_hits")
    hits = rows.select(*COLUMN, at).groupBy(*COLUMN, "_at").agg(F.sum("_hits").alias("_hits")).groupBy(*COLUMN).agg(F.sort_array(F.collect_list(F.struct("_at", "_hits"))).alias("_all"))
    sums = rows.groupBy(*COLUMN).agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_values", "length_sum", "length_squares")], F.hll_union_agg("sketch").alias("sketch"), n.alias("_formats"))
    return sums.join(hits, COLUMN, "left").select(*COLUMN, "n_rows", "n_values", "length_sum", "length_squares", F.coalesce(F.transform("_all", lambda x: x["_hits"]), F.array().cast("array<bigint>")).alias("format_counts"), "sketch")


def sketched_stats(sums: DataFrame, formats: Mapping[str, str] = FORMATS) -> DataFrame:
    """The columns of `column_stats` from sums. Distinct values are estimated: SKETCH_ERROR is the relative
    standard error, small counts are exact but for rounding."""
    values, size = F.col("n_values"), F.col("length_sum")
    spread = F.try_divide(F.col("length_squares") - size * F.try_divide(size, values), values - 1)
    return sums.select(
        *COLUMN, "n_rows", (F.col("n_rows") - values).alias("n_null"),
        F.when(values == 0, 0).when(F.col("sketch").isNotNull(), F.least(F.hll_sketch_estimate("sketch"), values)).cast("bigint").alias("n_distinct"),
        F.try_divide(size, values).alias("mean_length"), F.when(values > 1, F.sqrt(F.greatest(spread, F.lit(0.0)))).alias("std_length"),
        *[F.try_divide(F.get("format_counts", F.lit(i)), values).alias(f"_share_{f}") for i, f in enumerate(formats)],
    )


def with_exact_near(stats: DataFrame, tables: Mapping[str, DataFrame], bounds: Sequence[float] = (0.95, 0.5), errors: float = 4.0) -> DataFrame:
    """Exact distinct counts where the estimate is too near to one of the bounds (as a share of the rows) to tell
    on which side it lies; only these columns are read again. Looks at one row per column while the plan is built."""
    share, margin = F.try_divide(F.col("n_distinct"), F.col("n_rows")), errors * SKETCH_ERROR
    unsure = reduce(lambda a, b: a | b, [F.abs(share - b) <= b * margin + F.try_divide(F.lit(1.0), F.col("n_rows")) for b in bounds])
    wanted: dict[str, list[str]] = {}
    for r in stats.filter(unsure).select(*COLUMN).collect():
        wanted.setdefault(r["table"], []).append(r["column"])
    if not wanted:
        return stats
    counts = [
        df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.md5(F.col(f"`{c}`").cast("string").cast("binary")).alias("_d")) for c in wanted[name]])))
        .filter(F.col("_d").isNotNull()).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("_exact")).withColumn("table", F.lit(name))
        for name, df in tables.items() if name in wanted
    ]
    exact = reduce(DataFrame.unionByName, counts)
    return stats.join(exact, COLUMN, "left").withColumn("n_distinct", F.coalesce("_exact", "n_distinct")).drop("_exact")


def profile_columns(stats: DataFrame, formats: Mapping[str, str] = FORMATS) -> DataFrame:
    """Completeness, uniqueness, value distribution, length consistency and formats."""
    rows, values = F.col("n_rows"), F.col("n_rows") - F.col("n_null")
    unique_ratio = F.try_divide(F.col("n_distinct"), rows)
    steady = F.col("std_length") < F.col("mean_length") * 0.1
    unknown = values == 0
    return stats.select(
        *COLUMN, "n_rows", "n_null", "n_distinct",
        (1 - F.try_divide(F.col("n_null"), rows)).alias("completeness"),
        unique_ratio.alias("unique_ratio"),
        F.when(unknown, "unknown").otherwise(band(unique_ratio, [(0.95, "highly_unique"), (0.5, "moderately_unique")], "repetitive", inclusive=False)).alias("distribution"),
        F.when(unknown, "unknown").when(steady, "consistent").otherwise("variable").alias("consistency"),
        F.array_compact(F.array(*[F.when(F.col(f"_share_{f}") > FORMAT_SHARE, f) for f in formats])).alias("formats"),
    )


def _first_of_each_task(values: DataFrame, k: int) -> DataFrame:
    """The first k rows of each column that a task sees, null row ids first. A task holds no more than these and
    one batch, where a limit by rank would sort all that it reads."""
    place = lambda row: (row[0] is not None, row[0] or "", row[1])

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[tuple[str, str], list[tuple[str | None, str]]] = {}
        for batch in batches:
            for column, part in batch.groupby(COLUMN, sort=False):
                row_ids, texts = part["row_id"], part["value"]
                known = kept.get(column, [])
                if len(known) == k and known[-1][0] is not None:
                    near = (row_ids.isna() | (row_ids <= known[-1][0])).to_numpy(bool)
                    row_ids, texts = row_ids[near], texts[near]
                rows = zip(row_ids.astype(object).where(row_ids.notna(), None), texts)
                kept[column] = heapq.nsmallest(k, chain(known, rows), key=place)
        yield pd.DataFrame([(*column, *row) for column, rows in kept.items() for row in rows], columns=[*COLUMN, "row_id", "value"])

    return values.select(*COLUMN, "row_id", "value").mapInPandas(first, "table string, column string, row_id string, value string")


def sample_values(long: DataFrame, k: int = 5) -> DataFrame:
    """First k non-null values of each column in row order."""
    few = _first_of_each_task(long.filter(F.col("value").isNotNull()), k)
    first = top_per_group(few, COLUMN, [F.col("row_id"), F.col("value")], k)
    ordered = F.sort_array(F.collect_list(F.struct("row_id", "value")))
    return first.groupBy(*COLUMN).agg(F.transform(ordered, lambda r: r["value"]).alias("samples"))


def profile_table(long: DataFrame) -> DataFrame:
    """Every column of the given long form: profile and sample values."""
    return profile_columns(column_stats(value_groups(long))).join(sample_values(long), COLUMN, "left")


def table_shape(catalog: DataFrame) -> DataFrame:
    """Wide above 20 columns, narrow below 5, standard between."""
    n = F.col("n_columns")
    shape = F.when(n > 20, "wide_table").when(n < 5, "narrow_table").otherwise("standard_table")
    return catalog.groupBy("table").agg(F.count(F.lit(1)).alias("n_columns")).withColumn("table_structure", shape)


def typed(stats: DataFrame, catalog: DataFrame) -> DataFrame:
    return stats.join(catalog.select("table", "column", "data_type"), COLUMN)


def column_patterns(stats: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per table the names of its time, categorical and numeric columns."""
    name, kind = F.col("column"), F.col("data_type")
    listed = lambda test: F.sort_array(F.collect_list(F.when(test, name)))
    return typed(stats, catalog).groupBy("table").agg(
        listed(contains_any(F.lower(name), TIME_WORDS)).alias("temporal_patterns"),
        listed((kind == "string") & (F.col("n_distinct") < F.col("n_rows") * 0.5)).alias("categorical_patterns"),
        listed(kind.isin(NUMERIC_TYPES)).alias("numerical_patterns"),
    )


def table_quality(stats: DataFrame, catalog: DataFrame) -> DataFrame:
    """Completeness over all cells, length consistency of text columns, and their mean."""
    mean, std = F.col("mean_length"), F.col("std_length")
    steady = F.when(mean > 0, F.least(1 - std / mean, F.lit(1.0))).otherwise(F.lit(0.0))
    consistency = F.avg(F.when((F.col("data_type") == "string") & std.isNotNull(), steady))
    per_table = typed(stats, catalog).groupBy("table").agg(
        (1 - F.try_divide(F.sum("n_null"), F.sum("n_rows"))).alias("completeness"), consistency.alias("consistency")
    )
    both = (F.col("completeness") + F.col("consistency")) / 2
    return per_table.withColumn("overall_score", F.coalesce(both, F.col("completeness")))


def mean_quality(quality: DataFrame) -> DataFrame:
    score = F.col("overall_score")
    return quality.agg(F.avg(F.when(score > 0, score)).alias("mean_quality"), F.count(F.lit(1)).alias("n_tables"))


# ------------------------------------------------------------------- value reports
def value_share(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """Most frequent values with their percentage of all non-null rows.

    The total is summed over the grouped counts, so no window spans the whole input.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("total_count"))
    total = counts.agg(F.sum("total_count")).scalar()
    return counts.withColumn("percentage", F.round(percent("total_count", total), 2)).orderBy(F.desc("total_count"), "value").limit(top)


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Rows per value, most frequent first; a value is distinct exactly once in its own group."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("total_count"), F.lit(1).cast("bigint").alias("unique_values"))
    ordered = counts.orderBy(F.desc("total_count"), "value")
    return ordered.limit(top) if top else ordered


def visibility_level(count: Column | str) -> Column:
    return band(count, [(10, "High Visibility"), (5, "Medium Visibility")], "Low Visibility", inclusive=False)


def value_visibility(df: DataFrame, column: str) -> DataFrame:
    return value_counts(df, column).select("value", "total_count", visibility_level("total_count").alias("visibility_level"))


# ------------------------------------------------------------------- field meaning
def field_meaning(long: DataFrame, sampled: int | None = None, scored: int | None = None) -> DataFrame:
    """Semantic type of each column from its name and its distinct values.

    A type scores one point per pattern match in the name, and ten times the mean number of
    matches in a value, every distinct value tested on its own; the best type wins, the earlier
    declared on a tie. Only digests of values and their points are shuffled. A quick look may
    count `sampled` values and test `scored` of them, taken in the order of their digests.
    """
    points = lambda text, patterns: sum((F.regexp_count(text, F.lit("(?i)" + p)) for p in patterns), F.lit(0))
    values = long.filter(F.col("value").isNotNull()).withColumn("_d", F.md5("value"))
    if sampled is not None or scored is not None:
        order = Window.partitionBy(*COLUMN).orderBy("_d")
        ranked = values.select(*COLUMN, "_d").distinct().withColumn("_rn", F.row_number().over(order))
        chosen = ranked.filter(F.col("_rn") <= sampled) if sampled is not None else ranked
        values = values.join(chosen.filter(F.col("_rn") <= scored) if scored is not None else chosen, [*COLUMN, "_d"])
    once = values.groupBy(*COLUMN, "_d").agg(*[F.max(points(F.col("value"), p)).alias(f"_p_{t}") for t, p in SEMANTIC_PATTERNS.items()])
    sums = once.groupBy(*COLUMN).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_p_{t}").alias(f"_p_{t}") for t in SEMANTIC_PATTERNS])
    if sampled is not None or scored is not None:
        sums = sums.join(chosen.groupBy(*COLUMN).agg(F.count(F.lit(1)).alias("sample_count")), COLUMN)
    else:
        sums = sums.withColumn("sample_count", F.col("_n"))
    # Scores times the number of values, so that they stay whole numbers.
    candidates = [
        F.struct((10 * F.col(f"_p_{t}") + F.col("_n") * points(F.col("column"), p)).alias("score"), F.lit(-i).alias("priority"), F.lit(t).alias("type"))
        for i, (t, p) in enumerate(SEMANTIC_PATTERNS.items())
    ]
    best = F.array_max(F.array(*candidates))
    relevance = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SEMANTIC_RELEVANCE.items() for x in kv]), F.col("semantic_type")), F.lit(DEFAULT_RELEVANCE))
    return (
        sums.withColumn("_best", best)
        .select(
            *COLUMN,
            F.when(F.col("_best.score") > 0, F.col("_best.type")).otherwise("unknown").alias("semantic_type"),
            F.least(F.col("_best.score") / (10 * F.col("_n")), F.lit(1.0)).alias("confidence"),
            "sample_count",
        )
        .withColumn("relevance", relevance)
        .withColumn("quality_score", F.when(F.col("sample_count") > 0, 1.0).otherwise(0.0))
    )


def fields_for_requirements(fields: DataFrame, requirements: Mapping[str, Sequence[str]] = REQUIREMENTS, minimum: float = 0.3, top: int = 5) -> DataFrame:
    """Best fields for each requirement among the semantic types that serve it."""
    pairs = stacked(["requirement", "_type"], *[(r, t) for r, types in requirements.items() for t in types])
    scored = (
        fields.select("*", pairs).filter(F.col("_type") == F.col("semantic_type"))
        .withColumn("score", F.col("relevance") * F.col("confidence") * F.col("quality_score"))
        .filter(F.col("score") > minimum)
    )
    order = Window.partitionBy("requirement").orderBy(F.desc("score"), "table", "column")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("requirement", "rank", *COLUMN, "semantic_type", "score")


def requirement_reports(long: DataFrame, chosen: DataFrame) -> DataFrame:
    """The value report of each requirement on its best field.

    Asset coverage lists the ten most frequent values with their share, security controls all
    values, network visibility all values with a level, the others the twenty most frequent.
    One row per requirement is joined, and it goes to every task: dealt out by column or by
    requirement, all values of a column would be sorted in one.
    """
    best = F.broadcast(chosen.filter(F.col("rank") == 1).select("requirement", *COLUMN))
    rows = long.filter(F.col("value").isNotNull()).join(best, COLUMN)
    counts = rows.groupBy("requirement", *COLUMN, "value").agg(F.count(F.lit(1)).alias("total_count"))
    totals = counts.groupBy("requirement").agg(F.sum("total_count").alias("_all"))
    whole = F.col("requirement").isin("security_controls", "network_visibility")
    size = F.when(F.col("requirement") == "asset_coverage", 10).otherwise(20)
    top = top_per_group(counts.filter(~whole), ["requirement"], [F.desc("total_count"), F.col("value")], 20)
    rank = F.row_number().over(Window.partitionBy("requirement").orderBy(F.desc("total_count"), "value"))
    kept = top.withColumn("_rn", rank).filter(F.col("_rn") <= size).drop("_rn").unionByName(counts.filter(whole))
    return kept.join(F.broadcast(totals), "requirement").select(
        "requirement", *COLUMN, "value", "total_count",
        F.when(F.col("requirement") == "asset_coverage", F.round(percent("total_count", "_all"), 2)).alias("percentage"),
        F.when(F.col("requirement") == "network_visibility", visibility_level("total_count")).alias("visibility_level"),
    )


def analysis_summary(fields: DataFrame, chosen: DataFrame) -> DataFrame:
    """Fields analysed, fields of high relevance, and requirements that found a field."""
    served = chosen.select("requirement").distinct().agg(F.count(F.lit(1)))
    return fields.agg(F.count(F.lit(1)).alias("total_fields"), F.count_if(F.col("relevance") > 0.7).alias("high_relevance_fields")).withColumn("queries_built", served.scalar())


def top_fields(fields: DataFrame, k: int = 10) -> DataFrame:
    return fields.select(*COLUMN, "semantic_type", "relevance").orderBy(F.desc("relevance"), *COLUMN).limit(k)
