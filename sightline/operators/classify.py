"""Keyword rules over column and table names, as column expressions on catalog rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, NGram, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import rules
from sightline.functions.columns import all_labels, as_col, cases, first_label, lookup, qualified
from sightline.operators.similarity import similar_rows
from sightline.session import ensure_checkpoint_dir


def table_text() -> Column:
    return F.lower(qualified("dataset", "table"))


def full_text() -> Column:
    return F.lower(F.concat_ws(" ", F.col("column"), qualified("dataset", "table")))


def _parts(names: Sequence[str]) -> dict[str, list[str]]:
    return {n: n.split("_") for n in names}


def log_role(default: Column | str = "unclassified") -> Column:
    return first_label(full_text(), rules.ROLE_WORDS, default)


def log_type() -> Column:
    return first_label(full_text(), _parts(rules.LOG_TYPES), "unknown")


def common_field() -> Column:
    return first_label(F.lower("column"), _parts(rules.COMMON_FIELDS), "unknown")


def visibility_factors() -> Column:
    return all_labels(F.lower("column"), rules.FACTOR_WORDS)


def infra_type() -> Column:
    return first_label(table_text(), rules.INFRA_WORDS, "on_prem")


def privacy_level() -> Column:
    return first_label(F.lower("column"), rules.PRIVACY_WORDS, "public")


def classify_fields(catalog: DataFrame) -> DataFrame:
    """All name rules at once; the catalog's own partition and cluster flags stay."""
    return catalog.select(
        "*", log_role().alias("log_role"), log_type().alias("log_type"), common_field().alias("common_field"),
        visibility_factors().alias("visibility_factors"), infra_type().alias("infra_type"), privacy_level().alias("privacy_level"),
    )


def role_distribution(classified: DataFrame) -> DataFrame:
    return classified.groupBy("log_role").agg(F.count(F.lit(1)).alias("n_fields"))


# ---------------------------------------------------------------------------- meaning
def content_kind() -> Column:
    return first_label(F.lower("column"), rules.CONTENT_WORDS, F.concat(F.lit("general_"), F.lower("data_type")))


def significance() -> Column:
    level = first_label(F.lower("column"), rules.SIGNIFICANCE_WORDS, "standard")
    return F.concat(level, F.lit(" significance for "), F.col("log_role"), F.lit(" operations"))


def threat_relevance() -> Column:
    level = first_label(F.lower("column"), rules.THREAT_WORDS, None)
    return F.coalesce(F.concat(level, F.lit(" relevance for threat detection")), F.lit("contributes to general threat detection capabilities"))


def purpose(role: Column | str = "log_role") -> Column:
    role = as_col(role)
    return lookup(role, rules.ROLE_PURPOSE, F.concat(F.lit("supports "), role, F.lit(" security monitoring")))


def business_value(role: Column | str = "log_role") -> Column:
    return lookup(role, rules.ROLE_VALUE, "supports business security objectives")


def compliance_value(role: Column | str = "log_role") -> Column:
    return lookup(role, rules.ROLE_COMPLIANCE, "supports general compliance requirements")


def risk_value(role: Column | str = "log_role") -> Column:
    role = as_col(role)
    return lookup(role, rules.ROLE_RISK, F.concat(F.lit("contributes to "), role, F.lit(" risk reduction")))


def related_roles(classified: DataFrame, limit: int = 3) -> Column:
    """Other roles present in the catalog, as an expression. There are six roles at most."""
    present = classified.filter(F.col("log_role") != "unknown").agg(F.sort_array(F.collect_set("log_role"))).scalar()
    return F.slice(F.array_except(present, F.array("log_role")), 1, limit)


def dependency_fields() -> Column:
    name = F.lower("column")
    none = F.array().cast("array<string>")
    return cases([(name.contains(k), F.array(*map(F.lit, v))) for k, v in rules.DEPENDENT_FIELDS.items()], none)


def correlation_potential() -> Column:
    return F.concat(first_label(F.lower("column"), rules.CORRELATION_WORDS, "low"), F.lit(" correlation potential"))


def meaning_report(classified: DataFrame, clusters: DataFrame | None = None, meanings: DataFrame | None = None, similar: DataFrame | None = None) -> DataFrame:
    """What each field holds, why it matters, what it relates to, and, where given, its cluster, its primary
    meaning (`primary_meaning`) and the fields of similar names (`similar_fields`)."""
    report = classified.select(
        "dataset", "table", "column", "log_role",
        content_kind().alias("content_kind"), significance().alias("significance"), threat_relevance().alias("threat_relevance"),
        purpose().alias("purpose"), business_value().alias("business_value"), compliance_value().alias("compliance"), risk_value().alias("risk"),
        F.concat(F.lit("enhances "), F.col("log_role"), F.lit(" operational visibility")).alias("efficiency"),
        related_roles(classified).alias("related_roles"), dependency_fields().alias("dependency_fields"), correlation_potential().alias("correlation_potential"),
    )
    for part in (meanings, similar):
        report = report.join(part, ["table", "column"], "left") if part is not None else report
    return report.join(clusters, ["dataset", "table", "column"], "left") if clusters is not None else report


# --------------------------------------------------------------------- label scoring
def text_for_scoring(name: Column | str, values: Column | str, first: int | None = None, cut: int | None = None) -> Column:
    """Field name and the given values as one text; a quick look may take the `first` values and `cut` the text."""
    values = as_col(values) if first is None else F.slice(as_col(values), 1, first)
    text = F.concat_ws(" ", as_col(name), F.array_join(values, " "))
    return text if cut is None else F.substring(text, 1, cut)


def _words(label: str) -> list[str]:
    return label.replace("_", " ").split()


def column_labels(long: DataFrame, labels: Sequence[str], top: int = 1) -> DataFrame:
    """(table, column, n_values, labels): the best labels of each column by all its values.

    A label scores the mean share of its words inside a value, plus the share inside the name of the
    column; the earlier declared wins a tie. Hits are counted where the values are read, so no text is
    shuffled and a column with a third of all rows is summed by all tasks.
    """
    hits = lambda text, label: sum((F.lower(text).contains(w).cast("int") for w in _words(label)), F.lit(0))
    sums = long.filter(F.col("value").isNotNull()).groupBy("table", "column").agg(
        F.count(F.lit(1)).alias("n_values"), *[F.sum(hits(F.col("value"), label)).alias(f"_h{i}") for i, label in enumerate(labels)]
    )
    scored = [
        F.struct((F.col(f"_h{i}") / (F.col("n_values") * len(_words(label))) + hits(F.col("column"), label) / len(_words(label))).alias("score"), F.lit(-i).alias("priority"), F.lit(label).alias("label"))
        for i, label in enumerate(labels)
    ]
    best = F.slice(F.sort_array(F.array(*scored), asc=False), 1, top)
    return sums.select("table", "column", "n_values", F.transform(best, lambda s: F.struct(s["label"].alias("label"), s["score"].alias("score"))).alias("labels"))


def primary_meaning(long: DataFrame, labels: Sequence[str] = rules.MEANING_LABELS) -> DataFrame:
    """The meaning of each column by its name and all its values, or none if no word of any label occurs."""
    best = F.col("labels")[0]
    return column_labels(long, labels).select("table", "column", F.when(best["score"] > 0, best["label"]).alias("primary_meaning"), best["score"].alias("meaning_score"))


def similar_fields(fields: DataFrame, threshold: float = 0.3, keep: int = 5) -> DataFrame:
    """(table, column, similar_fields): columns of the catalog whose names are alike by hashed letter
    trigrams, at most `keep`, the closest first."""
    named = name_vectors(fields.select("table", "column")).select(F.xxhash64("table", "column").alias("id"), "table", "column", vector_to_array("features", "float32").alias("vec"))
    pairs = similar_rows(named, "id", "vec", threshold, keep, "similarity")
    names = named.select(F.col("id").alias("similar_id"), F.concat_ws(".", "table", "column").alias("name"))
    lists = pairs.join(names, "similar_id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "name"))).alias("found"))
    return named.join(lists, "id", "left").select("table", "column", F.coalesce(F.transform("found", lambda x: x["name"]), F.array().cast("array<string>")).alias("similar_fields"))


def cluster_faults(clustered: DataFrame, key: str, features: str = "vec", cluster: str = "cluster") -> DataFrame:
    """Per cluster: rows, rows that lie nearer to the mean of another cluster, and the mean squared distance.

    The means are those of the rows as they are clustered, so this checks any clustering by its result
    alone. There are few clusters; their means come to one row.
    """
    at = clustered.select(key, cluster, F.posexplode(features).alias("i", "x"))
    means = at.groupBy(cluster, "i").agg(F.avg("x").alias("m")).groupBy(cluster).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("m"))
    all_means = means.agg(F.sort_array(F.collect_list(F.struct(F.col(cluster).alias("c"), "m")))).scalar()
    distance = lambda m: F.aggregate(F.zip_with(F.col(features), m, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, v: a + v)
    measured = clustered.withColumn("_means", all_means).withColumn("_d", F.transform("_means", lambda s: F.struct(distance(s["m"]).alias("d"), s["c"].alias("c"))))
    own = F.filter("_d", lambda s: s["c"] == F.col(cluster))[0]["d"]
    measured = measured.select(cluster, own.alias("_own"), F.array_min(F.transform("_d", lambda s: s["d"])).alias("_least"))
    return measured.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_own") > F.col("_least") * (1 + 1e-9) + 1e-12).alias("misplaced"), F.avg("_own").alias("mean_square"))


def label_overlap(text: Column, labels: Sequence[str], top: int = 1) -> Column:
    """Labels by the share of their words inside the text, the earlier declared on a tie."""
    scored = []
    for i, label in enumerate(labels):
        words = label.replace("_", " ").split()
        hits = sum((F.lower(text).contains(w).cast("int") for w in words), F.lit(0))
        scored.append(F.struct((hits / len(words)).alias("score"), F.lit(-i).alias("priority"), F.lit(label).alias("label")))
    ordered = F.slice(F.sort_array(F.array(*scored), asc=False), 1, top)
    return F.transform(ordered, lambda s: F.struct(s["label"].alias("label"), s["score"].alias("score")))


Scorer = Callable[[list[str], list[str]], list[list[float]]]


def score_labels(df: DataFrame, text: str, labels: Sequence[str], top: int = 1, load_model: Callable[[], Scorer] | None = None) -> DataFrame:
    """Adds `labels`: the best labels of each text with their scores.

    Without a model the score is word overlap, computed in the JVM. `load_model` runs once per
    task and returns a function from texts and labels to a score matrix.
    """
    labels = list(labels)
    if load_model is None:
        return df.withColumn("labels", label_overlap(F.col(text), labels, top))

    def score(batches):
        model = load_model()
        for batch in batches:
            scores = model(batch[text].fillna("").tolist(), labels)
            best = [sorted(zip(row, labels), key=lambda p: -p[0])[:top] for row in scores]
            yield batch.assign(labels=pd.Series([[{"label": b, "score": float(s)} for s, b in row] for row in best], index=batch.index, dtype=object))

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(score, f"{columns}, labels array<struct<label: string, score: double>>")


# ------------------------------------------------------------------------- clustering
def name_vectors(fields: DataFrame, column: str = "column", size: int = 256) -> DataFrame:
    """Vectors of field names from hashed letter trigrams."""
    letters = fields.withColumn("_letters", F.split(F.concat(F.lit("^"), F.lower(column), F.lit("$")), ""))
    grams = NGram(n=3, inputCol="_letters", outputCol="_grams").transform(letters)
    counted = HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=size).transform(grams)
    return Normalizer(inputCol="_tf", outputCol="features").transform(counted).drop("_letters", "_grams", "_tf")


def cluster_fields(vectors: DataFrame, features: str = "features", seed: int = 42, most: int = 8) -> DataFrame:
    """K-means cluster per row, only for more than five rows.

    Counting, fitting and labelling read the vectors again, so they are written down once.
    """
    ensure_checkpoint_dir(vectors.sparkSession)
    vectors = vectors.checkpoint()
    n = vectors.count()
    if n <= 5:
        return vectors.withColumn("cluster", F.lit(None).cast("int"))
    model = KMeans(k=min(most, n // 3), seed=seed, featuresCol=features, predictionCol="cluster").fit(vectors)
    return model.transform(vectors)


def cluster_arrays(df: DataFrame, column: str, **options) -> DataFrame:
    return cluster_fields(df.withColumn("features", array_to_vector(F.col(column))), **options).drop("features")
