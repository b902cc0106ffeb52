"""Pattern detection over fragments.

All detectors run as literal patterns in one projection, so the texts are read once. Matches
are counted per distinct value with map-side combine before anything is grouped by column:
a column with a third of all rows is spread over tasks by its matched values.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.columns import any_of, cases
from sightline.functions.rules import DEFAULT_REGIMES, DETECTORS, FAMILY_REGIMES, INDUSTRY_DETECTORS, Detector

KEYS = ["table", "column", "area", "detector"]
MIN_CONFIDENCE = 0.3
EVIDENCE = 5
# What a pattern can start with: a class, a literal, or one of several words.
FIRST_CHARACTER = re.compile(r"\\b(?:\(\?:)?(\[[^\]]+\](?![?*])|[A-Za-z0-9](?![?*{|]))")
FIRST_WORDS = re.compile(r"\\b\(\?:([A-Za-z0-9|]+)\)")
WORD_START, WORD_END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def java_pattern(detector: Detector, ignore_case: bool | None = None) -> str:
    r"""The pattern with outer `\b` as letter-aware look-arounds.

    `\b` differs between Java versions where an accented letter touches the match. The first
    character is tested before the look-behind, which is the dearer test.
    """
    body = detector.pattern
    if body.startswith(r"\b"):
        words, first = FIRST_WORDS.match(body), FIRST_CHARACTER.match(body)
        if words:
            start = "[" + "".join(sorted({w[0] for w in words.group(1).split("|")})) + "]"
        else:
            start = first.group(1) if first else None
        body = (f"(?={start})" if start else "") + WORD_START + body[2:]
    if body.endswith(r"\b"):
        body = body[:-2] + WORD_END
    return ("(?i)" if (detector.ignore_case if ignore_case is None else ignore_case) else "") + body


def found_in(text: Column, detector: Detector, limit: int | None = None, ignore_case: bool | None = None) -> Column:
    """All matches of one detector in a text; a cheap literal test comes before the pattern."""
    hits = F.regexp_extract_all(text, F.lit(java_pattern(detector, ignore_case)), F.lit(0))
    if limit:
        hits = F.slice(hits, 1, limit)
    letters = any(c.isalpha() for c in detector.needs)
    exact_case = not (detector.ignore_case if ignore_case is None else ignore_case)
    usable = detector.needs and (exact_case or not letters)
    return F.when(text.contains(detector.needs), hits) if usable else hits


def match_counts(fragments: DataFrame, detectors: Sequence[Detector] = DETECTORS, per_fragment: int | None = None, counted: Column | None = None) -> DataFrame:
    """(table, column, area, detector, match, n): distinct matched values.

    Each fragment also adds one empty match of the detector "", so n there is the number of
    fragments of the column and no second scan is needed for it. `per_fragment` keeps only
    the first matches of each fragment, as a quick scan does; by default all count. Fragments
    for which `counted` holds are not searched: each counts as a match of "" by its text.
    """
    text, nothing = F.col("fragment"), F.lit("")
    own = nothing
    if counted is not None:
        fragments = fragments.select("table", "column", F.when(~F.coalesce(counted, F.lit(False)), text).alias("fragment"), F.when(counted, text).otherwise(nothing).alias("_own"))
        own = F.col("_own")
    # Only the patterns run for each detector; what follows is one expression for all of them, so that the
    # generated code stays short.
    hits = F.array(
        F.struct(nothing.alias("area"), nothing.alias("detector"), F.array(own).alias("found")),
        *[F.struct(F.lit(d.area).alias("area"), F.lit(d.name).alias("detector"), found_in(text, d, per_fragment).alias("found")) for d in detectors],
    )
    distinct = F.when(F.col("detector") == "", F.col("found")).otherwise(F.array_remove(F.array_distinct("found"), ""))
    return (
        fragments.select("table", "column", F.inline(hits))
        .filter(F.size("found") > 0)
        .select(*KEYS, F.explode(distinct).alias("match"))
        .groupBy(*KEYS, "match")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def confidence(n_distinct: Column, n_fragments: Column) -> Column:
    """Distinct matches per hundred fragments, between 0 and 1."""
    return F.least(n_distinct / F.greatest(F.lit(0.01) * n_fragments, F.lit(1.0)), F.lit(1.0))


def score(counts: DataFrame) -> DataFrame:
    """Per detector: distinct matches, fragments of the column, confidence, a few matches."""
    matched = F.col("match") != ""
    per_detector = counts.groupBy(*KEYS).agg(F.count_if(matched).alias("n_distinct"), F.sum("n").alias("_n"))
    # One row per column and detector from here on, a few dozen per column.
    column = Window.partitionBy("table", "column")
    # The fragment rows are told apart by n_distinct: a test on a key column would travel
    # through the join below and give the two branches different shuffles of the matches.
    is_match = F.col("n_distinct") > 0
    stats = (
        per_detector.withColumn("n_fragments", F.max(F.when(~is_match, F.col("_n"))).over(column))
        .filter(is_match)
        .withColumn("confidence", confidence(F.col("n_distinct"), F.col("n_fragments")))
    )
    # row_number() <= k is cut to k rows per group before the shuffle.
    smallest = Window.partitionBy(*KEYS).orderBy("match")
    evidence = (
        counts.withColumn("_rn", F.row_number().over(smallest))
        .filter((F.col("_rn") <= EVIDENCE) & (F.col("n") > 0))
        .groupBy(*KEYS)
        .agg(F.sort_array(F.collect_list("match")).alias("evidence"))
    )
    return stats.join(evidence, KEYS).select(*KEYS, "n_fragments", "n_distinct", "confidence", "evidence")


def detect(fragments: DataFrame, detectors: Sequence[Detector] = DETECTORS, threshold: float = MIN_CONFIDENCE, per_fragment: int | None = None) -> DataFrame:
    """Detections above the threshold, most confident first."""
    found = score(match_counts(fragments, detectors, per_fragment)).filter(F.col("confidence") > threshold)
    return found.orderBy(F.desc("confidence"), *KEYS)


def _hits(evidence: Column, detector: Detector, ignore_case: bool | None) -> Column:
    return F.exists(evidence, lambda e: e.rlike(java_pattern(detector, ignore_case)))


def industry_scores(detections: DataFrame, detectors: Sequence[Detector] = INDUSTRY_DETECTORS, ignore_case: bool | None = None) -> DataFrame:
    """Per industry family: summed multipliers of all (detection, pattern) pairs that match."""
    pairs = F.array(*[
        F.struct(F.lit(d.family).alias("family"), F.lit(d.multiplier).alias("multiplier"), _hits(F.col("evidence"), d, ignore_case).alias("hit"))
        for d in detectors
    ])
    return (
        detections.select(F.inline(pairs)).filter("hit").groupBy("family")
        .agg(F.sum("multiplier").alias("score"), F.count(F.lit(1)).alias("pattern_matches"))
        .withColumn("confidence", F.least(F.col("score") / 10.0, F.lit(1.0)))
    )


def best_family(scores: DataFrame, families: Sequence[str] = tuple(FAMILY_REGIMES)) -> DataFrame:
    """One row: the family with the highest score, the earlier declared on a tie, else generic."""
    priority = cases([(F.col("family") == f, F.lit(len(families) - i)) for i, f in enumerate(families)], F.lit(0))
    best = F.max_by("family", F.struct("score", priority.alias("priority")))
    return scores.agg(F.coalesce(best, F.lit("generic")).alias("detected_industry"))


def boost(detections: DataFrame, family: Column, detectors: Sequence[Detector] = INDUSTRY_DETECTORS, ignore_case: bool | None = None) -> DataFrame:
    """Multiply the confidence for each matching pattern of the family in the same area, up to 1."""
    factor = F.lit(1.0)
    for d in detectors:
        applies = (F.col("area") == d.area) & (F.col("_family") == d.family) & _hits(F.col("evidence"), d, ignore_case)
        factor = factor * F.when(applies, F.lit(d.multiplier)).otherwise(F.lit(1.0))
    boosted = F.least(F.col("confidence") * factor, F.lit(1.0))
    return detections.withColumn("_family", family).withColumn("confidence", boosted).drop("_family")


def compliance_relevance(families: DataFrame, family: str = "family") -> DataFrame:
    """One row per family and compliance regime that matters for it."""
    regimes = cases([(F.col(family) == f, F.array(*map(F.lit, r))) for f, r in FAMILY_REGIMES.items()], F.array(*map(F.lit, DEFAULT_REGIMES)))
    return families.select(family, F.explode(regimes).alias("regime"))


def recommended_patterns(families: DataFrame, family: str = "family", detectors: Sequence[Detector] = INDUSTRY_DETECTORS) -> DataFrame:
    """One row per family and pattern declared for it."""
    rows = F.array(*[
        F.struct(F.lit(d.family).alias("_family"), F.lit(d.name).alias("name"), F.lit(d.description).alias("description"), F.lit(d.area).alias("category"))
        for d in detectors
    ])
    return families.select(family, F.inline(rows)).filter(F.col("_family") == F.col(family)).drop("_family")


def hinted_columns(catalog: DataFrame, hints) -> DataFrame:
    """Columns whose name contains one of the hint names of a variant group."""
    name = F.lower("column")
    rows = F.array(*[F.struct(F.lit(g).alias("hint_group"), any_of(name.contains(h) for h in words).alias("hit")) for g, words in hints.items()])
    return catalog.select("*", F.inline(rows)).filter("hit").drop("hit")
