"""The corpus pipeline: documents in, clean, distinct, encoded documents out.

Each stage takes what its predecessor wrote. The first four return the columns they were given.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import bpe, fm_index, language_id, quality_rules, simhash_covering
from sightline.llm.common import fold, set_aside, stage_folder, table
from sightline.session import configure

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: A document stays if its language is predicted with this probability.
SURE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; null texts and those without letters go."""
    model = language_id.train(docs.where(fold() != 0))
    rows, text, back = set_aside(docs)
    return back(language_id.predict(rows, model, text).where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= SURE)))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are near a language reference; empty ones go."""
    judged, p = quality_rules.judged(docs, quality_rules.references(docs))
    return judged.where(F.col(p + "kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash_covering.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: these are cut out, and a document goes if no word is left."""
    return fm_index.cleaned(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their tokens."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("quality_rules", good_quality),
    ("simhash_near_dedup", distinct_texts),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]

#: Learned models, fingerprints and merge ranks have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each but the last written to the shared folder and read again."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    folder = stage_folder(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}_{name}")
            docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs
