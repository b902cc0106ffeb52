"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sightline.llm import bpe, chat_trees, conversation_repair, fm_index, html_wrappers, language_id, merkle_manifest, permutation_index, quality_ensemble, quality_rules, sharding, simhash_covering, toxicity_crf
from sightline.llm.common import table
from sightline.session import configure

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards_of(table(spark, sf_dir, "documents"))


def op2_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.texts_of(table(spark, sf_dir, "pages"))


def op3_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_trees.digests(table(spark, sf_dir, "conversations"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def op5_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_crf.scores_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op7_quality_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ensemble.scores_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_covering.near_duplicates(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages_of(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.tampered_manifest(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damage_report(table(spark, sf_dir, "conversations"))


def op13_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.neighbours(table(spark, sf_dir, "embeddings"))


def _configured(fn):
    return lambda spark, sf_dir: fn(configure(spark), sf_dir)


QUERIES = {fn.__name__: _configured(fn) for fn in (op1_sharding, op2_html_wrappers, op3_chat_trees, op4_quality_rules, op5_toxicity_crf, op6_bpe, op7_quality_ensemble, op8_fm_index, op9_simhash_covering, op10_language_id, op11_merkle_manifest, op12_conversation_repair, op13_permutation_index)}

ORACLES = {
    "op3_chat_trees": chat_trees.SQL, "op4_quality_rules": quality_rules.sql(), "op8_fm_index": fm_index.SQL,
    "op11_merkle_manifest": merkle_manifest.sql(), "op12_conversation_repair": conversation_repair.sql(),
}
