"""Registered vector queries and their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators.similarity import blocks_touched, hashed_rows, similar_rows
from sightline.plans.registry import rounded
from sightline.sources.tables import loader

#: Components over which similarity_blocks counts.
SHORT = 8


def _short(spark, base):
    return loader(spark, base)("embeddings").select("vec_id", F.slice("embedding", 1, SHORT).alias("embedding"))


def _similar(threshold, rank_by="id", find=similar_rows):
    return lambda spark, base: rounded(find(loader(spark, base)("embeddings"), "vec_id", "embedding", threshold, rank_by=rank_by))


def _sql(threshold, order):
    cosine = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
    return f"""SELECT vec_id, similar_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY {order}) AS rn FROM (
      SELECT a.vec_id, b.vec_id AS similar_id, {cosine} AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE s > {threshold}) WHERE rn <= 5"""


QUERIES = {
    "similar_vectors": _similar(0.7),
    "similar_vectors_loose": _similar(0.3),
    "similar_vectors_closest": _similar(0.3, "similarity"),
    "similar_vectors_hashed": _similar(0.7, "similarity", hashed_rows),
    "similarity_blocks": lambda spark, base: blocks_touched(_short(spark, base), "vec_id", "embedding", 0.9),
}

ORACLES = {
    "similar_vectors": _sql(0.7, "similar_id"),
    "similar_vectors_loose": _sql(0.3, "similar_id"),
    "similar_vectors_closest": _sql(0.3, "s DESC, similar_id"),
}
