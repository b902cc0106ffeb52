"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order in which it sees PIVOTS pivots, nearest first. It is posted in
the inverted files of its POSTED nearest pivots. A query opens the files of its PROBED nearest pivots,
ranks what it finds there by Spearman's footrule (how far the pivots' places differ in both orders), and
compares the nearest RERANKED share of each file exactly.

An inverted file is a cell of a Spark shuffle. A file with more than CELL vectors is dealt out over
several cells by hash, and its queries go to each of them, so that a pivot near which a third of all
vectors lies is many tasks. Within a cell the vectors come first and the queries stream by in batches.

Nearness is the inner product. For the order of pivots only, vectors get one more component that
makes their lengths equal, so that the largest inner product is the smallest angle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import stored, with_columns_in_arrow

#: Pivots are the first distinct vectors of a sample of SAMPLE rows in hashed order; nothing else is fitted.
PIVOTS, SAMPLE = 64, 4096
#: Files a vector is posted in, files a query opens, share of a file that is compared exactly.
POSTED, PROBED, RERANKED = 3, 24, 0.4
#: Vectors of a cell, about.
CELL = 8192


@dataclass(frozen=True)
class Pivots:
    """Unit vectors with the added component, and the greatest squared length of all vectors."""

    points: np.ndarray
    longest: float

    def order(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """The places (0 for the nearest) of the pivots, as seen by each vector."""
        rest = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(self.longest - (vectors * vectors).sum(1), 0.0))
        seen = vectors @ self.points[:, :-1].T + rest[:, None] * self.points[:, -1]
        return np.argsort(np.argsort(-seen, axis=1, kind="stable"), axis=1).astype(np.int16)


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite numbers, and not all zero."""
    ok = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vector.isNotNull() & F.coalesce(ok, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def usable_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec) of the rows that take part: those with an id and a usable vector of the usual length,
    which is the most frequent one (of equally frequent ones the least)."""
    vec = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (size["n"] if size else 0))


def fitted(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> Pivots | None:
    """Pivots from at most `sample` rows, the greatest length from all; None without rows."""
    longest = rows.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    if longest is None:
        return None
    some = rows.orderBy(F.xxhash64("id"), "id", "vec").limit(sample)
    # At most `pivots` vectors come to the driver.
    first = some.groupBy("vec").agg(F.min(F.struct(F.xxhash64("id"), "id")).alias("at")).orderBy("at", "vec").limit(pivots).collect()
    points = np.array([r["vec"] for r in first], np.float64)
    rest = np.sqrt(np.maximum(longest - (points * points).sum(1), 0.0))
    return Pivots(np.column_stack([points, rest]) / np.sqrt(longest), float(longest))


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def _bytes(column: pa.Array, kind: type, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), size)


def ordered(rows: DataFrame, pivots: Pivots, query: bool, files: int) -> DataFrame:
    """(id, vec, places, files): the vector as bytes, the places of the pivots, and the nearest `files` pivots in order."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def work():
        def do(column: pa.Array) -> list[pa.Array]:
            if not len(column):
                return [pa.array([], pa.binary()), pa.array([], pa.binary()), pa.array([], pa.list_(pa.int32()))]
            p = shared.value
            vectors = _vectors(column, p.points.shape[1] - 1)
            places = p.order(vectors, query)
            near = np.argsort(places, axis=1, kind="stable")[:, :files].astype(np.int32)
            return [pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array([x.tobytes() for x in places.astype(np.uint8 if places.shape[1] <= 256 else np.uint16)], pa.binary()), pa.array(near.tolist(), pa.list_(pa.int32()))]

        return do

    return with_columns_in_arrow(rows, ["vec"], {"bytes": T.BinaryType(), "places": T.BinaryType(), "files": T.ArrayType(T.IntegerType())}, work).select("id", "bytes", "places", "files")


def nearest_in(ids: np.ndarray, vectors: np.ndarray, places: np.ndarray, own: int, query: np.ndarray, seen: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and inner products of the best k of a cell, after the footrule has chosen a share of it.
    The cell is in the order of ids, and of equal footrules the smaller ids come first."""
    at = np.arange(len(ids))
    n = max(4 * k, int(np.ceil(share * len(ids))))
    if n < len(ids):
        footrule = np.abs(places - seen).sum(1, dtype=np.int64)
        at = np.argpartition(footrule * len(ids) + at, n - 1)[:n]
    at = at[ids[at] != own]
    scores = vectors[at] @ query
    best = np.lexsort((ids[at], -scores))
    if len(best) > k:
        # Rows of one id are one item, so a few more may be needed until k ids are full.
        _, first = np.unique(ids[at[best]], return_index=True)
        best = best[np.sort(first)[:k]]
    return ids[at[best]], scores[best]


def _cells(posted: DataFrame, asked: DataFrame, pivots: Pivots, k: int, share: float, cell: int) -> DataFrame:
    """(query_id, vec_id, score) found in the cells; at most k rows per query and cell."""
    width, size = pivots.points.shape[0], pivots.points.shape[1] - 1
    kind = np.uint8 if width <= 256 else np.uint16
    posts = posted.select("id", "bytes", "places", F.explode("files").alias("file"))
    # One row per pivot.
    parts = {r["file"]: -(-r["n"] // cell) for r in posted.select(F.explode("files").alias("file")).groupBy("file").agg(F.count("*").alias("n")).collect()}
    of_file = F.array(*[F.lit(parts.get(f, 1)) for f in range(width)])
    posts = posts.withColumn("part", F.pmod(F.xxhash64("id", "bytes"), F.get(of_file, F.col("file")).cast("long")).cast("int")).withColumn("asks", F.lit(0))
    asks = asked.select("id", "bytes", "places", F.explode("files").alias("file"))
    asks = asks.withColumn("part", F.explode(F.sequence(F.lit(0), F.get(of_file, F.col("file")) - 1))).withColumn("asks", F.lit(1))

    def run(batches):
        """Rows come sorted by cell, vectors before queries; a cell may go on in the next batch."""
        open_, held, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column(c).to_numpy() for c in (3, 4, 5)], axis=1)
            cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1).tolist(), len(names)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                if tuple(names[a, :2]) != open_:
                    open_, held, index = tuple(names[a, :2]), [], None
                ids, raw = part.column(0).to_numpy(), (part.column(1), part.column(2))
                if not names[a, 2]:
                    held.append((ids, _bytes(raw[0], np.float64, size), _bytes(raw[1], kind, width)))
                    continue
                if not held:
                    continue
                if index is None:
                    index = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    by_id = np.argsort(index[0], kind="stable")
                    index = (index[0][by_id], index[1][by_id], index[2][by_id].astype(np.int16))
                    held = held[:1]
                for own, query, seen in zip(ids.tolist(), _bytes(raw[0], np.float64, size), _bytes(raw[1], kind, width).astype(np.int16), strict=True):
                    found, scores = nearest_in(*index, own, query, seen, k, share)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), own)), pa.array(found), pa.array(scores)], names=["query_id", "vec_id", "score"])

    n = max(int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(sum(parts.values()), 4096))
    rows = posts.unionByName(asks).repartition(n, "file", "part").sortWithinPartitions("file", "part", "asks")
    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, pivots: int = PIVOTS, posted: int = POSTED, probed: int = PROBED, share: float = RERANKED, cell: int = CELL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, nearest first, ties to the
    smaller id, by the exact inner product in double precision.

    Every vector is indexed. Rows without id, and vectors that are null, empty, all zero, of another than the usual
    length or with null or non-finite components, take no part, neither as vectors nor as queries. Rows of
    one id are one item: never its own neighbour, and as near as its nearest vector. A query for which
    the opened files hold fewer than k items is asked again in all files without the footrule, so k are
    found wherever there are k. An empty table gives an empty result.
    """
    rows = stored(usable_rows(vectors, key, vector))
    fit = fitted(rows, pivots)
    if fit is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = fit.points.shape[1] - 1
    vec = F.col(f"`{vector}`").cast("array<double>")
    asks = queries.select(F.col(f"`{key}`").cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")) & (F.size("vec") == size))
    index = stored(ordered(rows, fit, False, posted))
    asked = stored(ordered(asks, fit, True, len(fit.points)))
    near = stored(_ranked(_cells(index, asked.withColumn("files", F.slice("files", 1, probed)), fit, k, share, cell), k))
    short = asked.join(near.where(F.col("rank") == k).select(F.col("query_id").alias("id")), "id", "left_anti")
    if short.head(1):
        # Whatever is posted is posted in the first of its files.
        first = index.withColumn("files", F.slice("files", 1, 1))
        more = _ranked(_cells(first, short, fit, k, 1.0, cell), k)
        near = near.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(more)
    return near.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbours(embeddings: DataFrame) -> DataFrame:
    """The 20 nearest others of every vector whose id is divisible by 20, against all vectors."""
    return search(embeddings, embeddings.where(F.col("vec_id") % 20 == 0))
