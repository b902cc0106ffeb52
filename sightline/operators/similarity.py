"""Rows with similar vectors, without comparing everything.

Equal vectors are collapsed first. Then one of two ways:

- `similar_rows` is exact. Each distinct vector has a home cell (its nearest pivot; their number grows with the root
  of the number of vectors), and each cell is cut into rings by the angle to its pivot. The
  blocks that come out know, for their own pivot and for some pivots common to all, the least and the
  greatest angle of their members. By the triangle inequality a vector is compared only with blocks that
  can hold another one within the threshold.
- `hashed_rows` finds each pair with a given probability. Vectors on the same side of some random
  planes meet in a bucket, over as many tables as the probability needs.

In both, two sides (runs of blocks, or parts of a bucket) meet in one task as matrix products, and only what may be
kept leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.session import ensure_checkpoint_dir

SALTS = 8
SLACK = 1e-6  # angles are compared with a little room, the cosine itself decides
SLICE = 256  # rows expanded or compared at a time
MAX_PIVOTS = 4096
#: Blocks are known to every task. Beyond so many, blocks grow instead.
MAX_BLOCKS = 1 << 16
COMMON = 8  # pivots to which every block knows its bounds
BINS = 2048  # of the angle, from which rings are made
MAX_TABLES = 256
#: Sides into which all blocks are gathered, as runs of about equal size. A vector is sent once to each side that it
#: can reach, so what is shuffled grows with the vectors. Sides hold no more than MAX_SIDE vectors, beside the last
#: block, so that two of them fit a task; only past SIDES * MAX_SIDE vectors there are more sides.
SIDES = 8
MAX_SIDE = 1 << 17
CELLS = 1 << 23  # of a matrix product at a time
FOLDS = 32  # columns of which only the greatest counts, where a bound for the closest is looked for

VECTORS = "vkey string, ids array<bigint>, vec array<float>"


def _unit(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1.0, 1.0))


def _distinct_vectors(df: DataFrame, key: str, vector: str, keep: int) -> DataFrame:
    """Distinct vectors with the smallest ids that carry them."""
    norm = F.aggregate(F.col("vec"), F.lit(0.0), lambda a, x: a + x * x)
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("vec")).filter(F.col("vec").isNotNull()).filter(norm > 0)
    rows = rows.withColumn("vkey", F.md5(F.array_join(F.col("vec").cast("array<string>"), ",")))
    # One more than is kept: the row itself is among them. The limit applies before the shuffle.
    order = Window.partitionBy("vkey").orderBy("id")
    few = rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= keep + 1)
    return few.groupBy("vkey").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("vec").alias("vec"))


# ----------------------------------------------------------------------- blocks
@dataclass(frozen=True)
class Blocks:
    """All blocks: home pivot and, for the home pivot and the common ones, least and greatest angle.
    Blocks of one cell are neighbours and in the order of their rings."""

    centres: np.ndarray
    reach: float
    home: np.ndarray
    low: np.ndarray  # blocks x (1 + common)
    high: np.ndarray
    index: dict[tuple[int, int, int], int]
    side: np.ndarray  # of each block

    def reachable(self, angles: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) of all blocks that may hold a vector within reach, and of the own one."""
        rows = np.arange(len(angles))
        near = angles[:, self.home]
        may = (near >= self.low[:, 0] - self.reach) & (near <= self.high[:, 0] + self.reach)
        # Members of another cell are nearer to its pivot than to mine.
        may &= near - angles[rows, self.home[own]][:, None] <= 2 * self.reach
        may[rows, own] = True
        row, block = np.nonzero(may)
        common = angles[row][:, : self.low.shape[1] - 1]
        fits = ((common >= self.low[block, 1:] - self.reach) & (common <= self.high[block, 1:] + self.reach)).all(axis=1)
        keep = fits | (block == own[row])
        return row[keep], block[keep]


def sides_of(sizes: np.ndarray) -> np.ndarray:
    """The side of each block, in the order of the blocks."""
    total = int(sizes.sum())
    sides = max(SIDES, -(-total // MAX_SIDE))
    return np.unique((np.cumsum(sizes) - sizes) * sides // max(1, total), return_inverse=True)[1]


def pivot_count(n: int, block: int) -> int:
    """About the root of the number of vectors, but no more than there are blocks to fill."""
    return int(min(MAX_PIVOTS, max(1, min(np.ceil(np.sqrt(n)), -(-n // block)))))


def _settled(unique: DataFrame, centres: np.ndarray) -> DataFrame:
    """The vectors with their home cell, their angle to its pivot, that angle's bin, and their angles
    to the common pivots."""
    def home(batches):
        for batch in batches:
            if len(batch):
                angles = _angles(_unit(batch["vec"]), centres)
                cell = angles.argmin(axis=1)
                angle = angles[np.arange(len(cell)), cell]
                yield batch.assign(cell=cell.astype(np.int32), angle=angle, bin=(angle * (BINS / np.pi)).astype(np.int32), common=list(angles[:, :COMMON]))

    return unique.mapInPandas(home, f"{VECTORS}, cell int, angle double, bin int, common array<double>")


def _blocked(settled: DataFrame, block: int) -> DataFrame:
    """Adds ring and part. A ring is a run of bins of about `block` vectors; a bin with more of them
    is a ring in several parts, dealt out by hash."""
    bins = settled.groupBy("cell", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("cell").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    rings = bins.withColumn("ring", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / block).cast("int"))
    rings = rings.withColumn("parts", F.ceil(F.col("n") / (2 * block)).cast("int")).drop("n")
    rows = settled.join(rings, ["cell", "bin"])
    return rows.withColumn("part", F.pmod(F.xxhash64("vkey"), F.col("parts")).cast("int")).drop("parts", "bin")


def _bounds(rows: DataFrame, centres: np.ndarray, reach: float) -> Blocks:
    common = min(COMMON, len(centres))
    ends = [f(F.col("common")[i]).alias(f"{name}{i}") for i in range(common) for name, f in (("low", F.min), ("high", F.max))]
    # At most MAX_BLOCKS blocks and one more per cell, so the driver and the tasks can hold them.
    found = rows.groupBy("cell", "ring", "part").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"), *ends).orderBy("cell", "ring", "part").collect()
    return Blocks(
        centres, reach, np.array([r["cell"] for r in found], np.int64),
        np.array([[r["low"], *(r[f"low{i}"] for i in range(common))] for r in found], np.float64).reshape(len(found), -1),
        np.array([[r["high"], *(r[f"high{i}"] for i in range(common))] for r in found], np.float64).reshape(len(found), -1),
        {(r["cell"], r["ring"], r["part"]): i for i, r in enumerate(found)},
        sides_of(np.array([r["n"] for r in found], np.int64)),
    )


def _reached(part: pd.DataFrame, known: Blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The own block of each row, and (row, block) of all blocks within its reach."""
    own = np.array([known.index[k] for k in zip(part["cell"], part["ring"], part["part"])])
    return own, *known.reachable(_angles(_unit(part["vec"]), known.centres), own)


def _slices(batches: Iterator[pd.DataFrame], step: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lo in range(0, len(batch), step):
            yield batch.iloc[lo:lo + step].reset_index(drop=True)


def _touches(rows: DataFrame, blocks: Blocks) -> DataFrame:
    """One row per vector and block within its reach: the pair of blocks, and the side."""
    n = len(blocks.home)
    shared = rows.sparkSession.sparkContext.broadcast(blocks)

    def spread(batches):
        known = shared.value
        for part in _slices(batches, max(1, min(SLICE, (1 << 22) // n))):
            own, row, other = _reached(part, known)
            mine = own[row]
            yield pd.DataFrame({"pair": np.minimum(mine, other) * n + np.maximum(mine, other), "side": (mine > other).astype(np.int32), "alone": mine == other})

    return rows.mapInPandas(spread, "pair bigint, side int, alone boolean")


def _sent(rows: DataFrame, blocks: Blocks) -> DataFrame:
    """One row per vector and side with blocks within its reach: the pair of sides, on which of them it
    is, its own block and these blocks."""
    n = len(blocks.home)
    shared = rows.sparkSession.sparkContext.broadcast(blocks)

    def spread(batches):
        known = shared.value
        sides = int(known.side[-1]) + 1
        for part in _slices(batches, max(1, min(SLICE, (1 << 22) // n))):
            own, row, other = _reached(part, known)
            # Rows come in order, and so do the blocks of a row and their sides.
            starts = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(known.side[other]) != 0)])
            to, mine = known.side[other[starts]], known.side[own[row[starts]]]
            out = part.loc[row[starts], ["vkey", "ids", "vec"]].reset_index(drop=True)
            out["own"] = own[row[starts]].astype(np.int32)
            out["reach"] = np.split(other.astype(np.int32), starts[1:])
            out["pair"] = np.minimum(mine, to) * sides + np.maximum(mine, to)
            out["side"] = (mine > to).astype(np.int32)
            out["alone"] = mine == to
            yield out

    return rows.mapInPandas(spread, f"{VECTORS}, own int, reach array<int>, pair bigint, side int, alone boolean")


def _exact_blocks(df: DataFrame, key: str, vector: str, threshold: float, keep: int, block: int) -> tuple[DataFrame, DataFrame | None, Blocks | None]:
    """Distinct vectors, those with their blocks, and the blocks; None where there are no vectors."""
    ensure_checkpoint_dir(df.sparkSession)
    unique = _distinct_vectors(df, key, vector, keep).checkpoint()
    n = unique.count()
    # A bounded number of vectors comes to the driver; digests deal them out evenly.
    chosen = unique.orderBy("vkey").select("vec").limit(pivot_count(n, block)).collect()
    if not chosen:
        return unique, None, None
    centres = _unit([r["vec"] for r in chosen])
    settled = _settled(unique, centres).checkpoint()
    rows = _blocked(settled, max(block, -(-n // MAX_BLOCKS))).checkpoint()
    return unique, rows, _bounds(rows, centres, float(np.arccos(threshold)) + SLACK)


def blocks_touched(df: DataFrame, key: str, vector: str, threshold: float = 0.7, block: int = 2048) -> DataFrame:
    """One row: vectors, blocks, pairs of blocks within reach of each other, all pairs there are, and how
    many (vector, block) are within reach of all there are."""
    unique, rows, blocks = _exact_blocks(df, key, vector, threshold, 1, block)
    n = 0 if blocks is None else len(blocks.home)
    sent = unique.select(F.lit(0).cast("bigint").alias("pair"), F.lit(0).alias("side"), F.lit(True).alias("alone")) if blocks is None else _touches(rows, blocks)
    total = unique.agg(F.count(F.lit(1)).alias("n_vectors"))
    pairs = sent.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.max("side").alias("right"), F.min("side").alias("left"), F.first("alone").alias("alone"))
    # A pair of two blocks is compared only if vectors of both reach the other one.
    counts = pairs.agg(F.count_if(F.col("alone") | (F.col("left") != F.col("right"))).alias("pairs_compared"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_sent"))
    return total.crossJoin(counts).select("n_vectors", F.lit(n).cast("bigint").alias("n_blocks"), "pairs_compared", F.lit(n * (n + 1) // 2).cast("bigint").alias("pairs"), "rows_sent", (F.col("n_vectors") * n).alias("rows"))


# ---------------------------------------------------------------------- results
def _hits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of what holds; of one dimension that is found faster."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def _first_ones(units: np.ndarray, others: np.ndarray, itself: np.ndarray, threshold: float, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, cosine) of the first `keep` columns above the threshold. A row that has them is done."""
    found, have = [], np.zeros(len(units), np.int64)
    for lo in range(0, len(others), 8 * SLICE):
        rows = np.flatnonzero(have < keep)
        if not len(rows):
            break
        cosine = units[rows] @ others[lo:lo + 8 * SLICE].T
        i, j = _hits(cosine > threshold)
        sims = cosine[i, j]
        i, j = rows[i], lo + j
        use = j != itself[i]
        i, j, sims = i[use], j[use], sims[use]
        top = have[i] + np.arange(len(i)) - np.searchsorted(i, i) < keep
        i, j, sims = i[top], j[top], sims[top]
        have += np.bincount(i, minlength=len(units))
        found.append((i, j, sims))
    return tuple(np.concatenate(x) for x in zip(*found))


def _nearest_ones(units: np.ndarray, others: np.ndarray, itself: np.ndarray, threshold: float, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, cosine) of the `keep` greatest above the threshold and whatever equals the last of them. The
    greatest of some columns each are different columns, so the `keep`th of these is a lower bound."""
    cosine = units @ others.T
    rows = np.flatnonzero(itself >= 0)
    cosine[rows, itself[rows]] = -2.0
    low = np.full(len(cosine), threshold)
    width = cosine.shape[1] // FOLDS
    if width >= keep:
        greatest = cosine[:, :FOLDS * width].reshape(len(cosine), FOLDS, width).max(axis=1)
        low = np.maximum(low, np.partition(greatest, width - keep, axis=1)[:, width - keep])
    i, j = _hits(cosine >= low[:, None])
    sims = cosine[i, j]
    above = sims > threshold
    return i[above], j[above], sims[above]


def _closest(left: pd.DataFrame, right: pd.DataFrame, threshold: float, keep: int, rank_by: str) -> Iterator[pd.DataFrame]:
    """For each row of the left side up to `keep` of the right side above the threshold, in the order of
    their first ids or from the closest on. With `own` and `reach`, rows are compared with those of the right
    side that reach their block."""
    if left.empty or right.empty or keep < 1:
        return
    first = np.array([v[0] for v in right["ids"]])
    by_id = np.argsort(first, kind="stable")
    first, keys, ids, others = first[by_id], right["vkey"].to_numpy()[by_id], right["ids"].to_numpy()[by_id], _unit(right["vec"])[by_id]
    at = {k: i for i, k in enumerate(keys)}
    look = _first_ones if rank_by == "id" else _nearest_ones
    whole = np.arange(len(keys))
    if "own" in left:
        reach = right["reach"].to_numpy()[by_id]
        block, column = np.concatenate(reach), np.repeat(whole, [len(r) for r in reach])
        order = np.argsort(block, kind="stable")
        block, column = block[order], column[order]
        parts = [(part, column[np.searchsorted(block, b):np.searchsorted(block, b, side="right")]) for b, part in left.groupby("own")]
    else:
        parts = [(left, whole)]
    for part, columns in parts:
        if not len(columns):
            continue
        mine, units, names = (others, first, keys) if len(columns) == len(keys) else (others[columns], first[columns], keys[columns]), _unit(part["vec"]), part["vkey"].to_numpy()
        place = np.full(len(keys) + 1, -1)
        place[columns] = np.arange(len(columns))
        itself = place[[at.get(k, -1) for k in names]]
        step = SLICE if rank_by == "id" else max(16, min(SLICE, CELLS // len(columns)))
        for lo in range(0, len(units), step):
            i, j, sims = look(units[lo:lo + step], mine[0], itself[lo:lo + step], threshold, keep)
            if not len(i):
                continue
            order = np.lexsort((mine[1][j], i)) if rank_by == "id" else np.lexsort((mine[1][j], -sims, i))
            i, j, sims = i[order], j[order], sims[order]
            top = np.arange(len(i)) - np.searchsorted(i, i) < keep
            yield pd.DataFrame({"vkey": names[lo + i[top]], "ids": ids[columns[j[top]]], "similarity": sims[top]})


def _compared(sent: DataFrame, threshold: float, keep: int, rank_by: str) -> DataFrame:
    """(vkey, ids, similarity) out of the groups of (pair, side, alone)."""
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"vkey": pd.Series(dtype=object), "ids": pd.Series(dtype=object), "similarity": pd.Series(dtype=float)})
        if pdf["alone"].iloc[0]:
            parts = list(_closest(pdf, pdf, threshold, keep, rank_by))
        else:
            left, right = (pdf[pdf["side"] == s] for s in (0, 1))
            parts = [*_closest(left, right, threshold, keep, rank_by), *_closest(right, left, threshold, keep, rank_by)]
        return pd.concat(parts) if parts else none

    return sent.groupBy("pair").applyInPandas(compare, "vkey string, ids array<bigint>, similarity double")


def _result(df: DataFrame, unique: DataFrame, near: DataFrame, key: str, vector: str, keep: int, rank_by: str) -> DataFrame:
    copies = unique.filter(F.size("ids") > 1).select("vkey", "ids", F.lit(1.0).alias("similarity"))
    others = near.unionByName(copies).select("vkey", F.explode("ids").alias("similar_id"), "similarity")
    order = [F.col("similar_id")] if rank_by == "id" else [F.desc("similarity"), F.col("similar_id")]
    best = others.withColumn("_rn", F.row_number().over(Window.partitionBy("vkey").orderBy(*order))).filter(F.col("_rn") <= keep + 1)
    lists = best.groupBy("vkey").agg(F.sort_array(F.collect_list(F.struct("_rn", "similar_id", "similarity"))).alias("found"))

    # A vector with very many copies is spread over several join keys.
    members = df.select(F.col(key), F.md5(F.array_join(F.col(vector).cast("array<string>"), ",")).alias("vkey")).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    salted = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    kept = F.slice(F.filter("found", lambda f: f["similar_id"] != F.col(key)), 1, keep)
    return members.join(salted, ["vkey", "_salt"]).select(key, F.inline(F.transform(kept, lambda f: F.struct(f["similar_id"].alias("similar_id"), f["similarity"].alias("similarity")))))


def _ranked_by(rank_by: str) -> None:
    if rank_by not in ("id", "similarity"):
        raise ValueError("rank_by is id or similarity")


def similar_rows(df: DataFrame, key: str, vector: str, threshold: float = 0.7, keep: int = 5, rank_by: str = "id", block: int = 2048) -> DataFrame:
    """(id, similar_id, similarity): for each row up to `keep` others above the threshold, exactly.

    `rank_by` is "id" (the first ones in id order) or "similarity" (the closest ones). Runs jobs
    while the plan is built: distinct vectors, home cells and blocks are written to the checkpoint folder.
    """
    _ranked_by(rank_by)
    unique, rows, blocks = _exact_blocks(df, key, vector, threshold, keep, block)
    if blocks is None:
        return _result(df, unique, unique.select("vkey", "ids", F.lit(0.0).alias("similarity")), key, vector, keep, rank_by)
    return _result(df, unique, _compared(_sent(rows, blocks), threshold, keep, rank_by), key, vector, keep, rank_by)


# ------------------------------------------------------------------- hyperplanes
def tables_needed(threshold: float, bits: int, recall: float) -> int:
    """Tables of so many planes in which a pair at the threshold meets with this probability."""
    meets = (1 - np.arccos(threshold) / np.pi) ** bits
    return max(1, int(np.ceil(np.log1p(-recall) / np.log1p(-meets)))) if meets < 1 else 1


def planes_for(n: int, threshold: float, recall: float, block: int) -> tuple[int, int]:
    """(planes of a table, tables): as many planes as give buckets of about a block, or as MAX_TABLES allow."""
    bits = max(1, int(np.ceil(np.log2(max(2, n / block)))))
    while bits > 1 and tables_needed(threshold, bits, recall) > MAX_TABLES:
        bits -= 1
    return bits, tables_needed(threshold, bits, recall)


def hashed_rows(df: DataFrame, key: str, vector: str, threshold: float = 0.7, keep: int = 5, rank_by: str = "id", recall: float = 0.95, block: int = 2048, seed: int = 42) -> DataFrame:
    """As `similar_rows`, but each pair at the threshold is found with probability `recall` (closer
    pairs with a higher one); what is found is compared exactly.

    A bucket larger than a block is dealt out in parts, and all pairs of its parts are compared.
    """
    _ranked_by(rank_by)
    ensure_checkpoint_dir(df.sparkSession)
    unique = _distinct_vectors(df, key, vector, keep).checkpoint()
    first = unique.select(F.size("vec").alias("d")).first()
    if first is None:
        return _result(df, unique, unique.select("vkey", "ids", F.lit(0.0).alias("similarity")), key, vector, keep, rank_by)
    bits, tables = planes_for(unique.count(), threshold, recall, block)
    dim = first["d"]

    def codes(batches):
        planes = np.random.default_rng(seed).normal(size=(dim, tables * bits))
        for batch in batches:
            for lo in range(0, len(batch), SLICE):
                part = batch.iloc[lo:lo + SLICE]
                sides = (_unit(part["vec"]) @ planes > 0).reshape(len(part), tables, bits)
                code = sides.dot(1 << np.arange(bits, dtype=np.int64)) + (np.arange(tables, dtype=np.int64) << bits)
                out = part.loc[part.index.repeat(tables)].reset_index(drop=True)
                yield out.assign(bucket=code.ravel())

    keyed = unique.mapInPandas(codes, f"{VECTORS}, bucket bigint")
    sizes = unique.mapInPandas(codes, f"{VECTORS}, bucket bigint").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / block).cast("int")
    members = keyed.join(sizes, "bucket").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("vkey"), F.col("parts")).cast("int"))
    other = members.select("vkey", "ids", "vec", "bucket", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    pair = F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other"))
    sent = other.select("vkey", "ids", "vec", pair.alias("pair"), (F.col("part") > F.col("other")).cast("int").alias("side"), (F.col("part") == F.col("other")).alias("alone"))
    near = _compared(sent, threshold, keep, rank_by)
    # A pair may meet in several tables.
    once = near.groupBy("vkey", "ids").agg(F.max("similarity").alias("similarity"))
    return _result(df, unique, once, key, vector, keep, rank_by)
