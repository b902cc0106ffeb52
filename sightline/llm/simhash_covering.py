"""SimHash near-duplicates with covering locality-sensitive hashing.

Each bit position gets a random vector of RADIUS + 1 bits. Every non-zero vector v gives a table: its
mask keeps the positions whose vector has an odd number of ones in common with v. At most RADIUS
differing positions never span all RADIUS + 1 dimensions, so some v is orthogonal to all of them:
its mask drops them all, and every pair within the radius meets in that table.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import free_name, stored, utf8, with_columns_in_arrow

RADIUS, BITS, SHINGLE, SEED = 4, 64, 4, 42
#: Members of one bucket that are compared in one task at once; larger buckets are dealt out in pairs of such parts.
PART = 4096


def masks(radius: int = RADIUS, seed: int = SEED) -> list[int]:
    """One 64-bit mask per table, 2 ** (radius + 1) - 1 of them."""
    rng = random.Random(seed)
    # Vectors dealt evenly, so that every mask keeps about half of the bits.
    dealt = [i % (1 << (radius + 1)) for i in range(BITS)]
    rng.shuffle(dealt)
    return [sum(1 << i for i, m in enumerate(dealt) if (m & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def simhash(text: bytes) -> int:
    """Bits set in more than half of the XXH64 hashes of the 4-word shingles; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z, and the six ASCII white spaces
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, ends = [0, *ends[:-SHINGLE].tolist()], (ends[SHINGLE - 1 :] - 1).tolist()
    hashed = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 1 << 16):
        part = [hashed(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)]
        counts += np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", to: str = "fp") -> DataFrame:
    """All columns and rows, with the fingerprint as a signed long in `to`. Null and empty texts get 0."""

    def work():
        def do(column: pa.Array) -> list[pa.Array]:
            data, ends = utf8(column)
            raw = data.tobytes()
            made = np.array([simhash(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], np.uint64)
            return [pa.array(made.view(np.int64))]

        return do

    return with_columns_in_arrow(docs, [text], {to: T.LongType()}, work)


def forest(points: np.ndarray, radius: int = RADIUS, others: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all points within the radius of each other, one less than a component has
    points. Each point is compared only with those that no link has reached yet. With `others`,
    only pairs across the two arrays count."""
    links: list[tuple[int, int]] = []
    sides = [points] if others is None else [points, others]
    left = [np.ones(len(s), bool) for s in sides]
    for seed in range(len(points)):
        if not left[0][seed]:
            continue
        left[0][seed] = False
        frontier = [(0, seed)]
        while frontier:
            side, i = frontier.pop()
            x, to = sides[side][i], 0 if others is None else 1 - side
            open_ = np.flatnonzero(left[to])
            near = open_[np.bitwise_count(sides[to][open_] ^ x) <= radius]
            left[to][near] = False
            for j in near.tolist():
                links.append((int(x), int(sides[to][j])))
                frontier.append((to, j))
    return links


def near_links(fps: DataFrame, fp: str = "fp", radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within the radius of each other: every
    pair within it is joined by a path of such links. Nothing is capped; buckets with more than
    PART members are split into parts and all pairs of parts are compared."""
    table = [m - (1 << 64) if m >> 63 else m for m in masks(radius)]
    distinct = fps.select(F.col(fp).alias("fp")).distinct()
    spread = distinct.select("fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m in table])).alias("t", "mask"))
    # Two masks may give equal values, so the table takes part in the key.
    keyed = spread.select(F.xxhash64("t", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"), "fp")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    sized = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    large = stored(sized.where(F.col("n") > PART).withColumn("parts", F.ceil(F.col("n") / PART).cast("int")))

    def small_links(batches):
        """Rows come sorted by bucket; a bucket may go on in the next batch."""
        rest = np.zeros((2, 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([rest, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            yield from found(rows[:, :cut])
            rest = rows[:, cut:]
        yield from found(rest)

    def found(rows):
        b, x = rows[0], rows[1].view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, int)
        size = np.diff(np.append(starts, len(b)))
        links = []
        for at in starts[size == 2]:
            links.append(at)
        twos = np.array(links, int)
        close = twos[np.bitwise_count(x[twos] ^ x[twos + 1]) <= radius] if len(twos) else twos
        out = [(int(x[i]), int(x[i + 1])) for i in close]
        for at, n in zip(starts[size > 2], size[size > 2], strict=True):
            out += forest(x[at : at + n], radius)
        if out:
            pairs = np.array(out, np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def part_links(key, frame):
        points = [np.sort(frame.fp.to_numpy()[(frame.part == p).to_numpy()]).view(np.uint64) for p in key[1:]]
        pairs = forest(points[0], radius, None if key[1] == key[2] else points[1])
        return pd_frame(pairs)

    def pd_frame(pairs):
        import pandas as pd

        made = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": made[:, 0], "b": made[:, 1]})

    small = keyed.join(large.select("bucket"), "bucket", "left_anti") if large.head(1) else keyed
    partitions = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = small.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(small_links, schema)
    if large.head(1):
        members = keyed.join(large, "bucket").withColumn("part", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int"))
        pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(F.col("part"), k.cast("int")).alias("p"), F.greatest(F.col("part"), k.cast("int")).alias("q")))
        dealt = members.select("bucket", "fp", "part", F.explode(pairs).alias("pq")).select("bucket", "fp", "part", "pq.p", "pq.q")
        links = links.unionByName(dealt.groupBy("bucket", "p", "q").applyInPandas(part_links, schema))
    return links.distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in a link; root is the least node that is reachable.

    Alternates large-star and small-star steps until nothing changes; each round is stored in the
    shared folder, so lineage stays short.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = stored(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


def grouped(fingerprinted: DataFrame, key: str = "doc_id", fp: str = "fp") -> DataFrame:
    """All columns and rows, with component_id, the least key among the rows reachable by links,
    and root, the least fingerprint of the component.

    Rows of one fingerprint are linked, so are fingerprints within the radius. Null keys never
    name a component unless all its keys are null. `fingerprinted` is read several times.
    """
    tops = components(near_links(fingerprinted, fp))
    lowest = fingerprinted.groupBy(F.col(fp).alias("node")).agg(F.min(key).alias("least"))
    rooted = lowest.join(tops, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = rooted.select("node", "root").join(ids, "root").select(F.col("node").alias(fp), "component_id", "root")
    return fingerprinted.join(of_node, fp)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint in hex and its component."""
    rows = stored(with_fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"))
    return grouped(rows).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies, with its columns: that of the least key (nulls last), and
    of several such rows the one read first.

    Groups are those of `near_duplicates`: digests of SHINGLE words linked at RADIUS bits or fewer.
    Null, empty and blank texts share the digest 0, so one of them stays. Rows are told apart by where
    they stand in the input, so repeated keys do no harm; `docs` must be a stored table, since it is
    read twice.
    """
    row = free_name(docs, "row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    slim = numbered.select(F.col(f"`{row}`").alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    rows = stored(with_fingerprints(slim).drop("text"))
    # Rows of one fingerprint are one row first, so no fingerprint is hot in the join.
    first = F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("row")))
    lowest = rows.groupBy(F.col("fp").alias("node")).agg(first.alias("first"))
    rooted = lowest.join(components(near_links(rows)), "node", "left")
    kept = rooted.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    return numbered.join(kept.select(F.col("first.row").alias(row)), row, "left_semi").drop(row)
