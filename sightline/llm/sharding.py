"""Byte-balanced shards by Karmarkar-Karp differencing over indivisible groups.

Groups are equal texts. Groups above a share of all bytes are items of their own, the many small
ones are bundled by hash; both numbers are bounded whatever the input, so that differencing runs
over a bounded list of item sizes. Rows are never moved for it: they look up their item's shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import stored

#: Bundles of small groups. A group of more than 1 / BUNDLES of all bytes is an item of its own.
BUNDLES = 4096


def difference(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """Shard of each item. Each partial partition is a list of (bytes, items) in descending order;
    the two of largest spread are laid on each other in opposite order until one is left."""
    heap = [(-size, item, [(size, (item,))] + [(0, ())] * (shards - 1)) for item, size in sizes.items()]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, key, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        # Items are kept as nested pairs, so that a merge does not copy them.
        joined = sorted(((x + y, (p, q) if p and q else p or q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)), key=lambda e: -e[0])
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], key, joined))
    out: dict[int, int] = {}
    for shard, (_, items) in enumerate(heap[0][2] if heap else []):
        todo = [items]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo.extend(x)
            else:
                out[x] = shard
    return out


def item(digest: Column) -> Column:
    """Bundle of a group, 0 to BUNDLES - 1."""
    return F.pmod(F.xxhash64(digest), F.lit(BUNDLES)).cast("int")


def sharded(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size, text_crc32, shard and slot of every row; nothing else of the row is kept.

    Rows of equal text are in one shard, however many they are; null counts as an empty text. A
    group larger than a fair share makes its shard larger, and the others share the rest. Slots
    are gapless from 0 in each shard. An empty table gives an empty result.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{key}`").alias(key),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(t, 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stored(rows)
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    heavy = F.col("bytes") * BUNDLES > total
    sizes = groups.groupBy(heavy.alias("heavy"), F.when(heavy, F.col("digest")).alias("digest"), F.when(~heavy, item(F.col("digest"))).alias("bundle")).agg(F.sum("bytes").alias("bytes"))
    # At most BUNDLES heavy groups and BUNDLES bundles.
    items = sizes.select("heavy", "digest", "bundle", "bytes").orderBy("bundle", "digest").collect()
    shard = difference({i: r["bytes"] for i, r in enumerate(items)}, shards)
    of_bundle = {r["bundle"]: shard[i] for i, r in enumerate(items) if not r["heavy"]}
    table = F.array(*[F.lit(of_bundle.get(b, 0)) for b in range(BUNDLES)])
    alone = [(r["digest"], shard[i]) for i, r in enumerate(items) if r["heavy"]]
    alone = rows.sparkSession.createDataFrame(alone, T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("own", T.IntegerType())]))
    placed = rows.join(F.broadcast(alone), "digest", "left").withColumn("shard", F.coalesce("own", F.get(table, item(F.col("digest")))))
    return slotted(placed.select(key, "size", "text_crc32", "shard", "row"))


def slotted(rows: DataFrame) -> DataFrame:
    """A gapless `slot` from 0 in each shard, in the order of `row`. The upper bits of `row` tell in
    which block of the input it was read; blocks are counted, their counts summed up, and rows
    numbered within their block, so that no task holds the rows of a whole shard."""
    rows = rows.withColumn("block", F.shiftright("row", 33))
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "block").orderBy("row")
    numbered = rows.withColumn("place", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "block"]).withColumn("slot", F.col("start") + F.col("place")).drop("block", "start", "place", "row")


def shards_of(docs: DataFrame) -> DataFrame:
    """Documents in 8 shards under the law of near equal bytes."""
    return sharded(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
