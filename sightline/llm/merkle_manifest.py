"""Merkle manifest of a dataset with SHA-256 midstates.

Rows are leaves. Leaves of one group (language) form a tree in which every FAN consecutive nodes have
a parent; the roots of the groups form one more such tree. A parent keeps a copy of its hash state
from before each child slot. When a child is replaced, its parent's digest is found again by resuming
the state of that slot with the replacement and the siblings to its right; those to its left are
never hashed again.

Spark works in blocks of LEVELS levels, that is FAN ** LEVELS neighbouring nodes, one row each. Going
up, each block gives its root, and the roots are the nodes of the next round. Going down, each block
gets the way from its root to the root of all, and folds all its nodes. So no task holds more than
some blocks, whatever the size of a group, and a group of a third of all rows is many blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import stored, with_columns_in_arrow
from sightline.operators.ordering import with_rank

FAN = 8
#: Levels of a block; a block has FAN ** LEVELS nodes.
LEVELS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: From a block's root up: the slot taken in each parent, and the digests of all its children.
STEP = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("children", T.ArrayType(T.StringType()))])


class Parent:
    """A node with its children: its digest, and a copy of the hash state before each child."""

    __slots__ = ("children", "states", "digest")

    def __init__(self, children: Sequence[bytes]):
        state, self.children, self.states = sha256(), children, []
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def folded(self, slot: int, replacement: bytes) -> bytes:
        """The digest with one child replaced."""
        state = self.states[slot].copy()
        state.update(replacement)
        for sibling in self.children[slot + 1 :]:
            state.update(sibling)
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> bytes:
        return b"".join(self.children[:slot]) + b"".join(self.children[slot + 1 :])


def parents_of(nodes: list[bytes], whole: bool, depth: int = LEVELS) -> list[list[Parent]]:
    """The levels of parents over the nodes of a block: up to one node if the block is a whole tree,
    else `depth`. A single node that is a whole tree has no parent."""
    levels: list[list[Parent]] = []
    while len(nodes) > 1 if whole else len(levels) < depth:
        levels.append([Parent(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)])
        nodes = [p.digest for p in levels[-1]]
    return levels


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _blocks(nodes: DataFrame, depth: int) -> DataFrame:
    """One row per block of (tree, pos, digest, ...): tree, block, members in order, whole (the block
    is all of its tree), root."""
    rest = [c for c in nodes.columns if c not in ("tree", "pos")]
    grouped = nodes.groupBy("tree", F.floor(F.col("pos") / FAN**depth).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", *rest))).alias("members"))
    sizes = nodes.groupBy("tree").agg((F.count("*") <= FAN**depth).alias("whole"))

    def work():
        def do(digests: pa.Array, whole: pa.Array) -> list[pa.Array]:
            roots = []
            for nodes_, all_ in zip(digests.to_pylist(), whole.to_pylist(), strict=True):
                levels = parents_of([x.encode() for x in nodes_], all_, depth)
                roots.append(levels[-1][0].digest.decode() if levels else nodes_[0])
            return [pa.array(roots, pa.string())]

        return do

    rows = grouped.join(sizes, "tree").withColumn("digests", F.col("members.digest"))
    return with_columns_in_arrow(rows, ["digests", "whole"], {"root": T.StringType()}, work).drop("digests")


def climbed(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """The stored blocks of each round, from the leaves (tree, pos from 0, digest, ...) up until every
    tree is one block. The number of rounds is the logarithm of the largest tree to the base FAN ** depth."""
    rounds = []
    while True:
        rounds.append(stored(_blocks(nodes, depth)))
        more = rounds[-1].where(~F.col("whole"))
        if not more.head(1):
            return rounds
        nodes = more.select("tree", F.col("block").alias("pos"), F.col("root").alias("digest"))


def roots_of(rounds: list[DataFrame]) -> DataFrame:
    """(tree, root) of every tree."""
    tops = [r.where("whole").select("tree", "root") for r in rounds]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def _with_ways(blocks: DataFrame, depth: int) -> DataFrame:
    """The ways of a block's members: the steps inside the block, then those of the block itself."""

    def work():
        def do(digests: pa.Array, whole: pa.Array, way: pa.Array) -> list[pa.Array]:
            out = []
            for nodes, all_, above in zip(digests.to_pylist(), whole.to_pylist(), way.to_pylist(), strict=True):
                levels = parents_of([x.encode() for x in nodes], all_, depth)
                names = [[[c.decode() for c in p.children] for p in level] for level in levels]
                out.append([[{"slot": i // FAN**k % FAN, "children": names[k][i // FAN ** (k + 1)]} for k in range(len(levels))] + above for i in range(len(nodes))])
            return [pa.array(out, pa.list_(pa.list_(pa.struct([("slot", pa.int32()), ("children", pa.list_(pa.string()))]))))]

        return do

    rows = blocks.withColumn("digests", F.col("members.digest"))
    return with_columns_in_arrow(rows, ["digests", "whole", "way"], {"ways": T.ArrayType(T.ArrayType(STEP))}, work).drop("digests")


def descended(rounds: list[DataFrame], tops: DataFrame, depth: int) -> DataFrame:
    """The blocks of the first round with `way`, the steps from the block's root to the root of all,
    and `subroot`. `tops` has tree, way and subroot of every tree."""
    below = None
    for blocks in reversed(rounds):
        known = blocks.where("whole").join(tops, "tree")
        if below is not None:
            known = known.unionByName(blocks.where(~F.col("whole")).join(below, ["tree", "block"]))
        if blocks is rounds[0]:
            return known
        ways = _with_ways(known, depth).select("tree", "subroot", F.inline(F.arrays_zip(F.col("members.pos").alias("pos"), F.col("ways").alias("way"))))
        below = ways.select("tree", F.col("pos").alias("block"), "way", "subroot")
    return below


def _folded(blocks: DataFrame, depth: int) -> DataFrame:
    """Adds, for the members in order, the digests of their siblings and the folded root."""

    def work():
        def do(digests: pa.Array, changed: pa.Array, whole: pa.Array, way: pa.Array) -> list[pa.Array]:
            proofs, folded = [], []
            for nodes, new, all_, above in zip(digests.to_pylist(), changed.to_pylist(), whole.to_pylist(), way.to_pylist(), strict=True):
                levels = parents_of([x.encode() for x in nodes], all_, depth)
                # States of the parents above are taken once for all members of the block.
                upper = [(s["slot"], Parent([c.encode() for c in s["children"]])) for s in above]
                above_siblings = b"".join(p.siblings(slot) for slot, p in upper)
                proofs.append([])
                folded.append([])
                for i, x in enumerate(new):
                    steps = [(i // FAN**k % FAN, level[i // FAN ** (k + 1)]) for k, level in enumerate(levels)]
                    proofs[-1].append(sha256(b"".join(p.siblings(slot) for slot, p in steps) + above_siblings).hexdigest())
                    now = x.encode()
                    for slot, p in (*steps, *upper):
                        now = p.folded(slot, now)
                    folded[-1].append(now.decode())
            return [pa.array(proofs, pa.list_(pa.string())), pa.array(folded, pa.list_(pa.string()))]

        return do

    rows = blocks.withColumn("digests", F.col("members.digest")).withColumn("changed", F.col("members.changed"))
    strings = T.ArrayType(T.StringType())
    return with_columns_in_arrow(rows, ["digests", "changed", "whole", "way"], {"proofs": strings, "folded": strings}, work)


def manifest(docs: DataFrame, key: str, group: str, fields: Sequence[str], changed: dict[str, Column] | None = None, when: Column | None = None, depth: int = LEVELS) -> DataFrame:
    """Per row: its key, leaf, subroot, root, proof_sha256, folded_root and verified.

    A leaf is the digest of `fields` in order. Leaves of a group ascend by key (nulls first, equal keys
    by leaf). Where `when` is true, a row is checked as if the fields in `changed` had other values;
    folded_root is what its proof then gives, and verified says whether that is the root. Null is a
    group of its own and comes first; the others follow in the order of their UTF-8 bytes. Repeated
    rows are leaves of their own. An empty table has no leaf and gives an empty result.
    """
    own = [F.col(f"`{c}`") for c in fields]
    other = [(changed or {}).get(c, F.col(f"`{c}`")) for c in fields]
    leaf = leaf_digest(own)
    replaced = F.when(F.coalesce(when, F.lit(False)), leaf_digest(other)).otherwise(leaf) if when is not None else leaf
    tree = F.when(F.col(f"`{group}`").isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")))
    leaves = stored(docs.select(tree.alias("tree"), F.col(f"`{key}`").alias("key"), leaf.alias("digest"), replaced.alias("changed")))
    ranked = with_rank(leaves, ["tree"], ["key", "digest"])
    rounds = climbed(ranked.select("tree", (F.col("rank") - 1).alias("pos"), "digest", "changed", "key"), depth)

    # The roots of the groups are the leaves of one more tree.
    subroots = stored(roots_of(rounds))
    order = with_rank(subroots.withColumn("all", F.lit("")), ["all"], ["tree"]).select(F.col("all").alias("tree"), (F.col("rank") - 1).alias("pos"), F.col("root").alias("digest"), F.col("tree").alias("group"))
    top = climbed(order, depth)
    root = top[-1].select("root").first()
    none = F.array().cast(T.ArrayType(STEP))
    ends = docs.sparkSession.createDataFrame([("",)], "tree string").select("tree", none.alias("way"), F.lit(None).cast("string").alias("subroot"))
    ways = _with_ways(descended(top, ends, depth), depth)
    tops = stored(ways.select(F.inline(F.arrays_zip(F.col("members.group").alias("tree"), F.col("ways").alias("way"), F.col("members.digest").alias("subroot")))))

    done = _folded(descended(rounds, tops, depth), depth)
    rows = done.select("subroot", F.inline(F.arrays_zip(F.col("members.key").alias("key"), F.col("digests").alias("leaf"), "proofs", "folded")))
    all_ = F.lit(root["root"] if root else None).cast("string")
    return rows.select(F.col("key").alias(key), "leaf", "subroot", all_.alias("root"), F.col("proofs").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == all_).alias("verified"))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents by language, a third of them checked with A-Z of the text in lower case."""
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return manifest(docs, "doc_id", "lang", FIELDS, {"text": F.translate("text", UPPER, LOWER)}, third)


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of an ASCII text in DuckDB, which lacks it: the reflected polynomial, bit by bit."""
    byte = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS UBIGINT))"
    # Each byte enters eight shifts: those after the first bring zeros.
    steps = f"flatten(list_transform({byte}, lambda b: [b, 0, 0, 0, 0, 0, 0, 0]))"
    shift = "lambda v, b: xor(xor(v, b) // 2, CAST(CASE WHEN xor(v, b) % 2 = 1 THEN 3988292384 ELSE 0 END AS UBIGINT))"
    return f"xor(list_reduce({steps}, {shift}, CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT))"


def _sql_field(name: str) -> str:
    return f"coalesce(CAST(strlen(CAST({name} AS VARCHAR)) AS VARCHAR) || ':' || CAST({name} AS VARCHAR), '-')"


def sql(levels: int = 6) -> str:
    """The same by plain hashing in DuckDB, for groups of at most FAN ** levels rows."""
    text = f"translate(text, '{UPPER}', '{LOWER}')"
    own, other = " || ".join(map(_sql_field, FIELDS)), " || ".join(_sql_field(c) if c != "text" else _sql_field(text) for c in FIELDS)
    parts = [f"""leaves AS (SELECT doc_id, lang, {crc32_sql('CAST(doc_id AS VARCHAR)')} AS crc, sha256({own}) AS leaf, sha256({other}) AS other FROM documents),
n0 AS (SELECT coalesce('+' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS digest FROM leaves),
d0 AS (SELECT doc_id, coalesce('+' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf, '' AS proof, CASE WHEN crc % 3 = 0 THEN other ELSE leaf END AS now FROM leaves)"""]

    def rise(n: str, up: str) -> str:
        # A tree that is one node stays as it is.
        return f"""{up} AS (SELECT tree, CASE WHEN size = 1 THEN pos ELSE pos // {FAN} END AS pos, CASE WHEN any_value(size) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS size FROM {n}) GROUP BY tree, CASE WHEN size = 1 THEN pos ELSE pos // {FAN} END)"""

    def fold(d: str, n: str, out: str) -> str:
        run = f"(SELECT tree, pos // {FAN} AS up, list(digest ORDER BY pos) AS run, any_value(size) AS size FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS size FROM {n}) GROUP BY tree, up)"
        at = f"CAST(d.pos % {FAN} AS INT)"
        left, right = f"array_to_string(r.run[1:{at}], '')", f"array_to_string(r.run[{at} + 2:], '')"
        return f"""{out} AS (SELECT d.doc_id, d.tree, d.leaf, CASE WHEN r.size = 1 THEN d.pos ELSE d.pos // {FAN} END AS pos,
  CASE WHEN r.size = 1 THEN d.proof ELSE d.proof || {left} || {right} END AS proof, CASE WHEN r.size = 1 THEN d.now ELSE sha256({left} || d.now || {right}) END AS now
  FROM {d} d JOIN {run} r ON r.tree = d.tree AND r.up = d.pos // {FAN})"""

    for k in range(levels):
        parts += [rise(f"n{k}", f"n{k + 1}"), fold(f"d{k}", f"n{k}", f"d{k + 1}")]
    top = levels + 1
    parts.append(f"n{top} AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, digest, tree AS of FROM n{levels})")
    parts.append(f"d{top} AS (SELECT d.doc_id, n.of AS part, '' AS tree, d.leaf, n.pos, d.proof, d.now FROM d{levels} d JOIN n{top} n ON n.of = d.tree)")
    parts.append(f"s AS (SELECT of, digest AS subroot FROM n{top})")
    for k in range(top, top + 2):
        parts += [rise(f"n{k}", f"n{k + 1}"), fold(f"d{k}", f"n{k}", f"d{k + 1}").replace("d.doc_id,", "d.doc_id, d.part,")]
    last = top + 2
    return "WITH " + ",\n".join(parts) + f"""
SELECT d.doc_id, d.leaf, s.subroot, n.digest AS root, sha256(d.proof) AS proof_sha256, d.now AS folded_root, d.now = n.digest AS verified
FROM d{last} d JOIN s ON s.of = d.part, n{last} n"""

