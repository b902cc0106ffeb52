"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding.

The leaves of a piece's tree are its byte positions; leaf i holds the key rank * width + i of the
pair that starts at live position i. The root is the leftmost pair of least rank. A merge changes
three leaves (the pair itself, its dead right half, its live left neighbour), each with one
update per level. Short pieces of one batch are merged side by side in numpy, one tree per row;
longer ones one at a time.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sightline.llm.common import with_columns_in_arrow

#: Largest rank file that is sent to every task.
MAX_VOCABULARY_BYTES = 64 << 20
#: Distinct pieces or words a task remembers; beyond that it starts anew. Changes no result.
REMEMBERED = 200_000
WIDEST = 64
#: Texts from this length on are taken apart in blocks of pieces. Changes no result.
LONG_TEXT = 1 << 22
#: No such pair; above every rank times WIDEST.
NONE = np.int32(0x7FFFFFFF)


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line.strip())}


class PairRanks:
    """Rank of the token that two adjacent tokens make, by open addressing; looked up in bulk."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(rank)
        keys = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        self.bits = max(4, int(len(keys) * 6).bit_length())
        self.keys, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        todo, at = np.arange(len(keys)), self.slot(keys)
        while len(todo):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[todo[free]]
            won = self.keys[at] == keys[todo]
            self.made[at[won]] = np.array(made, np.int32)[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & ((1 << self.bits) - 1)
        self.one = dict(zip(keys.tolist(), made, strict=True))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        at = self.slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.made[at], NONE)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.made[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


class Encoder:
    def __init__(self, content: bytes, pattern: str):
        self.ranks = parse_ranks(content)
        self.pairs = PairRanks(self.ranks)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pattern = regex.compile(pattern)
        self.spaced = pattern == public_tokenizers.PATTERN
        #: Ids of pieces, and of words with and without a space before them.
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.after_space: dict[str, bytes] = {}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers; unknown pieces of all texts are merged together."""
        for kept in (self.known, self.words, self.after_space):
            if len(kept) > REMEMBERED:
                kept.clear()
        out: list[bytes | None] = [None] * len(texts)
        if self.spaced:
            lines = [[line.split(" ") for line in t.split("\n")] if len(t) < LONG_TEXT else [] for t in texts]
            self.learn_words(lines)
            newline, first, rest = self.words["\n"], self.words, self.after_space
            for i, parts in enumerate(lines):
                try:
                    out[i] = newline.join([first[p[0]] + b"".join(map(rest.__getitem__, p[1:])) if len(p) > 1 else first[p[0]] for p in parts])
                except KeyError:  # a word with white space at its edge: the text is matched as a whole
                    pass
        left = [i for i, ids in enumerate(out) if ids is None and len(texts[i]) < LONG_TEXT]
        pieces = [self.pattern.findall(texts[i]) for i in left]
        self.learn(set().union(*pieces))
        for i, p in zip(left, pieces, strict=True):
            out[i] = b"".join(map(self.known.__getitem__, p))
        # Last, since these may empty what is remembered.
        for i, t in enumerate(texts):
            if len(t) >= LONG_TEXT:
                out[i] = self.encode_long(t)
        return out

    def learn_words(self, lines: list[list[list[str]]]) -> None:
        """Of this pattern no match runs over a single space or newline with no white space beside
        it: a newline there is a piece, a space belongs to the word behind it. So such words can
        be encoded one by one, each distinct one once."""
        firsts, others = {"\n"}, set()
        for parts in lines:
            for p in parts:
                firsts.add(p[0])
                others.update(p[1:])
        new = [(self.words, w, w) for w in firsts - self.words.keys() if w == "\n" or w and not (w[0].isspace() or w[-1].isspace())]
        new += [(self.after_space, w, " " + w) for w in others - self.after_space.keys() if w and not (w[0].isspace() or w[-1].isspace())]
        pieces = [self.pattern.findall(w) for _, _, w in new]
        self.learn({p for found in pieces for p in found})
        known = self.known
        for (to, w, _), found in zip(new, pieces, strict=True):
            to[w] = known[found[0]] if len(found) == 1 else b"".join([known[p] for p in found])

    def encode_long(self, text: str) -> bytes:
        """The same, holding a bounded number of pieces at once."""
        found, out = (m.group() for m in self.pattern.finditer(text)), bytearray()
        while pieces := list(islice(found, 100_000)):
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.learn(set(pieces))
            out += b"".join(map(self.known.__getitem__, pieces))
        return bytes(out)

    def learn(self, pieces: set[str]) -> None:
        groups: dict[int, list[tuple[str, bytes]]] = {}
        known = self.known
        for piece in pieces - known.keys():
            raw = piece.encode()
            if (whole := self.ranks.get(raw)) is not None:
                known[piece] = whole.to_bytes(4, "little")
            elif len(raw) <= WIDEST:
                groups.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
            else:
                known[piece] = np.array(self.merge_long(raw), "<i4").tobytes()
        for width, items in groups.items():
            for (piece, _), ids in zip(items, self.merge_side_by_side([raw for _, raw in items], width), strict=True):
                known[piece] = ids

    def merge_side_by_side(self, raws: list[bytes], width: int) -> list[bytes]:
        n, out = len(raws), [b""] * len(raws)
        size = np.array([len(r) for r in raws], np.int32)
        padded = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raws), np.uint8).reshape(n, width)
        tokens, who = self.single[padded], np.arange(n)
        place = np.arange(width, dtype=np.int32)
        after = np.tile(place + 1, (n, 1))
        before = np.tile(place - 1, (n, 1))
        alive = place[None, :] < size[:, None]
        leaves = np.full((n, width), NONE, np.int32)
        inside = place[None, :-1] + 1 < size[:, None]
        rank = self.pairs(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(n, width - 1)
        leaves[:, :-1] = np.where(inside & (rank < NONE), rank * width + place[:-1], NONE)
        tree = [leaves]
        while tree[-1].shape[1] > 1:
            tree.append(np.minimum(tree[-1][:, 0::2], tree[-1][:, 1::2]))
        while True:
            root = tree[-1][:, 0]
            going = root < NONE
            if not going.all():
                ended = np.flatnonzero(~going)
                live = alive[ended]
                ids, cuts = tokens[ended][live].astype("<i4").tobytes(), np.cumsum(live.sum(1) * 4).tolist()
                for i, start, end in zip(who[ended].tolist(), [0, *cuts], cuts, strict=False):
                    out[i] = ids[start:end]
                if not going.any():
                    return out
                tokens, after, before, size, who, alive = tokens[going], after[going], before[going], size[going], who[going], alive[going]
                tree = [level[going] for level in tree]
                root = tree[-1][:, 0]
            rows = np.arange(len(root))
            made, at = np.divmod(root, width)
            right = after[rows, at]
            beyond = after[rows, right]
            tokens[rows, at], after[rows, at], alive[rows, right] = made, beyond, False
            follows = beyond < size
            before[rows[follows], beyond[follows]] = at[follows]
            left = before[rows, at]
            leads = left >= 0
            own = np.full(len(rows), NONE, np.int32)
            rank = self.pairs(made[follows], tokens[rows[follows], beyond[follows]])
            own[follows] = np.where(rank < NONE, rank * width + at[follows], NONE)
            rank = self.pairs(tokens[rows[leads], left[leads]], made[leads])
            of_left = np.where(rank < NONE, rank * width + left[leads], NONE)
            row = np.concatenate([rows, rows, rows[leads]])
            leaf = np.concatenate([right, at, left[leads]])
            tree[0][row, leaf] = np.concatenate([np.full(len(rows), NONE, np.int32), own, of_left])
            for lower, upper in zip(tree, tree[1:], strict=False):
                leaf = leaf >> 1
                upper[row, leaf] = np.minimum(lower[row, 2 * leaf], lower[row, 2 * leaf + 1])

    def merge_long(self, raw: bytes) -> list[int]:
        n, pairs = len(raw), self.pairs.one
        width = 1 << (n - 1).bit_length()
        none = width << 40
        tokens = self.single[np.frombuffer(raw, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def key(a: int, b: int) -> int:
            rank = pairs.get(tokens[a] << 32 | tokens[b]) if a >= 0 and b < n else None
            return none if rank is None else rank * width + a

        tree = [none] * width + [key(i, i + 1) for i in range(n)] + [none] * (width - n)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(leaf: int, value: int) -> None:
            i = leaf + width
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                least = a if a < b else b
                if tree[i] == least:
                    return
                tree[i] = least

        while tree[1] < none:
            made, at = divmod(tree[1], width)
            right = after[at]
            beyond = after[right]
            tokens[at], after[at] = made, beyond
            if beyond < n:
                before[beyond] = at
            put(right, none)
            put(at, key(at, beyond))
            if before[at] >= 0:
                put(before[at], key(before[at], at))
        ids, at = [], 0
        while at < n:
            ids.append(tokens[at])
            at = after[at]
        return ids


class Decoder:
    """Bytes that belong to ids, for many ids at once."""

    def __init__(self, of_id: dict[int, bytes]):
        n = max(of_id, default=-1) + 1
        parts = [of_id.get(i, b"") for i in range(n)]
        self.size = np.array([len(p) for p in parts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.there = np.array([i in of_id for i in range(n)], bool)

    def __call__(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.there) or not self.there[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        out = []
        for at in range(0, len(ids), 1 << 18):
            part = ids[at : at + (1 << 18)]
            size = self.size[part]
            ends = np.cumsum(size)
            out.append(self.blob[np.repeat(self.start[part] - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


def parts_of(column: pa.Array) -> list[np.ndarray]:
    """The ids of each row; null has none."""
    column = column.fill_null(pa.scalar([], column.type)) if column.null_count else column
    values, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    ends = ends - ends[0]
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        content = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    return content


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", to: str = "token_ids") -> DataFrame:
    """All columns and rows, with the ids of the whole text as array<int> in `to`.

    Each match of `pattern` is encoded by itself; there are no special tokens. Null and empty
    texts give an empty array. A column called `to` is replaced. Repeated rows stay repeated.
    """
    content = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def work():
        bpe = Encoder(content.value, pattern)

        def do(column: pa.Array) -> list[pa.Array]:
            parts = bpe.encode_all([t or "" for t in column.to_pylist()])
            ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32()))]

        return do

    return with_columns_in_arrow(docs, [text], {to: T.ArrayType(T.IntegerType())}, work)


def decode(docs: DataFrame, path: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """All columns and rows, with the bytes of the ids in `to`; null ids give empty bytes.

    An id that the vocabulary lacks fails the job.
    """
    content = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def work():
        decoder = Decoder({rank: token for token, rank in parse_ranks(content.value).items()})
        return lambda column: [pa.array([decoder(x) for x in parts_of(column)], pa.binary())]

    return with_columns_in_arrow(docs, [ids], {to: T.BinaryType()}, work)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: how many tokens, and digests of the ids and of the bytes they decode to."""
    content = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        ranks = parse_ranks(content.value)
        decoder = Decoder({rank: token for token, rank in ranks.items()})
        decimal = Decoder({rank: b" %d" % rank for rank in ranks.values()})
        for batch in batches:
            ids = parts_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(decimal(x)[1:]).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(decoder(x)).hexdigest() for x in ids], pa.string()),
            ], names=schema.fieldNames())

    return encode(docs.select("doc_id", "text"), path, pattern).select("doc_id", "token_ids").mapInArrow(run, schema)
