"""Benchmark decontamination: an FM-index per shard of training text.

A shard is a slice of documents as word symbols. Its suffix array gives the Burrows-Wheeler transform,
kept in a wavelet tree; benchmark windows are found by backward search over ranks, occurrences are
located by walking to sampled suffix positions, and overlapping occurrences are merged into spans.

Words that no window has split the text into stretches: a window cannot run across them, and a
stretch shorter than the shortest window holds none, so only the other stretches are indexed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import set_aside, with_columns_in_arrow

WINDOW = 10
#: Windows that are searched for at once; more of them are taken in blocks.
BLOCK_WINDOWS = 200_000
#: Every how many positions of the text one is kept for locating.
SAMPLE = 8

_KEPT = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case: runs of digits, ASCII letters and all characters beyond ASCII."""
    return (text or "").encode().translate(_KEPT).split()


@dataclass
class Windows:
    """A block of distinct benchmark windows."""

    symbols: dict[bytes, int]  # from 1
    phrases: np.ndarray  # windows x WINDOW, filled from the right; 0 before a short one
    lengths: np.ndarray
    items: list[list[str]]  # of each window

    @property
    def shortest(self) -> int:
        return int(self.lengths.min())


def windows_of(rows: Iterator[tuple[str, str | None]], block: int = BLOCK_WINDOWS) -> Iterator[Windows]:
    """Blocks of windows, items kept whole: WINDOW consecutive words, or all words of a shorter item."""
    symbols: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str]] = {}

    def made() -> Windows:
        keys = list(found)
        phrases = np.zeros((len(keys), WINDOW), np.int64)
        for i, k in enumerate(keys):
            phrases[i, WINDOW - len(k) :] = k
        return Windows(symbols, phrases, np.array([len(k) for k in keys]), [sorted(found[k]) for k in keys])

    for item, text in rows:
        ids = [symbols.setdefault(w, len(symbols) + 1) for w in words_of(text)]
        for i in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
            found.setdefault(tuple(ids[i : i + WINDOW]), set()).add(item)
        if len(found) >= block:
            yield made()
            symbols, found = {}, {}
    if found:
        yield made()


class WaveletTree:
    """Ranks of symbols in a sequence; one level of bits per bit of a symbol, most significant first."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (sequence >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
        """How often each symbol occurs before each place."""
        first, places = np.zeros(len(symbol), np.int64), [a.astype(np.int64) for a in at]
        for level in range(self.bits):
            ones, one = self.ones[level], ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            move = lambda p: np.where(one, self.zeros[level] + ones[p], p - ones[p])  # noqa: B023, E731
            first, places = move(first), [move(p) for p in places]
        return [p - first for p in places]

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before."""
        symbol, first, place = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), at.astype(np.int64)
        for level in range(self.bits):
            ones = self.ones[level]
            one = ones[place + 1] > ones[place]
            symbol = symbol * 2 + one
            first = np.where(one, self.zeros[level] + ones[first], first - ones[first])
            place = np.where(one, self.zeros[level] + ones[place], place - ones[place])
        return symbol, place - first


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By doubling. Each 0 ends a stretch and differs from all others, the earlier the smaller."""
    n = len(text)
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text + int(ends.sum()))
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        key = rank[order]
        fresh = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        later = np.zeros(n, np.int64)
        later[: n - step] = rank[step:] + 1
        rank = rank * (n + 1) + later
        order = np.argsort(rank, kind="stable")
        step *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, n_symbols: int):
        """Symbols from 1, each stretch followed by a 0."""
        order = suffix_array(text)
        self.tree = WaveletTree(text[order - 1], max(1, n_symbols.bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))])
        starts = np.concatenate([[True], text[:-1] == 0])
        kept = starts | (np.arange(len(text)) % SAMPLE == 0)
        self.sampled = kept[order]
        self.position = np.where(self.sampled, order, -1)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences as (phrase, position)."""
        who = np.arange(len(phrases))
        low, high = np.zeros(len(who), np.int64), np.full(len(who), self.before[-1], np.int64)
        ended: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(phrases.shape[1]):
            symbol = phrases[who, phrases.shape[1] - 1 - k]
            low, high = (self.before[symbol] + r for r in self.tree.rank(symbol, low, high))
            there = low < high
            who, low, high = who[there], low[there], high[there]
            over = lengths[who] == k + 1
            ended.append((who[over], low[over], high[over]))
            who, low, high = who[~over], low[~over], high[~over]
        who, low, high = (np.concatenate(x) for x in zip(*ended, strict=True))
        n = high - low
        phrase = np.repeat(who, n)
        place = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return phrase, self.locate(place)

    def locate(self, place: np.ndarray) -> np.ndarray:
        out, steps, todo = np.full(len(place), -1, np.int64), 0, np.arange(len(place))
        place = place.copy()
        while len(todo):
            known = self.sampled[place]
            out[todo[known]] = self.position[place[known]] + steps
            todo, place = todo[~known], place[~known]
            symbol, rank = self.tree.symbol_and_rank(place)
            place = self.before[symbol] + rank
            steps += 1
        return out


def occurrences(words: np.ndarray, ends: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(window, word position) of all occurrences in a shard: symbols of all its words (0: in no
    window), and where each document ends."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not len(words):
        return none
    # Stretches of known words inside a document.
    known = words > 0
    breaks = np.zeros(len(words) + 1, bool)
    breaks[ends] = True
    first = known & (np.concatenate([[True], ~known[:-1]]) | breaks[:-1] | (np.arange(len(words)) == 0))
    starts = np.flatnonzero(first)
    last = known & (np.concatenate([~known[1:], [True]]) | breaks[1:])
    stops = np.flatnonzero(last) + 1
    long = stops - starts >= windows.shortest
    starts, stops = starts[long], stops[long]
    if not len(starts):
        return none
    size = stops - starts + 1
    at = np.cumsum(size) - size
    origin = np.repeat(starts - at, size) + np.arange(size.sum())
    text = words[np.minimum(origin, len(words) - 1)].astype(np.int64)
    text[at + size - 1] = 0
    window, position = FMIndex(text, len(windows.symbols)).search(windows.phrases, windows.lengths)
    return window, origin[position]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def found_in(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block: int = BLOCK_WINDOWS) -> DataFrame:
    """All columns and rows, with n_words, hit_spans (merged word ranges) and hit_items (sorted ids as text).

    The benchmark comes to the driver item by item and is sent to the tasks in blocks of about
    `block` windows; each further block takes another look at the documents and adds to what the
    earlier ones found. Null and empty texts have no words. Items without words are in no document,
    repeated items count once, an item without id counts as the id "". Columns of the three names
    are replaced. No row is moved.
    """
    rows = ((("" if r[0] is None else str(r[0])), r[1]) for r in benchmark.select(item, item_text).toLocalIterator())
    outputs = {"n_words": T.LongType(), "hit_spans": SPANS, "hit_items": T.ArrayType(T.StringType())}
    blocks = windows_of(rows, block)
    first = next(blocks, None)
    df = _searched(docs, text, first, outputs, [])
    for windows in blocks:
        df = _searched(df, text, windows, outputs, ["hit_spans", "hit_items"])
    return df


def _searched(df: DataFrame, text: str, windows: Windows | None, outputs: dict, earlier: list[str]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(windows)

    def work():
        w = shared.value

        def do(column: pa.Array, *before: pa.Array) -> list[pa.Array]:
            all_words = [words_of(t) for t in column.to_pylist()]
            counts = np.array([len(x) for x in all_words], np.int64)
            spans: list[list[tuple[int, int]]] = [[] for _ in all_words]
            items: list[set[str]] = [set() for _ in all_words]
            if w is not None and counts.sum():
                symbol = w.symbols.get
                symbols = np.concatenate([np.fromiter(map(symbol, x, repeat(0)), np.int32, len(x)) for x in all_words])
                ends = np.cumsum(counts)
                window, position = occurrences(symbols, ends, w)
                doc = np.searchsorted(ends, position, side="right")
                start = position - (ends - counts)[doc]
                for d, a, n in zip(doc.tolist(), start.tolist(), w.lengths[window].tolist(), strict=True):
                    spans[d].append((a, a + n))
                pairs = np.unique(np.stack([doc, window], axis=1), axis=0) if len(doc) else np.zeros((0, 2), int)
                for d, k in pairs.tolist():
                    items[d].update(w.items[k])
            if before:
                for d, (s, i) in enumerate(zip(before[0].to_pylist(), before[1].to_pylist(), strict=True)):
                    spans[d] += [(x["start"], x["end"]) for x in s]
                    items[d].update(i)
            made = [[{"start": a, "end": b} for a, b in merged(s)] for s in spans]
            return [
                pa.array(counts),
                pa.array(made, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array([sorted(i) for i in items], pa.list_(pa.string())),
            ]

        return do

    return with_columns_in_arrow(df, [text, *earlier], outputs, work)


def without_spans(text: str | None, spans: list[dict]) -> str | None:
    """The text without the words of the spans; what stood on both sides is parted by a newline."""
    if not spans or text is None:
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    parts, last = [], 0
    for s in spans:
        parts.append(text[last : at[s["start"]][0]])
        last = at[s["end"] - 1][1]
    parts.append(text[last:])
    return "\n".join(p for p in (x.strip() for x in parts) if p)


def cleaned(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents, same columns, with benchmark passages cut out of the text.

    A document stays if words are left, or if it had none of the passages.
    """
    rows, t, back = set_aside(docs, text)
    df = found_in(rows, benchmark, t)

    def work():
        def do(column: pa.Array, spans: pa.Array) -> list[pa.Array]:
            return [pa.array([without_spans(x, s) for x, s in zip(column.to_pylist(), spans.to_pylist(), strict=True)], pa.string())]

        return do

    cut = F.size("hit_spans") > 0
    df = with_columns_in_arrow(df, [t, "hit_spans"], {t: T.StringType()}, work)
    df = df.where(~cut | F.col(t).rlike(_WORD.pattern))
    if "n_chars" in docs.columns:
        n = f"column {docs.columns.index('n_chars')}"
        df = df.withColumn(n, F.when(cut, F.length(t).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return back(df)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, words in benchmark windows, items, digest of their ids."""
    df = found_in(docs.select("doc_id", "text"), benchmark).drop("text")
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return df.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bwin AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS v
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bwin),
dwin AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS v FROM (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT rid, i, n, item_id FROM dwin JOIN bwin USING (n, v)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, list(DISTINCT CAST(item_id AS VARCHAR)) AS x FROM hit GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(x), 0) AS n_items,
  sha256(coalesce(array_to_string(list_sort(x), ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
""".strip()
