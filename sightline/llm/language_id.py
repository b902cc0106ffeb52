"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of the learned rows are summed by Spark; the log-probability matrix (buckets x languages)
is broadcast; documents are scored in numpy, a slice of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import fold, held_out, slices, utf8, with_columns_in_arrow

UNDETERMINED = "und"
#: 2 ** BITS buckets; n-grams of these lengths; additive smoothing.
BITS, LENGTHS, SMOOTHING = 16, (1, 2, 3), 0.1
#: Documents learned from at most: of each language those first in a hashed order of their ids.
TRAIN_ROWS = 20_000
#: Largest model that is sent to every task.
MAX_MODEL_BYTES = 256 << 20
BLOCK = 1 << 19

_folded: list[np.ndarray] = []


def folded() -> np.ndarray:
    """For each code point its lower-case letter, or a space where it is no letter."""
    if not _folded:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _folded.append(table)
    return _folded[0]


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts with single spaces between words, the text of each, and letters per text."""
    data, offsets = utf8(column)
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    who = np.repeat(np.arange(len(column), dtype=np.int32), np.diff(starts))
    codes = folded()[codes]
    space = codes == 32
    n_letters = np.bincount(who[~space], minlength=len(column))
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (who[1:] == who[:-1]))
    return codes[keep], who[keep], n_letters


def grams(codes: np.ndarray, who: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the n-grams inside each text, and their texts, in blocks of bounded size."""
    for at in range(0, len(codes), BLOCK):
        for n in LENGTHS:
            part, own = codes[at : at + BLOCK + n - 1], who[at : at + BLOCK + n - 1]
            if len(part) < n:
                continue
            m = len(part) - n + 1
            h = part[:m] + np.uint32(n * 0x3C6EF372)
            for k in range(1, n):
                h = h * np.uint32(0x01000193) + part[k : k + m]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            whole = own[:m] == own[n - 1 :]
            bucket = ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)
            yield bucket[whole], own[:m][whole]


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # languages x buckets
    log_prior: np.ndarray


def shares(ids: dict[str, int], bound: int) -> dict[str, int]:
    """How many ids of each language are learned: all of them where they are few, and at least one."""
    out, left = {}, bound
    for i, (x, n) in enumerate(sorted(ids.items(), key=lambda r: (r[1], r[0]))):
        out[x] = min(n, max(1, left // (len(ids) - i)))
        left -= out[x]
    return out


def last_hashes(ids: DataFrame, sizes: dict[str, int], bound: int) -> dict[str, int]:
    """Of each language, the largest hash that is learned. `ids` has l and h, each pair once.

    Only hashes that may be among the first come to the driver: little more than `bound` of them.
    """
    some = {x: k for x, k in shares(sizes, bound).items() if k < sizes[x]}
    out = dict.fromkeys(sizes, (1 << 63) - 1)
    if some:
        # Hashes are even: the k-th of n lies near k / n of the way.
        reach = {x: min((1 << 63) - 1, int(((k + 10 * k**0.5 + 20) / sizes[x]) * (1 << 64)) - (1 << 63)) for x, k in some.items()}
        near = ids.sparkSession.createDataFrame(list(reach.items()), "l string, reach long")
        found: dict[str, list[int]] = {x: [] for x in some}
        for r in ids.join(F.broadcast(near), "l").where("h <= reach").select("l", "h").toLocalIterator():
            found[r["l"]].append(r["h"])
        for x, k in some.items():
            first = sorted(found[x])
            out[x] = first[min(k, len(first)) - 1] if first else reach[x]
    return out


def train(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", bound: int = TRAIN_ROWS) -> Model:
    """Learn from at most `bound` ids with text and language, as many of each language as fit.

    A language with fewer ids than its share is learned whole, the others share the rest alike, so
    that no language is left out for being rare. The prior is that of all labelled rows.
    """
    known = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull()).select(F.xxhash64(F.col(key)).alias("h"), F.col(lang).alias("l"), F.col(text).alias("t"))
    ids = known.groupBy("l", "h").agg(F.count("*").alias("n"))
    of_language = {r["l"]: r for r in ids.groupBy("l").agg(F.count("*").alias("ids"), F.sum("n").alias("rows")).collect()}
    last = last_hashes(ids, {x: r["ids"] for x, r in of_language.items()}, bound)
    cuts = rows.sparkSession.createDataFrame(list(last.items()), "l string, last long")
    sample = known.join(F.broadcast(cuts), "l").where("h <= last").select("l", "t")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        seen: set[str] = set()
        for batch in batches:
            for part in slices(batch, 1):
                langs = part.column(0).to_pylist()
                names = sorted(set(langs))
                seen.update(names)
                index = np.array([names.index(x) for x in langs], np.int64)
                codes, who, _ = letters(part.column(1))
                for bucket, own in grams(codes, who):
                    n = np.bincount((index[own] << BITS) + bucket, minlength=len(names) << BITS).reshape(len(names), -1)
                    for i, x in enumerate(names):
                        total[x] = total[x] + n[i] if x in total else n[i]
        for x, n in total.items():
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"l": [x] * len(hit), "bucket": hit.astype(np.int32), "n": n[hit]})
        if seen:  # also languages without a letter
            yield pa.RecordBatch.from_pydict({"l": list(seen), "bucket": np.full(len(seen), -1, np.int32), "n": np.zeros(len(seen), np.int64)})

    counts = sample.mapInArrow(count, "l string, bucket int, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n"))
    counts = counts.groupBy("l").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).orderBy("l")
    languages, log_p, prior = [], [], []
    for row in counts.toLocalIterator():
        n = np.full(1 << BITS, SMOOTHING)
        for bucket, k in row["c"]:
            if bucket >= 0:
                n[bucket] += k
        prior.append(of_language[row["l"]]["rows"])
        languages.append(row["l"])
        log_p.append(np.log(n / n.sum()).astype(np.float32))
        if len(log_p) * log_p[0].nbytes > MAX_MODEL_BYTES:
            raise ValueError("the model has more languages than can be broadcast")
    return Model(languages, np.array(log_p, np.float32).reshape(len(languages), 1 << BITS), np.log(np.array(prior, float) / max(1, sum(prior))))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns and rows, with lang_pred and score (posterior of the predicted language).

    A text that is null or has no letter gets `und` and 0; so does every text if nothing was
    learned. Ties go to the language that sorts first. Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        m = shared.value
        k = len(m.languages)

        def do(column: pa.Array) -> list[pa.Array]:
            n = len(column)
            codes, who, n_letters = letters(column)
            scores = np.zeros((k, n))
            for bucket, own in grams(codes, who):
                if not len(own):
                    continue
                starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                for i in range(k):
                    scores[i][own[starts]] += np.add.reduceat(m.log_p[i][bucket], starts, dtype=np.float64)
            if not k:
                return [pa.array([UNDETERMINED] * n, pa.string()), pa.array(np.zeros(n))]
            scores += m.log_prior[:, None]
            best = scores.argmax(0)
            share = 1 / np.exp(scores - scores.max(0)).sum(0)
            none = n_letters == 0
            return [pa.array([UNDETERMINED if z else m.languages[b] for z, b in zip(none, best, strict=True)], pa.string()), pa.array(np.where(none, 0.0, share))]

        return do

    return with_columns_in_arrow(docs, [text], {"lang_pred": T.StringType(), "score": T.DoubleType()}, work)


def languages_of(docs: DataFrame) -> DataFrame:
    """Learn from the folds that are not held out, and predict every document."""
    model = train(docs.where(fold() != 0))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
