"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are words; each is tagged toxic or not. Labels of tokens are derived from labelled documents:
in a toxic document, words and word beginnings that are far more frequent in toxic than in clean
documents are toxic tokens. Marginals come from forward-backward, which runs over all tokens of a
slice at once as a scan of 2 x 2 matrices. A document's score is a logistic function of its
largest marginal and of the number of toxic tokens expected.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import bounded_rows, fold, held_out, with_columns_in_arrow
from sightline.llm.fm_index import _WORD, words_of

#: Labelled documents learned from at most: those first in a hashed order of their ids.
TOXIC_DOCS, CLEAN_DOCS = 500, 3000
#: Tokens of toxic and of clean documents that take part in fitting the field itself, and tokens tagged at once.
FIELD_TOKENS, AT_ONCE = (100_000, 260_000), 50_000
BITS, ROUNDS, STEP, RIDGE = 18, 40, 0.5, 1e-4
#: A word or beginning marks toxic tokens from such log odds on, if a likelihood ratio test tells it from chance.
MIN_ODDS, MIN_RATIO = 2.5, 25.0
#: Distinct words a worker remembers; beyond that it starts anew. Changes no result.
REMEMBERED = 300_000
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
Scan = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def beginnings(word: bytes) -> list[bytes]:
    """The word, and its first 3 to 5 letters with a mark, if it is longer."""
    chars = word.decode("utf-8", "ignore")
    return [word] + [b"^" + chars[:n].encode() for n in (3, 4, 5) if len(chars) > n]


def own_features(word: bytes) -> list[int]:
    return [crc32(x) & ((1 << BITS) - 1) for x in [*beginnings(word), b"$" + word[-4:]]]


def beside(word: bytes, side: bytes) -> int:
    return crc32(side + word) & ((1 << BITS) - 1)


def times(x: Scan, y: Scan) -> Scan:
    """Products of 2 x 2 matrices, scaled so that the largest entry is 1."""
    a, b, c, d = x[0] * y[0] + x[1] * y[2], x[0] * y[1] + x[1] * y[3], x[2] * y[0] + x[3] * y[2], x[2] * y[1] + x[3] * y[3]
    most = np.maximum(np.maximum(a, b), np.maximum(c, d))
    return a / most, b / most, c / most, d / most


def prefix_products(m: Scan) -> Scan:
    """Product of the first, the first two, ... matrices, by pairs and pairs of pairs."""
    n = len(m[0])
    if n == 1:
        return m
    half = n // 2 * 2
    pairs = prefix_products(times(tuple(x[0:half:2] for x in m), tuple(x[1:half:2] for x in m)))
    out = tuple(np.empty(n) for _ in m)
    rest = times(tuple(x[: (n - 1) // 2] for x in pairs), tuple(x[2::2] for x in m)) if n > 2 else tuple(x[:0] for x in m)
    for o, p, r, x in zip(out, pairs, rest, m, strict=True):
        o[1::2], o[0], o[2::2] = p, x[0], r
    return out


def forward_backward(unary: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of tag 1 and of each pair of tags (previous, own); `first` marks where texts begin."""
    u = np.clip(unary, -60, 60)
    e0, e1 = np.exp(-np.maximum(u, 0)), np.exp(np.minimum(u, 0))
    w = np.exp(trans)
    m = tuple(np.where(first, 1.0, w[i, j]) * (e1 if j else e0) for i in (0, 1) for j in (0, 1))
    alpha = prefix_products(m)[:2]
    last = np.append(first[1:], True)
    after = tuple(np.where(last, 1.0, np.append(x[1:], 1.0)) for x in m)
    # A product taken from the end is that of the transposed matrices from the front.
    back = tuple(x[::-1] for x in (after[0], after[2], after[1], after[3]))
    q = tuple(x[::-1] for x in prefix_products(back))
    beta = (q[0] + q[2], q[1] + q[3])
    p0, p1 = alpha[0] * beta[0], alpha[1] * beta[1]
    marginal = p1 / np.maximum(p0 + p1, 1e-300)
    previous = [np.concatenate([[1.0], a[:-1]]) for a in alpha]
    pair = np.stack([previous[i] * m[2 * i + j] * beta[j] for i in (0, 1) for j in (0, 1)])
    pair = np.where(first, 0.0, pair / np.maximum(pair.sum(0), 1e-300))
    return marginal, pair


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    bias: float
    calibration: tuple[float, float, float]


def summary(marginal: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: log odds of its largest marginal, and log of one plus the tokens expected to be toxic."""
    n = len(ends)
    size = np.diff(np.concatenate([[0], ends]))
    some = np.flatnonzero(size)
    most, total = np.zeros(n), np.zeros(n)
    if len(some):
        starts = (ends - size)[some]
        most[some], total[some] = np.maximum.reduceat(marginal, starts), np.add.reduceat(np.where(marginal > 0.01, marginal, 0.0), starts)
    most = np.clip(most, 1e-5, 1 - 1e-5)
    return np.log(most / (1 - most)), np.log1p(total)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> Model | None:
    """Fit on at most `toxic_docs` and `clean_docs` labelled documents; None without either kind."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null").distinct()
    shares = {r["y"]: r["n"] for r in known.where("y in (0, 1)").groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = bounded_rows(known.where("y = 1"), F.col("k"), toxic_docs).unionByName(bounded_rows(known.where("y = 0"), F.col("k"), clean_docs))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(chosen), "k").select("k", "y", "t")
    order: dict[int, list[list[bytes]]] = {0: [], 1: []}
    once: dict[bytes, bytes] = {}  # each distinct word is held once
    texts = [(r["y"], crc32(str(r["k"]).encode()), [once.setdefault(w, w) for w in words_of(r["t"])]) for r in rows.toLocalIterator()]
    for y, _, words in without_copies(sorted(texts, key=lambda r: r[:2])):
        order[y].append(words)
    if not order[0] or not order[1]:
        return None
    return fit(order[1], order[0], shares[1] / (shares[0] + shares[1]))


def without_copies(texts: list[tuple[int, int, list[bytes]]]) -> list[tuple[int, int, list[bytes]]]:
    """One of each group of near copies among the sampled documents, whose words would otherwise look like
    those of many documents: texts that share the least of their 4-word digests, by two hashes."""
    seen: set[tuple[int, int]] = set()
    out = []
    for row in texts:
        words = row[2]
        hashed = [crc32(b" ".join(words[i : i + 4])) for i in range(max(1, len(words) - 3))]
        marks = {(k, min(h * m & 0xFFFFFFFF for h in hashed)) for k, m in enumerate((1, 0x9E3779B1))}
        if seen.isdisjoint(marks):
            out.append(row)
        seen |= marks
    return out


def fit(toxic: list[list[bytes]], clean: list[list[bytes]], share: float) -> Model:
    """`share` is that of toxic documents outside the sample."""
    counts: list[dict[bytes, int]] = [{}, {}]
    for words in toxic:
        for x in {b for w in set(words) for b in beginnings(w)}:
            counts[1][x] = counts[1].get(x, 0) + 1
    # A word of one toxic document marks nothing, so clean ones are counted for the others only.
    counts[1] = {x: n for x, n in counts[1].items() if n > 1}
    for words in clean:
        for x in {b for w in set(words) for b in beginnings(w)} & counts[1].keys():
            counts[0][x] = counts[0].get(x, 0) + 1
    marks = {x for x, n in counts[1].items() if marked(n, counts[0].get(x, 0), len(toxic), len(clean))}
    of_toxic = beginning(toxic, FIELD_TOKENS[0])
    field = [*of_toxic, *beginning(clean, FIELD_TOKENS[1])]
    tag_of: dict[bytes, int] = {}
    words, tags = [], []
    for i, text in enumerate(field):
        for w in text:
            if w not in tag_of:
                tag_of[w] = int(not marks.isdisjoint(beginnings(w)))
            tags.append(tag_of[w] if i < len(of_toxic) else 0)
        words += text
    ends = np.cumsum([len(t) for t in field])
    first = np.zeros(len(words), bool)
    first[(ends - [len(t) for t in field])[[bool(t) for t in field]]] = True
    y = np.array(tags, float)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.array([vocabulary[w] for w in words])
    width = 5
    own = np.full((len(vocabulary), width), -1, np.int64)
    for w, i in vocabulary.items():
        f = own_features(w)
        own[i, : len(f)] = f
    left = np.array([beside(w, b"<") for w in vocabulary])
    right = np.array([beside(w, b">") for w in vocabulary])
    last = np.append(first[1:], True)
    weights, trans, bias = np.zeros(1 << BITS), np.zeros((2, 2)), 0.0
    moment, size = [np.zeros(1 << BITS), np.zeros((2, 2)), 0.0], [np.zeros(1 << BITS), np.zeros((2, 2)), 0.0]
    real = np.zeros((2, 2))
    pairs = (np.stack([y[:-1], y[1:]]).astype(int), ~first[1:])
    np.add.at(real, (pairs[0][0][pairs[1]], pairs[0][1][pairs[1]]), 1)
    n = max(1, len(words))
    for round_ in range(1, ROUNDS + 1):
        marginal, pair = forward_backward(unaries(ids, first, own, left, right, weights, bias), first, trans)
        off = (marginal - y) / n
        of_word = np.bincount(ids, off, minlength=len(vocabulary))
        grad = np.bincount(own[own >= 0], np.broadcast_to(of_word[:, None], own.shape)[own >= 0], minlength=1 << BITS)
        grad += np.bincount(left[ids[:-1]], np.where(first[1:], 0, off[1:]), minlength=1 << BITS) + np.bincount(right[ids[1:]], np.where(last[:-1], 0, off[:-1]), minlength=1 << BITS)
        grads = [grad + RIDGE * weights / n, (pair.sum(1).reshape(2, 2) - real) / n, off.sum()]
        values = [weights, trans, bias]
        for k, g in enumerate(grads):  # Adam
            moment[k], size[k] = 0.9 * moment[k] + 0.1 * g, 0.99 * size[k] + 0.01 * g * g
            values[k] = values[k] - STEP * (moment[k] / (1 - 0.9**round_)) / (np.sqrt(size[k] / (1 - 0.99**round_)) + 1e-10)
        weights, trans, bias = values[0], values[1], float(values[2])
    model = Model(weights.astype(np.float32), trans, bias, (0.0, 0.0, 0.0))
    tagger, texts, seen = Tagger(model), [*toxic, *clean], []
    while texts:
        part = beginning(texts, AT_ONCE)
        seen.append(summary(*tagger.marginals(part)))
        texts = texts[len(part) :]
    most, expected = (np.concatenate(x) for x in zip(*seen, strict=True))
    label = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    importance = np.where(label > 0, share / len(toxic), (1 - share) / len(clean))
    model.calibration = calibrated(most / 10, expected, label, importance)
    return model


def beginning(texts: list[list[bytes]], tokens: int) -> list[list[bytes]]:
    """The first texts that have so many tokens together, one at least."""
    n = int(np.searchsorted(np.cumsum([len(t) for t in texts]), tokens, side="right"))
    return texts[: max(1, n)]


def marked(toxic: int, clean: int, all_toxic: int, all_clean: int) -> bool:
    """Whether a word of so many toxic and clean documents tells toxic ones."""
    if math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1)) < MIN_ODDS:
        return False
    share, n = all_toxic / (all_toxic + all_clean), toxic + clean
    ratio = 2 * (toxic * math.log(toxic / (n * share)) + (clean * math.log(clean / (n * (1 - share))) if clean else 0))
    return ratio >= MIN_RATIO


def unaries(ids: np.ndarray, first: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Weight of tag 1 at each token: its own features, the word before and the word after."""
    of_word = np.where(own >= 0, weights[own], 0).sum(1)
    u = of_word[ids] + bias
    u[1:] += np.where(first[1:], 0, weights[left][ids[:-1]])
    u[:-1] += np.where(first[1:], 0, weights[right][ids[1:]])
    return u


def calibrated(a: np.ndarray, b: np.ndarray, label: np.ndarray, importance: np.ndarray) -> tuple[float, float, float]:
    """Logistic weights (constant, a, b) by Newton steps with a small ridge."""
    x, w = np.stack([np.ones(len(a)), a, b], 1), np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.diag([1e-7, 1e-5, 1e-5])
        w = w - np.linalg.solve((x * (importance * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (importance * (p - label)) + ridge @ w)
    return float(w[0]), float(w[1]), float(w[2])


class Tagger:
    """Remembers the weights of words it has seen."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.values = np.zeros((1024, 3))

    def marginals(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all tokens, and where each text ends."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, weights = self.known, self.model.weights
        new = list(set().union(*texts) - known.keys())
        if len(known) + len(new) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros((len(known) + len(new), 3))])
        for w in new:
            i = known[w] = len(known)
            self.values[i] = weights[own_features(w)].sum(), weights[beside(w, b"<")], weights[beside(w, b">")]
        size = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(size)
        if not len(ends) or not ends[-1]:
            return np.zeros(0), ends
        ids = np.concatenate([np.fromiter(map(known.__getitem__, t), np.int64, len(t)) for t in texts])
        first = np.zeros(len(ids), bool)
        first[(ends - size)[size > 0]] = True
        value = self.values[ids]
        u = value[:, 0] + self.model.bias
        u[1:] += np.where(first[1:], 0, value[:-1, 1])
        u[:-1] += np.where(first[1:], 0, value[1:, 2])
        return forward_backward(u, first, self.model.trans)[0], ends


def scored(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns and rows, with score (0 to 1) and toxic_spans (ranges of code points).

    Null and empty texts have no tokens and get the score of a text without toxic tokens. Without
    a model every score is 0 and there are no spans. Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        tagger = Tagger(shared.value) if shared.value else None

        def do(column: pa.Array) -> list[pa.Array]:
            texts = column.to_pylist()
            spans: list[list[dict]] = [[] for _ in texts]
            score = np.zeros(len(texts))
            if tagger:
                marginal, ends = tagger.marginals([words_of(t) for t in texts])
                most, expected = summary(marginal, ends)
                c, a, b = tagger.model.calibration
                score = 1 / (1 + np.exp(-np.clip(c + a * most / 10 + b * expected, -30, 30)))
                hits = np.flatnonzero(marginal >= 0.5)
                doc = np.searchsorted(ends, hits, side="right")
                for d in np.unique(doc).tolist():
                    spans[d] = runs(texts[d], hits[doc == d] - (ends[d - 1] if d else 0))
            return [pa.array(score), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]

        return do

    return with_columns_in_arrow(docs, [text], {"score": T.DoubleType(), "toxic_spans": SPANS}, work)


def runs(text: str, tokens: np.ndarray) -> list[dict]:
    """Ranges of the text that runs of tokens cover."""
    at = [m.span() for m in _WORD.finditer(text)]
    cuts = np.flatnonzero(np.diff(tokens) > 1) + 1
    return [{"start": at[r[0]][0], "end": at[r[-1]][1]} for r in np.split(tokens, cuts)]


def scores_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the folds that are not held out, and score every document."""
    model = learn(docs, labels.where(fold() != 0))
    df = scored(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return df.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_spans")
