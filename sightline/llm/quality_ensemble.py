"""Quality classifier: a sparse ensemble of rules.

Boosted shallow trees are grown over document statistics; each path from a root becomes a rule, a
conjunction of comparisons. A logistic model with a lasso penalty weighs the rules, most of them
with 0, and what is left is compiled into one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import bounded_rows, fold, held_out
from sightline.llm.quality_rules import CLASSES, measured

#: Labelled documents learned from at most: those first in a hashed order of their ids.
TRAIN_ROWS = 20_000
TREES, DEPTH, CUTS, RATE, LEAST_ROWS = 40, 3, 48, 0.3, 10
LASSO, STEPS = 1e-3, 400
#: Statistics of a text, all computed by column expressions.
STATISTICS = ("n_words", "word_length", "symbol_share", "dup_line_share", "common_share", *(f"class{i}_share" for i in range(len(CLASSES) + 2)))

#: (statistic, whether at most the value or more, value)
Test = tuple[int, bool, float]


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """All columns and rows, with STATISTICS in columns of a free prefix; and the prefix. Null and
    empty texts have 0 everywhere."""
    df, p = measured(docs, text, windows=False)
    c = lambda name: F.col(f"{p}{name}")
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    common = F.aggregate(c("common"), F.lit(0), lambda a, x: a + x)
    made = [
        c("n_words").cast("double"), over(c("word_chars"), c("n_words")), over(c("n_symbols"), c("n_chars")), over(c("n_dup_lines"), c("n_lines")), over(common, c("n_words")),
        *[over(F.get(c("classes"), F.lit(i)), c("n_chars")) for i in range(len(CLASSES) + 2)],
    ]
    return df.select(*[F.col(f"`{x}`") for x in docs.columns], *[x.alias(f"{p}{n}") for x, n in zip(made, STATISTICS, strict=True)]), p


@dataclass
class Ensemble:
    constant: float
    rules: list[tuple[tuple[Test, ...], float]]

    def score(self, p: str) -> Column:
        """Probability of label 1 as a column over statistics with the prefix `p`."""
        total = F.lit(self.constant)
        for tests, weight in self.rules:
            holds = None
            for k, at_most, value in tests:
                x = F.col(f"{p}{STATISTICS[k]}")
                test = x <= F.lit(value) if at_most else x > F.lit(value)
                holds = test if holds is None else holds & test
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{weight:+.3f} if " + " and ".join(f"{STATISTICS[k]} {'<=' if a else '>'} {v:.4g}" for k, a, v in tests) for tests, weight in sorted(self.rules, key=lambda r: -abs(r[1]))]


def grow(binned: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, list[tuple[Test, ...]]]:
    """One tree on the bins of each statistic: its value per row, and the paths to all its nodes."""
    value, paths = np.zeros(len(gradient)), []

    def split(rows: np.ndarray, path: tuple[Test, ...]) -> None:
        if path:
            paths.append(path)
        g, h = gradient[rows], hessian[rows]
        best = (1e-6, None)
        if len(path) < DEPTH and len(rows) >= 2 * LEAST_ROWS:
            whole = g.sum() ** 2 / (h.sum() + 1)
            for k, edges in enumerate(cuts):
                if not len(edges):
                    continue
                b = binned[rows, k]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, len(edges) + 1))[:-1] for w in (g, h, np.ones(len(rows))))
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                gain[(ns < LEAST_ROWS) | (len(rows) - ns < LEAST_ROWS)] = -1
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), (k, at))
        if best[1] is None:
            value[rows] = -g.sum() / (h.sum() + 1)
            return
        k, at = best[1]
        left = binned[rows, k] <= at
        split(rows[left], (*path, (k, True, float(cuts[k][at]))))
        split(rows[~left], (*path, (k, False, float(cuts[k][at]))))

    split(np.arange(len(gradient)), ())
    return value, paths


def holds(x: np.ndarray, tests: tuple[Test, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, at_most, value in tests:
        out &= x[:, k] <= value if at_most else x[:, k] > value
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Rules and weights from statistics and labels 0 or 1. One label only gives a constant near it."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    constant = float(np.log(rate / (1 - rate)))
    if len(np.unique(y)) < 2:
        return Ensemble(constant, [])
    cuts = [np.unique(np.quantile(x[:, k], np.arange(1, CUTS) / CUTS)) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], 1)
    margin, rules = np.full(len(y), constant), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        value, paths = grow(binned, cuts, p - y, p * (1 - p))
        margin += RATE * value
        rules.update(dict.fromkeys(paths))
    z = np.stack([holds(x, r) for r in rules], 1).astype(np.float32)
    # Two rules that hold for the same rows count once.
    _, kept = np.unique(z, axis=1, return_index=True)
    names, z = [list(rules)[i] for i in sorted(kept)], z[:, sorted(kept)]
    weights, constant = lasso(z, y, constant)
    return Ensemble(constant, [(names[i], float(weights[i])) for i in np.flatnonzero(weights)])


def lasso(z: np.ndarray, y: np.ndarray, constant: float) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty on the rule weights, by accelerated proximal steps."""
    n, m = z.shape
    v = np.ones(m) / np.sqrt(m)
    for _ in range(30):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + 1e-30
    step = 4 * n / (float(np.linalg.norm(z @ v) ** 2) + n)
    w, b, ahead, t = np.zeros(m), constant, (np.zeros(m), constant), 1.0
    for _ in range(STEPS):
        off = 1 / (1 + np.exp(-(z @ ahead[0] + ahead[1]))) - y
        moved = ahead[0] - step * (z.T @ off) / n
        new_w, new_b = np.sign(moved) * np.maximum(np.abs(moved) - step * LASSO, 0), ahead[1] - step * off.mean()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = (new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b))
        w, b, t = new_w, new_b, new_t
    return w, float(b)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", bound: int = TRAIN_ROWS) -> Ensemble:
    """Fit on at most `bound` labelled documents. Without any, every score is 0.5."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)").distinct()
    chosen = bounded_rows(known, F.col("k"), bound)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")
    df, p = with_statistics(rows, "t")
    got = df.select("k", "y", *[p + s for s in STATISTICS]).toPandas().sort_values(["k", "y"], kind="stable")
    if not len(got):
        return Ensemble(0.0, [])
    return fit(got[[p + s for s in STATISTICS]].to_numpy(float), got["y"].to_numpy(float))


def scored(docs: DataFrame, model: Ensemble, text: str = "text", to: str = "score") -> DataFrame:
    """All columns and rows, with the score in `to` (replacing a column of that name). Null and
    empty texts are scored as texts of no words. Equal texts get equal scores."""
    df, p = with_statistics(docs, text)
    return df.select(*[F.col(f"`{x}`") for x in docs.columns if x.lower() != to.lower()], model.score(p).alias(to))


def scores_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the folds that are not held out, and score every document."""
    model = learn(docs, labels.where(fold() != 0))
    df = scored(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return df.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
