"""Quality and toxicity: held-out accuracy, and odd input."""

import numpy as np
import pytest

from sightline.llm import quality_ensemble as E
from sightline.llm import toxicity_crf as X
from tests.llm import rows


def labelled(spark, mark):
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = rows.prose(i, 50)
        docs.append((i, mark(text, i) if bad else text, "en", "s", 0))
        if i % 3:
            labels.append((i, int(not bad), int(bad)))
    docs += rows.document_rows()[3:8]
    labels += [(None, 1, 0), (4, None, None), (7, 1, 0), (7, 1, 0)]
    return rows.documents(spark, rows=docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: i % 4 == 0 for i in range(400)}, len(docs)


def test_quality(spark):
    docs, labels, bad, n = labelled(spark, lambda t, i: t.upper() if i % 8 else "#".join(t.split()))
    got = E.scores_of(docs, labels).collect()
    assert len(got) == n and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in bad and r.doc_id > 10]
    assert len(held) > 40 and all((r.predicted == 0) == bad[r.doc_id] for r in held)


def test_quality_rules_compile_to_what_they_mean(spark):
    docs, *_ = labelled(spark, lambda t, i: t.upper())
    df, p = E.with_statistics(docs)
    got = df.select("doc_id", *[p + s for s in E.STATISTICS]).toPandas()
    x = got[[p + s for s in E.STATISTICS]].to_numpy(float)
    model = E.fit(x, (x[:, 1] > np.median(x[:, 1])).astype(float))
    assert model.rules and len(model.describe()) == len(model.rules)
    want = 1 / (1 + np.exp(-(model.constant + sum(w * E.holds(x, r) for r, w in model.rules))))
    scored = df.select("doc_id", model.score(p).alias("s")).toPandas()["s"].to_numpy()
    assert np.allclose(np.sort(want), np.sort(scored))


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in E.scores_of(rows.documents(spark), none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.5 for r in E.scores_of(rows.documents(spark, clash=True), one).collect())
    assert E.scores_of(rows.nothing(spark), one).count() == 0


def test_toxicity(spark):
    docs, labels, bad, n = labelled(spark, lambda t, i: f"{t} Nastyword{i % 7} you vileterm, {t}")
    got = X.scores_of(docs, labels).collect()
    assert len(got) == n and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in bad]
    assert len(held) > 60 and all((r.predicted == 1) == bad[r.doc_id] for r in held)
    texts = {r.doc_id: r.text for r in docs.where("doc_id >= 20").collect()}
    for r in got:
        if r.predicted and r.doc_id in texts:
            assert any("vileterm" in texts[r.doc_id][s.start : s.end] or "Nastyword" in texts[r.doc_id][s.start : s.end] for s in r.toxic_spans)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = X.scores_of(rows.documents(spark, clash=True), none).collect()
    assert {r.score for r in got} == {0.0} and X.scores_of(rows.nothing(spark), none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 101])
def test_marginals_against_enumeration_and_recursion(n):
    rng = np.random.default_rng(n)
    unary, trans = rng.normal(size=n) * 3, rng.normal(size=(2, 2))
    first = rng.random(n) < 0.2
    first[0] = True
    got, pair = X.forward_backward(unary, first, trans)
    starts = [*np.flatnonzero(first), n]
    want = []
    for a, b in zip(starts, starts[1:], strict=False):
        alpha, beta = np.zeros((b - a, 2)), np.ones((b - a, 2))
        e = np.stack([np.ones(b - a), np.exp(unary[a:b])], 1)
        alpha[0] = e[0]
        for t in range(1, b - a):
            alpha[t] = alpha[t - 1] @ np.exp(trans) * e[t]
        for t in range(b - a - 2, -1, -1):
            beta[t] = np.exp(trans) @ (e[t + 1] * beta[t + 1])
        p = alpha * beta
        want += (p[:, 1] / p.sum(1)).tolist()
    assert np.allclose(got, want)
    assert np.allclose(pair.sum(0), np.where(first, 0, 1)) and np.allclose((pair[1] + pair[3])[~first], got[~first])
