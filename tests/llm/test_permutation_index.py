"""Neighbours against brute force."""

import numpy as np
import pytest

from sightline.llm import permutation_index as P
from tests.llm import rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(data, every=20, k=20):
    known = [(i, np.array(v, np.float32).astype(np.float64)) for i, v, *_ in data if i is not None and v is not None and len(v) and None not in v]
    known = [(i, v) for i, v in known if np.isfinite(v).all() and v.any()]
    out = {}
    for q, a in known:
        if q % every == 0:
            best = out.setdefault(q, {})
            for i, b in known:
                if i != q:
                    s = sum(x * y for x, y in zip(a.tolist(), b.tolist(), strict=True))
                    best[i] = max(best.get(i, -np.inf), s)
    return {q: sorted(((-s, i) for i, s in best.items()))[:k] for q, best in out.items()}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({i for _, i in got.get(q, [])} & {i for _, i in best}) for q, best in want.items()) / max(1, sum(map(len, want.values())))


def some(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=dim).astype(np.float32).tolist(), 0) for i in range(n)]


def check_scores(got, data):
    by_id = {}
    for i, v, *_ in data:
        if v is not None and None not in v:
            by_id.setdefault(i, []).append(np.array(v, np.float32).astype(np.float64))
    for q, best in got.items():
        assert best == sorted(best)
        assert q not in {i for _, i in best} and len({i for _, i in best}) == len(best)
        for s, i in best:
            assert -s == pytest.approx(max(float(a @ b) for a in by_id[q] for b in by_id[i]), abs=1e-12)


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = [(r.vec_id, r.embedding) for r in df.collect()]
    got, want = found(P.neighbours(df)), brute(data)
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert recall(got, want) >= 0.93
    check_scores(got, data)


@pytest.mark.parametrize("cell", [8192, 16])
def test_lengths_differ_and_cells_are_parted(spark, cell):
    rng = np.random.default_rng(5)
    data = [(i, (np.array(v) * rng.uniform(0.1, 10)).tolist(), 0) for i, v, _ in some(400)]
    df = spark.createDataFrame(data, SCHEMA)
    got, want = found(P.search(df, df.where("vec_id % 20 = 0"), cell=cell)), brute(data)
    assert recall(got, want) >= 0.9
    check_scores(got, data)


def test_everything_is_found_if_all_files_are_opened(spark):
    data = some(300)
    df = spark.createDataFrame(data, SCHEMA)
    got = found(P.search(df, df.where("vec_id % 20 = 0"), probed=64, share=1.0))
    want = brute(data)
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}


def test_odd_rows(spark):
    data = some(50, 4) + [(60, None, 0), (80, [0.0] * 4, 0), (100, [1.0, None, 0.0, 0.0], 0), (120, [1.0, float("nan"), 0.0, 0.0], 0), (140, [float("inf"), 0.0, 0.0, 0.0], 0), (160, [], 0), (180, [1.0, 2.0], 0), (None, [1.0, 0.0, 0.0, 0.0], 0)]
    data += [(20, data[20][1], 0), (40, data[3][1], 0), (7, data[7][1], 1)]  # repeated rows, and an id with two vectors
    df = spark.createDataFrame(data, SCHEMA)
    for name in (*rows.CLASHING, "id", "vec", "bytes", "files", "rank"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    got = found(P.neighbours(df))
    assert set(got) == {0, 20, 40} and all(len(x) == 20 for x in got.values())
    check_scores(got, [d for d in data if d[0] != 180])


@pytest.mark.parametrize("n", [1, 2, 15, 21])
def test_few_rows_are_all_found(spark, n):
    data = some(n, 3)
    df = spark.createDataFrame(data, SCHEMA)
    got, want = found(P.neighbours(df)), brute(data)
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items() if x}


def test_a_third_of_all_rows_are_one_vector(spark):
    unit = [(np.array(v) / np.linalg.norm(v)).tolist() for _, v, _ in some(600, 8)]
    data = [(i, unit[0] if i % 3 == 0 else v, 0) for i, v in enumerate(unit)]
    df = spark.createDataFrame(data, SCHEMA)
    got = found(P.search(df, df.where("vec_id % 20 = 0"), cell=32))
    for q in range(0, 600, 60):  # ties go to the smaller id
        assert [i for _, i in got[q]] == [i for i in range(0, 600, 3) if i != q][:20]


def test_empty_table(spark):
    assert P.neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
