"""Distributed order-dependent operators and the vector join against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import ops, ordering
from sightline.operators import similarity as sim
from sightline.operators.similarity import similar_rows
from sightline.plans import vectors


def skewed_rows(n=400, seed=3):
    """A third of the rows and more belong to one key; times tie."""
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(6)}", i, rnd.randrange(60), rnd.choice([1, -1, -1])) for i in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    data = skewed_rows()
    return data, spark.createDataFrame(data, "key string, id int, t int, v int")


def by_key(data):
    groups = {}
    for r in sorted(data, key=lambda r: (r[2], r[1])):
        groups.setdefault(r[0], []).append(r)
    return groups


def test_rank(spark, rows):
    data, df = rows
    got = {r["id"]: r["rank"] for r in ordering.with_rank(df, ["key"], ["t", "id"]).collect()}
    assert got == {r[1]: i + 1 for g in by_key(data).values() for i, r in enumerate(g)}
    got = {r["id"]: r["rank"] for r in ordering.with_rank(df, [], ["t", "id"]).collect()}
    assert got == {r[1]: i + 1 for i, r in enumerate(sorted(data, key=lambda r: (r[2], r[1])))}


def test_hot_key_spans_blocks(spark, rows):
    _, df = rows
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = ordering._blocks(df, ["key"], ["t", "id"]).groupBy("key", "_block").count()
        assert blocks.filter("key = 'hot'").count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_running_sum_and_low(spark, rows, coalesce):
    data, df = rows
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        got = {r["id"]: (r["running"], r["lowest"]) for r in ordering.with_running(df, ["key"], ["t", "id"], "v").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {}
    for g in by_key(data).values():
        total, low = 0, None
        for r in g:
            total += r[3]
            low = total if low is None else min(low, total)
            want[r[1]] = (total, low)
    assert got == want


@pytest.mark.parametrize("stretch", [1, 7, 1000])
def test_last_n(spark, rows, stretch):
    data, df = rows
    out = ordering.with_last_n(df, ["key"], ["t", "id"], 5, {"s": F.sum("v"), "n": F.count(F.lit(1))}, stretch=stretch)
    got = {r["id"]: (r["s"], r["n"]) for r in out.collect()}
    want = {}
    for g in by_key(data).values():
        for i, r in enumerate(g):
            frame = g[max(0, i - 4): i + 1]
            want[r[1]] = (sum(x[3] for x in frame), len(frame))
    assert got == want


def test_percentile_is_the_floor_index(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 1, 9, 3, 7, 2, 8, 4, 10, 6])], "id int, v double")
    # int(0.95 * 9) = 8: the ninth of ten values, where a rounding rule takes the tenth.
    assert ordering.element_at_fraction(df, [], "v", "id", 95).first()["p95"] == 9.0


def metrics(spark, rows):
    return spark.createDataFrame(rows, "operation_id int, resource_id string, end_micros bigint, success boolean")


def test_failure_streaks(spark):
    rnd = random.Random(5)
    data = [(i, "hot" if rnd.random() < 0.5 else f"r{rnd.randrange(4)}", rnd.randrange(200), rnd.random() < 0.45) for i in range(500)]
    got = {r["resource_id"]: (r["max_streak"], r["last_streak"], r["opened"], r["first_open_micros"]) for r in ops.failure_streaks(metrics(spark, data)).collect()}
    want = {}
    for key in {d[1] for d in data}:
        count = best = 0
        first = None
        for _, _, at, ok in sorted((d for d in data if d[1] == key), key=lambda d: (d[2], d[0])):
            count = max(0, count - 1) if ok else count + 1
            best = max(best, count)
            if count >= 5 and first is None:
                first = at
        want[key] = (best, count, best >= 5, first)
    assert got == want


def test_rolling_error_rate_needs_ten(spark):
    data = [(i, "r", i, i % 4 != 0) for i in range(30)]
    got = {r["operation_id"]: (r["in_frame"], r["error_rate"]) for r in ops.rolling_error_rate(metrics(spark, data)).collect()}
    assert min(got) == 9 and got[9] == (10, 30.0) and got[29] == (20, 25.0)


def test_request_counts_window_is_open_at_its_start(spark):
    data = [(1, "a", 1, "2024-01-01 00:00:00"), (1, "a", 2, "2024-01-01 00:30:00"), (1, "a", 3, "2024-01-01 01:00:00"), (1, "a", 4, "2024-01-01 01:00:00"), (2, "a", 5, "2024-01-01 01:00:00")]
    df = spark.createDataFrame(data, "user_id int, event_type string, event_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r["event_id"]: r["requests"] for r in ops.request_counts(df).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 3, 5: 1}
    assert [r["event_id"] for r in ops.over_limit(df, 2).collect()] == [4]


def test_concurrency_and_alerts(spark):
    data = [(i, "x", "2024-01-01 00:00:00", 40.0 if i else 1.0, 1000, True, "r") for i in range(60)]
    ops_df = spark.createDataFrame(data, "operation_id int, operation_type string, start_time string, duration_s double, rows_scanned bigint, success boolean, resource_id string").withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))
    m = ops.operation_metrics(ops_df)
    assert sorted(r["already_running"] for r in ops.concurrency(m).collect()) == list(range(60))
    kinds = {r["type"]: r["count"] for r in ops.threshold_alerts(m).groupBy("type").count().collect()}
    assert kinds == {"slow_operation": 59, "low_throughput": 59, "high_concurrency": 10}
    message = ops.threshold_alerts(m).filter("type = 'slow_operation'").select(ops.alert_message()).first()[0]
    assert message.endswith("took 40.0 seconds")


def brute_similar(vectors, threshold, keep, rank_by):
    out = {}
    ids = sorted(vectors)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items() if np.linalg.norm(v) > 0}
    for i in ids:
        near = [(j, float(unit[i] @ unit[j])) for j in ids if j != i and i in unit and j in unit]
        near = [(j, s) for j, s in near if s > threshold]
        near.sort(key=(lambda p: p[0]) if rank_by == "id" else (lambda p: (-round(p[1], 9), p[0])))
        if near:
            out[i] = [j for j, _ in near[:keep]]
    return out


@pytest.mark.parametrize("rank_by", ["id", "similarity"])
@pytest.mark.parametrize("threshold", [0.3, 0.7])
def test_similar_rows(spark, threshold, rank_by):
    rnd = np.random.default_rng(11)
    vectors = {i: rnd.normal(size=6).round(2).tolist() for i in range(150)}
    for i in range(150, 230):  # a third of the rows are copies of one vector
        vectors[i] = vectors[7]
    vectors[230], vectors[231] = [0.0] * 6, [0.0] * 6
    df = spark.createDataFrame(list(vectors.items()), "id bigint, vec array<float>")
    as_read = {r["id"]: r["vec"] for r in df.collect()}
    got = {}
    for r in similar_rows(df, "id", "vec", threshold, rank_by=rank_by, block=16).collect():
        got.setdefault(r["id"], []).append((r["similar_id"], r["similarity"]))
    got = {i: [j for j, _ in sorted(v, key=(lambda p: p[0]) if rank_by == "id" else (lambda p: (-round(p[1], 9), p[0])))] for i, v in got.items()}
    assert got == brute_similar(as_read, threshold, 5, rank_by)


def test_similar_rows_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "id bigint, vec array<float>")
    assert similar_rows(df, "id", "vec").count() == 0


def clusters(n_clusters, n, dim=6, spread=0.05, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n_clusters, dim))
    return [(i, (centres[i % n_clusters] + spread * rng.normal(size=dim)).tolist()) for i in range(n)]


def as_frame(spark, vectors):
    return spark.createDataFrame(vectors, "id long, vec array<float>")


def pairs_of(df):
    return {(r["id"], r["similar_id"]): r["similarity"] for r in df.collect()}


def test_rings_and_bounds_lose_no_pair(spark):
    df = as_frame(spark, clusters(12, 400))
    as_read = {r["id"]: r["vec"] for r in df.collect()}
    want = brute_similar(as_read, 0.99, 400, "id")
    got = pairs_of(similar_rows(df, "id", "vec", 0.99, keep=400, block=8))
    assert set(got) == {(a, b) for a, found in want.items() for b in found} and got


def test_few_blocks_are_touched_where_vectors_are_grouped(spark):
    row = sim.blocks_touched(as_frame(spark, clusters(40, 2000, spread=0.01)), "id", "vec", 0.99, block=64).first()
    assert row["n_vectors"] == 2000 and row["n_blocks"] >= 32
    assert row["pairs_compared"] < 0.2 * row["pairs"] and row["rows_sent"] < 0.2 * row["rows"]
    assert sim.blocks_touched(as_frame(spark, []), "id", "vec").first()["pairs"] == 0


def test_pivots_and_blocks_are_bounded():
    assert [sim.pivot_count(n, 64) for n in (0, 1, 640, 10_000, 10**12)] == [1, 1, 10, 100, sim.MAX_PIVOTS]
    for n in (10, 10**6, 10**10):
        bits, tables = sim.planes_for(n, 0.7, 0.95, 2048)
        meets = (1 - np.arccos(0.7) / np.pi) ** bits
        assert tables <= sim.MAX_TABLES and 1 - (1 - meets) ** tables >= 0.95


@pytest.mark.parametrize("block", [64, 2048])
def test_hashed_rows_find_most_pairs(spark, block):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id AS id", "slice(embedding, 1, 8) AS vec")
    as_read = {r["id"]: r["vec"] for r in df.collect()}
    want = {(a, b) for a, found in brute_similar(as_read, 0.8, 500, "id").items() for b in found}
    got = pairs_of(sim.hashed_rows(df, "id", "vec", 0.8, keep=500, block=block))
    assert len(want) > 1000 and set(got) <= want and len(got) >= 0.93 * len(want)
    exact = pairs_of(similar_rows(df, "id", "vec", 0.8, keep=500))
    assert set(exact) == want and all(abs(exact[p] - s) < 1e-9 for p, s in got.items())


def test_hashed_rows_of_nothing_and_of_copies(spark):
    assert sim.hashed_rows(as_frame(spark, []), "id", "vec").count() == 0
    same = as_frame(spark, [(i, [1.0, 2.0]) for i in range(50)])
    got = pairs_of(sim.hashed_rows(same, "id", "vec"))
    assert {b for a, b in got if a == 7} == {0, 1, 2, 3, 4} and len(got) == 250


def test_similar_vectors_compares_whole_vectors(spark, tmp_path):
    head = [1.0] * 8
    rows = [(1, head + [9.0] * 8), (2, head + [-9.0] * 8), (3, head + [9.0] * 7 + [8.0])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert set(pairs_of(vectors.QUERIES["similar_vectors"](spark, str(tmp_path)).withColumnRenamed("vec_id", "id"))) == {(1, 3), (3, 1)}


def test_similar_vectors_hashed_compares_whole_vectors(spark, tmp_path):
    rng = np.random.default_rng(8)
    tails = rng.normal(size=(20, 24))
    # Heads are one vector or nothing, tails of five rows each are alike.
    rows = [(i, [float(i % 2)] * 8 + (9 * tails[i // 5] + rng.normal(size=24)).tolist()) for i in range(100)]
    as_frame(spark, rows).toDF("vec_id", "embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = pairs_of(vectors.QUERIES["similar_vectors_hashed"](spark, str(tmp_path)).withColumnRenamed("vec_id", "id"))
    want = brute_similar(dict(rows), 0.7, 5, "similarity")
    assert set(got) == {(a, b) for a, found in want.items() for b in found} and set(got) >= {(a, b) for a in range(100) for b in range(100) if a != b and a // 5 == b // 5}


def test_a_vector_is_sent_once_to_a_side(spark):
    rng = np.random.default_rng(5)
    df = as_frame(spark, [(i, rng.normal(size=6).tolist()) for i in range(600)])
    _, rows, blocks = sim._exact_blocks(df, "id", "vec", 0.3, 5, 4)
    sent = sim._sent(rows, blocks)
    assert len(blocks.home) > 8 * sim.SIDES and sent.count() <= 600 * sim.SIDES
    assert sent.select("pair").distinct().count() <= sim.SIDES * (sim.SIDES + 1) // 2
    sizes = np.full(4096, 2048)
    assert np.bincount(sim.sides_of(sizes), weights=sizes).max() <= sim.MAX_SIDE and sim.sides_of(sizes[:3]).tolist() == [0, 1, 2]


@pytest.mark.parametrize("look", [sim._first_ones, sim._nearest_ones])
def test_what_is_looked_up_holds_the_best(look):
    rng = np.random.default_rng(6)
    units = sim._unit(rng.normal(size=(5000, 3)).round(1) + 0.05)
    itself = np.array([7, -1, 2500])
    i, j, sims = look(units[[7, 8, 2500]], units, itself, 0.5, 5)
    for row, own in enumerate(itself):
        cosine = units[[7, 8, 2500][row]] @ units.T
        want = [c for c in np.flatnonzero(cosine > 0.5) if c != own]
        if look is sim._nearest_ones:
            want.sort(key=lambda c: -cosine[c])
        got = sims[i == row] if look is sim._nearest_ones else j[i == row]
        assert own not in j[i == row] and len(got) < len(want)
        assert sorted(got, reverse=look is sim._nearest_ones)[:5] == pytest.approx(cosine[want[:5]] if look is sim._nearest_ones else want[:5])
