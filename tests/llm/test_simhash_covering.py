import random
import re

import numpy as np
import pytest
import xxhash

from sightline.llm import simhash_covering as S
from tests.llm import rows


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def brute_roots(points):
    root = {p: p for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(points):
        for b in points[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in points}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def clusters(seed, centres=30, members=12):
    rng = random.Random(seed)
    out = set()
    for _ in range(centres):
        x = rng.getrandbits(64)
        for _ in range(members):
            out.add(x)
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randrange(64)
    return sorted(out)


def test_masks_cover_every_difference_within_the_radius():
    masks, rng = S.masks(), random.Random(1)
    assert len(masks) == 31
    for _ in range(5000):
        diff = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not m & diff for m in masks)


def test_fingerprints(spark):
    got = S.with_fingerprints(rows.documents(spark, clash=True), to="made").collect()
    assert len(got) == len(rows.document_rows())
    for r in got:
        if r.text is None or len(r.text) < 10_000:
            assert r.made == signed(brute_fingerprint(r.text))


def test_forest_joins_what_brute_force_joins():
    points = clusters(2)
    links = S.forest(np.array(points, np.uint64))
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    roots = brute_roots(points)
    assert len(links) == len(points) - len(set(roots.values()))
    assert all(roots[a] == roots[b] for a, b in links)


@pytest.mark.parametrize("part", [4096, 3])
def test_components(spark, monkeypatch, part):
    monkeypatch.setattr(S, "PART", part)
    points = clusters(3, 12)
    df = spark.createDataFrame([(i, signed(p)) for i, p in enumerate(points)] + [(900 + i, signed(p)) for i, p in enumerate(points[:5])] + [(None, signed(points[0]))], "doc_id long, fp long")
    got = {(r.doc_id, r.fp): r.component_id for r in S.grouped(df).collect()}
    roots, least = brute_roots(points), {}
    for i, p in enumerate(points):
        least.setdefault(roots[p], i)
    for (_, fp), c in got.items():
        assert c == least[roots[fp & (1 << 64) - 1]]


def test_near_duplicates_of_documents(spark):
    got = S.near_duplicates(rows.documents(spark)).collect()
    by_text = {}
    for r, (i, t, *_) in zip(sorted(got, key=lambda r: (str(r.doc_id), r.fingerprint)), sorted(rows.document_rows(), key=lambda r: (str(r[0]), f"{brute_fingerprint(r[1]) if r[1] is None or len(r[1]) < 10_000 else 0:016x}")), strict=True):
        assert str(r.doc_id) == str(i)
    for r in got:
        by_text.setdefault(r.fingerprint, set()).add(r.component_id)
    assert all(len(c) == 1 for c in by_text.values())
    assert next(r.component_id for r in got if r.doc_id == 3) == 1
    assert {r.component_id for r in got if r.doc_id in (4, 5, 6)} == {4}


def test_one_of_each(spark, tmp_path):
    rows.documents(spark, clash=True).coalesce(2).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    kept = S.one_of_each(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids.count(2) == 1 and ids.count(1) == 1 and 3 not in ids and 4 in ids and 5 not in ids and ids.count(None) == 1


def test_empty_table(spark, tmp_path):
    assert S.near_duplicates(rows.nothing(spark)).count() == 0
