"""The manifest against plain hashing, and against SQL."""

import zlib
from hashlib import sha256

import duckdb
import pytest

from sightline.llm import merkle_manifest as M
from tests.llm import rows


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    i, text, lang, source, n = row
    text = text.translate(str.maketrans(M.UPPER, M.LOWER)) if lower and text is not None else text
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text))


def path(nodes, i):
    """Siblings and the way up to one node: (left, right) of each run, and the root."""
    steps = []
    while len(nodes) > 1:
        run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
        steps.append((run[: i % 8], run[i % 8 + 1 :]))
        nodes, i = [h(nodes[k : k + 8]) for k in range(0, len(nodes), 8)], i // 8
    return steps, nodes[0]


def brute(data):
    groups = {}
    for r in data:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    subroots = [path([leaf(r) for r in groups[x]], 0)[1] for x in names]
    out = []
    for k, x in enumerate(names):
        nodes = [leaf(r) for r in groups[x]]
        upper, root = path(subroots, k)
        for i, r in enumerate(groups[x]):
            steps = path(nodes, i)[0] + upper
            now = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for left, right in steps:
                now = h([*left, now, *right])
            out.append((str(r[0]), nodes[i], subroots[k], root, h(s for left, right in steps for s in left + right), now, now == root))
    return sorted(out)


def plain(got):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got)


def many(n, langs=("en", "de", None, "é", "z")):
    return [(i, f"Text {i} " + "Ab" * (i % 5), langs[0] if i % 3 else langs[i // 3 % len(langs)], None if i % 7 == 0 else f"s{i % 4}", i) for i in range(n)]


@pytest.mark.parametrize("data", [rows.document_rows(), many(1), many(9, ("en",)), many(700), many(65) + many(65)[:9], [(i, "x", f"l{i % 70:02}", "s", 1) for i in range(140)]])
def test_equals_plain_hashing(spark, data):
    assert plain(M.tampered_manifest(rows.documents(spark, clash=True, rows=data)).collect()) == brute(data)


def test_several_rounds(spark):
    data = many(600)
    got = M.manifest(rows.documents(spark, rows=data), "doc_id", "lang", M.FIELDS, depth=1).collect()
    want = brute(data)
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256) for r in got) == [w[:5] for w in want]
    assert all(r.verified for r in got)


def test_only_changed_rows_fail(spark):
    data = many(300)
    for r in M.tampered_manifest(rows.documents(spark, rows=data)).collect():
        changed = zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        assert r.verified == (not changed)  # each text has capitals


def test_empty_table(spark):
    assert M.tampered_manifest(rows.nothing(spark)).count() == 0


def test_other_columns(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "`a.b` long, v string")
    got = M.manifest(df.selectExpr("*", "CAST(`a.b` % 2 AS string) AS g"), "a.b", "g", ["a.b", "v"]).collect()
    assert len(got) == 20 and all(r.verified for r in got) and len({r.root for r in got}) == 1 and len({r.subroot for r in got}) == 2


def test_resuming_a_state_equals_hashing_anew():
    children = [sha256(bytes([i])).hexdigest().encode() for i in range(8)]
    p = M.Parent(children)
    new = sha256(b"new").hexdigest().encode()
    for slot in range(8):
        assert p.folded(slot, new) == M.Parent([*children[:slot], new, *children[slot + 1 :]]).digest
        assert p.folded(slot, children[slot]) == p.digest


@pytest.mark.parametrize("text", ["0", "7", "123456789", "-12", "9007199254740993"])
def test_crc32_in_sql(text):
    assert duckdb.sql(f"SELECT {M.crc32_sql(chr(39) + text + chr(39))}").fetchall() == [(zlib.crc32(text.encode()),)]


def test_sql_gives_the_same(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = sorted((str(r[0]), *r[1:]) for r in con.execute(M.sql()).fetchall())
    assert plain(M.tampered_manifest(spark.read.parquet(f"{small}/documents.parquet")).collect()) == want
