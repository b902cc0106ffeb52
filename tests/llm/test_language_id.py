import random

from sightline.llm import language_id as L
from tests.llm import rows

SPEECH = {"aa": "kalo mira sento vela duno".split(), "bb": "schtung pfrim gwolk zwent brax".split()}


def text(lang, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(SPEECH[lang]) + rng.choice(SPEECH[lang]) for _ in range(30))


def speech(n=60):
    return [(i, text("ab"[i % 2] * 2, i), "ab"[i % 2] * 2, "s", 0) for i in range(n)]


def test_held_out_documents(spark):
    data = speech() + [(100, None, "aa", "s", 0), (101, "", None, "s", 0), (102, "12 ?!", "bb", "s", 0), (None, text("aa", 7), None, None, None), (3, text("bb", 3), "bb", "s", 0)]
    got = L.languages_of(rows.documents(spark, rows=data)).collect()
    assert len(got) == len(data)
    want = {i: lang for i, t, lang, *_ in data if i is not None and i < 100}
    assert all(r.lang_pred == want[r.doc_id] and 0.5 < r.score <= 1 for r in got if r.doc_id in want)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (100, 101, 102))
    assert [(r.lang_pred, r.held_out) for r in got if r.doc_id is None] == [("aa", False)]


def test_scores_do_not_depend_on_slices(spark, monkeypatch):
    data = speech(20) + [(50, text("aa", 1) * 300, None, None, 0)]
    df = rows.documents(spark, rows=data)
    model = L.train(df)
    first = sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in L.predict(df, model).collect())
    monkeypatch.setattr(L, "BLOCK", 37)
    column = __import__("pyarrow").array([t for _, t, *_ in data])
    codes, who, _ = L.letters(column)
    assert sum(len(b) for b, _ in L.grams(codes, who)) == sum(max(0, (who == d).sum() - n + 1) for d in range(len(data)) for n in L.LENGTHS)
    assert len(first) == 21


def test_clashing_columns_are_replaced_and_nothing_learned(spark):
    df = rows.documents(spark, clash=True)
    got = L.predict(df, L.train(df.where("lang = 'none'"))).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)} and got[0].host == "host!"
    assert L.languages_of(rows.nothing(spark)).count() == 0


def test_rare_languages_are_learned(spark):
    data = [(i, text("aa", i), "aa", "s", 0) for i in range(400)] + [(1000 + i, text("bb", i), "bb", "s", 0) for i in range(3)]
    df = rows.documents(spark, rows=data)
    model = L.train(df, bound=20)
    assert model.languages == ["aa", "bb"]
    assert [round(float(x), 6) for x in __import__("numpy").exp(model.log_prior) * 403] == [400, 3]
    got = {r.doc_id: r.lang_pred for r in L.predict(rows.documents(spark, rows=[(1, text("bb", 77), None, None, 0)]), model).collect()}
    assert got == {1: "bb"}
    ids = df.selectExpr("lang as l", "xxhash64(doc_id) as h")
    last = L.last_hashes(ids, {"aa": 400, "bb": 3}, 20)
    assert {x: ids.where(f"l = '{x}' and h <= {n}").count() for x, n in last.items()} == {"aa": 17, "bb": 3}
    assert L.shares({"a": 1, "b": 50, "c": 7}, 20) == {"a": 1, "c": 7, "b": 12} and L.shares({"a": 5, "b": 5}, 1) == {"a": 1, "b": 1}
