from sightline.llm import chat_trees as C

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["", "</s>", "<\\/s>", "[INST]", "[\\\\/INST] x", "a</s>[INST] b [/INST]c<s>", "<", "[", "\\", " [/INST]", "é\U0001f600\n<s"]


def read(spark, data):
    df = C.formatted(C.chain(spark.createDataFrame(data, SCHEMA), "conv_id", "turn", "role", "text"))
    return {r.tree: r for r in C.read_back(df).collect()}


def test_every_text_comes_back(spark):
    data = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)] + [(2, i, t, t) for i, t in enumerate(NASTY)]
    got = read(spark, data)
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)]
    assert got[1].loss_text == "".join(NASTY[1::2])
    assert [(t.role, t.text) for t in got[2].turns] == [(t, t) for t in NASTY] and got[2].loss_text == ""


def test_escaping_leaves_no_control_string():
    for t in NASTY:
        e = C.escape(t)
        assert C.unescape(e) == t and not any(x in e for x in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_nulls_ties_and_long_conversations(spark):
    data = [(None, 1, None, None), (None, 0, "user", "a"), (3, None, "assistant", "z"), (3, 5, "user", "b"), (3, 5, "user", "a"), (3, 5, "user", "a")]
    data += [(4, i, "user", f"t{i}") for i in range(300)] + [(5, 0, "assistant", "y" * 500_000)]
    got = read(spark, data)
    assert [t.text for t in got[None].turns] == ["a", ""]
    assert [t.text for t in got[3].turns] == ["z", "a", "a", "b"] and got[3].loss_text == "z"
    assert [t.text for t in got[4].turns] == [f"t{i}" for i in range(300)]
    assert got[5].loss_text == "y" * 500_000


def test_empty_table_has_the_probe_only(spark):
    rows = C.digests(spark.createDataFrame([], SCHEMA)).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in rows] == [(-7, 2, 21)]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "x", "y")], SCHEMA + ", tree string, formatted string")
    assert C.digests(df).count() == 2


def test_branches_by_score(spark):
    """    a - b - d (best mean)      e: parent missing, so a root      f - f2 - f: a cycle
             \\ c"""
    data = [(1, "a", None, 1.0), (1, "b", "a", 2.0), (1, "c", "a", 1.5), (1, "d", "b", 9.0), (1, "e", "zz", None), (1, "f", "f2", 9.0), (1, "f2", "f", 9.0), (2, "x", None, None)]
    df = spark.createDataFrame(data, "tree long, node string, parent string, score double").selectExpr("*", "'user' AS role", "node AS text")
    got = C.branches(df, C.Tree(score="score"), top=2).orderBy("tree", "rank").collect()
    assert [(r.tree, r.branch, r.rank, r.nodes) for r in got] == [(1, "d", 1, ["a", "b", "d"]), (1, "c", 2, ["a", "c"]), (2, "x", 1, ["x"])]
    assert C.branches(df, C.Tree(score="score"), top=99).count() == 4
