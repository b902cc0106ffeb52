import re
from collections import Counter

from sightline.llm import quality_rules as Q
from tests.llm import rows


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if n[x] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


EXTRA = [(60, "one two three four five six\n" * 3 + "a b c", "en", "s", 0), (61, "a a a a a a a", "en", "s", 0), (62, "# * x|y <b>\n\n#\n#", "en", "s", 0), (63, "Erred*** reed&&& ndsh$$$ " * 60, "en", "s", 0)]


def judge(spark, data, clash=False):
    df = rows.documents(spark, clash, data)
    made, p = Q.judged(df, Q.references(df))
    return made, p


def test_counts_and_verdicts(spark):
    data = rows.document_rows() + EXTRA + [(70 + i, rows.prose(70 + i, 120), "en", "s", 0) for i in range(20)]
    made, p = judge(spark, data, clash=True)
    got = made.collect()
    assert len(got) == len(data)
    for r in got:
        counts = brute(r.text)
        assert tuple(r[p + c] for c in Q.COUNTS) == counts
        assert r[p + "base_failed"] == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert r.score == "score!"
    kept = {r.doc_id: r[p + "kept"] for r in got}
    assert all(kept[70 + i] for i in range(20)) and not kept[63] and not kept[4] and not kept[5]


def test_symbols_are_far_from_the_reference(spark):
    noisy = " ".join(f"w{i}{'#*$%'[i % 4] * 3}" for i in range(80))
    made, p = judge(spark, [(i, rows.prose(i, 120), "en", "s", 0) for i in range(10)] + [(99, noisy, "en", "s", 0)])
    row = made.where("doc_id = 99").first()
    assert not row[p + "base_failed"] and row[p + "class_distance"] > 0.3 and not row[p + "kept"]


def test_filter_on_the_verdict_and_short_texts(spark):
    made, p = judge(spark, [(1, rows.prose(1, 12), None, None, 0), (2, "too short", None, None, 0)])
    assert [r.doc_id for r in made.where(made[p + "kept"]).collect()] == [1]


def test_empty_table(spark):
    assert Q.verdicts(rows.nothing(spark)).count() == 0
