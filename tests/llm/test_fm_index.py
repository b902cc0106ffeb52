import random
import re

import numpy as np
import pytest

from sightline.llm import fm_index as M
from tests.llm import rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        for win in {tuple(b[i : i + 10]) for i in range(max(1, len(b) - 9))} if b else ():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit.update(range(p, p + len(win)))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


ITEMS = [(1, rows.prose(1)), (2, rows.prose(2, 12)), (3, "The River!"), (10, None), (11, ""), (12, "¡Été là!"), (None, rows.prose(5, 15)), (1, rows.prose(1))]


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [200_000, 7])
def test_against_brute_force(spark, block):
    data = rows.document_rows() + [(50 + i, f"{rows.prose(i, 5)} {rows.prose(i % 6)} THE river; {rows.prose(5, 15)}", "en", "s", 0) for i in range(20)]
    got = M.found_in(rows.documents(spark, clash=True, rows=data), benchmark(spark, ITEMS), block=block).collect()
    assert len(got) == len(data)
    for r in got:
        if r.text is None or len(r.text) < 200_000:
            n = sum(s.end - s.start for s in r.hit_spans)
            assert (r.n_words, n, r.hit_items) == brute(r.text, ITEMS), r.doc_id
        assert r.score == "score!"


def test_passages_are_cut_out(spark):
    passage = rows.prose(1)
    data = [(1, f"Before it, {passage} After it.", "en", "s", 0), (2, passage, "en", "s", 0), (3, rows.prose(7), None, None, 5), (4, None, "en", "s", None), (5, "", "en", "s", 0)]
    df = rows.documents(spark, clash=True, rows=data)
    out = M.cleaned(df, benchmark(spark, ITEMS))
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == df.columns and out.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    assert set(got) == {1, 3, 4, 5}
    assert got[1].text.startswith("Before it,") and got[1].text.endswith("After it.") and passage[:-1] not in got[1].text
    assert got[1].n_chars == len(got[1].text) and got[3].n_chars == 5 and got[3].text == rows.prose(7) and got[4].text is None
    again = M.found_in(out, benchmark(spark, ITEMS)).collect()
    assert not any(r.hit_spans for r in again)


def test_empty_tables(spark):
    assert M.contamination(rows.nothing(spark), benchmark(spark, ITEMS)).count() == 0
    got = M.contamination(rows.documents(spark), benchmark(spark, [])).collect()
    assert len(got) == len(rows.document_rows()) and not any(r.contaminated for r in got)


def test_index_finds_all_occurrences():
    rng = random.Random(3)
    text = np.array([rng.choice([0, 1, 1, 2, 3]) for _ in range(400)] + [1, 2] * 50 + [0])
    phrases = {tuple(text[i : i + n].tolist()) for n in (1, 2, 5) for i in range(300) if 0 not in text[i : i + n]} | {(3, 3, 3, 3, 3)}
    filled = np.array([(0,) * (10 - len(p)) + p for p in phrases])
    got = M.FMIndex(text, 3).search(filled, np.array([len(p) for p in phrases]))
    found = set(zip(got[0].tolist(), got[1].tolist(), strict=True))
    assert found == {(k, i) for k, p in enumerate(phrases) for i in range(len(text)) if tuple(text[i : i + len(p)].tolist()) == p}
