"""Repairs against trying everything, against a plain table of prefixes, and against SQL."""

import itertools
import random
import re
import zlib
from hashlib import sha256

import duckdb
import pytest

from sightline.llm import conversation_repair as R
from tests.llm import rows

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def every_repair(given, limit=3):
    """(cost, audit) of the cheapest edits by trying all, with at most `limit` inserts in a row."""
    best = None
    choices = [["D"] if kind == R.GONE else ["K", "D", "Ru", "Ra"] for _, kind in given]
    gaps = [list(g) for n in range(limit + 1) for g in itertools.product("ua", repeat=n)]
    for picked in itertools.product(*choices):
        for filled in itertools.product(gaps, repeat=len(given) + 1):
            cost, audit, out = 0, "", ""
            for i, inserted in enumerate(filled):
                cost += 5 * len(inserted)
                audit += "I" * len(inserted)
                out += "".join(inserted)
                if i < len(given):
                    initial, kind = given[i]
                    how = picked[i]
                    audit += how[0]
                    cost += {"K": 0, "D": 2, "R": 1}[how[0]] + (5 if kind == R.CUT and how != "D" else 0)
                    out += "" if how == "D" else initial if how == "K" else how[1]
            if re.fullmatch("(s?(ua)+)?", out) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def prefixes(given):
    """The same by the best prefix for each row and state."""
    def closed(best):
        for q in (0, 1, 3, 2):
            for _, c, to in R.inserts(q):
                if q in best:
                    new = (best[q][0] + c, best[q][1] + "I")
                    best[to] = min(best.get(to, new), new)
        return best

    best = closed({0: (0, "")})
    for row in given:
        after = {}
        for q, (cost, audit) in best.items():
            for letter, c, to in R.steps(q, row):
                new = (cost + c, audit + letter)
                after[to] = min(after.get(to, new), new)
        best = closed(after)
    return min(best[q] for q in (0, 3) if q in best)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_search_equals_trying_everything(n):
    for given in itertools.product(itertools.product("suax", range(3)), repeat=n):
        assert R.search(list(given)) == every_repair(given, 2)


def some(rng, n):
    return [(rng.choice("uauausx "), rng.choice((0, 0, 0, 1, 2))) for _ in range(n)]


def test_search_equals_prefix_tables():
    rng = random.Random(1)
    for n in [*range(3, 40)] * 3 + [64, 200]:
        given = some(rng, n)
        assert R.search(given) == prefixes(given)


def test_segments_together_equal_the_whole():
    rng = random.Random(2)
    for n in (7, 20, 45):
        given = some(rng, n)
        tables = [R.table_of(given[i : i + 6], False, i == 0) for i in range(0, n, 6)]
        cost, audit, end = min((c, a, x) for e, x, c, a in R.combined(tables) if x in R.ENDS)
        assert (cost, audit) == prefixes(given)
        told = R.states_between(tables, R.START, end)
        parts = [next((c, a) for e, x, c, a in t if (e, x) == pair) for t, pair in zip(tables, told, strict=True)]
        assert (sum(c for c, _ in parts), "".join(a for _, a in parts)) == (cost, audit)


def brute(data):
    """The report in plain Python."""
    out, by_conv = {}, {}
    for conv, turn, role, text in data:
        by_conv.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate:
            role = "user" if fate == 4 else role
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            by_conv[conv] += [(turn is not None, turn or 0, role, sha256(text.encode()).digest(), text)] * (2 if fate == 3 else 1)
    for conv, found in by_conv.items():
        found.sort()
        turns = {f[1] for f in found if f[0]}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, given, counts = set(), [], [0, 0, 0]
        for _, _, role, _, text in found:
            kind = R.FINE
            if not text.strip(SPACES):
                counts[0], kind = counts[0] + 1, R.GONE
            elif (role, text) in seen:
                counts[1], kind = counts[1] + 1, R.GONE
            elif text.rstrip(SPACES)[-1] not in ".!?":
                counts[2], kind = counts[2] + 1, R.CUT
            seen.add((role, text))
            given.append((role[:1], kind))
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(given))
        cost, audit = prefixes(given)
        lines, at, state = [], 0, R.START
        for letter in audit:
            if letter != "D":
                initial = given[at][0] if letter == "K" else "a" if state == R.USER else "u"
                state = R.MOVES[state, initial]
                role = found[at][2] if letter == "K" else R.ROLES[initial]
                lines.append(f"{role}:{'' if letter == 'I' else found[at][4]}")
            at += letter != "I"
        out[conv] = (gaps, *counts, illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest())
    return out


def plain(df):
    got = df.collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def odd_rows():
    rng = random.Random(3)
    texts = ["One. ", "Two!\n", "Cut off", "", " \t", None, "é?", "Ask.", "x" * 50_000 + "."]
    data = [(c, t, rng.choice(["user", "assistant", "system", None, "", "tool"]), rng.choice(texts)) for c in range(40) for t in range(rng.randrange(1, 9))]
    data += [(50, None, "user", "a."), (50, None, "assistant", "b."), (51, 3, "user", "a."), (51, 3, "user", "a."), (51, 9, "assistant", "b."), (None, 1, "user", "a."), (None, 2, "assistant", "b.")]
    return data


def test_odd_rows(spark):
    data = odd_rows()
    df = spark.createDataFrame(data, SCHEMA)
    for name in (*rows.CLASHING, "conv", "rank", "segment", "rows"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    assert plain(R.damage_report(df)) == brute(data)


def test_a_long_conversation_among_short_ones(spark, monkeypatch):
    monkeypatch.setattr(R, "SEGMENT", 4)  # three rounds of runs
    rng = random.Random(4)
    data = [(1, t // 2, rng.choice(["user", "assistant", "system"]), f"{t}" + rng.choice(["", "."])) for t in range(300)] + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    assert plain(R.damage_report(spark.createDataFrame(data, SCHEMA))) == brute(data)


def test_conversations_of_which_nothing_is_left(spark):
    dropped = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = plain(R.damage_report(spark.createDataFrame([(*dropped, "user", "a.")], SCHEMA)))
    assert got == {dropped[0]: (0, 0, 0, 0, 0, 0, "", sha256().hexdigest())}
    assert R.damage_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repaired_rows_have_their_texts(spark):
    data = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes."), (1, 3, "assistant", ""), (1, 4, "tool", "More?"), (1, 5, "assistant", "Done.")]
    got = [(r.role, r.text) for r in R.repaired(spark.createDataFrame(data, SCHEMA)).orderBy("segment", "place").collect()]
    assert got == [("user", "Hi."), ("assistant", "Yes."), ("user", "More?"), ("assistant", "Done.")]


def test_sql_gives_the_same(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    want = {r[0]: r[1:] for r in con.execute(R.sql()).fetchall()}
    assert plain(R.damage_report(spark.read.parquet(f"{small}/conversations.parquet"))) == want


def test_sql_on_odd_rows():
    data = odd_rows()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", data)
    assert {r[0]: r[1:] for r in con.execute(R.sql()).fetchall()} == brute(data)
