"""Conversation structure repair by depth-first branch-and-bound.

A conversation is in order if the initials of its roles are nothing or `s?(ua)+`. Edits bring it there:
Keep a row, Rerole it to user or assistant, Delete it, Insert an empty row of user or assistant. The
cheapest list of edits is searched depth first with an explicit stack: a prefix is left as soon as its
cost and a lower bound of what must follow cannot beat the best complete list, the incumbent (cost,
audit), or as soon as the table of its node, that is (rows done, state), holds a prefix that is no
worse. When the stack is empty, the incumbent is proved.

A long conversation is cut into segments of SEGMENT rows. Each segment is searched for each pair of
states at its ends; runs of SEGMENT neighbouring results are combined, run by run and round by round, and
then each segment is told its states. So the search never holds more than a segment, and a conversation
that has a third of all rows is many segments. Texts are left out of all that: they travel once, to
the rows that stay.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import stored, with_columns_in_arrow
from sightline.llm.merkle_manifest import crc32_sql
from sightline.operators.ordering import with_rank

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SEGMENT = 64
#: States: nothing yet, after system, after user, after assistant. An initial leads on.
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
#: What a row is like: fine, to be deleted (blank or duplicate), truncated.
FINE, GONE, CUT = range(3)

Row = tuple[str, int]  # initial and kind
Found = tuple[int, str]  # cost and audit

SPACE = r"\x20\x09-\x0D"


def steps(state: int, row: Row) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up a row."""
    initial, kind = row
    out = [("D", DELETE, state)]
    if kind == GONE:
        return out
    extra = TRUNCATED if kind == CUT else 0
    if (state, initial) in MOVES:
        out.append(("K", KEEP + extra, MOVES[state, initial]))
    out += [("R", REROLE + extra, MOVES[state, x]) for x in ROLES if x != initial and (state, x) in MOVES]
    return out


def inserts(state: int) -> list[tuple[str, int, int]]:
    return [("I", INSERT, MOVES[state, x]) for x in ROLES if (state, x) in MOVES]


def lower_bounds(rows: list[Row]) -> list[list[int]]:
    """For each number of rows done and each state, what the other rows cost at least: their cheapest
    edits if a conversation might end in any state."""
    bounds = [[0] * 4]
    for row in reversed(rows):
        least = [min(cost + bounds[-1][to] for _, cost, to in steps(q, row)) for q in range(4)]
        for _ in range(3):
            least = [min([least[q], *(cost + least[to] for _, cost, to in inserts(q))]) for q in range(4)]
        bounds.append(least)
    return bounds[::-1]


def search(rows: list[Row], entry: int = START, ends: tuple[int, ...] = ENDS) -> Found | None:
    """The cheapest edits from one state to one of `ends`, of equal ones the least audit; None if there
    are none. Two prefixes of a node with equal cost never are prefixes of each other, since inserts
    cost, so the lesser one stays the lesser whatever follows."""
    bounds, n = lower_bounds(rows), len(rows)
    incumbent: Found | None = None
    tables: list[dict[int, Found]] = [{} for _ in range(n + 1)]
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if incumbent is not None:
            floor = cost + bounds[i][state]
            if floor > incumbent[0] or floor == incumbent[0] and audit > incumbent[1][: len(audit)]:
                continue
        known = tables[i].get(state)
        if known is not None and known <= (cost, audit):
            continue
        tables[i][state] = (cost, audit)
        if i == n and state in ends:
            incumbent = min(incumbent or (cost, audit), (cost, audit))
        after = [(i, to, cost + c, audit + x) for x, c, to in inserts(state)]
        if i < n:
            after += [(i + 1, to, cost + c, audit + x) for x, c, to in steps(state, rows[i])]
        # The most promising one is on top of the stack.
        stack += sorted(after, key=lambda p: (p[2] + bounds[p[0]][p[1]], p[3]), reverse=True)
    return incumbent


def table_of(rows: list[Row], whole: bool, first: bool) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, audit) of a segment; of a whole conversation only the best."""
    if whole:
        cost, audit = search(rows) or (0, "")
        return [(START, walked(START, rows, audit), cost, audit)]
    out = []
    for entry in (START,) if first else range(4):
        for end in range(4):
            found = search(rows, entry, (end,))
            if found is not None:
                out.append((entry, end, *found))
    return out


def walked(state: int, rows: list[Row], audit: str) -> int:
    """The state after an audit."""
    at = 0
    for letter in audit:
        initial = next(x for x in ROLES if (state, x) in MOVES)
        if letter == "K":
            initial = rows[at][0]
        if letter != "D":
            state = MOVES[state, initial]
        at += letter != "I"
    return state


def combined(tables: list[list[tuple[int, int, int, str]]]) -> list[tuple[int, int, int, str]]:
    """The table of neighbouring segments together."""
    out: dict[tuple[int, int], Found] = {(e, x): (c, a) for e, x, c, a in tables[0]}
    for table in tables[1:]:
        longer: dict[tuple[int, int], Found] = {}
        for (entry, middle), (cost, audit) in out.items():
            for e, x, c, a in table:
                if e == middle and ((entry, x) not in longer or (cost + c, audit + a) < longer[entry, x]):
                    longer[entry, x] = (cost + c, audit + a)
        out = longer
    return [(*k, *v) for k, v in sorted(out.items())]


def states_between(tables: list[list[tuple[int, int, int, str]]], entry: int, end: int) -> list[tuple[int, int]]:
    """(entry, exit) of each of the neighbouring segments on the best way through all of them."""
    ways: dict[int, tuple[Found, list[int]]] = {entry: ((0, ""), [entry])}
    for table in tables:
        longer: dict[int, tuple[Found, list[int]]] = {}
        for e, x, c, a in table:
            if e in ways:
                (cost, audit), way = ways[e]
                if x not in longer or (cost + c, audit + a) < longer[x][0]:
                    longer[x] = ((cost + c, audit + a), [*way, x])
        ways = longer
    way = ways[end][1]
    return list(zip(way[:-1], way[1:], strict=True))


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACE}]")


def is_truncated(text: Column) -> Column:
    """The last character that is no white space does not end a sentence. Blank texts have none."""
    return ~is_blank(text) & ~text.rlike(rf"[.!?][{SPACE}]*\z")


TABLE = T.ArrayType(T.StructType([T.StructField("entry", T.IntegerType()), T.StructField("exit", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))
_TABLE = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_PAIRS = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32())]))
PAIRS = T.ArrayType(T.StructType([T.StructField("entry", T.IntegerType()), T.StructField("exit", T.IntegerType())]))


def _said(rows: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Neutral names; null roles and texts are one space."""
    space = F.lit(" ")
    return rows.select(F.col(f"`{conversation}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), space).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), space).alias("text"))


def faulty(said: DataFrame) -> DataFrame:
    """(conv, rank, turn, role, digest, blank, duplicate, truncated): the rows of each conversation from 1
    by turn (nulls first; within a turn by role and digest of the text), with their first fault."""
    text = F.col("text")
    rows = stored(said.select("conv", "turn", "role", F.unhex(F.sha2(text, 256)).alias("digest"), is_blank(text).alias("blank"), is_truncated(text).alias("cut")))
    ranked = with_rank(rows, ["conv"], ["turn", "role", "digest"])
    # The first of each role and text; its rank is one row's own, so no group of copies meets in the join.
    firsts = ranked.groupBy("conv", "role", "digest").agg(F.min("rank").alias("r")).select(F.col("conv").alias("c"), "r")
    marked = ranked.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("rank") == F.col("r")), "left")
    again = F.col("r").isNull()
    return marked.select("conv", "rank", "turn", "role", "digest", "blank", (~F.col("blank") & again).alias("duplicate"), (F.col("cut") & ~again).alias("truncated"))


def segmented(marked: DataFrame) -> DataFrame:
    """One row per segment: its rows in order, the table of its best edits, and adjacent initials that
    are out of order inside it."""
    kind = F.when(F.col("blank") | F.col("duplicate"), GONE).when(F.col("truncated"), CUT).otherwise(FINE)
    row = F.struct("rank", F.substring("role", 1, 1).alias("initial"), kind.alias("kind"), "role", "digest")
    segments = marked.groupBy("conv", F.floor((F.col("rank") - 1) / SEGMENT).alias("segment")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    sizes = marked.groupBy("conv").agg((F.count("*") <= SEGMENT).alias("whole")).select(F.col("conv").alias("c"), "whole")
    segments = segments.join(sizes, F.col("conv").eqNullSafe(F.col("c"))).drop("c")

    def work():
        def do(initials: pa.Array, kinds: pa.Array, whole: pa.Array, segment: pa.Array) -> list[pa.Array]:
            tables = []
            # Many short conversations look alike.
            seen: dict[tuple, list] = {}
            for initials_, kinds_, all_, at in zip(initials.to_pylist(), kinds.to_pylist(), whole.to_pylist(), segment.to_pylist(), strict=True):
                key = (tuple(initials_), tuple(kinds_), all_, at == 0)
                if key not in seen:
                    seen[key] = [{"entry": e, "exit": x, "cost": c, "audit": a} for e, x, c, a in table_of(list(zip(initials_, kinds_, strict=True)), all_, at == 0)]
                tables.append(seen[key])
            return [pa.array(tables, _TABLE)]

        return do

    df = segments.withColumn("initials", F.col("rows.initial")).withColumn("kinds", F.col("rows.kind"))
    return with_columns_in_arrow(df, ["initials", "kinds", "whole", "segment"], {"table": TABLE}, work).drop("kinds")


def _plain(tables: list[list[dict]]) -> list[list[tuple[int, int, int, str]]]:
    return [[(t["entry"], t["exit"], t["cost"], t["audit"]) for t in table] for table in tables]


def _runs(nodes: DataFrame) -> DataFrame:
    """Runs of SEGMENT neighbouring nodes (conv, segment, table) of one conversation, with their tables
    in order, whole, and the combined table."""
    grouped = nodes.groupBy("conv", F.floor(F.col("segment") / SEGMENT).alias("run")).agg(F.sort_array(F.collect_list(F.struct("segment", "table"))).alias("members"))
    sizes = nodes.groupBy("conv").agg((F.count("*") <= SEGMENT).alias("whole")).select(F.col("conv").alias("c"), "whole")
    rows = grouped.join(sizes, F.col("conv").eqNullSafe(F.col("c"))).drop("c").withColumn("tables", F.col("members.table"))

    def work():
        def do(tables: pa.Array) -> list[pa.Array]:
            return [pa.array([[{"entry": e, "exit": x, "cost": c, "audit": a} for e, x, c, a in combined(_plain(t))] for t in tables.to_pylist()], _TABLE)]

        return do

    return with_columns_in_arrow(rows, ["tables"], {"table": TABLE}, work)


def _told(runs: DataFrame) -> DataFrame:
    """(conv, segment, entry, exit) of the members of runs that know their entry and exit."""

    def work():
        def do(tables: pa.Array, entry: pa.Array, exit_: pa.Array) -> list[pa.Array]:
            out = [[{"entry": e, "exit": x} for e, x in states_between(_plain(t), a, b)] for t, a, b in zip(tables.to_pylist(), entry.to_pylist(), exit_.to_pylist(), strict=True)]
            return [pa.array(out, _PAIRS)]

        return do

    df = with_columns_in_arrow(runs, ["tables", "entry", "exit"], {"pairs": PAIRS}, work)
    return df.select("conv", F.inline(F.arrays_zip(F.col("members.segment").alias("segment"), "pairs"))).select("conv", "segment", "pairs.entry", "pairs.exit")


def _best(table: Column) -> Column:
    """The best entry of the table of a whole conversation."""
    return F.array_min(F.transform(F.filter(table, lambda t: t["exit"].isin(*ENDS)), lambda t: F.struct(t["cost"].alias("cost"), t["audit"].alias("audit"), t["entry"].alias("entry"), t["exit"].alias("exit"))))


def chosen(segments: DataFrame) -> DataFrame:
    """The segments (stored) with entry and exit of the best edits, their cost and their audit."""
    alone = segments.where("whole").withColumn("best", _best(F.col("table"))).select("*", "best.entry", "best.exit").drop("best")
    nodes, rounds = segments.where("NOT whole").select("conv", "segment", "table"), []
    known = None
    if nodes.head(1):
        while True:
            rounds.append(stored(_runs(nodes)))
            more = rounds[-1].where("NOT whole")
            if not more.head(1):
                break
            nodes = more.select("conv", F.col("run").alias("segment"), "table")
        for runs in reversed(rounds):
            own = runs.where("whole").withColumn("best", _best(F.col("table"))).select("*", "best.entry", "best.exit").drop("best")
            if known is not None:
                below = known.select(F.col("conv").alias("c"), F.col("segment").alias("r"), "entry", "exit")
                own = own.unionByName(runs.where("NOT whole").join(below, F.col("conv").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r"))).drop("c", "r"))
            known = _told(own)
    if known is not None:
        below = known.select(F.col("conv").alias("c"), F.col("segment").alias("s"), "entry", "exit")
        alone = alone.unionByName(segments.where("NOT whole").join(below, F.col("conv").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s"))).drop("c", "s"))
    fits = F.filter("table", lambda t: (t["entry"] == F.col("entry")) & (t["exit"] == F.col("exit")))[0]
    return alone.withColumn("cost", fits["cost"]).withColumn("audit", fits["audit"])


LINES = T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("role", T.StringType()), T.StructField("was", T.StringType()), T.StructField("digest", T.BinaryType())]))
_LINES = pa.list_(pa.struct([("place", pa.int32()), ("role", pa.string()), ("was", pa.string()), ("digest", pa.binary())]))


def _lines(told: DataFrame) -> DataFrame:
    """(conv, segment, place, role, was, digest) of the rows that stay or are inserted: `was` and
    `digest` name the row that has the text, null for an inserted one."""

    def work():
        def do(rows: pa.Array, audits: pa.Array, entries: pa.Array) -> list[pa.Array]:
            out = []
            for rows_, audit, state in zip(rows.to_pylist(), audits.to_pylist(), entries.to_pylist(), strict=True):
                at, lines = 0, []
                for letter in audit:
                    row = rows_[at] if letter != "I" else None
                    at += letter != "I"
                    if letter == "D":
                        continue
                    initial = row["initial"] if letter == "K" else next(x for x in ROLES if (state, x) in MOVES)
                    state = MOVES[state, initial]
                    role = row["role"] if letter == "K" else ROLES[initial]
                    lines.append({"place": len(lines), "role": role, "was": row and row["role"], "digest": row and row["digest"]})
                out.append(lines)
            return [pa.array(out, _LINES)]

        return do

    return with_columns_in_arrow(told, ["rows", "audit", "entry"], {"lines": LINES}, work).select("conv", "segment", F.inline("lines"))


def _with_texts(lines: DataFrame, said: DataFrame) -> DataFrame:
    """The lines with their texts. At most one row of a conversation, role and text stays, so each text is
    looked up once."""
    texts = said.groupBy(F.col("conv").alias("c"), F.col("role").alias("w"), F.unhex(F.sha2("text", 256)).alias("d")).agg(F.first("text").alias("text"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("was") == F.col("w")) & (F.col("digest") == F.col("d"))
    found = lines.where("digest IS NOT NULL").join(texts, same).select("conv", "segment", "place", "role", "text")
    return found.unionByName(lines.where("digest IS NULL").select("conv", "segment", "place", "role", F.lit("").alias("text")))


def repaired(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations row by row: conv, segment, place (order within the segment), role, text.

    Null roles and texts are one space; null conversations are one conversation; null turns come
    first; rows of one turn follow each other by role and digest of the text. A conversation of which nothing
    is left has no row. Copies of a row are duplicates, so one of them stays at most.
    """
    said = _said(rows, conversation, turn, role, text)
    return _with_texts(_lines(chosen(stored(segmented(faulty(said))))), said)


def _hashes(lines: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of `role:text` joined by newlines. Lines come sorted by conversation and
    are hashed as they come: a digest is sequential, but no conversation is held whole."""
    key = lines.schema["conv"]
    schema = T.StructType([key, T.StructField("repaired_sha256", T.StringType())])

    def run(batches):
        open_, state = None, None
        for batch in batches:
            convs = batch.column(0)
            names, digests = [], []
            for conv, role, text in zip(convs.to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if state is None or conv != open_:
                    if state is not None:
                        names.append(open_)
                        digests.append(state.hexdigest())
                    open_, state = conv, sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, convs.type), pa.array(digests, pa.string())], names=["conv", "repaired_sha256"])
            last = convs.type
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([open_], last), pa.array([state.hexdigest()], pa.string())], names=["conv", "repaired_sha256"])

    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lines.repartition(n, "conv").sortWithinPartitions("conv", "segment", "place").mapInArrow(run, schema)


def _pieces(told: DataFrame) -> DataFrame:
    """(conv, cost, audit, illegal) of whole conversations. What each segment adds is one short row."""
    bad = F.when(F.size("initials") > 1, F.size(F.filter(F.transform(F.sequence(F.lit(1), F.size("initials") - 1), lambda i: F.concat(F.col("initials")[i - 1], F.col("initials")[i])), lambda p: ~p.isin("su", "ua", "au")))).otherwise(0)
    piece = F.struct("segment", "audit", F.col("initials")[0].alias("first"), F.element_at("initials", -1).alias("last"))
    rows = told.select("conv", "cost", bad.alias("bad"), piece.alias("piece"))
    whole = rows.groupBy("conv").agg(F.sum("cost").alias("cost"), F.sum("bad").alias("bad"), F.sort_array(F.collect_list("piece")).alias("pieces"))
    seams = F.when(F.size("pieces") > 1, F.size(F.filter(F.transform(F.sequence(F.lit(1), F.size("pieces") - 1), lambda i: F.concat(F.col("pieces")[i - 1]["last"], F.col("pieces")[i]["first"])), lambda p: ~p.isin("su", "ua", "au")))).otherwise(0)
    return whole.select("conv", "cost", F.array_join("pieces.audit", "").alias("audit"), (F.col("bad") + seams).cast("long").alias("illegal"))


def report(rows: DataFrame, everything: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation of `everything` (one column, repeats allowed): what is wrong with its `rows`, the
    cheapest edits, their cost and the digest of the repaired conversation.

    A conversation without rows has zeros, no audit and the digest of nothing; null is a conversation.
    Gaps are counted between the least and the greatest turn. The audit of a conversation is one
    value, so it is put together in one row; all else of a long one stays in segments.
    """
    said = _said(rows, conversation, turn, role, text)
    marked = stored(faulty(said))
    told = stored(chosen(stored(segmented(marked))))
    # Two steps, so that a conversation with very many rows is counted by turns first.
    by_turn = marked.groupBy("conv", "turn").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    counts = by_turn.groupBy("conv").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    out = everything.select(F.col(f"`{everything.columns[0]}`").alias("conv")).distinct()
    for part in (counts, _pieces(told), _hashes(_with_texts(_lines(told), said))):
        part = part.withColumnRenamed("conv", "c")
        out = out.join(part, F.col("conv").eqNullSafe(F.col("c")), "left").drop("c")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("conv").alias(conversation), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with known faults, dealt out by the crc32 of `conv_id:turn`, nulls as one space."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(name) % 20).alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def damage_report(conversations: DataFrame) -> DataFrame:
    """Damage all conversations, and report on every original one."""
    return report(damaged(conversations), conversations.select("conv_id"))


def _add(value: str, cost: str, letter: str) -> str:
    """In SQL, cost and audit are one text: nine digits and the letters. Null stays null."""
    return f"(lpad(CAST(CAST({value}[1:9] AS INT) + {cost} AS VARCHAR), 9, '0') || {value}[10:] || '{letter}')"


def _closed(s: list[str]) -> str:
    """The four states after any inserts."""
    user = f"least({s[USER]}, {', '.join(_add(s[q], str(INSERT), 'I') for q in (START, SYSTEM, ASSISTANT))})"
    return f"{s[START]} AS s0, {s[SYSTEM]} AS s1, {user} AS s2, least({s[ASSISTANT]}, {_add(user, str(INSERT), 'I')}) AS s3"


def sql() -> str:
    """The same in DuckDB: the best prefix for each row and state, row by row."""
    ways: list[list[str]] = [[] for _ in range(4)]
    for q in range(4):
        ways[q].append(_add(f"p.s{q}", str(DELETE), "D"))
        for x in ("s", "u", "a"):
            if (q, x) in MOVES:
                to = MOVES[q, x]
                ways[to].append(f"CASE WHEN k.kind <> {GONE} AND k.initial = '{x}' THEN {_add(f'p.s{q}', 'k.extra', 'K')} END")
                if x in ROLES:
                    ways[to].append(f"CASE WHEN k.kind <> {GONE} AND k.initial <> '{x}' THEN {_add(f'p.s{q}', f'k.extra + {REROLE}', 'R')} END")
    step = [f"least({', '.join(w)})" for w in ways]
    none = "CAST(NULL AS VARCHAR)"
    fate = crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    return rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {fate} % 20 AS fate FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
  CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM c JOIN (VALUES (1), (2)) v(copy) ON copy = 1 OR fate = 3 WHERE fate <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM d),
f AS (SELECT *, NOT regexp_matches(text, '[^{SPACE}]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
  NOT regexp_matches(text, '[.!?][{SPACE}]*\z') AS cut, lead(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS next FROM r),
k AS (SELECT *, role[1] AS initial, CASE WHEN blank OR again THEN {GONE} WHEN cut THEN {CUT} ELSE {FINE} END AS kind, CASE WHEN cut THEN {TRUNCATED} ELSE 0 END AS extra FROM f),
p AS (SELECT conv_id, 0 AS i, {_closed(["'000000000'", none, none, none])} FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, i, {_closed(["a", "b", "c", "e"])} FROM (SELECT p.conv_id, k.i, {step[0]} AS a, {step[1]} AS b, {step[2]} AS c, {step[3]} AS e
  FROM p JOIN k ON k.conv_id IS NOT DISTINCT FROM p.conv_id AND k.i = p.i + 1)),
best AS (SELECT conv_id, arg_max(least(s0, s3), i) AS best FROM p GROUP BY conv_id),
letters AS (SELECT conv_id, unnest(range(1, len(best) - 8)) AS j, best[j + 9] AS letter FROM best),
placed AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS e FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
lines AS (SELECT l.conv_id, l.j, l.letter, l.e, k.role, k.text, bool_or(l.e = 1 AND l.letter = 'K' AND k.initial = 's') OVER (PARTITION BY l.conv_id) AS system
  FROM placed l LEFT JOIN k ON l.letter <> 'I' AND k.conv_id IS NOT DISTINCT FROM l.conv_id AND k.i = l.i WHERE l.letter <> 'D'),
texts AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (e + CAST(system AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS x FROM lines GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
  count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated, count(*) FILTER (next IS NOT NULL AND (role[1] || next) NOT IN ('su', 'ua', 'au')) AS illegal FROM k GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(best[1:9] AS BIGINT) AS cost, best[10:] AS audit, sha256(coalesce(x, '')) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM b.conv_id
""".strip()
